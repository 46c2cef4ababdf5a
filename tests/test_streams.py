"""Streams with late and repeated rows against the same rows as a table."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.streaming import streams as S

SCHEMA = "id long, user long, ts timestamp, step string"
STEPS = ["view", "click", "buy"]
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(seed, n=400):
    rng = random.Random(seed)
    return [(i, rng.randrange(25), START + timedelta(seconds=30 * i + rng.randrange(30)), rng.choice([*STEPS, "error"])) for i in range(n)]


@pytest.fixture()
def replayed(spark, tmp_path):
    """The rows in files of about 40: some come two files late, some twice; a last row far ahead lets all windows close."""
    rng, rows = random.Random(7), events(1)
    files = [[] for _ in range(len(rows) // 40 + 3)]
    for r in rows:
        files[r[0] // 40 + (rng.randrange(3) if rng.random() < 0.2 else 0)].append(r)
        if rng.random() < 0.2:
            files[r[0] // 40 + rng.randrange(2)].append(r)
    files.append([(10_000, 999, START + timedelta(days=2), "error")])
    files.append([(10_001, 999, START + timedelta(days=4), "error")])
    for i, f in enumerate(files):
        spark.createDataFrame(f, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "made" / f"{i:03d}"))
    (tmp_path / "in").mkdir()
    import os
    import shutil

    for i in range(len(files)):
        (part,) = (tmp_path / "made" / f"{i:03d}").glob("*.parquet")
        shutil.copy(part, tmp_path / "in" / f"{i:03d}.parquet")
        os.utime(tmp_path / "in" / f"{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = S.read_stream(spark, "parquet", str(tmp_path / "in"), SCHEMA, maxFilesPerTrigger="1")
    return stream, spark.createDataFrame(rows, SCHEMA), tmp_path


def gathered(df, path):
    out = []
    S.drain(df, lambda rows, n: out.extend(tuple(r) for r in rows.collect()), str(path))
    return out


def test_windows_of_distinct_events(replayed):
    stream, batch, path = replayed
    distinct = S.distinct_events(stream, ["id"], "ts", "2 hours")
    counts = distinct.groupBy(F.window("ts", "10 minutes", "5 minutes").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    got = [r for r in gathered(counts, path / "windows") if r[0].year == 2024 and r[0].day == 1 or r[1].day == 1]
    want = [tuple(r) for r in S.windowed_counts(S.distinct_events(batch, ["id"], "ts"), "ts", 600, slide=300).collect()]
    assert sorted(got) == sorted(want)


def test_sessions_with_late_rows(replayed):
    stream, batch, path = replayed
    rows = S.sessions(S.distinct_events(stream, ["id"], "ts", "2 hours"), "ts", "4 minutes", ["user"], late=None)
    got = [r for r in gathered(rows, path / "sessions") if r[2] != 999]
    want = [tuple(r) for r in S.sessions(batch, "ts", "4 minutes", ["user"]).collect()]
    assert sorted(got) == sorted(want)


def test_paths_with_late_and_repeated_rows(replayed):
    stream, batch, path = replayed
    last = {}
    for user, reached, since in gathered(S.paths(stream, "user", "ts", "step", STEPS, "2 hours"), path / "paths"):
        last[user] = max(last.get(user, (0, None)), (reached, since))
    want = {r.user: (r.reached, r.since) for r in S.paths(batch, "user", "ts", "step", STEPS).collect()}
    assert last == want and 3 in {v[0] for v in want.values()}


def test_whole_results_as_a_table(replayed):
    stream, batch, path = replayed
    counts = S.to_table(stream.groupBy("step").count(), str(path / "out"), str(path / "cp"))
    assert {r.step for r in counts.collect()} == {*STEPS, "error"}
