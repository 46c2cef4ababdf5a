"""String clusters against all pairs."""

import random

import pyarrow as pa
import pytest

from tessera.operators import strings as S
from tessera.operators.registry import run


def brute(values, threshold):
    values = sorted(set(values))
    group = list(range(len(values)))
    sets = [S.grams(v) for v in values]
    for i in range(len(values)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) and group[i] != group[j]:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    parts = {}
    for v, g in zip(values, group, strict=True):
        parts.setdefault(g, set()).add(v)
    return {frozenset(p) for p in parts.values() if len(p) > 1}


def strings(seed):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        base = "".join(rng.choices("abcdefghij ", k=rng.randrange(12, 60)))
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(base))
            out.append(base[:at] + rng.choice("xyz") + base[at + rng.randrange(2) :])
    return [*out, "", "a", "ab", "ab", "abc", "é𝄞é𝄞é", None]


def found(df):
    parts = {}
    for r in df.collect():
        parts.setdefault(r.cluster, set()).add(r.value)
    return {frozenset(p) for p in parts.values()}


@pytest.mark.parametrize(("threshold", "tile"), [(0.8, 512), (0.8, 3), (0.9, 512)])
def test_clusters_of_all_pairs(spark, threshold, tile):
    values = strings(1)
    df = spark.createDataFrame([(v,) for v in values], "s string").repartition(4)
    made = S.string_clusters(df, "s", threshold, tile=tile)
    assert found(made) == brute([v for v in values if v is not None], threshold)
    assert sorted(r.cluster for r in made.select("cluster").distinct().collect()) == list(range(len(found(made))))


def test_one_bucket_with_many_strings(spark):
    values = [f"the very same beginning of all these strings {i:03d}" for i in range(300)]
    made = run("string-clusters", {"input data": spark.createDataFrame([(v,) for v in values + values[:9]], "s string")}, attributes=["s"])["output data"]
    rows = made.collect()
    assert {r.cluster for r in rows} == {0} and len(rows) == 300 and sum(r["count"] for r in rows) == 309


def test_analysis_has_outliers_and_clusters(spark):
    df = spark.createDataFrame([(float(i % 10), f"name {i % 3}") for i in range(100)] + [(1000.0 + i, None) for i in range(3)] + [(-500.0, "x")], "v double, s string")
    made = run("attribute-analysis", {"input data": df}, outliers=2)
    assert [(r.attribute, r.value) for r in made["outliers"].collect()] == [("v", -500.0), ("v", 1000.0)]
    assert run("attribute-analysis", {"input data": df}, cluster=True, similarity=0.5)["clusters"].keys() == {"s"}


@pytest.mark.parametrize("pairs", [0, 8])
def test_numbered_names_are_not_compared_all_with_all(spark, pairs):
    values = [f"Customer#{i:09d}" for i in range(0, 6000, 7)] + [f"item {i % 10} of {i}" for i in range(40)] + ["abcd", "abcde", "bcdef", "xx", "xxx"]
    report = {}
    made = S.string_clusters(spark.createDataFrame([(v,) for v in values], "s string").repartition(4), "s", tile=64, pairs=pairs, report=report)
    assert found(made) == brute(values, 0.8)
    assert report["rows"] == len(set(values)) and (pairs == 0 or report["sent"] < 20 * report["rows"])


def test_a_crowded_tile_is_not_compared_string_by_string(monkeypatch):
    """Links of a tile are those of all pairs, with no set of two strings compared on its own."""
    rng = random.Random(5)
    values = [f"https://m.{rng.choice(['thth', 'tion'])}.example.org/de/{rng.randrange(10**4)}{rng.choice(['/', '.html', '#top'])}" for _ in range(300)] + [chr(0x4E00 + i % 9) * 2 + "".join(chr(0x4E00 + k) for k in range(i, i + 9000)) for i in range(3)]
    values = sorted(set(values))
    want = brute(values, 0.8)
    monkeypatch.setattr(S, "_like", None)
    n = len(values)
    columns = {"depth": [1] * n, "sig": [7] * n, "i": [0] * n, "j": [0] * n, "chunk": [0] * n, "label": list(range(n)), "value": values}
    batch = pa.RecordBatch.from_pydict(columns)
    made = [(r["a"], r["b"]) for out in S._tiles(0.8)([batch.slice(0, 100), batch.slice(100)]) for r in out.to_pylist()]
    group = list(range(n))
    for a, b in made:
        low, high = sorted((group[a], group[b]))
        group = [low if g == high else g for g in group]
    parts = {}
    for v, g in zip(values, group, strict=True):
        parts.setdefault(g, set()).add(v)
    assert {frozenset(p) for p in parts.values() if len(p) > 1} == want
    assert len(made) < n
