"""Vector codes against plain loops over integers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import codes

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    kept = [(i, [max(min(math.floor(1024 * x), codes.LIMIT), -codes.LIMIT) for x in v], k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    width += -width % 4 or (0 if width else 4)
    kept = sorted(((i, v + [0] * (width - len(v)), k) for i, v, k in kept), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = width // 4
    part = lambda v, p: v[p * d : p * d + d]
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[nearest(part(v, p), books[p])[1]].append(part(v, p))
            for k, m in members.items():
                books[p][k] = [sum(c) // len(m) for c in zip(*m, strict=True)]
    out, totals = [], defaultdict(int)
    for i, v, k in kept:
        told = [nearest(part(v, p), books[p]) for p in range(4)]
        out.append((i, "".join(f"{c:02x}" for _, c in told), sum(e for e, _ in told), k))
        totals[k] += out[-1][2]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, totals[k], sha) for i, c, e, k in out), key=repr)


def got(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return sorted((tuple(r) for r in codes.compress(df, **how).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=repr)


def vectors(rng, n, dim):
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(9)]
    return [(i, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)], None if i % 11 == 0 else 7 if i % 3 else i % 40) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("hot", [256, 4, 100_000])
def test_against_loops(spark, hot):
    rng = random.Random(hot)
    rows = vectors(rng, 420, 8)
    rows += rows[:9] + [(rows[20][0], rows[30][1], 1), (None, rows[4][1], 2), (-1, None, 1), (-2, [1.0, None] * 4, 1), (-3, [float("nan")] * 8, 1), (-4, [float("inf")] * 8, 1)]
    assert got(spark, rows, hot=hot) == brute(rows)


def test_odd_lengths_few_rows_and_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1e30, 1e9, 0.25, 3.5, -0.001, 16384.0]) for _ in range(rng.randrange(0, 8))], i % 2) for i in range(30)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, [(1, [], 1), (2, [], None)]) == brute([(1, [], 1), (2, [], None)])
    assert got(spark, [(1, None, 1)]) == []


def test_pruning_is_exact():
    rng = np.random.default_rng(1)
    entries = rng.integers(-40, 40, (256, 3))
    entries[100:120] = entries[:20]  # ties
    x = np.concatenate([rng.integers(-50, 50, (3000, 3)), entries, np.zeros((2, 3), np.int64), rng.integers(-(1 << 24), 1 << 24, (50, 3))])
    code, error = codes.Codebook(entries).nearest(x)
    d = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()


def test_clashing_columns(spark):
    rows = vectors(random.Random(4), 60, 4)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.withColumns({c: F.lit("?") for c in "parts code error label_error _label _n part entry place total n".split()})
    assert sorted(codes.compress(more).collect()) == sorted(codes.compress(df).collect())
