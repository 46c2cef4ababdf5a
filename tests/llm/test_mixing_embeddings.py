import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import embeddings, mixing


def test_targets_stop_and_reshare():
    got = mixing.targets({"b": 100, "a": 10, None: 1000, "c": 50})
    # weights a 3, b 1, c 2, null 3; 1740 words; a stops at 20, c at 100, b at 200, null takes the rest
    assert got == {"a": 20, "c": 100, "b": 200, None: 1420}
    assert mixing.targets({"x": 0}) == {"x": 0.0} and mixing.targets({}) == {}


def test_flight_keeps_both_totals():
    rng = random.Random(0)
    for n in (0, 1, 2, 3, 50, 999):
        size = [rng.choice([0, 1, 5, rng.randrange(5000)]) for _ in range(n)]
        pi = [rng.random() for _ in range(n)]
        before = sum(pi), sum(p * s for p, s in zip(pi, size, strict=True))
        mixing.flight(pi, size, rng)
        assert sum(0 < p < 1 for p in pi) <= 2
        assert sum(pi) == pytest.approx(before[0], abs=1e-5) and sum(p * s for p, s in zip(pi, size, strict=True)) == pytest.approx(before[1], abs=0.05)


def test_flight_is_unbiased():
    rng, seen, n = random.Random(1), [0] * 8, 4000
    for _ in range(n):
        pi = [0.3] * 8
        mixing.flight(pi, [1, 2, 3, 5, 8, 13, 21, 34], rng)
        seen = [a + b for a, b in zip(seen, pi, strict=True)]
    assert all(abs(x / n - 0.3) < 0.04 for x in seen)


def mix_rows():
    rng = random.Random(2)
    rows = [(i, "w " * rng.choice([1, 3, 40, 400]), rng.choice(["s0", "s0", "s0", "s1", "é", None]), "x") for i in range(900)]
    return rows + [(2000, None, "s1", None), (2001, "", "empty", None), (None, "a b", "s0", None), (5, rows[5][1], rows[5][2], None), (5, rows[5][1], rows[5][2], None)]


@pytest.mark.parametrize("chunk", [4096, 16])
def test_mix_report(spark, chunk):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string").repartition(5)
    got = mixing.mix_report(docs, chunk=chunk).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len((t or "").split())) for i, t, _, _ in rows)
    total = defaultdict(int)
    for _, t, s, _ in rows:
        total[s] += len((t or "").split())
    want = mixing.targets(dict(total))
    taken, wanted = defaultdict(int), {}
    for r in got:
        key = r.source_size
        taken[key] += r.taken
        wanted[key] = r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert sorted(wanted.values()) == pytest.approx(sorted(want.values()))
    for k, t in wanted.items():
        assert abs(taken[k] - t) <= 400
    again = mixing.mix_report(docs.repartition(2), chunk=chunk).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mix = mixing.mixed(docs, chunk=chunk)
    assert mix.columns == docs.columns
    out = mix.collect()
    assert sum(len((r.text or "").split()) for r in out) == sum(taken.values())
    assert mixing.mix_report(docs.filter("false")).count() == 0 and mixing.mixed(docs.filter("false")).count() == 0


def test_quantised_bound_holds():
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 64)) * 10.0 ** rng.integers(-30, 30, (200, 1))
    q, s, e = embeddings.quantise(v)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    true = unit @ unit.T
    near = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s
    assert (np.abs(true - near) <= e[:, None] + e + e[:, None] * e + 1e-9).all()
    assert e.max() < 0.05


@pytest.mark.parametrize("block", [2048, 16])
def test_vectors_match_brute_force(spark, block):
    rng = np.random.default_rng(3)
    rows = []
    centres = rng.normal(size=(6, 16))
    for i in range(150):
        v = centres[i % 6] + rng.normal(size=16) * 0.22
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    rows += [(200 + i, rows[0][1], rows[0][2]) for i in range(20)] + [(300, [2 * x for x in rows[1][1]], rows[1][2]), (301, rows[1][1], None), (302, None, 1), (303, [0.0] * 16, 1), (304, [1.0, None] + [0.0] * 14, 1), (305, [float("nan")] * 16, 1), (306, [float("inf")] * 16, 1), (307, [], 1), (308, [1.0, 2.0], 1), (309, [-0.0] * 16, 1), (None, rows[2][1], rows[2][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, 0.93, block).collect()}
    assert len(got) == len(rows)
    good = lambda v, label: label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ids = [i for i, _, _ in rows]
    nb = {i: set() for i in ids}
    for i, v, l in rows:
        for j, w, m in rows:
            if i != j and l == m and good(v, l) and good(w, m) and len(v) == len(w):
                x, y = np.array(v), np.array(w)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93:
                    nb[i].add(j)
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for j in nb[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min((x for x in seen if x is not None), default=None)
        assert got[i] == (len(nb[i]), least, i == least), i
    assert embeddings.near_vectors(df.filter("false")).count() == 0
