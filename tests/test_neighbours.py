"""Neighbours, spanning trees and linkage clusters against plain NumPy over all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import neighbours as N
from tessera.operators.registry import run

IN, OUT = "input data", "output data"


def cloud(seed, n=300, dim=3, copies=20):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 8, (6, dim))
    x = centres[rng.integers(0, 6, n)] + rng.normal(0, 1, (n, dim))
    x[n - copies :] = x[0]  # one place with many rows
    x[5:9] = np.round(x[5:9])
    return x


def frame(spark, x, parts=6):
    rows = [(int(i), *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"f{j} double" for j in range(x.shape[1]))).repartition(parts)


def brute(x, q=None, k=5, metric="euclidean"):
    d = N.pairwise(x if q is None else q, x, metric)
    if q is None:
        np.fill_diagonal(d, np.inf)
    return {i: [(int(j), round(float(row[j]), 9)) for j in np.lexsort((np.arange(len(x)), row))[:k]] for i, row in enumerate(d)}


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.k, r.dist, r.other)):
        out.setdefault(r.k, []).append((r.other, round(r.dist, 9)))
    return out


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbours_of_all_rows(spark, metric):
    x = cloud(1)
    report = {}
    got = told(N.nearest(frame(spark, x), ["f0", "f1", "f2"], 5, "id", metric=metric, report=report))
    assert got == brute(x, metric=metric)
    assert report["sent"] < 8 * report["rows"]  # of 16 cells


def test_tiles_and_other_queries(spark, monkeypatch):
    monkeypatch.setattr(N, "TILE", 7)
    x, q = cloud(2, 200), cloud(3, 90)
    got = told(N.nearest(frame(spark, x), ["f0", "f1", "f2"], 4, "id", queries=frame(spark, q)))
    assert got == brute(x, q, 4)


def test_few_rows_and_rows_without_coordinates(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, None), (4, float("nan"))], "id long, f0 double")
    assert told(N.nearest(df, ["f0"], 5, "id")) == {1: [(2, 1.0)], 2: [(1, 1.0)]}
    assert N.nearest(df.limit(0), ["f0"], 5, "id").collect() == []


def kruskal(x):
    d = N.pairwise(x, x)
    pairs = sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i))
    parent, edges = list(range(len(x))), []

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for w, i, j in pairs:
        if (a := root(i)) != (b := root(j)):
            parent[a] = b
            edges.append(w)
    return edges


def single_linkage(x, clusters):
    """Groups by merging the two nearest ones until so many are left."""
    groups = [{i} for i in range(len(x))]
    d = N.pairwise(x, x)
    while len(groups) > clusters:
        w, i, j = min((d[np.ix_(list(a), list(b))].min(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] |= groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("k", [1, 8])
def test_spanning_tree(spark, k):
    x = cloud(4, 160, copies=0)
    points, _ = N.classes_of(N.points_of(frame(spark, x), ["f0", "f1", "f2"], "id"), 1)
    edges = N.spanning_tree(points, k=k).collect()
    found = {(min(e.a, e.b), max(e.a, e.b)): e.dist for e in edges}
    assert len(found) == 159
    assert np.allclose(sorted(found.values()), kruskal(x))


def parts(df, column):
    out = {}
    for r in df.collect():
        out.setdefault(r[column], set()).add(r.id)
    return {frozenset(g) for g in out.values()}


def test_single_linkage_clusters(spark):
    x = cloud(5, 70, 2, copies=6)
    df = frame(spark, x)
    for clusters in (1, 4, 9):
        made = run("agglomerative-clustering", {IN: df}, attributes=["f0", "f1"], number_of_clusters=clusters, linkage="single", alias="cluster", key="id")
        assert parts(made[OUT], "cluster") == single_linkage(x, clusters)


def linkage(x, clusters, how):
    """Plain agglomeration by definition of each linkage."""
    groups = [[i] for i in range(len(x))]
    d = N.pairwise(x, x)

    def far(a, b):
        if how == "ward":
            return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(axis=0) - x[b].mean(axis=0)) ** 2).sum()
        part = d[np.ix_(a, b)]
        return part.max() if how == "complete" else part.mean()

    while len(groups) > clusters:
        _, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("how", ["ward", "complete", "average"])
def test_other_linkages(spark, how):
    x = cloud(6, 60, 2, copies=5)
    made = run("agglomerative-clustering", {IN: frame(spark, x)}, attributes=["f0", "f1"], number_of_clusters=5, linkage=how, key="id")
    assert parts(made[OUT], "prediction") == linkage(x, 5, how)


def test_many_rows_meet_as_small_clusters(spark):
    x = cloud(7, 900, 2)
    made = run("agglomerative-clustering", {IN: frame(spark, x)}, attributes=["f0", "f1"], number_of_clusters=4, micro_clusters=60, key="id")[OUT]
    found = [x[list(g)] for g in parts(made, "prediction")]
    cost = sum(((g - g.mean(axis=0)) ** 2).sum() for g in found)
    best = sum(((x[list(g)] - x[list(g)].mean(axis=0)) ** 2).sum() for g in linkage(x[::4], 4, "ward")) * 4
    assert len(found) == 4 and cost < 1.3 * best


def test_outlier_factors(spark):
    x = cloud(8, 150, 2, copies=1)
    k = 4
    near = brute(x, k=k)
    kd = {i: n[-1][1] for i, n in near.items()}
    density = {i: 1 / max(np.mean([max(d, kd[j]) for j, d in n]), 1e-12) for i, n in near.items()}
    want = {i: np.mean([density[j] for j, _ in n]) / density[i] for i, n in near.items()}
    got = {r.id: r.lof for r in run("local-outlier-factor", {IN: frame(spark, x)}, features=["f0", "f1"], n_neighbors=k, key="id")[OUT].collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in want)


def test_nearest_labels_of_rows_not_trained_on(spark):
    x, q = cloud(9, 200, 2), cloud(9, 200, 2)[:50] + 0.3
    labels = np.digitize(x[:, 0], [-5, 0, 5])
    train = frame(spark, x).join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "id long, y int"), "id")
    model = run("knn-classifier", {IN: train}, features=["f0", "f1"], label="y", n_neighbors=5, key="id")["model"]
    got = {r.id: r.prediction for r in model.transform(frame(spark, q)).collect()}
    for i, near in brute(x, q, 5).items():
        votes = [int(labels[j]) for j, _ in near]
        assert got[i] == min(sorted(set(votes)), key=lambda v: (-votes.count(v), v))
    own = run("knn-classifier", {IN: train, "test input data": frame(spark, q)}, features=["f0", "f1"], label="y", n_neighbors=5, key="id")
    assert {r.id: r.prediction for r in own[OUT].collect()} == got


def test_clashing_names(spark):
    df = frame(spark, cloud(10, 40, 2)).withColumns({c: F.lit("?") for c in ("k", "x", "cell", "other", "dist", "group", "near")})
    out = run("local-outlier-factor", {IN: df}, features=["f0", "f1"], n_neighbors=3, key="id")[OUT]
    assert out.columns == [*df.columns, "lof"] and out.count() == 40


def test_tables_of_a_spanning_tree_do_not_pass_through_the_driver(spark, monkeypatch):
    from tessera.operators import neighbours

    plans, kept = [], neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().sparkPlan().toString())) or kept(df, name))
    points = kept(spark.range(40).selectExpr("id", "array(cast(id * id as double)) AS x"), "line")
    edges = neighbours.spanning_tree(points, k=2)
    groups = neighbours.cut_tree(points, edges, threshold=30.0)
    assert groups.filter("group = 0").count() == 16
    assert not [n for n, p in plans if n in ("known", "reach", "unsure", "pointers", "labels") and "Broadcast" in p]
