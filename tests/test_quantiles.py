"""Exact quantiles against Spark's own, with every group over the limit of what it may see."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators.quantiles import percentiles
from tessera.operators.registry import run

QS = [0.0, 0.25, 0.5, 0.99]


def table(spark, seed):
    rng = random.Random(seed)
    rows = [("hot", rng.choice([5.0, 5.0, rng.gauss(0, 100)])) for _ in range(3000)]  # one value has two thirds of the hot group
    rows += [(rng.choice(["a", "b", None]), rng.choice([rng.random(), None, -1.5])) for _ in range(800)]
    rows += [("one", 3.25), ("two", 1.0), ("two", 4.0), ("none", None), ("wide", float("inf")), ("wide", 0.0)]
    return spark.createDataFrame(rows, "g string, v double").repartition(5)


@pytest.mark.parametrize(("walked", "accuracy"), [(200_000, 10_000), (4, 8)])
def test_equal_to_percentile(spark, walked, accuracy):
    df = table(spark, walked)
    got = {r.g: r.q for r in percentiles(df, ["g"], F.col("v"), QS, few=1, walked=walked, accuracy=accuracy).collect()}
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, QS))).alias("q")).collect()}
    assert got == want
    whole = percentiles(df, [], F.col("v"), QS, few=1, walked=walked, accuracy=accuracy).first()[0]
    assert whole == df.agg(F.percentile("v", F.array(*map(F.lit, QS)))).first()[0]


def test_operators_use_them(spark, monkeypatch):
    from tessera.operators import quantiles

    df = table(spark, 3).filter("v < 1e300")
    plain = run("box-plot", {"input data": df}, attributes=["v"], group=["g"])["output data"].collect(), run("quantile-table", {"input data": df}, attributes=["v"])["output data"].collect(), run("clean-missing", {"input data": table(spark, 3)}, attributes=["v"], cleaning_mode="MEDIAN")["output data"].agg(F.sum(F.when(F.col("g").isNull(), F.col("v")))).first()[0]
    monkeypatch.setattr(quantiles, "FEW", 10)
    again = run("box-plot", {"input data": df}, attributes=["v"], group=["g"])["output data"].collect(), run("quantile-table", {"input data": df}, attributes=["v"])["output data"].collect(), run("clean-missing", {"input data": table(spark, 3)}, attributes=["v"], cleaning_mode="MEDIAN")["output data"].agg(F.sum(F.when(F.col("g").isNull(), F.col("v")))).first()[0]
    rounded = lambda rows: sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    assert rounded(plain[0]) == rounded(again[0]) and rounded(plain[1]) == rounded(again[1]) and plain[2] == pytest.approx(again[2])


def test_box_plot_sends_fences_to_the_rows(spark):
    rows = spark.createDataFrame([("ab"[i % 10 == 0], float(i)) for i in range(500)], "g string, v double")
    made = run("box-plot", {"input data": rows}, attributes=["v"], group=["g"])["output data"]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert sorted(tuple(r[c] for c in ("g", "q1", "median", "q3", "outliers")) for r in made.collect()) == [("a", 125.25, 250.0, 374.75, 0), ("b", 122.5, 245.0, 367.5, 0)]
