"""Model search: nothing leaks, strategies keep the best."""

import random

import pytest
from pyspark.ml.classification import LogisticRegression

from tessera.plans.automl import drawn, search


def test_features_are_fitted_in_each_part(spark):
    """A name that no two rows share says nothing about others, though its place among all names would give the label away."""
    rng = random.Random(1)
    rows = [(f"{'ny'[i % 2]}{rng.random():.9f}", float(rng.random()), i % 2) for i in range(240)]
    df = spark.createDataFrame(rows, "name string, x double, y int")
    found = search(df, [{"name": "name", "type": "categorical"}, {"name": "x"}], {"name": "y", "type": "categorical"}, [("lr", LogisticRegression(), {"regParam": [0.0]})], "accuracy", split=3)
    assert found[0]["metric"] < 0.65


def table(spark, n=900):
    rng = random.Random(2)
    rows = [(x := rng.gauss(0, 1), z := rng.gauss(0, 1), int(x + 0.5 * z + rng.gauss(0, 0.3) > 0)) for _ in range(n)]
    return spark.createDataFrame(rows, "x double, z double, y int")


def test_random_search_and_halving(spark):
    df = table(spark)
    features, label = [{"name": "x"}, {"name": "z"}], {"name": "y", "type": "categorical"}
    space = {"regParam": ("log_uniform", 1e-4, 50.0), "maxIter": ("int", 1, 20)}
    drawn_ones = search(df, features, label, [("lr", LogisticRegression(), space)], "accuracy", strategy="random", max_models=4, seed=3)
    assert len(drawn_ones) == 4 and sum(r["model"] is not None for r in drawn_ones) == 1
    assert [r["metric"] for r in drawn_ones] == sorted((r["metric"] for r in drawn_ones), reverse=True)
    grid = [("lr", LogisticRegression(), {"regParam": [0.001, 5.0, 50.0, 500.0]})]
    halved = search(df, features, label, grid, "accuracy", strategy="halving", least_rows=100, keep=2)
    assert halved[0]["rows"] == 900 and halved[0]["model"] is not None and halved[0]["params"]["regParam"] in (0.001, 5.0)
    assert sorted(r["rows"] for r in halved) == [100, 100, 200, 900]
    with pytest.raises(ValueError, match="strategy"):
        search(df, features, label, grid, "accuracy", strategy="luck")


def test_draws(spark):
    space = {"a": ("uniform", 1, 2), "b": ("log_uniform", 1e-3, 1e3), "c": ("int", 1, 5), "d": ["p", "q"]}
    made = drawn(space, 200, 1)
    assert made == drawn(space, 200, 1) != drawn(space, 200, 2)
    assert all(1 <= m["a"] <= 2 and 1e-3 <= m["b"] <= 1e3 and m["c"] in range(1, 6) and m["d"] in "pq" for m in made)
    assert 60 < sum(m["b"] < 1 for m in made) < 140
