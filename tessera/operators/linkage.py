"""Agglomerative clustering: single linkage from a spanning tree, the others from places or small clusters of them."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.durable import free_name, numbered, stored
from tessera.operators.neighbours import cut_tree, pairwise, points_of, spanning_tree
from tessera.operators.registry import IN, OUT, ParameterError, names, need, operator

#: Places, or small clusters of them, that are merged on the driver, at most.
MICRO = 1024
_AFFINITY = {"euclidean": "euclidean", "l2": "euclidean", "l1": "manhattan", "manhattan": "manhattan", "cosine": "cosine"}


def merged(x: np.ndarray, weight: np.ndarray, how: str, metric: str, clusters: int, threshold: float | None) -> np.ndarray:
    """Group of each weighted place after merging the two nearest groups again and again."""
    n, group, size = len(x), np.arange(len(x)), weight.astype(np.float64)
    if how == "ward":
        d = pairwise(x, x) ** 2 * (size[:, None] * size / (size[:, None] + size))
    elif metric == "cosine":
        d = pairwise(x, x) ** 2 / 2  # of vectors of length one
    else:
        d = pairwise(x, x, metric)
    np.fill_diagonal(d, np.inf)
    centre = x.copy()
    for left in range(n, 1, -1):
        i, j = divmod(int(d.argmin()), n)
        i, j = min(i, j), max(i, j)
        near = math.sqrt(2 * d[i, j]) if how == "ward" else d[i, j]
        if (threshold is not None and near >= threshold) or (threshold is None and left <= clusters):
            break
        total = size[i] + size[j]
        if how == "ward":
            centre[i] = (size[i] * centre[i] + size[j] * centre[j]) / total
            row = pairwise(centre[i][None], centre)[0] ** 2 * (total * size / (total + size))
        else:
            row = np.maximum(d[i], d[j]) if how == "complete" else (size[i] * d[i] + size[j] * d[j]) / total
        row[~np.isfinite(d[i])] = np.inf
        row[[i, j]] = np.inf
        d[i], d[:, i], d[j], d[:, j] = row, row, np.inf, np.inf
        size[i] = total
        group[group == j] = i
    return group


def _small_clusters(places: DataFrame, micro: int) -> DataFrame:
    """(x, m): the small cluster of each place (x, n); a place is its own where there are few."""
    if places.count() <= micro:
        return numbered(places, "m", [F.asc("x")]).select("x", "m")
    made = places.select("x", "n", array_to_vector("x").alias("v"))
    model = KMeans(k=micro, seed=1, maxIter=10, featuresCol="v", predictionCol="m", weightCol="n").fit(made)
    return model.transform(made).select("x", F.col("m").cast("long").alias("m"))


@operator("agglomerative-clustering")
def agglomerative(inputs, attributes=None, features=None, number_of_clusters=2, linkage="ward", affinity="euclidean", distance_threshold=None, alias=None, prediction="prediction", key=None, micro_clusters=MICRO, **_):
    """Clusters by merging the two nearest groups until ``number_of_clusters`` are left, or until none are nearer than
    ``distance_threshold``. They are numbered from 0 in the order of their smallest rows.

    Single linkage is exact: a minimum spanning tree of all places without its longest edges. Ward, complete and average linkage
    are exact up to ``micro_clusters`` distinct places; beyond, k-means first makes so many small clusters, which are merged
    by their centres and sizes. ``key`` (unique) makes numbers reproducible; without it rows are numbered as they are read.
    Rows with a null or a feature that is not finite get null."""
    df, found = inputs[IN], names(need(attributes or features, "attributes"))
    how, metric, k = linkage or "ward", _AFFINITY.get(affinity or "euclidean"), int(number_of_clusters or 2)
    if how not in ("ward", "complete", "average", "single"):
        raise ParameterError(f"unknown linkage: {how}")
    if metric is None:
        raise ParameterError(f"unknown affinity: {affinity}")
    if how == "ward" and metric != "euclidean":
        raise ParameterError("ward linkage needs euclidean affinity")
    if k <= 0:
        raise ParameterError("number_of_clusters must be greater than 0")
    threshold = None if distance_threshold in (None, "") else float(distance_threshold)
    (row,) = free_name(df, "_row")
    rows = df.withColumn(row, F.col(key).cast("long")) if key else numbered(df, row)
    points = stored(points_of(rows, found, row, metric == "cosine"), "points")
    places = points.groupBy("x").agg(F.min("k").alias("id"), F.count(F.lit(1)).alias("n"))
    places = stored(places, "places")
    if how == "single":
        limit = math.sqrt(2 * threshold) if threshold is not None and metric == "cosine" else threshold
        at = places.select("id", "x")
        groups = cut_tree(at, spanning_tree(at, "euclidean" if metric == "cosine" else metric), k, limit)
        group_of = at.join(groups.hint("merge"), "id").select("x", F.col("group").alias("g"))
    else:
        small = stored(_small_clusters(places, int(micro_clusters)), "small")
        width = places.select(F.max(F.size("x"))).first()[0] or 0
        mean = [F.sum(F.col("x")[i] * F.col("n")) / F.sum("n") for i in range(width)]
        j = places.join(small.hint("merge"), "x")
        told = sorted(j.groupBy("m").agg(F.array(*mean).alias("c"), F.sum("n").alias("n")).collect(), key=lambda r: r.m)  # at most ``micro_clusters`` rows
        if told:
            group = merged(np.array([r.c for r in told], np.float64), np.array([r.n for r in told]), how, metric, k, threshold)
            known = df.sparkSession.createDataFrame([(r.m, int(g)) for r, g in zip(told, group, strict=True)], "m long, g long")
        else:
            known = small.select("m", F.col("m").alias("g"))
        group_of = small.join(F.broadcast(known), "m").select("x", "g")
    labelled = points.join(group_of.hint("merge"), "x").select(F.col("k").alias("_k"), "g")
    labelled = stored(labelled, "grouped")
    order = labelled.groupBy("g").agg(F.min("_k").alias("first"))
    name = alias or prediction
    numbers = numbered(order, "_n", [F.asc("first")]).select(F.col("g"), F.col("_n").cast("int").alias("_n"))
    labelled = labelled.join(numbers.hint("merge"), "g").select("_k", F.col("_n").alias("_label"))
    columns = [rows[c] for c in df.columns if c != name]
    return {OUT: rows.join(labelled.hint("merge"), rows[row] == labelled["_k"], "left").select(*columns, F.col("_label").alias(name))}
