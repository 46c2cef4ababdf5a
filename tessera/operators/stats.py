"""Statistics: distributions, survival, fairness, outliers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.durable import free_name, numbered, running, stored
from tessera.operators.neighbours import nearest
from tessera.operators.registry import IN, OUT, names, need, operator


def _share(df, a):
    """Each value's share of the column's sum; the sum is one aggregated row, joined back."""
    (name,) = free_name(df, "_total")
    total = df.agg(F.sum(a).alias(name))
    return df.crossJoin(F.broadcast(total)), F.col(a) / F.col(name), name


@operator("pdf")
def pdf(inputs, attributes=None, alias="pdf", **_):
    df, share, total = _share(inputs[IN], names(need(attributes, "attributes"))[0])
    return {OUT: df.withColumn(alias, share).drop(total)}


@operator("cdf")
def cdf(inputs, attributes=None, alias="cdf", order_by=None, **_):
    a = names(need(attributes, "attributes"))[0]
    df, share, total = _share(inputs[IN], a)
    return {OUT: running(df, {alias: share}, [F.asc(c) for c in names(order_by) or [a]]).drop(total)}


@operator("ccdf")
def ccdf(inputs, attributes=None, alias="ccdf", order_by=None, **_):
    a = names(need(attributes, "attributes"))[0]
    df, share, total = _share(inputs[IN], a)
    return {OUT: running(df, {alias: share}, [F.desc(c) for c in names(order_by) or [a]]).drop(total)}


@operator("kaplan-meier-survival")
def kaplan_meier(inputs, duration_attribute=None, event_observed_attribute=None, pivot_attribute=None, **_):
    """Survival estimate per distinct time and group, from counts per time: the rows left after aggregation are distinct times."""
    by = names(pivot_attribute)
    t, e = need(duration_attribute, "duration_attribute"), need(event_observed_attribute, "event_observed_attribute")
    counts = inputs[IN].groupBy(*by, F.col(t).alias("time")).agg(F.sum(F.col(e).cast("long")).alias("events"), F.count("*").alias("leaving"))
    log = F.when(F.col("events") < F.col("at_risk"), F.log(1 - F.col("events") / F.col("at_risk"))).otherwise(F.lit(float("-inf")))
    if not by:
        rows = running(counts, {"at_risk": F.col("leaving")}, [F.desc("time")])
        return {OUT: running(rows, {"_sum": log}, [F.asc("time")]).withColumn("survival", F.exp("_sum")).drop("_sum")}
    w = Window.partitionBy(*by)
    at_risk = F.sum("leaving").over(w.orderBy(F.desc("time")).rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("at_risk", at_risk)
    return {OUT: rows.withColumn("survival", F.exp(F.sum(log).over(w.orderBy("time").rowsBetween(Window.unboundedPreceding, 0))))}


@operator("fairness-evaluator")
def fairness(inputs, attributes=None, label=None, score=None, baseline=None, tau=0.8, **_):
    """Confusion counts and rates per group of a sensitive attribute, each rate's ratio to the baseline group's, and whether it is
    within tau and 1 / tau."""
    a = names(need(attributes, "attributes"))[0]
    y, s = F.col(label).cast("double") > 0.5, F.col(score).cast("double") > 0.5
    n = lambda c: F.sum(c.cast("long"))
    g = inputs[IN].groupBy(F.col(a).cast("string").alias("group")).agg(F.count("*").alias("group_size"), n(s & y).alias("tp"), n(s & ~y).alias("fp"), n(~s & y).alias("fn"), n(~s & ~y).alias("tn"))
    total = F.broadcast(g.agg(F.sum(F.col("tp") + F.col("fp")).alias("_pp")))
    rate = lambda a, b: F.when(b != 0, a / b)
    c = F.col
    g = g.crossJoin(total).select("*", rate(c("tp") + c("fp"), c("group_size")).alias("pred_pos_ratio_g"), rate(c("tp") + c("fp"), c("_pp")).alias("pred_pos_ratio_k"), rate(c("fp"), c("fp") + c("tn")).alias("fpr"), rate(c("fp"), c("fp") + c("tp")).alias("fdr"), rate(c("fn"), c("fn") + c("tp")).alias("fnr"), rate(c("fn"), c("fn") + c("tn")).alias("for")).drop("_pp")
    rates = ["pred_pos_ratio_g", "pred_pos_ratio_k", "fpr", "fdr", "fnr", "for"]
    base = F.broadcast(g.filter(F.col("group") == str(baseline)).select(*(F.col(f"`{r}`").alias(f"_{r}") for r in rates)))
    j = g.crossJoin(base)
    j = j.withColumns({f"{r}_disparity": rate(F.col(f"`{r}`"), F.col(f"_{r}")) for r in rates})
    return {OUT: j.withColumns({f"{r}_fair": F.col(f"{r}_disparity").between(float(tau), 1 / float(tau)) for r in rates}).drop(*(f"_{r}" for r in rates))}


@operator("outlier-detection", "local-outlier-factor")
def local_outlier_factor(inputs, features=None, min_points=5, n_neighbors=None, alias="lof", key=None, metric="euclidean", **_):
    """Local outlier factor of each row (1 and less: as dense as around), from its exact neighbours. ``key`` must be unique; without
    it rows are numbered. Rows with a null or a feature that is not finite get null."""
    df, k = inputs[IN], int(n_neighbors or min_points)
    (row,) = free_name(df, "_row")
    rows = df.withColumn(row, F.col(key).cast("long")) if key else numbered(df, row)
    near = stored(nearest(rows, names(need(features, "features")), k, row, metric=metric), "neighbours")
    reach = near.groupBy("k").agg(F.max("dist").alias("kd"))
    j = near.join(reach.toDF("other", "okd"), "other").withColumn("rd", F.greatest("dist", "okd"))
    density = j.groupBy("k").agg((1 / F.greatest(F.avg("rd"), F.lit(1e-12))).alias("lrd"))
    density = stored(density, "densities")
    around = near.join(density.toDF("other", "olrd"), "other").groupBy("k").agg(F.avg("olrd").alias("o"))
    lof = around.join(density, "k").select(F.col("k").alias("_k"), (F.col("o") / F.col("lrd")).alias("_lof"))
    columns = [rows[c] for c in df.columns if c != alias]
    return {OUT: rows.join(lof, rows[row] == lof["_k"], "left").select(*columns, F.col("_lof").alias(alias))}
