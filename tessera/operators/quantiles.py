"""Exact quantiles whose memory does not grow with a group.

Spark's ``percentile`` keeps all distinct values of a group in one task. Where a group has more than ``FEW`` rows, a sketch of fixed
size gives each quantile a bracket of values instead; one pass counts what lies below and within each bracket, which also proves
that it holds the wanted ranks. Brackets with too many distinct values are narrowed by a sketch of what they hold. Then the values
within, counted once each, are walked to the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.durable import stored

#: Rows of a group that ``percentile`` may see; distinct values of a bracket that are walked; the sketch's accuracy.
FEW, WALKED, ACCURACY = 2_000_000, 200_000, 10_000
_INF = float("inf")


def percentiles(df: DataFrame, by: list[str], column: Column, qs: list[float], few: int | None = None, walked: int | None = None, accuracy: int | None = None) -> DataFrame:
    """(by..., q): the quantiles of a column by group as an array of doubles, equal to those of ``percentile``; null where a group has
    no value."""
    few, walked, accuracy = few or FEW, walked or WALKED, accuracy or ACCURACY
    keys = [f"_g{i}" for i in range(len(by))]
    rows = df.select(*(F.col(b).alias(k) for b, k in zip(by, keys, strict=True)), column.cast("double").alias("v"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if by else rows.agg(F.count(F.lit(1)).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    if most <= few:
        found = rows.groupBy(*keys).agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q"))
        return found.toDF(*by, "q")
    every = rows.select(keys).distinct() if by else None
    rows = rows.filter(F.col("v").isNotNull())
    around = [min(max(p, 0.0), 1.0) for q in qs for p in (q - 2 / accuracy, q + 2 / accuracy)]
    sketch = F.percentile_approx("v", F.array(*map(F.lit, around)), F.lit(accuracy)).alias("s")
    at = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), sketch)
    ranks = [(F.floor(F.lit(q) * (F.col("n") - 1)), F.ceil(F.lit(q) * (F.col("n") - 1))) for q in qs]
    bracket = [F.struct(F.col("s")[2 * i].alias("low"), F.col("s")[2 * i + 1].alias("high"), F.lit(0).cast("long").alias("below"), r[0].cast("long").alias("first"), r[1].cast("long").alias("last")) for i, r in enumerate(ranks)]
    state = stored(at.select(*keys, "n", F.array(*bracket).alias("b")), "brackets")
    for _ in range(20):
        j = joined(rows, state, keys)
        inside = lambda i: (F.col("v") >= F.col("b")[i]["low"]) & (F.col("v") <= F.col("b")[i]["high"])
        told = j.groupBy(*keys).agg(
            *(F.count_if(F.col("v") < F.col("b")[i]["low"]).alias(f"below{i}") for i in range(len(qs))),
            *(F.count_if(inside(i)).alias(f"within{i}") for i in range(len(qs))),
            *(F.approx_count_distinct(F.when(inside(i), F.col("v"))).alias(f"distinct{i}") for i in range(len(qs))),
        )
        told = stored(told, "counts")
        state = joined(state, told, keys)
        b = [F.col("b")[i] for i in range(len(qs))]
        holds = [(F.col(f"below{i}") <= b[i]["first"]) & (b[i]["last"] < F.col(f"below{i}") + F.col(f"within{i}")) for i in range(len(qs))]
        ready = [holds[i] & (F.col(f"distinct{i}") <= walked) for i in range(len(qs))]
        done = state.filter(~F.coalesce(_all(ready), F.lit(True))).isEmpty()
        state = stored(
            state.select(
                *keys,
                "n",
                F.array(*(F.struct(
                    F.when(holds[i], b[i]["low"]).otherwise(F.lit(-_INF)).alias("low"),
                    F.when(holds[i], b[i]["high"]).otherwise(F.lit(_INF)).alias("high"),
                    F.when(holds[i], F.col(f"below{i}")).otherwise(F.lit(0)).alias("below"),
                    b[i]["first"].alias("first"), b[i]["last"].alias("last"), F.when(holds[i], F.col(f"within{i}")).otherwise(F.col("n")).alias("within"), ready[i].alias("ready"),
                ) for i in range(len(qs)))).alias("b"),
            ),
            "brackets",
        )
        if done:
            break
        # a sketch of what each open bracket holds, around the wanted ranks; what is ready stays
        held = joined(rows, state, keys).select(*keys, "v", F.posexplode("b").alias("i", "r")).filter("NOT r.ready AND v >= r.low AND v <= r.high")
        share = lambda rank, by_: F.least(F.greatest((F.col(rank) - F.col("below")) / F.col("within") + by_ * 2.0 / accuracy, F.lit(0.0)), F.lit(1.0))
        held = held.groupBy(*keys, "i").agg(F.percentile_approx("v", F.array(*(F.lit(k / 64) for k in range(65))), F.lit(accuracy)).alias("grid"), F.first("r.below").alias("below"), F.first("r.within").alias("within"), F.first("r.first").alias("first"), F.first("r.last").alias("last"))
        low = F.element_at("grid", F.greatest(F.floor(share("first", -1) * 64).cast("int"), F.lit(0)) + 1)
        high = F.element_at("grid", F.least(F.ceil(share("last", 1) * 64).cast("int"), F.lit(64)) + 1)
        new = held.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(low.alias("low"), high.alias("high")).alias("to")))).alias("_new"))
        state = joined(state, new, keys, "left")
        narrowed = F.transform("b", lambda r, i: F.struct(F.coalesce(F.col("_new")[i]["low"], r["low"]).alias("low"), F.coalesce(F.col("_new")[i]["high"], r["high"]).alias("high"), r["below"].alias("below"), r["first"].alias("first"), r["last"].alias("last")))
        state = stored(state.select(*keys, "n", narrowed.alias("b")), "brackets")
    within = joined(rows, state, keys).select(*keys, "v", F.posexplode("b").alias("i", "r")).filter("v >= r.low AND v <= r.high")
    values = within.groupBy(*keys, "i", "v").agg(F.count(F.lit(1)).alias("c"), F.first("r").alias("r"))
    upto = F.col("r.below") + F.sum("c").over(Window.partitionBy(*keys, "i").orderBy("v"))
    values = values.withColumn("_upto", upto)
    ends = values.groupBy(*keys, "i").agg(F.min(F.when(F.col("_upto") > F.col("r.first"), F.col("v"))).alias("lower"), F.min(F.when(F.col("_upto") > F.col("r.last"), F.col("v"))).alias("higher"), F.first("r.first").alias("first"), F.first("r.last").alias("last"))
    ends = joined(ends, state.select(*keys, "n"), keys).withColumn("p", F.element_at(F.array(*map(F.lit, qs)), F.col("i") + 1) * (F.col("n") - 1))
    value = F.when((F.col("first") == F.col("last")) | (F.col("lower") == F.col("higher")), F.col("lower")).otherwise((F.col("last") - F.col("p")) * F.col("lower") + (F.col("p") - F.col("first")) * F.col("higher"))
    found = ends.select(*keys, F.struct("i", value.alias("x")).alias("e")).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["x"]).alias("q"))
    if every is not None:
        found = joined(every, found, keys, "left").select(*keys, "q")
    return found.toDF(*by, "q")


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys that may be null; without keys b has one row."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    c = b.toDF(*(f"_j{c}" if c in keys else c for c in b.columns))
    on = [a[k].eqNullSafe(c[f"_j{k}"]) for k in keys]
    return a.join(c, on, how).drop(*(f"_j{k}" for k in keys))


def grouped_percentiles(df: DataFrame, columns: list[str], qs: list[float]) -> dict[str, list[float] | None]:
    """Quantiles of whole columns; in one aggregation where the table has at most ``FEW`` rows."""
    if df.count() <= FEW:
        row = df.agg(*(F.percentile(c, F.array(*map(F.lit, qs))).alias(f"c{i}") for i, c in enumerate(columns))).first()
        return dict(zip(columns, row, strict=True))
    found = {}
    for c in columns:
        row = percentiles(df, [], F.col(c), qs).first()
        found[c] = row[0] if row else None
    return found
