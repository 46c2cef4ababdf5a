"""Profiles of columns and the data behind charts. Whatever is drawn has been aggregated by Spark first."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators import quantiles
from tessera.operators.durable import running, stored
from tessera.operators.quantiles import grouped_percentiles as quantiles_of
from tessera.operators.registry import IN, OUT, ParameterError, flag, names, need, operator
from tessera.operators.relational import aggregate_column

_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def numeric(df, attributes=None) -> list[str]:
    return [n for n, t in df.dtypes if t.startswith(_NUMBERS) and (not attributes or n in names(attributes))]


@operator("summary-statistics")
def summary_statistics(inputs, attributes=None, correlation=False, **_):
    """One row a column, from one pass: max, min, stddev, count, avg, approximate distinct, missing, skewness, kurtosis; with
    ``correlation``, Pearson's with every number column."""
    df = inputs[IN]
    columns, numbers = names(attributes) or df.columns, set(numeric(df))
    pairs = [(a, b) for a in columns for b in columns if correlation and a in numbers and b in numbers]
    sums = []
    for a in columns:
        c, n = F.col(a), a in numbers
        num = lambda f, c=c, n=n: (f(c) if n else F.lit(None)).cast("double")
        text = lambda f, c=c: f(c.cast("string") if not n else c).cast("string")
        sums.append(F.struct(F.lit(a).alias("attribute"), text(F.max).alias("max"), text(F.min).alias("min"), F.round(num(F.stddev), 4).alias("stddev"), F.count(c).alias("count"), F.round(num(F.avg), 4).alias("avg"), F.approx_count_distinct(c).alias("approx_distinct"), F.count_if(c.isNull()).alias("missing"), F.round(num(F.skewness), 2).alias("skewness"), F.round(num(F.kurtosis), 2).alias("kurtosis"), *(F.corr(a, b).alias(f"corr_{b}") for x, b in pairs if x == a)))
    if correlation:
        return {OUT: df.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums)))}
    return {OUT: df.agg(F.array(*sums).alias("s")).select(F.explode("s").alias("s")).select("s.*")}


@operator("correlation")
def correlation(inputs, attributes=None, method="pearson", **_):
    """attribute_a, attribute_b, correlation. Spearman's works on average ranks, found per column by grouping equal values."""
    df = inputs[IN]
    cols = names(attributes) or numeric(df)
    if method == "spearman":
        df = df.select(*(F.col(c).cast("double").alias(c) for c in cols)).na.drop()
        for c in cols:
            counts = df.groupBy(c).agg(F.count("*").alias("_n"))
            ranks = running(counts, {"_r": F.col("_n")}, [F.asc(c)]).withColumn("_r", F.col("_r") - (F.col("_n") - 1) / 2)
            df = df.join(ranks.select(F.col(c).alias("_v"), "_r"), F.col(c) == F.col("_v")).drop("_v", c).withColumnRenamed("_r", c)
    pairs = list(combinations(cols, 2))
    row = df.agg(F.array(*(F.struct(F.lit(a).alias("attribute_a"), F.lit(b).alias("attribute_b"), F.corr(a, b).alias("correlation")) for a, b in pairs)).alias("p"))
    return {OUT: row.select(F.explode("p").alias("p")).select("p.*")}


QUARTILES = [0.25, 0.5, 0.75]


@operator("box-plot")
def box_plot(inputs, fact_attributes=None, attributes=None, group=None, exact=True, **_):
    """Per group and column: quartiles, fences at 1.5 interquartile ranges, whiskers (the outermost values within) and the number of
    outliers."""
    df, by = inputs[IN], names(group)
    parts = []
    most = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0
    for a in names(need(fact_attributes or attributes, "attributes")):
        q = F.percentile(F.col(a), F.array(*map(F.lit, QUARTILES))) if exact else F.percentile_approx(a, QUARTILES)
        few = not exact or most <= quantiles.FEW
        s = df.groupBy(*by).agg((q if few else F.lit(None)).alias("q"), F.min(a).cast("double").alias("min"), F.max(a).cast("double").alias("max"), F.avg(a).alias("mean"))
        if not few:
            s = quantiles.joined(s.drop("q"), quantiles.percentiles(df, by, F.col(a), QUARTILES), by)
        s = s.select(*by, F.lit(a).alias("attribute"), F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "mean", "min", "max")
        s = s.withColumns({"lower_fence": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "upper_fence": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
        # a table of one row a group: its size is known, so that it is sent to the rows and not all rows of a group to one task
        s = stored(s, "fences")
        on = [df[g].eqNullSafe(s[g]) for g in by]
        j = df.select(*by, F.col(a).cast("double").alias("_v")).join(s.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(by)), "lower_fence", "upper_fence"), [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(by)]) if on else df.select(F.col(a).cast("double").alias("_v")).crossJoin(F.broadcast(s.select("lower_fence", "upper_fence")))
        within = F.col("_v").between(F.col("lower_fence"), F.col("upper_fence"))
        w = j.groupBy(*(F.col(g).alias(f"_h{i}") for i, g in enumerate(by))).agg(F.min(F.when(within, F.col("_v"))).alias("lower_whisker"), F.max(F.when(within, F.col("_v"))).alias("upper_whisker"), F.count_if(~within).alias("outliers"))
        parts.append((s.join(w, [F.col(g).eqNullSafe(F.col(f"_h{i}")) for i, g in enumerate(by)]) if by else s.crossJoin(w)).drop(*(f"_h{i}" for i in range(len(by)))))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return {OUT: made}


@operator("histogram")
def histogram(inputs, attributes=None, bins=20, **_):
    """Equal bins between the least and the largest value; the last one is closed. Empty bins are listed with 0. Nulls, NaN and
    infinite values are in no bin; a column without other values gives no rows."""
    df, n = inputs[IN], int(bins)
    made = None
    for a in names(need(attributes, "attributes")):
        x = df.select(F.col(a).cast("double").alias("x")).filter((F.abs("x") < float("inf")) & ~F.isnan("x"))
        lo, hi = x.agg(F.min("x"), F.max("x")).first()
        if lo is None:
            continue
        width = (hi - lo) / n or 1.0
        at = F.least(F.floor((F.col("x") - lo) / width), F.lit(n - 1))
        counts = x.groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
        every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("bin"))
        h = every.join(counts, "bin", "left").select(F.lit(a).alias("attribute"), "bin", (lo + F.col("bin") * width).alias("start"), (lo + (F.col("bin") + 1) * width).alias("end"), F.coalesce("n", F.lit(0)).alias("count"))
        made = h if made is None else made.unionByName(h)
    return {OUT: made if made is not None else df.sparkSession.createDataFrame([], "attribute string, bin int, start double, end double, count long")}


@operator("quantile-table")
def quantile_table(inputs, attributes=None, quantiles=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99), **_):
    """Exact quantiles by column."""
    cols, qs = names(attributes) or numeric(inputs[IN]), [float(q) for q in quantiles]
    found = quantiles_of(inputs[IN], cols, qs)
    made = [(c, q, v) for c in cols for q, v in zip(qs, found[c] or [None] * len(qs), strict=True)]
    return {OUT: inputs[IN].sparkSession.createDataFrame(made, "attribute string, quantile double, value double")}


@operator("frequency-table")
def frequency_table(inputs, attributes=None, top=20, **_):
    """The most frequent values, ties by value."""
    a = names(need(attributes, "attributes"))[0]
    return {OUT: inputs[IN].groupBy(F.col(a).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value").limit(int(top))}


def binned(df, x: dict):
    """A chart's x column: CATEGORICAL or NONE as it is, EQUAL_INTERVAL in a number of bins, FIXED_SIZE by width, QUANTILES."""
    a, kind = x["attribute"], x.get("binning", "CATEGORICAL")
    c = F.col(a).cast("double") * float(x.get("multiplier") or 1)
    if kind == "FIXED_SIZE":
        size = float(x["binSize"])
        return df, F.floor(c / size) * size
    if kind == "EQUAL_INTERVAL":
        n = int(x["bins"])
        lo, hi = df.agg(F.min(c), F.max(c)).first()
        if lo is None:
            return df, c
        width = (hi - lo) / n or 1.0
        return df, lo + F.least(F.floor((c - lo) / width), F.lit(n - 1)) * width
    if kind == "QUANTILES":
        n = int(x["bins"])
        edges = sorted(set(quantiles_of(df.select(c.alias("x")), ["x"], [i / n for i in range(n + 1)])["x"] or []))
        out = F.lit(edges[0] if edges else None)
        for e in edges[1:-1]:
            out = F.when(c >= e, F.lit(e)).otherwise(out)
        return df, out
    if kind in ("CATEGORICAL", "NONE"):
        return df, F.col(a)
    raise ParameterError(f"unknown binning: {kind}")


@operator("chart", "bar-chart", "line-chart", "area-chart", "pie-chart", "donut-chart", "treemap", "funnel-chart", "bubble-chart", "scatter-plot", "plot-chart", "map", "map-chart", "chart-builder")
def chart(inputs, x=None, y=None, max_displayed=None, group_others=True, fill_missing=False, filters=None, **_):
    """Rows for a chart: x entries {attribute, binning, bins, binSize, multiplier, max_displayed, sorting}, y entries {attribute,
    aggregation, alias}. Beyond ``max_displayed`` the largest by the first y stay and the rest is one group, if y can be added. With several x
    and ``fill_missing`` each combination of shown values has a row, sums and counts being 0 where there are none. An x's
    ``sorting`` is NATURAL, Y_ASC or Y_DESC."""
    df, keys = inputs[IN], []
    for i, e in enumerate(names(x) if isinstance(x, str) else x or []):
        e = {"attribute": e} if isinstance(e, str) else e
        df, c = binned(df, e)
        keys.append((f"_x{i}", e["attribute"], c, e))
    df = df.withColumns({k: c for k, _, c, _ in keys})
    ys = [{"attribute": v, "aggregation": "NONE"} if isinstance(v, str) else v for v in y or []]
    if all(v.get("aggregation", "NONE") == "NONE" for v in ys):
        return {OUT: df.select(*(F.col(k).alias(n) for k, n, _, _ in keys), *(F.col(v["attribute"]) for v in ys))}
    f = {"COUNTD": "countDistinct", "LIST": "collect_list"}
    alias = [v.get("alias") or f"{v['aggregation'].lower()}_{v['attribute']}" for v in ys]
    sums = [aggregate_column({"f": f.get(v["aggregation"], v["aggregation"].lower()), "attribute": v["attribute"], "alias": b}) for v, b in zip(ys, alias, strict=True)]
    top = max_displayed or next((e.get("max_displayed") for *_, e in keys if e.get("max_displayed")), None)
    made = df.groupBy(*(k for k, *_ in keys)).agg(*sums)
    if top and len(keys) == 1:
        key = keys[0][0]
        best = made.orderBy(F.desc(alias[0]), key).limit(int(top))
        if group_others and all(v["aggregation"] in ("SUM", "COUNT") for v in ys):
            rest = made.join(best.select(F.col(key).alias("_b")), F.col(key).eqNullSafe(F.col("_b")), "left_anti").agg(*(F.sum(b).alias(b) for b in alias))
            best = best.withColumn(key, F.col(key).cast("string")).unionByName(rest.filter(F.col(alias[0]).isNotNull()).select(F.lit("others").alias(key), *alias))
        made = best
    if fill_missing and len(keys) > 1:
        # a chart shows few values of each x, so that all combinations are few as well
        every = made.select(F.col(keys[0][0]).alias("_e0")).distinct()
        for i, (k, *_) in enumerate(keys[1:], 1):
            every = every.crossJoin(made.select(F.col(k).alias(f"_e{i}")).distinct())
        j = every.join(made, [F.col(f"_e{i}").eqNullSafe(F.col(k)) for i, (k, *_) in enumerate(keys)], "left")
        zero = {b for b, v in zip(alias, ys, strict=True) if v["aggregation"] in ("SUM", "COUNT", "COUNTD")}
        made = j.select(*(F.col(f"_e{i}").alias(k) for i, (k, *_) in enumerate(keys)), *(F.coalesce(b, F.lit(0)).alias(b) if b in zero else F.col(b) for b in alias))
    order = [c for k, _, _, e in keys for c in {"NATURAL": [F.asc(k)], "Y_ASC": [F.asc(alias[0]), F.asc(k)], "Y_DESC": [F.desc(alias[0]), F.asc(k)]}.get(e.get("sorting"), [])]
    if order:
        made = made.orderBy(*order)
    return {OUT: made.withColumnsRenamed({k: n for k, n, _, _ in keys})}


@operator("heatmap")
def heatmap(inputs, row_attribute=None, column_attribute=None, aggregation_function="count", value_attribute="*", **_):
    return {OUT: inputs[IN].groupBy(F.col(row_attribute).alias("row"), F.col(column_attribute).alias("column")).agg(aggregate_column({"f": aggregation_function.lower(), "attribute": value_attribute or "*", "alias": "value"}))}


@operator("indicator")
def indicator(inputs, value=None, delta=None, **_):
    return {OUT: inputs[IN].select(*(F.col(c) for c in (value, delta) if c)).limit(1)}


@operator("table-visualization")
def table_visualization(inputs, attributes=None, limit=500, **_):
    return {OUT: inputs[IN].select(*(names(attributes) or ["*"])).limit(int(limit))}


@operator("markdown", "iframe")
def static(inputs, **_):
    return {}


@operator("word-cloud")
def word_cloud(inputs, attributes=None, top=100, **_):
    from tessera.operators.text import word_counting

    return {OUT: word_counting(inputs, attributes)[OUT].orderBy(F.desc("count"), "word").limit(int(top))}


def outlying(df, attributes: list[str], most: int):
    """(attribute, value): up to ``most`` distinct values of each column beyond its fences, the smallest ones."""
    fences = box_plot({IN: df}, attributes)[OUT].select("attribute", "lower_fence", "upper_fence")  # one row a column
    long = df.select(F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("value")) for a in attributes))).alias("r")).select("r.*")
    beyond = long.join(F.broadcast(fences), "attribute").filter(~F.col("value").between(F.col("lower_fence"), F.col("upper_fence")) & ~F.isnan("value"))
    parts = [beyond.filter(F.col("attribute") == a).select("attribute", "value").distinct().orderBy("value").limit(most) for a in attributes]
    return reduce(DataFrame.unionByName, parts)


@operator("attribute-analysis")
def attribute_analysis(inputs, attributes=None, cluster=False, threshold=0.8, similarity=None, outliers=10, **_):
    """Statistics, histograms, box plots, outliers (up to so many distinct values beyond a column's fences, smallest first), frequent values
    and Spearman correlation of a table; with ``cluster`` the clusters of like strings of each text column instead."""
    df = inputs[IN]
    cols, numbers = names(attributes) or df.columns, numeric(df, attributes)
    if flag(cluster):
        from tessera.operators.strings import string_clusters

        texts = [c for c in cols if dict(df.dtypes)[c] == "string"]
        return {"clusters": {c: string_clusters(df, c, float(threshold if similarity is None else similarity)) for c in texts}}
    return {
        OUT: summary_statistics(inputs, cols)[OUT],
        "histogram": histogram(inputs, numbers, 40)[OUT] if numbers else None,
        "box plot": box_plot(inputs, numbers)[OUT] if numbers else None,
        "outliers": outlying(df, numbers, int(outliers)) if numbers else None,
        "frequency": {c: frequency_table(inputs, c)[OUT] for c in cols},
        "correlation": correlation(inputs, numbers, "spearman")[OUT] if len(numbers) > 1 else None,
    }
