"""Projection, filters, missing data, joins, aggregation, windows, order, samples and sets."""

from __future__ import annotations

import operator as op
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.expressions import Compiler, spark_type, window_spec
from tessera.operators.durable import free_name, numbered, stored
from tessera.operators.quantiles import grouped_percentiles
from tessera.operators.registry import IN, IN1, IN2, OUT, ParameterError, flag, names, need, operator


def out(df: DataFrame) -> dict:
    return {OUT: df}


# --- projection


@operator("projection", "select")
def select(inputs, attributes=None, mode="include", **_):
    """attributes: names or {attribute, alias}; mode include, exclude, rename or duplicate. Every listed alias is kept, also
    several of one attribute."""
    df = inputs[IN]
    pairs = [(a, a) if isinstance(a, str) else (a["attribute"], a.get("alias") or a["attribute"]) for a in need(attributes, "attributes")]
    if mode == "exclude":
        df = df.drop(*(a for a, _ in pairs))
    elif mode == "rename":
        df = df.withColumnsRenamed(dict(pairs))
    elif mode == "duplicate":
        df = df.withColumns({b: F.col(a) for a, b in pairs})
    else:
        df = df.select(*(F.col(a).alias(b) for a, b in pairs))
    return {OUT: df, "output projected data": df}


@operator("rename")
def rename(inputs, attributes=None, **_):
    return select(inputs, attributes, "rename")


@operator("rename-attr")
def rename_attr(inputs, attributes=None, alias=None, **_):
    found = names(need(attributes, "attributes"))
    to = [x.strip() for x in (alias.split(",") if isinstance(alias, str) else alias or [])] + [None] * len(found)
    return out(inputs[IN].withColumnsRenamed({a: b or f"{a}_renamed" for a, b in zip(found, to, strict=False)}))


@operator("discard")
def discard(inputs, attributes=None, **_):
    return select(inputs, attributes, "exclude")


@operator("duplicate")
def duplicate(inputs, attributes=None, **_):
    return select(inputs, attributes, "duplicate")


@operator("drop")
def drop(inputs, column=None, **_):
    return out(inputs[IN].drop(*names(need(column, "column"))))


@operator("transformation", "add-by-formula", "flag-with-formula")
def transformation(inputs, expression=None, formula=None, **_):
    """Columns from trees ({alias, tree}); every tree sees the columns of the input."""
    found = expression or formula
    found = [found] if isinstance(found, dict) else need(found, "expression")
    compiler = Compiler()
    return out(inputs[IN].withColumns({e["alias"]: compiler.column(e.get("tree") or e["expression"]) for e in found}))


@operator("cast")
def cast(inputs, cast_attributes=None, errors="coerce", invalid_values="_invalid", **_):
    """errors: coerce (null), raise (the query fails), or move (bad values go to <attribute>_invalid)."""
    df, new = inputs[IN], {}
    for a in need(cast_attributes, "cast_attributes"):
        name, kind = a["attribute"], str(a["type"])
        c = F.col(name)
        if kind.lower() == "json":
            made = F.to_json(c) if dict(df.dtypes)[name].startswith(("struct", "array", "map")) else c.cast("string")
        elif kind.lower() == "array":
            made = F.array(c)
        elif kind.lower() in ("date", "time") and a.get("formats"):
            made = F.try_to_date(c, a["formats"])
        elif kind.lower() == "datetime" and a.get("formats"):
            made = F.try_to_timestamp(c, F.lit(a["formats"]))
        else:
            kind = {"date": "date", "time": "date"}.get(kind.lower(), spark_type(kind))
            made = c.cast(kind) if errors == "raise" else c.try_cast(kind)
        new[name] = made
        if errors == "move":
            new[f"{name}{invalid_values if str(invalid_values).startswith('_') else '_invalid'}"] = F.when(made.isNull() & c.isNotNull(), c.cast("string"))
    return out(df.withColumns(new))


@operator("replace-value")
def replace_value(inputs, attributes=None, value=None, replacement=None, nullify=False, **_):
    found = names(need(attributes, "attributes"))
    swap = F.lit(None) if flag(nullify) else F.lit(replacement)
    return out(inputs[IN].withColumns({a: F.when(F.col(a) == F.lit(value), swap).otherwise(F.col(a)) for a in found}))


@operator("find-replace")
def find_replace(inputs, attributes=None, find=None, replace=None, nullify=False, **_):
    return replace_value(inputs, attributes, find, replace, nullify)


@operator("change-attribute")
def change_attribute(inputs, attributes=None, new_name=None, new_data_type=None, nullable=None, is_feature=None, is_label=None, **_):
    """Rename by a format ('{}_x'), cast, and mark columns in their metadata."""
    df = inputs[IN]
    for a in names(need(attributes, "attributes")):
        meta = dict(df.schema[a].metadata or {}) | {k: flag(v) for k, v in (("nullable", nullable), ("feature", is_feature), ("label", is_label)) if v is not None}
        if new_data_type and new_data_type != "keep":
            df = df.withColumn(a, F.col(a).cast(spark_type(new_data_type)))
        df = df.withMetadata(a, meta)
        if new_name:
            df = df.withColumnRenamed(a, new_name.format(a))
    return out(df)


@operator("add-columns")
def add_columns(inputs, aliases="ds0_,ds1_", order_by=None, how="inner", **_):
    """Put the n-th rows of two tables side by side. ``order_by`` ([left names, right names]) says what n-th means; without
    it, it is the order in which Spark reads. Of tables of unlike length the rest goes, or stays with nulls (``how`` left,
    right, outer). Rows that are equal in the order come in any order."""
    a, b = (x.strip() for x in (aliases.split(",") if isinstance(aliases, str) else aliases)[:2])
    sides = []
    for df, prefix, order in zip((inputs[IN1], inputs[IN2]), (a, b), order_by or (None, None), strict=True):
        (at,) = free_name(df, "_at")
        sides.append((numbered(df, at, [F.col(c) for c in names(order)] if order else None), at, df.columns, prefix))
    # names may clash: sides meet under names of their own
    l, r = (x.select(F.col(at).alias(f"_n{i}"), *(F.col(f"`{c}`").alias(f"_{i}_{k}") for k, c in enumerate(columns))) for i, (x, at, columns, _p) in enumerate(sides))
    j = l.join(r, F.col("_n0") == F.col("_n1"), _HOW.get(how, how))
    return out(j.select(*(F.col(f"_{i}_{k}").alias(prefix + c) for i, (_x, _at, columns, prefix) in enumerate(sides) for k, c in enumerate(columns))))


@operator("multiplexer")
def multiplexer(inputs, **_):
    return out(next(inputs[p] for p in (IN1, IN2) if inputs.get(p) is not None))


@operator("service-output", "publish-as-visualization")
def service_output(inputs, **_):
    return out(inputs.get(IN))


@operator("comment")
def comment(inputs, **_):
    return {}


# --- filters and missing data

_COMPARE = {"==": op.eq, "=": op.eq, "eq": op.eq, "!=": op.ne, "ne": op.ne, ">": op.gt, "gt": op.gt, "<": op.lt, "lt": op.lt, ">=": op.ge, "ge": op.ge, "<=": op.le, "le": op.le}


def _typed(df: DataFrame, name: str, value):
    return F.lit(value).cast(df.schema[name].dataType)


@operator("filter", "filter-selection")
def filter_rows(inputs, filter=None, expression=None, formula=None, **_):  # noqa: A002
    """All of: simple triples {attribute, f, value}, whose value takes the column's type, and trees."""
    df, conditions = inputs[IN], []
    for t in filter or []:
        conditions.append(_COMPARE[t["f"]](F.col(t["attribute"]), _typed(df, t["attribute"], t["value"])))
    found = expression or formula or []
    for e in [found] if isinstance(found, dict) else found:
        conditions.append(Compiler().column(e.get("tree") or e.get("expression") or e))
    return out(df.filter(reduce(op.and_, conditions)) if conditions else df)


@operator("user-filter")
def user_filter(inputs, filters=None, ignore=False, **_):
    """{name, op, value, type, multiplicity}: op also in and ni. Filters without a value are left out unless they must have one."""
    df = inputs[IN]
    if flag(ignore):
        return out(df)
    kinds = {"CHARACTER": "string", "INTEGER": "long", "DECIMAL": "double", "DATE": "date"}
    for f in filters or []:
        value = f.get("value", f.get("default_value"))
        if value in (None, "", []):
            if f.get("multiplicity", "ZERO_OR_MORE") in ("ONE", "ONE_OR_MORE"):
                raise ParameterError(f"filter on {f['name']} needs a value")
            continue
        c, lit = F.col(f["name"]), lambda v, k=kinds[f.get("type", "CHARACTER")]: F.lit(v).cast(k)
        if f["op"] in ("in", "ni"):
            found = c.isin([lit(v) for v in (value if isinstance(value, list) else str(value).split(","))])
            df = df.filter(found if f["op"] == "in" else ~found)
        else:
            df = df.filter(_COMPARE[f["op"]](c, lit(value)))
    return out(df)


@operator("clean-missing")
def clean_missing(inputs, attributes=None, cleaning_mode="REMOVE_ROW", value=None, min_missing_ratio=None, max_missing_ratio=None, **_):
    """REMOVE_ROW, REMOVE_COLUMN, VALUE, MEAN, MODE or MEDIAN on the attributes whose share of nulls is within the ratios. All
    statistics of all attributes come from one pass."""
    df, found = inputs[IN], names(need(attributes, "attributes"))
    if min_missing_ratio is not None or max_missing_ratio is not None:
        lo, hi = float(min_missing_ratio or 0), float(1 if max_missing_ratio is None else max_missing_ratio)
        shares = df.agg(*(F.avg(F.col(a).isNull().cast("int")).alias(a) for a in found)).first()
        found = [a for a in found if shares[a] is not None and lo <= shares[a] <= hi]
    if not found:
        return {OUT: df, "output result": df}
    if cleaning_mode == "REMOVE_ROW":
        df = df.na.drop(subset=found)
    elif cleaning_mode == "REMOVE_COLUMN":
        df = df.drop(*found)
    else:
        if cleaning_mode == "VALUE":
            fill = {a: value for a in found}
        else:
            # ties of the mode go to the smallest value
            if cleaning_mode == "MEDIAN":
                row = {a: q and q[0] for a, q in grouped_percentiles(df, found, [0.5]).items()}
            else:
                modes = {"MEAN": F.avg, "MODE": lambda a: F.mode(a, True)}
                row = df.agg(*(modes[cleaning_mode](F.col(a)).alias(a) for a in found)).first()
            fill = {a: row[a] for a in found if row[a] is not None}
        df = df.withColumns({a: F.coalesce(F.col(a), F.lit(v).cast(df.schema[a].dataType if cleaning_mode in ("VALUE", "MODE") else "double")) for a, v in fill.items()})
    return {OUT: df, "output result": df}


@operator("remove-missing")
def remove_missing(inputs, attributes=None, **_):
    return out(inputs[IN].na.drop(subset=names(need(attributes, "attributes"))))


@operator("force-range")
def force_range(inputs, attributes=None, start=None, end=None, outliers="clip", **_):
    """Clip to [start, end], or make what is outside null (outliers='clean'). Nulls and NaN stay."""
    new = {}
    for a in names(need(attributes, "attributes")):
        c, x = F.col(a), F.col(a)
        if start is not None:
            x = F.when(c < start, F.lit(None) if outliers == "clean" else F.lit(start)).otherwise(x)
        if end is not None:
            above = (c > end) & ~F.isnan(c.cast("double")) if dict(inputs[IN].dtypes)[a] in ("double", "float") else c > end
            x = F.when(above, F.lit(None) if outliers == "clean" else F.lit(end)).otherwise(x)
        new[a] = x
    return out(inputs[IN].withColumns(new))


# --- joins

_HOW = {"left": "left_outer", "right": "right_outer", "outer": "full_outer", "full": "full_outer", "semi": "left_semi", "anti": "left_anti"}
_THETA = {"=": op.eq, "==": op.eq, "!=": op.ne, "<": op.lt, "<=": op.le, ">": op.gt, ">=": op.ge}


@operator("join")
def join(inputs, left_attributes=None, right_attributes=None, join_type="inner", match_case=True, keep_right_keys=True, aliases="", join_parameters=None, **_):
    """Equal keys by name lists, or ``join_parameters`` with conditions [{first, second, op}], prefixes and what to select of
    either side (1 all, 2 listed [{attribute, alias}], 3 nothing). Strategy is left to Spark's statistics."""
    p = join_parameters or {}
    conditions = p.get("conditions") or [{"first": a, "second": b, "op": "="} for a, b in zip(names(left_attributes), names(right_attributes), strict=True)]
    how = (p.get("joinType") or join_type or "inner").lower().replace(" ", "_")
    how = _HOW.get(how, how)
    left, right = inputs[IN1], inputs[IN2]
    # unlike inner names make self joins and shared names unambiguous
    l, r = left.toDF(*(f"_l{i}" for i in range(len(left.columns)))), right.toDF(*(f"_r{i}" for i in range(len(right.columns))))
    lc, rc = ({n: F.col(f"{p}{i}") for i, n in enumerate(df.columns)} for p, df in (("_l", left), ("_r", right)))
    fold = lambda df, n, c: F.lower(c) if not flag(match_case) and isinstance(df.schema[n].dataType.simpleString(), str) and df.schema[n].dataType.simpleString() == "string" else c
    on = reduce(op.and_, (_THETA[c.get("op", "=")](fold(left, c["first"], lc[c["first"]]), fold(right, c["second"], rc[c["second"]])) for c in conditions)) if conditions else None
    j = l.crossJoin(r) if on is None or how == "cross" else l.join(r, on, how)
    prefixes = [p.get("firstPrefix"), p.get("secondPrefix")] if p else [x.strip() for x in (aliases.split(",") if aliases else [])]
    prefixes = [x or "" for x in [*prefixes, None, None][:2]]
    kept = [_side(left, lc, p.get("firstSelectionType", 1), p.get("firstSelect"), prefixes[0])]
    if how not in ("left_semi", "left_anti", "leftsemi", "leftanti"):
        keys = {c["second"] for c in conditions if c.get("op", "=") in ("=", "==")}
        second = _side(right, rc, p.get("secondSelectionType", 1), p.get("secondSelect"), prefixes[1])
        kept.append(second if flag(keep_right_keys) or p else [x for x in second if x[2] not in keys])
    taken: set[str] = set()
    columns = []
    for c, name, _own in (x for side in kept for x in side):
        while name in taken:
            name += "_r"
        taken.add(name)
        columns.append(c.alias(name))
    return out(j.select(columns))


def _side(df, columns, selection, listed, prefix):
    if int(selection) == 3:
        return []
    if int(selection) == 2:
        return [(columns[a["attribute"]], a.get("alias") or a["attribute"], a["attribute"]) for a in listed or [] if a.get("select", True)]
    return [(columns[n], prefix + n, n) for n in df.columns]


@operator("table-lookup")
def table_lookup(inputs, left_attributes=None, right_attributes=None, **params):
    """A left join that keeps the looked-up side's other columns."""
    return join(inputs, left_attributes, right_attributes, "left", keep_right_keys=False, **params)


# --- aggregation

#: Aggregates by name.
AGGREGATES = {
    "collect_list": F.collect_list, "collect_set": F.collect_set, "avg": F.avg, "mean": F.avg, "count": F.count, "first": F.first, "last": F.last,
    "max": F.max, "min": F.min, "sum": F.sum, "countDistinct": F.count_distinct, "countdistinct": F.count_distinct, "approx_count_distinct": F.approx_count_distinct,
    "sumDistinct": F.sum_distinct, "sumdistinct": F.sum_distinct, "stddev": F.stddev, "stddev_pop": F.stddev_pop, "variance": F.variance, "var_pop": F.var_pop,
    "kurtosis": F.kurtosis, "skewness": F.skewness, "size": F.count, "median": F.median, "mode": lambda c: F.mode(c, True),
}


def aggregate_column(f: dict):
    name, attribute = f["f"], f.get("attribute", "*")
    if name in ("size",) or (attribute == "*" and name == "count"):
        return F.count(F.lit(1)).alias(f.get("alias") or "count")
    if name not in AGGREGATES:
        if not hasattr(F, name):
            raise ParameterError(f"unknown aggregate: {name}")
        return getattr(F, name)(F.col(attribute)).alias(f.get("alias") or f"{name}_{attribute}")
    return AGGREGATES[name](F.col(attribute)).alias(f.get("alias") or f"{name}_{attribute}")


@operator("aggregation", "group", "pivot")
def aggregation(inputs, attributes=None, function=None, functions=None, pivot=None, pivot_values=None, **_):
    """Groups by names (none: one group) with {attribute, f, alias} lists; with ``pivot``, one column a pivot value."""
    columns = [aggregate_column(f) for f in need(function or functions, "function")]
    grouped = inputs[IN].groupBy(*names(attributes))
    if pivot:
        values = [v.strip() for v in pivot_values.split(",")] if isinstance(pivot_values, str) and pivot_values else pivot_values or None
        grouped = grouped.pivot(names(pivot)[0], values)
    return out(grouped.agg(*columns))


# --- windows


@operator("window-transformation")
def window_transformation(inputs, partition_attribute=None, order_by=None, type="none", rows_from=None, rows_to=None, range_from=None, range_to=None, expressions=None, **_):  # noqa: A002
    """Trees over one window. Rows start so many rows before; open where no number is given."""
    order = [(o["attribute"], o.get("f", "asc") == "asc") for o in order_by or []]
    number = lambda x: None if x in (None, "", "unboundedPreceding", "unboundedFollowing") else int(x)
    lo, hi = number(rows_from), number(rows_to)
    rows = (None if lo is None else -lo, hi) if type == "rows" else None
    between = (number(range_from), number(range_to)) if type == "range" else None
    framed = window_spec(names(partition_attribute), order, rows, between)
    plain = window_spec(names(partition_attribute), order)
    ranking = {"lag", "lead", "ntile", "cume_dist", "percent_rank", "rank", "dense_rank", "row_number"}

    def has(tree, found) -> bool:
        return isinstance(tree, dict) and (tree.get("callee", {}).get("name") in found or any(has(v, found) for v in tree.values())) or isinstance(tree, list) and any(has(v, found) for v in tree)

    new = {}
    for e in need(expressions, "expressions"):
        tree = e.get("tree") or e["expression"]
        new[e["alias"]] = Compiler(window=plain if has(tree, ranking) else framed).column(tree)
    return out(inputs[IN].withColumns(new))


@operator("sliding-window")
def sliding_window(inputs, attribute=None, alias="value", window_size=2, window_gap=1, window_pass=1, order_by=None, partition_by=None, **_):
    """Each ``window_pass``-th row becomes size - 1 values in a row and the one ``gap`` rows after them. An order is required;
    with ``partition_by`` every series has its own windows. No task sees all rows."""
    df, size, gap, step = inputs[IN], int(window_size), int(window_gap), max(1, int(window_pass))
    by, order = names(partition_by), names(need(order_by, "order_by"))
    at = [*range(size - 1), size + gap - 2]
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        v, n = free_name(df, "_v", "_n")
        values = F.collect_list(F.struct(F.col(attribute).alias("v"))).over(w.rowsBetween(0, size + gap - 2))
        full = df.withColumns({v: values, n: F.row_number().over(w) - 1}).filter((F.size(v) == size + gap - 1) & (F.col(n) % step == 0))
        return out(full.select(*df.columns, *(F.col(v)[i]["v"].alias(f"{alias}{k + 1}") for k, i in enumerate(at))))
    # rows are numbered, and each value goes to the windows that hold it
    n, start, k, v, got = free_name(df, "_n", "_start", "_k", "_v", "_got")
    rows = numbered(df, n, [F.col(c) for c in order])
    places = F.explode(F.array(*(F.struct((F.col(n) - i).alias("s"), F.lit(j).alias("k")) for j, i in enumerate(at))))
    sent = rows.select(places.alias("p"), F.struct(F.col(attribute).alias("v")).alias(v)).select(F.col("p.s").alias(start), F.col("p.k").alias(k), v).filter((F.col(start) >= 0) & (F.col(start) % step == 0))
    full = sent.groupBy(start).agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias(got)).filter(F.size(got) == size)
    j = rows.join(full, F.col(n) == F.col(start))
    return out(j.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(got)[i]["v"].alias(f"{alias}{i + 1}") for i in range(size))))


# --- order, samples and folds


@operator("sort")
def sort(inputs, attributes=None, order_by=None, **_):
    keys = need(attributes or order_by, "attributes")
    return out(inputs[IN].orderBy(*(F.asc(k["attribute"]) if k.get("f", "asc") == "asc" else F.desc(k["attribute"]) for k in ({"attribute": k} if isinstance(k, str) else k for k in keys))))


@operator("sample")
def sample(inputs, type="percent", fraction=None, value=None, seed=None, withReplacement=False, scale=1, **_):  # noqa: A002, N803
    """A share of the rows (``percent``: 0 < fraction <= 1; a fraction over 1 is an error unless ``scale`` is 100, when 50 is a
    half), a number of them at random (``value``, exact), or the first (``head``)."""
    df = inputs[IN]
    seed = 0 if seed in (None, "") else int(seed)
    if type == "head":
        df = df.limit(int(need(value, "value")))
    elif type == "value":
        # a little more than wanted is drawn first, so that few rows are sorted; where luck left too few, all are
        wanted, total = int(need(value, "value")), df.count()
        (draw,) = free_name(df, "_draw")
        some = df.withColumn(draw, F.rand(seed)).filter(F.col(draw) <= (wanted + 10 * wanted**0.5 + 100) / max(total, 1))
        some = stored(some, "sample")
        df = (some if some.count() >= min(wanted, total) else df.withColumn(draw, F.rand(seed))).orderBy(draw).limit(wanted).drop(draw)
    else:
        part = float(need(fraction, "fraction")) / float(scale)
        if not 0 < part <= 1:
            raise ParameterError("fraction must be over 0 and at most 1, or at most the scale")
        df = df.sample(flag(withReplacement), part, seed)
    return {OUT: df, "sampled data": df}


@operator("split")
def split(inputs, weights=50, seed=None, **_):
    part = float(weights)
    if not 0 < part < 100:
        raise ParameterError("weights must be between 0 and 100")
    a, b = inputs[IN].randomSplit([part, 100 - part], 0 if seed in (None, "") else int(seed))
    return {"split 1": a, "split 2": b, "splitted data 1": a, "splitted data 2": b}


@operator("split-k-fold", "k-fold")
def split_k_fold(inputs, k_fold=3, n_splits=None, type="random", label=None, column=None, alias_fold="fold", alias=None, seed=0, shuffle=True, stratified=False, order_by=None, **_):  # noqa: A002
    """A fold number a row: random by a hash, exact by rank within the table or (stratified) the label, or contiguous."""
    df, k, name = inputs[IN], int(n_splits or k_fold), alias or alias_fold
    label = label or column
    by = names(label)[:1] if "stratified" in type or flag(stratified) else []
    if type == "random" and not by and flag(shuffle):
        return out(df.withColumn(name, F.floor(F.rand(int(seed)) * k).cast("int")))
    at, draw, first, count = free_name(df, "_at", "_draw", "_first", "_count")
    rows = df.withColumn(draw, F.rand(int(seed)))
    order = [draw] if flag(shuffle) and not order_by else names(need(order_by, "order_by"))
    rows = numbered(rows, at, [F.col(c) for c in [*by, *order]])
    # each label's rows stand one behind the other: folds of like size, the first ones with one row more
    sizes = rows.groupBy(*by).agg(F.min(at).alias(first), F.count(F.lit(1)).alias(count))
    if by:
        sizes = sizes.withColumnRenamed(by[0], "_label")
        j = rows.join(sizes, F.col(by[0]).eqNullSafe(F.col("_label"))).drop("_label")
    else:
        j = rows.crossJoin(F.broadcast(sizes))  # one row
    place, small = F.col(at) - F.col(first), F.floor(F.col(count) / k)
    more = F.col(count) % k
    fold = F.when(place < more * (small + 1), F.floor(place / (small + 1))).otherwise(more + F.floor((place - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return out(j.withColumn(name, fold.cast("int")).drop(at, draw, first, count))


# --- sets


@operator("add-rows", "concat-rows")
def add_rows(inputs, by_name=False, **_):
    a, b = inputs[IN1], inputs[IN2]
    return out(a.unionByName(b, allowMissingColumns=True) if flag(by_name) else a.unionAll(b))


@operator("set-intersection", "intersection")
def intersection(inputs, keep_all=False, **_):
    a, b = inputs[IN1], inputs[IN2]
    return out(a.intersectAll(b) if flag(keep_all) else a.intersect(b))


@operator("difference")
def difference(inputs, keep_all=False, **_):
    a, b = inputs[IN1], inputs[IN2]
    return out(a.exceptAll(b) if flag(keep_all) else a.subtract(b))


@operator("distinct", "remove-duplicated-rows")
def distinct(inputs, attributes=None, order_by=None, **_):
    """Whole rows, or one row a key: any, or with ``order_by`` the first."""
    df, keys = inputs[IN], names(attributes)
    if keys and order_by:
        w = Window.partitionBy(*keys).orderBy(*names(order_by))
        return out(df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n"))
    return out(df.dropDuplicates(keys) if keys else df.distinct())


@operator("balance-data")
def balance(inputs, partitions=None, **_):
    df = inputs[IN]
    return out(df.repartition(int(partitions)) if partitions else df.hint("rebalance"))


@operator("execute-sql")
def execute_sql(inputs, query=None, names=None, **_):  # noqa: A002
    """A query over views ds1 and ds2, the inputs; common table expressions are welcome."""
    text = need(query, "query").strip().rstrip(";")
    if text[:6].lower() not in ("select", "with a") and not text.lower().startswith("with"):
        raise ParameterError("only queries can be run")
    given = {f"ds{i}": inputs[p] for i, p in ((1, IN1), (2, IN2)) if inputs.get(p) is not None}
    session = next(iter(given.values())).sparkSession if given else None
    if session is None:
        from pyspark.sql import SparkSession

        session = SparkSession.getActiveSession()
    for name, df in given.items():
        df.createOrReplaceTempView(name)
    found = session.sql(text)
    new = [n.strip() for n in (names.split(",") if isinstance(names, str) and names else names or [])]
    if new and len(new) != len(found.columns):
        raise ParameterError(f"{len(found.columns)} columns but {len(new)} names")
    return out(found.toDF(*new) if new else found)


@operator("execute-python")
def execute_python(inputs, code=None, **_):
    """A trusted callable of (spark, in1, in2) that returns one DataFrame or two."""
    if not callable(code):
        raise ParameterError("code must be a callable; text is not run")
    found = code(next(iter(inputs.values())).sparkSession, inputs.get(IN1), inputs.get(IN2))
    found = found if isinstance(found, tuple) else (found, None)
    return {"output data 1": found[0], "output data 2": found[1], OUT: found[0]}


# --- verbs of the explorer that rewrite one column


def _array_get(index: int):
    return lambda c: F.try_element_at(c, F.lit(index + 1 if index >= 0 else index))


_VERBS = {
    "to-upper": lambda c, **_: F.upper(c), "to-lower": lambda c, **_: F.lower(c), "capitalize": lambda c, **_: F.initcap(c), "initcap": lambda c, **_: F.initcap(c),
    "trim": lambda c, **_: F.trim(c), "extract-with-regex": lambda c, regex, group=1, **_: F.regexp_extract(c, regex, int(group)),
    "regexp_extract": lambda c, regex, group=1, **_: F.regexp_extract(c, regex, int(group)), "replace-with-regex": lambda c, regex, value="", **_: F.regexp_replace(c, regex, value),
    "split": lambda c, delimiter=" ", **_: F.split(c, delimiter), "split-into-words": lambda c, delimiter=r"\s+", **_: F.split(c, delimiter),
    "truncate-text": lambda c, characters, **_: F.substring(c, 1, int(characters)), "round-number": lambda c, decimals=0, **_: F.round(c, int(decimals)),
    "ts-to-date": lambda c, **_: F.from_unixtime(c), "date-to-ts": lambda c, **_: F.unix_timestamp(c), "format-date": lambda c, format="yyyy-MM-dd", **_: F.date_format(c, format),
    "truncate-date-to": lambda c, unit="month", **_: F.date_trunc(unit, c), "date-part": lambda c, unit="year", **_: F.date_part(F.lit(unit.rstrip("s")), c),
    "parse-to-date": lambda c, format=None, **_: F.try_to_date(c, format) if format else F.try_to_date(c), "concat-array": lambda c, delimiter=",", **_: F.array_join(c, delimiter),
    "sort-array": lambda c, **_: F.array_sort(c), "change-array-type": lambda c, new_type="string", **_: c.cast(f"array<{spark_type(new_type)}>"), "invert-boolean": lambda c, **_: ~c,
}


def _verb(slug: str, f):
    def run(inputs, attributes=None, **params):
        return out(inputs[IN].withColumns({a: f(F.col(a), **params) for a in names(need(attributes, "attributes"))}))

    return run


for _slug, _f in _VERBS.items():
    operator(*([_slug] if _slug != "split" else ["split-text"]))(_verb(_slug, _f))


def _expression_verbs():
    from tessera.functions.expressions import OWN, strip_accents

    return {"extract-numbers": lambda c, **_: OWN["extract_numbers"](c), "remove-accents": lambda c, **_: strip_accents(c), "normalize": lambda c, **_: strip_accents(F.lower(c)), "normalize-text": lambda c, **_: strip_accents(F.lower(c))}


for _slug, _f in _expression_verbs().items():
    operator(_slug)(_verb(_slug, _f))


@operator("flag-empty")
def flag_empty(inputs, attributes=None, **_):
    return out(inputs[IN].withColumns({f"{a}_na": F.col(a).isNull() for a in names(need(attributes, "attributes"))}))


@operator("extract-from-array")
def extract_from_array(inputs, attributes=None, indexes="0", **_):
    wanted = [int(i) for i in (indexes.split(",") if isinstance(indexes, str) else indexes)]
    return out(inputs[IN].withColumns({f"{a}_{i}" if i >= 0 else f"{a}_n{-i}": _array_get(i)(F.col(a)) for a in names(need(attributes, "attributes")) for i in wanted}))


_UNITS = {"year": "YEAR", "month": "MONTH", "week": "WEEK", "day": "DAY", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND"}


@operator("date-add")
def date_add(inputs, attributes=None, unit="day", value=1, alias=None, **_):
    return out(inputs[IN].withColumns({alias or a: F.timestamp_add(_UNITS[unit.rstrip("s")], F.lit(int(value)), F.col(a)) for a in names(need(attributes, "attributes"))}))


@operator("date-diff")
def date_diff(inputs, attributes=None, alias="diff", type="now", unit="day", date_attribute=None, value=None, invert=False, **_):  # noqa: A002
    other = F.current_timestamp() if type == "now" else F.lit(value).cast("timestamp") if type == "constant" else F.col(need(date_attribute, "date_attribute"))
    a = F.col(names(need(attributes, "attributes"))[0])
    first, second = (other, a) if flag(invert) else (a, other)
    return out(inputs[IN].withColumn(alias, F.timestamp_diff(_UNITS[unit.rstrip("s")], first, second)))


