"""Queries over whole tables for the engine's operators, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"a query named {f.__name__} is there already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, sum(l_extendedprice) AS sum_base_price,
           sum(l_extendedprice * (1 - l_discount)) AS sum_disc_price, avg(l_discount) AS avg_disc, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("2001-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"),
        F.sum("l_extendedprice").alias("sum_base_price"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("sum_disc_price"),
        F.avg("l_discount").alias("avg_disc"),
        F.count("*").alias("count_order"),
    )


# --- operators by slug


def op(df: DataFrame | dict, slug: str, **params) -> DataFrame:
    from tessera.operators.registry import run

    inputs = df if isinstance(df, dict) else {"input data": df}
    return run(slug, inputs, **params)["output data"]


def two(a: DataFrame, b: DataFrame) -> dict:
    return {"input data 1": a, "input data 2": b}


def by_slug(name: str, tables: str, slug: str, sql: str | None, columns: list[str] | None = None, **params):
    """Register a query that gives one table, or two, to an operator."""

    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = [table(spark, sf_dir, n) for n in tables.split()]
        df = op(t[0] if len(t) == 1 else two(*t), slug, **params)
        return df.selectExpr(*columns) if columns else df

    f.__name__ = name
    query(sql)(f)


from tessera.functions.expressions import binary, call, ident  # noqa: E402

_L, _O, _C, _E = "lineitem", "orders", "customer", "events"

by_slug("projection_include_alias", _O, "projection", "SELECT o_orderkey AS k, o_orderkey AS again, o_totalprice FROM orders", attributes=[{"attribute": "o_orderkey", "alias": "k"}, {"attribute": "o_orderkey", "alias": "again"}, "o_totalprice"])
by_slug("projection_exclude", _C, "projection", "SELECT c_custkey, c_name, c_mktsegment FROM customer", attributes=["c_acctbal", "c_nationkey"], mode="exclude")
by_slug("rename_columns", _C, "rename-attr", "SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal AS c_acctbal_renamed, c_mktsegment FROM customer", attributes=["c_custkey", "c_acctbal"], alias=["id"])
by_slug("duplicate_columns", _C, "duplicate", "SELECT *, c_name AS name2 FROM customer", attributes=[{"attribute": "c_name", "alias": "name2"}])
by_slug("drop_column", _C, "drop", "SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer", column="c_name")
by_slug("formula_columns", _L, "transformation", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS disc, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS size FROM lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "disc", "size"], expression=[{"alias": "disc", "tree": binary("*", ident("l_extendedprice"), binary("-", 1, ident("l_discount")))}, {"alias": "size", "tree": {"type": "ConditionalExpression", "test": binary(">", ident("l_quantity"), 25), "consequent": {"type": "Literal", "value": "many"}, "alternate": {"type": "Literal", "value": "few"}}}])
by_slug("cast_coerce", _E, "cast", "SELECT event_id, TRY_CAST(event_type AS INTEGER) AS event_type FROM events", ["event_id", "event_type"], cast_attributes=[{"attribute": "event_type", "type": "Integer"}])
by_slug("cast_move_invalid", _O, "cast", "SELECT o_orderkey, TRY_CAST(o_orderpriority AS INTEGER) AS o_orderpriority, CASE WHEN TRY_CAST(o_orderpriority AS INTEGER) IS NULL THEN o_orderpriority END AS o_orderpriority_invalid FROM orders", ["o_orderkey", "o_orderpriority", "o_orderpriority_invalid"], cast_attributes=[{"attribute": "o_orderpriority", "type": "Integer"}], errors="move")
by_slug("replace_value", _O, "replace-value", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS o_orderstatus FROM orders", ["o_orderkey", "o_orderstatus"], attributes=["o_orderstatus"], value="F", replacement="done")
by_slug("replace_nullify", _O, "replace-value", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders", ["o_orderkey", "o_orderstatus"], attributes=["o_orderstatus"], value="F", nullify=True)
by_slug("filter_simple", _L, "filter-selection", "SELECT * FROM lineitem WHERE l_quantity >= 30 AND l_returnflag = 'R'", filter=[{"attribute": "l_quantity", "f": ">=", "value": "30"}, {"attribute": "l_returnflag", "f": "==", "value": "R"}])
by_slug("filter_tree", _L, "filter", "SELECT * FROM lineitem WHERE (l_tax > 0.05 OR NOT (l_discount < 0.02)) AND l_quantity < 10", formula={"type": "LogicalExpression", "operator": "&&", "left": {"type": "LogicalExpression", "operator": "||", "left": binary(">", ident("l_tax"), 0.05), "right": {"type": "UnaryExpression", "operator": "!", "argument": binary("<", ident("l_discount"), 0.02)}}, "right": binary("<", ident("l_quantity"), 10)})
by_slug("filter_in", _C, "user-filter", "SELECT * FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 100.5", filters=[{"name": "c_mktsegment", "op": "in", "value": "BUILDING,MACHINERY"}, {"name": "c_acctbal", "op": "gt", "value": "100.5", "type": "DECIMAL"}, {"name": "c_name", "op": "eq"}])
by_slug("filter_date", _O, "user-filter", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'", filters=[{"name": "o_orderdate", "op": "ge", "value": "2000-01-01", "type": "DATE", "multiplicity": "ONE"}])
by_slug("force_range", _L, "force-range", "SELECT l_orderkey, l_partkey, l_linenumber, greatest(10, least(20, l_quantity)) AS l_quantity FROM lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"], attributes="l_quantity", start=10, end=20)


def _holes(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.when(F.col("l_quantity") > 10, F.col("l_tax")).alias("tax"), F.when(F.col("l_quantity") > 20, F.col("l_returnflag")).alias("flag"), F.when(F.col("l_quantity") > 20, F.col("l_quantity")).alias("qty"))


_HOLES = "h AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity > 10 THEN l_tax END AS tax, CASE WHEN l_quantity > 20 THEN l_returnflag END AS flag, CASE WHEN l_quantity > 20 THEN l_quantity END AS qty FROM lineitem)"
_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _cleaned(name, sql, **params):
    def f(spark, sf_dir):
        return op(_holes(spark, sf_dir), "clean-missing", **params)

    f.__name__ = name
    query(f"WITH {_HOLES} {sql}")(f)


_cleaned("clean_value", f"SELECT {_KEYS}, coalesce(tax, -1) AS tax, flag, qty FROM h", attributes="tax", cleaning_mode="VALUE", value=-1)
_cleaned("clean_mode", f"SELECT {_KEYS}, tax, coalesce(flag, (SELECT flag FROM h WHERE flag IS NOT NULL GROUP BY flag ORDER BY count(*) DESC, flag LIMIT 1)) AS flag, qty FROM h", attributes="flag", cleaning_mode="MODE")
_cleaned("clean_median", f"SELECT {_KEYS}, tax, flag, coalesce(qty, (SELECT median(qty) FROM h)) AS qty FROM h", attributes="qty", cleaning_mode="MEDIAN")
_cleaned("clean_remove_row", "SELECT * FROM h WHERE tax IS NOT NULL AND flag IS NOT NULL", attributes=["tax", "flag"], cleaning_mode="REMOVE_ROW")
_cleaned("clean_remove_column", f"SELECT {_KEYS}, tax, qty FROM h", attributes=["flag", "l_orderkey"], cleaning_mode="REMOVE_COLUMN", min_missing_ratio=0.1, max_missing_ratio=0.9)

for _name, _how, _sql in (
    ("join_inner", "inner", "JOIN"),
    ("join_left", "left_outer", "LEFT JOIN"),
    ("join_right", "right_outer", "RIGHT JOIN"),
    ("join_full", "full_outer", "FULL JOIN"),
):

    def _join(spark, sf_dir, how=_how):
        a = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select("c_custkey", "c_name")
        b = table(spark, sf_dir, "orders").filter("o_totalprice > 200000").select("o_orderkey", "o_custkey")
        return op(two(a, b), "join", left_attributes=["c_custkey"], right_attributes=["o_custkey"], join_type=how)

    _join.__name__ = _name
    query(f"SELECT c_custkey, c_name, o_orderkey, o_custkey FROM (SELECT * FROM customer WHERE c_acctbal > 0) {_sql} (SELECT * FROM orders WHERE o_totalprice > 200000) ON c_custkey = o_custkey")(_join)

by_slug("join_semi", "customer orders", "join", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)", left_attributes=["c_custkey"], right_attributes=["o_custkey"], join_type="leftsemi")
by_slug("join_anti", "part customer", "join", "SELECT * FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)", left_attributes=["p_partkey"], right_attributes=["c_custkey"], join_type="leftanti")
by_slug("join_selected_prefix", "nation region", "join", "SELECT n_nationkey AS a_n_nationkey, n_name AS a_n_name, n_regionkey AS a_n_regionkey, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey", join_parameters={"conditions": [{"first": "n_regionkey", "second": "r_regionkey", "op": "="}], "joinType": "inner", "firstPrefix": "a_", "firstSelectionType": 1, "secondSelectionType": 2, "secondSelect": [{"attribute": "r_name", "alias": "region"}]})
by_slug("join_theta_range", "nation region", "join", "SELECT n_nationkey, n_name, n_regionkey, r_regionkey, r_name FROM nation JOIN region ON n_regionkey < r_regionkey", join_parameters={"conditions": [{"first": "n_regionkey", "second": "r_regionkey", "op": "<"}], "joinType": "inner"})


@query("SELECT a.n_name AS n_name, b.n_nationkey AS n_nationkey FROM nation a JOIN nation b ON lower(a.n_name) = lower(b.n_name)")
def join_case_insensitive(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return op(two(n.select("n_name"), n.select(F.lower("n_name").alias("name"), "n_nationkey")), "join", left_attributes=["n_name"], right_attributes=["name"], match_case=False, keep_right_keys=False)


@query("WITH a AS (SELECT n_name, row_number() OVER (ORDER BY n_name) AS i FROM nation), b AS (SELECT r_name, row_number() OVER (ORDER BY r_name) AS i FROM region) SELECT n_name AS ds0_n_name, r_name AS ds1_r_name FROM a JOIN b USING (i)")
def positional_zip(spark, sf_dir):
    return op(two(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name")), "add-columns", order_by=[["n_name"], ["r_name"]])


by_slug("agg_functions", _L, "aggregation", "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS a, min(l_tax) AS lo, max(l_tax) AS hi, count(DISTINCT l_suppkey) AS d, round(stddev(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp FROM lineitem GROUP BY l_returnflag", ["l_returnflag", "n", "round(a, 6) AS a", "lo", "hi", "d", "round(sd, 6) AS sd", "round(vp, 6) AS vp"], attributes=["l_returnflag"], function=[{"attribute": "*", "f": "count", "alias": "n"}, {"attribute": "l_quantity", "f": "avg", "alias": "a"}, {"attribute": "l_tax", "f": "min", "alias": "lo"}, {"attribute": "l_tax", "f": "max", "alias": "hi"}, {"attribute": "l_suppkey", "f": "countDistinct", "alias": "d"}, {"attribute": "l_quantity", "f": "stddev", "alias": "sd"}, {"attribute": "l_quantity", "f": "var_pop", "alias": "vp"}])
by_slug("agg_global", _O, "aggregation", "SELECT count(*) AS n, sum(DISTINCT o_custkey) AS s FROM orders", function=[{"attribute": "*", "f": "count", "alias": "n"}, {"attribute": "o_custkey", "f": "sumDistinct", "alias": "s"}])
by_slug("agg_collect", _C, "aggregation", "SELECT c_nationkey, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS s FROM customer GROUP BY c_nationkey", ["c_nationkey", "array_join(array_sort(s), ',') AS s"], attributes=["c_nationkey"], function=[{"attribute": "c_mktsegment", "f": "collect_set", "alias": "s"}])
by_slug("pivot_values", _L, "aggregation", "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS F, sum(l_quantity) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY l_returnflag", attributes=["l_returnflag"], function=[{"attribute": "l_quantity", "f": "sum", "alias": "q"}], pivot="l_linestatus", pivot_values="F,O")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def sql_rollup(spark, sf_dir):
    return op({"input data 1": table(spark, sf_dir, "lineitem")}, "execute-sql", query="WITH t AS (SELECT * FROM ds1) SELECT l_returnflag, l_linestatus, count(*) AS n FROM t GROUP BY ROLLUP (l_returnflag, l_linestatus)")


_ORDER = [{"attribute": "o_orderdate", "f": "asc"}, {"attribute": "o_orderkey", "f": "asc"}]
by_slug("win_rank_family", _O, "window-transformation", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, lag(o_orderkey, 1) OVER w AS before, lead(o_orderkey, 1) OVER w AS after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", ["o_orderkey", "rn", "rk", "dr", "nt", "before", "after"], partition_attribute=["o_custkey"], order_by=_ORDER, expressions=[{"alias": "rn", "tree": call("row_number")}, {"alias": "rk", "tree": call("rank")}, {"alias": "dr", "tree": call("dense_rank")}, {"alias": "nt", "tree": call("ntile", 4)}, {"alias": "before", "tree": call("lag", ident("o_orderkey"), 1)}, {"alias": "after", "tree": call("lead", ident("o_orderkey"), 1)}])
by_slug("win_rows_frame", _O, "window-transformation", "SELECT o_orderkey, count(o_orderkey) OVER w AS n, max(o_totalprice) OVER w AS m, first_value(o_orderkey) OVER w AS f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", ["o_orderkey", "n", "m", "f"], partition_attribute=["o_custkey"], order_by=_ORDER, type="rows", rows_from=2, rows_to=0, expressions=[{"alias": "n", "tree": call("count", ident("o_orderkey"))}, {"alias": "m", "tree": call("max", ident("o_totalprice"))}, {"alias": "f", "tree": call("first", ident("o_orderkey"))}])
by_slug("win_range_frame", _C, "window-transformation", "SELECT c_custkey, count(c_custkey) OVER (PARTITION BY c_nationkey ORDER BY c_custkey RANGE BETWEEN 100 PRECEDING AND 100 FOLLOWING) AS n FROM customer", ["c_custkey", "n"], partition_attribute=["c_nationkey"], order_by=[{"attribute": "c_custkey", "f": "asc"}], type="range", range_from=-100, range_to=100, expressions=[{"alias": "n", "tree": call("count", ident("c_custkey"))}])
by_slug("sliding_window", _O, "sliding-window", "WITH t AS (SELECT o_custkey, o_totalprice AS v1, lead(o_totalprice, 1) OVER w AS v2, lead(o_totalprice, 3) OVER w AS v3, row_number() OVER w - 1 AS i FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)) SELECT o_custkey, v1, v2, v3 FROM t WHERE v3 IS NOT NULL AND i % 2 = 0", ["o_custkey", "v1", "v2", "v3"], attribute="o_totalprice", alias="v", window_size=3, window_gap=2, window_pass=2, order_by=["o_orderkey"], partition_by=["o_custkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk_revenue(spark, sf_dir):
    t = op(table(spark, sf_dir, "orders"), "sort", attributes=[{"attribute": "o_totalprice", "f": "desc"}, {"attribute": "o_orderkey", "f": "asc"}])
    return op(t, "sample", type="head", value=100).select("o_orderkey", "o_totalprice")


by_slug("kfold_contiguous", _C, "k-fold", "SELECT c_custkey, ntile(5) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS fold FROM customer", ["c_custkey", "fold"], n_splits=5, shuffle=False, stratified=True, column="c_mktsegment", order_by=["c_custkey"])


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_all(spark, sf_dir):
    return op(two(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), table(spark, sf_dir, "region")), "add-rows")


@query("SELECT n_nationkey, n_name AS name, NULL::INTEGER AS r_regionkey FROM nation UNION ALL SELECT NULL, r_name, r_regionkey FROM region")
def union_by_name(spark, sf_dir):
    return op(two(table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name")), table(spark, sf_dir, "region").withColumnRenamed("r_name", "name")), "add-rows", by_name=True)


def _keys_of(spark, sf_dir):
    return two(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")))


@query("SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders")
def intersect_keys(spark, sf_dir):
    return op(_keys_of(spark, sf_dir), "intersection")


@query("SELECT p_partkey AS k FROM part EXCEPT SELECT c_custkey FROM customer")
def except_keys(spark, sf_dir):
    return op(two(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k")), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))), "difference")


@query("SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def except_all_keys(spark, sf_dir):
    k = _keys_of(spark, sf_dir)
    return op(two(k["input data 2"], k["input data 1"]), "difference", keep_all=True)


by_slug("dedup_by_key", _O, "distinct", "SELECT * EXCLUDE (i) FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i = 1", attributes=["o_custkey"], order_by=["o_orderkey"])


def functions_query(name: str, tbl: str, key: str, columns: dict, sql: str):
    """Register a query of expression trees over a table's rows."""
    f = {"expression": [{"alias": a, "tree": t} for a, t in columns.items()]}
    by_slug(name, tbl, "transformation", sql, [key, *columns], **f)


functions_query("fn_string", _C, "c_custkey", {
    "up": call("upper", ident("c_name")), "len": call("length", ident("c_name")), "sub": call("substring", ident("c_name"), 1, 4), "pad": call("lpad", ident("c_mktsegment"), 12, "*"),
    "rev": call("reverse", ident("c_name")), "cat": call("concat_ws", "-", ident("c_name"), ident("c_mktsegment")), "rep": call("regexp_replace", ident("c_name"), "[0-9]+", "#"), "pos": call("instr", ident("c_name"), "#"),
    "m": call("md5", ident("c_name")), "s": call("sha2", ident("c_name"), 256), "tr": call("translate", ident("c_mktsegment"), "AEIOU", "aeiou"), "lev": call("levenshtein", ident("c_mktsegment"), "BUILDING"), "punct": call("strip_punctuation", ident("c_name")),
}, "SELECT c_custkey, upper(c_name) AS up, length(c_name) AS len, substring(c_name, 1, 4) AS sub, lpad(c_mktsegment, 12, '*') AS pad, reverse(c_name) AS rev, concat_ws('-', c_name, c_mktsegment) AS cat, regexp_replace(c_name, '[0-9]+', '#', 'g') AS rep, instr(c_name, '#') AS pos, md5(c_name) AS m, sha256(c_name) AS s, translate(c_mktsegment, 'AEIOU', 'aeiou') AS tr, levenshtein(c_mktsegment, 'BUILDING') AS lev, regexp_replace(c_name, '[[:punct:]]', '', 'g') AS punct FROM customer")
_R = lambda t: call("round", t, 6)
functions_query("fn_math", "part", "p_partkey", {
    "a": _R(call("sqrt", ident("p_retailprice"))), "b": _R(call("log10", ident("p_retailprice"))), "c": _R(call("pow", ident("p_size"), 2)), "d": call("ceil", ident("p_retailprice")), "e": call("floor", ident("p_retailprice")),
    "f": _R(call("sin", ident("p_size"))), "g": _R(call("cbrt", ident("p_size"))), "h": call("abs", {"type": "UnaryExpression", "operator": "-", "argument": ident("p_size")}), "i": binary("%", ident("p_size"), 7), "j": call("greatest", ident("p_size"), 10), "k": call("signum", ident("p_retailprice")), "l": _R(call("toRadians", ident("p_size"))),
    "m": call("shiftLeft", ident("p_size"), 2), "n": call("bitwiseNOT", ident("p_size")),
}, "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS a, round(log10(p_retailprice), 6) AS b, round(pow(p_size, 2), 6) AS c, ceil(p_retailprice)::BIGINT AS d, floor(p_retailprice)::BIGINT AS e, round(sin(p_size), 6) AS f, round(cbrt(p_size), 6) AS g, abs(-p_size) AS h, p_size % 7 AS i, greatest(p_size, 10) AS j, sign(p_retailprice)::DOUBLE AS k, round(radians(p_size), 6) AS l, p_size << 2 AS m, ~p_size AS n FROM part")
functions_query("fn_date", _O, "o_orderkey", {
    "y": call("year", ident("o_orderdate")), "m": call("month", ident("o_orderdate")), "d": call("dayofmonth", ident("o_orderdate")), "q": call("quarter", ident("o_orderdate")), "dow": call("dayofweek", ident("o_orderdate")), "doy": call("dayofyear", ident("o_orderdate")), "w": call("weekofyear", ident("o_orderdate")),
    "f": call("date_format", ident("o_orderdate"), "yyyy-MM"), "ld": call("last_day", ident("o_orderdate")), "add": call("date_add", ident("o_orderdate"), 10), "dd": call("datediff", ident("o_orderdate"), call("to_date", "1995-01-01")), "t": call("date_trunc", "month", ident("o_orderdate")),
}, "SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofweek(o_orderdate) + 1 AS dow, dayofyear(o_orderdate) AS doy, weekofyear(o_orderdate) AS w, strftime(o_orderdate, '%Y-%m') AS f, last_day(o_orderdate) AS ld, (o_orderdate::DATE + 10) AS add, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS dd, date_trunc('month', o_orderdate)::TIMESTAMP AS t FROM orders")
functions_query("fn_array_json", _E, "event_id", {
    "k": call("cast", call("get_json_object", ident("props"), "$.k"), "integer"), "n": call("size", call("split", ident("event_type"), "i")), "j": call("array_join", call("sort_array", call("split", ident("event_type"), "")), ""), "c": call("array_contains", call("array", ident("event_type"), "view"), "view"), "num": call("element_at", call("extract_numbers", ident("props")), 1), "el": call("coalesce", call("element_at", call("array", 1, 2), 5), -1),
}, "SELECT event_id, json_extract_string(props, '$.k')::INTEGER AS k, len(string_split(event_type, 'i')) AS n, array_to_string(list_sort(string_split(event_type, '')), '') AS j, true AS c, regexp_extract(props, '[-+]?[0-9]+(\\.[0-9]+)?')::DOUBLE AS num, -1 AS el FROM events")


@query("SELECT time_bucket(INTERVAL 3600 SECOND, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def fn_group_datetime(spark, sf_dir):
    t = op(table(spark, sf_dir, "events"), "transformation", expression=[{"alias": "start", "tree": call("group_datetime", ident("ts"), 3600)}])
    return op(t, "aggregation", attributes=["start", "event_type"], function=[{"attribute": "*", "f": "count", "alias": "n"}])


@query("SELECT time_bucket(INTERVAL 3600 SECOND, ts) AS start, time_bucket(INTERVAL 3600 SECOND, ts) + INTERVAL 3600 SECOND AS \"end\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """The same windows over a stream of the table's files, run to its end into a table that is read back."""
    from tessera.operators.durable import scratch
    from tessera.streaming.streams import read_stream, to_table, windowed_counts

    path = f"{sf_dir}/events.parque[t]"  # a pattern, as a stream's path must not be one file
    schema = spark.read.parquet(path).schema
    stream = read_stream(spark, "parquet", path, schema).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = to_table(windowed_counts(stream, "ts", 3600, ["event_type"], value="value"), scratch(spark, "windows"), scratch(spark, "stream"))
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT unnest(['l_quantity', 'l_tax', 'l_returnflag']) AS attribute, unnest([max(l_quantity)::VARCHAR, max(l_tax)::VARCHAR, max(l_returnflag)]) AS max, count(*) AS count, unnest([round(stddev(l_quantity), 4), round(stddev(l_tax), 4), NULL]) AS stddev, unnest([round(avg(l_quantity), 4), round(avg(l_tax), 4), NULL]) AS avg, 0 AS missing FROM lineitem")
def summary_stats(spark, sf_dir):
    return op(table(spark, sf_dir, "lineitem"), "summary-statistics", attributes=["l_quantity", "l_tax", "l_returnflag"]).select("attribute", "max", "count", "stddev", "avg", "missing")


by_slug("frequency_table", _L, "frequency-table", "SELECT l_suppkey AS value, count(*) AS count FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", attributes="l_suppkey")
by_slug("quantile_table", _O, "quantile-table", "SELECT 'o_totalprice' AS attribute, q AS quantile, round(v, 6) AS value FROM (SELECT unnest([0.25, 0.5, 0.75]) AS q, unnest(quantile_cont(o_totalprice, [0.25, 0.5, 0.75])) AS v FROM orders)", ["attribute", "quantile", "round(value, 6) AS value"], attributes=["o_totalprice"], quantiles=[0.25, 0.5, 0.75])
by_slug("histogram_equal", _L, "histogram", "WITH b AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem), c AS (SELECT least(floor((l_quantity - lo) / ((hi - lo) / 10)), 9)::INTEGER AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) SELECT 'l_quantity' AS attribute, i::INTEGER AS bin, coalesce(n, 0) AS count FROM range(10) r(i) LEFT JOIN c ON bin = i", ["attribute", "bin", "count"], attributes=["l_quantity"], bins=10)
by_slug("box_plot_groups", _L, "box-plot", "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) SELECT l_returnflag, round(any_value(q1), 4) AS q1, round(any_value(median), 4) AS median, round(any_value(q3), 4) AS q3, count(*) FILTER (l_extendedprice NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag", ["l_returnflag", "round(q1, 4) AS q1", "round(median, 4) AS median", "round(q3, 4) AS q3", "outliers"], attributes=["l_extendedprice"], group=["l_returnflag"])
by_slug("correlation_pearson", _L, "correlation", "SELECT 'l_quantity' AS attribute_a, 'l_extendedprice' AS attribute_b, round(corr(l_quantity, l_extendedprice), 6) AS correlation FROM lineitem", ["attribute_a", "attribute_b", "round(correlation, 6) AS correlation"], attributes=["l_quantity", "l_extendedprice"])
by_slug("correlation_spearman", _L, "correlation", "WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS b FROM lineitem) SELECT 'l_quantity' AS attribute_a, 'l_discount' AS attribute_b, round(corr(a, b), 6) AS correlation FROM r", ["attribute_a", "attribute_b", "round(correlation, 6) AS correlation"], attributes=["l_quantity", "l_discount"], method="spearman")
by_slug("bin_fixed", _O, "chart", "SELECT floor(o_totalprice / 50000) * 50000 AS o_totalprice, count(*) AS n FROM orders GROUP BY 1", x=[{"attribute": "o_totalprice", "binning": "FIXED_SIZE", "binSize": 50000}], y=[{"attribute": "o_orderkey", "aggregation": "COUNT", "alias": "n"}])
by_slug("top_n_others", _C, "chart", "WITH g AS (SELECT c_nationkey::VARCHAR AS k, c_nationkey AS o, count(*) AS n FROM customer GROUP BY 1, 2), t AS (SELECT * FROM g ORDER BY n DESC, o LIMIT 5) SELECT k AS c_nationkey, n FROM t UNION ALL SELECT 'others', sum(n)::BIGINT FROM g WHERE o NOT IN (SELECT o FROM t)", x=[{"attribute": "c_nationkey"}], y=[{"attribute": "c_custkey", "aggregation": "COUNT", "alias": "n"}], max_displayed=5)
by_slug("heatmap", _L, "heatmap", "SELECT l_returnflag AS row, l_linestatus AS column, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2", row_attribute="l_returnflag", column_attribute="l_linestatus", aggregation_function="max", value_attribute="l_quantity")
by_slug("pdf", _O, "pdf", "SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders), 9) AS pdf FROM orders", ["o_orderkey", "round(pdf, 9) AS pdf"], attributes="o_totalprice")
by_slug("cdf", _O, "cdf", "SELECT o_orderkey, round(sum(o_totalprice) OVER (ORDER BY o_totalprice, o_orderkey) / (SELECT sum(o_totalprice) FROM orders), 6) AS cdf FROM orders", ["o_orderkey", "round(cdf, 6) AS cdf"], attributes="o_totalprice", order_by=["o_totalprice", "o_orderkey"])
by_slug("rescale_min_max", _C, "rescale", "SELECT c_custkey, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / (SELECT max(c_acctbal) - min(c_acctbal) FROM customer), 8) AS c_acctbal FROM customer", ["c_custkey", "round(c_acctbal, 8) AS c_acctbal"], attributes=["c_acctbal"])
by_slug("anonymize", _C, "anonymize", "SELECT c_custkey, md5(c_name) AS c_name, rpad(substring(c_mktsegment, 1, 2), length(c_mktsegment)::INTEGER, '*') AS c_mktsegment FROM customer", ["c_custkey", "c_name", "c_mktsegment"], rules=[{"attribute": "c_name", "technique": "ENCRYPTION", "details": {"type": "md5"}}, {"attribute": "c_mktsegment", "technique": "GENERALIZATION", "details": {"type": "substring", "end": 2}}, {"attribute": "c_acctbal", "technique": "SUPPRESSION"}])
by_slug("expectations", _L, "validation", "SELECT * FROM (SELECT 'expect_column_values_to_be_between' AS expectation, count(*) FILTER (l_quantity > 40) AS unexpected_count, false AS success FROM lineitem UNION ALL SELECT 'expect_column_values_to_not_be_null', 0, true)", ["expectation", "unexpected_count", "success"], validations=[{"expectation": "expect_column_values_to_be_between", "column": "l_quantity", "max_value": 40}, {"expectation": "expect_column_values_to_not_be_null", "column": "l_tax"}])
by_slug("word_count", "documents", "nlp-word-counting", "SELECT word, count(*) AS count FROM (SELECT unnest(regexp_split_to_array(lower(text), '\\s+')) AS word FROM documents) WHERE word <> '' GROUP BY word", attributes="text")


@query("SELECT doc_id, len(w) AS n, array_to_string(w[1:3], ' ') AS first FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) >= 3) AS w FROM documents)")
def tokenize(spark, sf_dir):
    t = op(table(spark, sf_dir, "documents"), "tokenizer", attributes="text", alias="w")
    return t.select("doc_id", F.size("w").alias("n"), F.array_join(F.slice("w", 1, 3), " ").alias("first"))


@query("SELECT doc_id, greatest(len(w) - 1, 0) AS n, CASE WHEN len(w) >= 2 THEN w[1] || ' ' || w[2] END AS first FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: length(x) >= 3) AS w FROM documents)")
def n_grams(spark, sf_dir):
    t = op(op(table(spark, sf_dir, "documents"), "tokenizer", attributes="text", alias="w"), "generate-n-grams", attributes="w", alias="g", n=2)
    return t.select("doc_id", F.size("g").alias("n"), F.try_element_at("g", F.lit(1)).alias("first"))


_KM = "WITH t AS (SELECT {g} AS g, value AS t, event_id % 3 = 0 AS e FROM events), c AS (SELECT g, t, count(*) FILTER (e) AS d, count(*) AS n FROM t GROUP BY g, t), r AS (SELECT *, sum(n) OVER (PARTITION BY g ORDER BY t DESC) AS risk FROM c), l AS (SELECT *, CASE WHEN d < risk THEN ln(1 - d / risk) ELSE '-infinity'::DOUBLE END AS x FROM r) SELECT {s}t AS time, d AS events, risk::BIGINT AS at_risk, round(exp(sum(x) OVER (PARTITION BY g ORDER BY t)), 8) AS survival FROM l"


@query(_KM.format(g="event_type", s='g AS "group", '))
def kaplan_meier(spark, sf_dir):
    t = table(spark, sf_dir, "events").select(F.col("event_type").alias("group"), "value", (F.col("event_id") % 3 == 0).cast("int").alias("seen"))
    return op(t, "kaplan-meier-survival", duration_attribute="value", event_observed_attribute="seen", pivot_attribute=["group"]).select("group", "time", "events", "at_risk", F.round("survival", 8).alias("survival"))


@query(_KM.format(g="1", s=""))
def kaplan_meier_whole(spark, sf_dir):
    t = table(spark, sf_dir, "events").select("value", (F.col("event_id") % 3 == 0).cast("int").alias("seen"))
    return op(t, "kaplan-meier-survival", duration_attribute="value", event_observed_attribute="seen").select("time", "events", "at_risk", F.round("survival", 8).alias("survival"))


@query()
def page_rank(spark, sf_dir):
    return op(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")), "page-rank", maxIters=5)


@query()
def frequent_item_sets(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat_ws("-", "l_returnflag", "l_linenumber")).alias("items"))
    return op(t, "frequent-item-set", attribute="items", min_support=0.005)


@query()
def association_rules(spark, sf_dir):
    return op(frequent_item_sets(spark, sf_dir), "association-rules", confidence=0.1)


@query()
def k_means(spark, sf_dir):
    from tessera.operators.registry import run

    algorithm = run("k-means-clustering", {}, number_of_clusters=4, seed=1)["algorithm"]
    return run("clustering-model", {"input data": table(spark, sf_dir, "part"), "algorithm": algorithm}, features=["p_size", "p_retailprice"])["output data"].select("p_partkey", "prediction")


@query()
def logistic_regression(spark, sf_dir):
    from tessera.operators.registry import run

    t = table(spark, sf_dir, "lineitem").withColumn("y", (F.col("l_quantity") > 25).cast("int"))
    return run("logistic-regression-classifier-model", {"input data": t}, features=["l_extendedprice", "l_discount"], label="y", max_iter=10)["output data"].select("l_orderkey", "l_linenumber", "prediction")


@query("SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name")
def workflow_revenue(spark, sf_dir):
    """A graph of tasks: four readers, three joins, a filter, a formula and an aggregation."""
    from tessera.plans.workflow import run_workflow

    reader = lambda i, n: {"id": i, "operation": {"slug": "data-reader"}, "forms": {"data_source": {"value": {"url": f"{sf_dir}/{n}.parquet", "format": "PARQUET"}}}}
    task = lambda i, slug, **forms: {"id": i, "operation": {"slug": slug}, "forms": {k: {"value": v} for k, v in forms.items()}}
    flow = lambda a, b, port="input data": {"source_id": a, "target_id": b, "target_port_name": port}
    spec = {
        "variables": [{"name": "from", "value": "1996-01-01"}],
        "tasks": [
            reader("c", "customer"), reader("o", "orders"), reader("l", "lineitem"), reader("n", "nation"),
            task("f", "user-filter", filters=[{"name": "o_orderdate", "op": "ge", "value": "${from}", "type": "DATE"}, {"name": "o_orderdate", "op": "lt", "value": "1997-01-01", "type": "DATE"}]),
            task("j1", "join", left_attributes=["o_custkey"], right_attributes=["c_custkey"]), task("j2", "join", left_attributes=["l_orderkey"], right_attributes=["o_orderkey"]), task("j3", "join", left_attributes=["c_nationkey"], right_attributes=["n_nationkey"]),
            task("t", "transformation", expression=[{"alias": "r", "tree": binary("*", ident("l_extendedprice"), binary("-", 1, ident("l_discount")))}]),
            task("a", "aggregation", attributes=["n_name"], function=[{"attribute": "r", "f": "sum", "alias": "revenue"}]),
        ],
        "flows": [flow("o", "f"), flow("f", "j1", "input data 1"), flow("c", "j1", "input data 2"), flow("l", "j2", "input data 1"), flow("j1", "j2", "input data 2"), flow("j2", "j3", "input data 1"), flow("n", "j3", "input data 2"), flow("j3", "t"), flow("t", "a")],
    }
    return run_workflow(spark, spec, wanted=["a"])["a"]["output data"]


@query("SELECT upper(c_mktsegment) AS c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def explorer_steps(spark, sf_dir):
    from tessera.plans.explorer import explore

    return explore(table(spark, sf_dir, "customer"), [{"slug": "filter", "formula": binary(">", ident("c_acctbal"), 0)}, {"slug": "to-upper", "attributes": "c_mktsegment"}, {"slug": "group", "attributes": ["c_mktsegment"], "function": [{"attribute": "*", "f": "count", "alias": "n"}]}])


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def notebook_cells(spark, sf_dir):
    from tessera.plans.notebook import Notebook

    book = Notebook(spark, {"orders": table(spark, sf_dir, "orders")}, least=100000)
    book.sql("SELECT * FROM orders WHERE o_totalprice > {least}", "large_orders")
    return book.sql("SELECT o_orderpriority, count(*) AS n FROM large_orders GROUP BY o_orderpriority")


from tessera import queries_functions, queries_learning, queries_operators  # noqa: E402, F401
