"""Queries over whole tables for further operators, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions.expressions import binary, call, ident
from tessera.operators.registry import run
from tessera.queries import by_slug, op, query, table, two

_O, _C, _P, _L, _E = "orders", "customer", "part", "lineitem", "events"

# --- rows and columns

by_slug("select_columns", _C, "select", "SELECT c_custkey, c_acctbal FROM customer", attributes=["c_custkey", "c_acctbal"])
by_slug("rename_verb", _C, "rename", "SELECT c_custkey AS id, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer", attributes=[{"attribute": "c_custkey", "alias": "id"}])
by_slug("discard_verb", _C, "discard", "SELECT c_custkey, c_name FROM customer", attributes=["c_nationkey", "c_acctbal", "c_mktsegment"])
by_slug("add_by_formula", _L, "add-by-formula", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem", ["l_orderkey", "l_linenumber", "net"], formula=[{"alias": "net", "tree": binary("*", ident("l_extendedprice"), binary("-", 1, ident("l_discount")))}])
by_slug("flag_with_formula", _L, "flag-with-formula", "SELECT l_orderkey, l_linenumber, l_quantity > 25 AS many FROM lineitem", ["l_orderkey", "l_linenumber", "many"], formula=[{"alias": "many", "tree": binary(">", ident("l_quantity"), 25)}])
by_slug("find_replace", _C, "find-replace", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'HOUSING' ELSE c_mktsegment END AS c_mktsegment FROM customer", ["c_custkey", "c_mktsegment"], attributes=["c_mktsegment"], find="BUILDING", replace="HOUSING")
by_slug("change_attribute", _C, "change-attribute", "SELECT c_custkey, c_nationkey::VARCHAR AS new_c_nationkey FROM customer", ["c_custkey", "new_c_nationkey"], attributes=["c_nationkey"], new_name="new_{}", new_data_type="character")
by_slug("remove_missing", "documents", "remove-missing", "SELECT doc_id, source FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL", ["doc_id", "source"], attributes=["text", "lang"])
by_slug("flag_empty", "documents", "flag-empty", "SELECT doc_id, lang IS NULL AS lang_na, text IS NULL AS text_na FROM documents", ["doc_id", "lang_na", "text_na"], attributes=["lang", "text"])
by_slug("balance_rows", _E, "balance-data", "SELECT event_id, event_type FROM events", ["event_id", "event_type"], partitions=5)
by_slug("table_lookup", "customer nation", "table-lookup", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey", ["c_custkey", "n_name"], left_attributes=["c_nationkey"], right_attributes=["n_nationkey"])
by_slug("group_verb", _O, "group", "SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS first FROM orders GROUP BY ALL", attributes=["o_orderstatus"], function=[{"attribute": "*", "f": "count", "alias": "n"}, {"attribute": "o_orderkey", "f": "min", "alias": "first"}])
by_slug("remove_duplicated_rows", _O, "remove-duplicated-rows", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", ["o_orderstatus", "o_orderpriority"], attributes=["o_orderstatus", "o_orderpriority"])
by_slug("sort_rows", "nation", "sort", "SELECT * FROM nation", attributes=[{"attribute": "n_name", "f": "desc"}])


@query("SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1) % 1 AS zero, c_name FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS i FROM orders) JOIN (SELECT *, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS i FROM customer) USING (i)")
def positional_sides(spark, sf_dir):
    """The n-th order by price beside the n-th customer by balance; the orders beyond the last customer go."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    df = op(two(o, c), "add-columns", order_by=[["o_totalprice", "o_orderkey"], ["c_acctbal", "c_custkey"]], aliases=",")
    return df.select("o_orderkey", "o_totalprice", F.lit(0).cast("long").alias("zero"), "c_name")


@query("WITH l AS (SELECT l_orderkey, l_linenumber, l_extendedprice, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem), r AS (SELECT l_orderkey, l_linenumber, l_quantity, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS i FROM lineitem) SELECT l.l_orderkey AS a_l_orderkey, l.l_linenumber AS a_l_linenumber, r.l_orderkey AS b_l_orderkey, r.l_quantity AS b_l_quantity FROM l JOIN r USING (i)")
def positional_lines(spark, sf_dir):
    """All lines in one order beside all lines in another."""
    lines = table(spark, sf_dir, "lineitem")
    left = lines.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey")
    right = lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_partkey", "l_suppkey")
    df = op(two(left, right), "add-columns", order_by=[["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]], aliases="a_,b_")
    return df.select("a_l_orderkey", "a_l_linenumber", "b_l_orderkey", "b_l_quantity")


@query("SELECT o_orderkey, o_totalprice FROM orders")
def split_halves(spark, sf_dir):
    """Both parts of a random split together are the table."""
    made = run("split", {"input data": table(spark, sf_dir, "orders")}, weights=30, seed=4)
    return made["split 1"].unionByName(made["split 2"]).select("o_orderkey", "o_totalprice")


@query("SELECT ntile AS fold, count(*) AS n FROM (SELECT ntile(7) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS ntile, o_orderstatus FROM orders) GROUP BY ntile, o_orderstatus")
def kfold_stratified(spark, sf_dir):
    """Sizes of random folds within each status, which luck does not change."""
    made = op(table(spark, sf_dir, "orders"), "split-k-fold", k_fold=7, type="stratified", label="o_orderstatus", seed=3)
    return made.groupBy("fold", "o_orderstatus").agg(F.count("*").alias("n")).select("fold", "n")


by_slug("sliding_window_whole", _O, "sliding-window", "WITH t AS (SELECT o_orderkey, o_totalprice AS v1, lead(o_totalprice, 1) OVER w AS v2, lead(o_totalprice, 3) OVER w AS v3, row_number() OVER w - 1 AS i FROM orders WINDOW w AS (ORDER BY o_orderkey)) SELECT o_orderkey, v1, v2, v3 FROM t WHERE v3 IS NOT NULL AND i % 2 = 0", ["o_orderkey", "v1", "v2", "v3"], attribute="o_totalprice", alias="v", window_size=3, window_gap=2, window_pass=2, order_by=["o_orderkey"])


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM (SELECT * FROM orders LIMIT 1000)")
def sample_value(spark, sf_dir):
    """An exact number of rows at random; which ones depends on the seed, how many does not."""
    return op(table(spark, sf_dir, "orders"), "sample", type="value", value=1000, seed=1).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


# --- verbs

for _slug, _sql, _more in (
    ("to-lower", "lower(c_mktsegment)", {}), ("to-upper", "upper(c_mktsegment)", {}), ("capitalize", "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])", {}), ("initcap", "upper(c_mktsegment[1]) || lower(c_mktsegment[2:])", {}), ("trim", "trim(c_mktsegment)", {}),
    ("extract-with-regex", "regexp_extract(c_mktsegment, '([A-Z])U', 1)", {"regex": "([A-Z])U", "group": 1}), ("regexp_extract", "regexp_extract(c_mktsegment, '([A-Z])U', 1)", {"regex": "([A-Z])U"}), ("replace-with-regex", "regexp_replace(c_mktsegment, '[AEIOU]+', '-', 'g')", {"regex": "[AEIOU]+", "value": "-"}),
    ("truncate-text", "c_mktsegment[1:4]", {"characters": 4}), ("remove-accents", "strip_accents(c_mktsegment)", {}), ("normalize", "lower(strip_accents(c_mktsegment))", {}), ("normalize-text", "lower(strip_accents(c_mktsegment))", {}),
    ("nlp-lower-case", "lower(c_mktsegment)", {"alias": "c_mktsegment"}), ("normalizer", "trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', ' ', 'g'))", {"alias": "c_mktsegment"}),
):
    by_slug(f"verb_{_slug.replace('-', '_')}", _C, _slug, f"SELECT c_custkey, {_sql} AS c_mktsegment FROM customer", ["c_custkey", "c_mktsegment"], attributes=["c_mktsegment"], **_more)

by_slug("verb_round_number", _P, "round-number", "SELECT p_partkey, round(p_retailprice, 1) AS p_retailprice FROM part", ["p_partkey", "p_retailprice"], attributes=["p_retailprice"], decimals=1)
by_slug("verb_split_into_words", _P, "split-into-words", "SELECT p_partkey, array_to_string(regexp_split_to_array(p_name, '\\s+'), '|') AS p_name FROM part", ["p_partkey", "array_join(p_name, '|') AS p_name"], attributes=["p_name"])
by_slug("verb_ts_to_date", _O, "ts-to-date", "SELECT o_orderkey, strftime(make_timestamp(o_custkey * 1000000), '%Y-%m-%d %H:%M:%S') AS o_custkey FROM orders", ["o_orderkey", "o_custkey"], attributes=["o_custkey"])
by_slug("verb_format_date", _O, "format-date", "SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS o_orderdate FROM orders", ["o_orderkey", "o_orderdate"], attributes=["o_orderdate"], format="dd/MM/yyyy")
by_slug("verb_truncate_date_to", _O, "truncate-date-to", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS d FROM orders", ["o_orderkey", "date_format(o_orderdate, 'yyyy-MM-dd') AS d"], attributes=["o_orderdate"], unit="month")
by_slug("verb_date_part", _O, "date-part", "SELECT o_orderkey, month(o_orderdate) AS m FROM orders", ["o_orderkey", "cast(o_orderdate AS int) AS m"], attributes=["o_orderdate"], unit="months")
by_slug("verb_date_add", _O, "date-add", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') AS d FROM orders", ["o_orderkey", "date_format(later, 'yyyy-MM-dd') AS d"], attributes=["o_orderdate"], unit="days", value=3, alias="later")
by_slug("verb_date_diff", _L, "date-diff", "SELECT l_orderkey, l_linenumber, date_sub('day', TIMESTAMP '1992-01-01', l_shipdate) AS days FROM lineitem", ["l_orderkey", "l_linenumber", "days"], attributes=["l_shipdate"], alias="days", type="constant", value="1992-01-01", unit="day", invert=True)
by_slug("verb_extract_numbers", _C, "extract-numbers", "SELECT c_custkey, regexp_extract(c_name, '([0-9]+)', 1)::DOUBLE AS x FROM customer", ["c_custkey", "c_name[0] AS x"], attributes=["c_name"])


def _words(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("w"))


def on_words(name: str, slug: str, sql: str, column: str = "w", **params):
    """Register a query that gives the words of part names to a verb on arrays."""

    def f(spark, sf_dir):
        return op(_words(spark, sf_dir), slug, attributes=["w"], **params).selectExpr("p_partkey", f"{column} AS x")

    f.__name__ = name
    query(f"WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT p_partkey, {sql} AS x FROM t")(f)


on_words("verb_concat_array", "concat-array", "array_to_string(w, '+')", delimiter="+")
on_words("verb_sort_array", "sort-array", "array_to_string(list_sort(w), '|')", "array_join(w, '|')")
on_words("verb_extract_from_array", "extract-from-array", "w[1]", "w_0", indexes="0")
on_words("verb_change_array_type", "change-array-type", "length(w)", "size(w)", new_type="string")
on_words("verb_n_grams", "n-grams", "CASE WHEN length(w) >= 2 THEN array_to_string(list_transform(range(1, length(w)), lambda i: w[i] || ' ' || w[i + 1]), '|') ELSE '' END", "array_join(g, '|')", alias="g", n=2)
on_words("stop_words_listed", "remove-stop-words", "array_to_string(list_filter(w, lambda x: lower(x) NOT IN ('a', 'of', 'the')), '|')", "array_join(k, '|')", alias="k", stop_word_list="a,of,the")


@query("SELECT o_orderkey, o_totalprice <= 100000 AS big FROM orders")
def verb_invert_boolean(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("big"))
    return op(df, "invert-boolean", attributes=["big"])


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def verb_parse_to_date(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("d"))
    return op(df, "parse-to-date", attributes=["d"], format="dd/MM/yyyy").select("o_orderkey", F.date_format("d", "yyyy-MM-dd").alias("d"))


@query("SELECT o_orderkey, epoch(date_trunc('day', o_orderdate))::BIGINT AS d FROM orders")
def verb_date_to_ts(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return op(df, "date-to-ts", attributes=["d"])


# --- features: what an estimator learns, spelt out in SQL


@query("WITH c AS (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM customer GROUP BY 1) SELECT c_custkey, i::DOUBLE AS seg FROM customer JOIN c USING (c_mktsegment)")
def string_indexer(spark, sf_dir):
    return op(table(spark, sf_dir, "customer"), "string-indexer", attributes=["c_mktsegment"], alias="seg").select("c_custkey", "seg")


@query("SELECT c_custkey, c_mktsegment AS back FROM customer")
def index_to_string(spark, sf_dir):
    made = op(table(spark, sf_dir, "customer"), "feature-indexer", attributes=["c_mktsegment"], alias="seg")
    return op(made, "index-to-string", attributes=["seg"], alias="back").select("c_custkey", "back")


@query("WITH c AS (SELECT c_mktsegment, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) - 1 AS i FROM customer GROUP BY 1) SELECT c_custkey, array_to_string(list_transform(range(5), lambda k: CASE WHEN k = i THEN '1' ELSE '0' END), ' ') AS v FROM customer JOIN c USING (c_mktsegment)")
def one_hot(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    made = op(table(spark, sf_dir, "customer"), "one-hot-encoding", attributes=["c_mktsegment"], alias="v")
    return made.select("c_custkey", F.array_join(F.transform(F.slice(vector_to_array("v"), 1, 5), lambda x: x.cast("int").cast("string")), " ").alias("v"))


@query("SELECT p_partkey, p_size::DOUBLE AS f1, p_retailprice AS f2 FROM part")
def features_there_and_back(spark, sf_dir):
    made = op(table(spark, sf_dir, "part"), "feature-assembler", attributes=["p_size", "p_retailprice"], alias="v")
    return op(made, "feature-disassembler", feature="v", alias="f", top_n=2).select("p_partkey", "f1", "f2")


def scaled(name: str, slug: str, sql: str, **params):
    """Register a query of a scaler on two columns."""

    def f(spark, sf_dir):
        from pyspark.ml.functions import vector_to_array

        made = op(table(spark, sf_dir, "part"), slug, attributes=["p_size", "p_retailprice"], alias="v", **params).withColumn("v", vector_to_array("v"))
        return made.select("p_partkey", F.round(F.col("v")[0], 6).alias("a"), F.round(F.col("v")[1], 6).alias("b"))

    f.__name__ = name
    query("SELECT p_partkey, " + ", ".join(f"round({sql.format(c=c)}, 6) AS {a}" for a, c in (("a", "p_size"), ("b", "p_retailprice"))) + " FROM part")(f)


scaled("scale_standard", "standard-scaler", "({c} - avg({c}) OVER ()) / stddev({c}) OVER ()", with_mean=True, with_std=True)
scaled("scale_max_abs", "max-abs-scaler", "{c} / max(abs({c})) OVER ()")
scaled("scale_min_max", "min-max-scaler", "({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ())")

by_slug("bucketizer", _P, "bucketizer", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 0.0 WHEN p_size < 30 THEN 1.0 ELSE 2.0 END AS p_size_bucket FROM part", ["p_partkey", "p_size_bucket"], attributes=["p_size"], splits=[0, 10, 30, 1000])
by_slug("z_score", _P, "rescale", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev(p_size) OVER (), 6) AS p_size FROM part", ["p_partkey", "round(p_size, 6) AS p_size"], type="z_score", attributes=["p_size"])


@query("SELECT p_partkey, round(p_size * 2.0 + 1, 4) AS prediction FROM part")
def linear_regression(spark, sf_dir):
    """A line through points on a line."""
    made = table(spark, sf_dir, "part").select("p_partkey", "p_size", (F.col("p_size") * 2.0 + 1).alias("y"))
    return op(made, "linear-regression-model", features=["p_size"], label="y").select("p_partkey", F.round("prediction", 4).alias("prediction"))


@query("SELECT p_partkey, CASE WHEN p_size >= 25 THEN 'big' ELSE 'small' END AS prediction FROM part")
def decision_tree(spark, sf_dir):
    """One cut tells the classes apart."""
    made = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.when(F.col("p_size") >= 25, "big").otherwise("small").alias("y"))
    return op(made, "decision-tree-classifier-model", features=["p_size"], label="y", max_bins=64).select("p_partkey", "prediction")


@query("SELECT p_partkey, (p_size // 10)::INTEGER AS p FROM part")
def decision_tree_regressor(spark, sf_dir):
    """Steps of ten."""
    made = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.floor(F.col("p_size") / 10).cast("double").alias("y"))
    df = op(made, "decision-tree-regression-model", features=["p_size"], label="y", max_bins=64, max_depth=8)
    return df.select("p_partkey", F.round("prediction").cast("int").alias("p"))


@query("SELECT CASE WHEN p_size >= 25 THEN 1 ELSE 0 END AS y, avg(p_size) AS mean, count(*) AS n FROM part GROUP BY 1")
def random_forest(spark, sf_dir):
    made = table(spark, sf_dir, "part").select("p_size", (F.col("p_size") >= 25).cast("int").alias("y"))
    df = op(made, "random-forest-classifier-model", features=["p_size"], label="y", max_bins=64, num_trees=5, seed=1)
    return df.groupBy(F.col("prediction").cast("int").alias("y")).agg(F.avg("p_size").alias("mean"), F.count("*").alias("n"))


@query("WITH m AS (SELECT p_size, avg(p_retailprice) AS y FROM part GROUP BY 1) SELECT count(*) AS n, true AS rising FROM part")
def isotonic_regression(spark, sf_dir):
    """Predictions never fall as the feature grows."""
    df = op(table(spark, sf_dir, "part"), "isotonic-regression-model", features=["p_size"], label="p_retailprice")
    by = df.groupBy("p_size").agg(F.min("prediction").alias("lo"), F.max("prediction").alias("hi"), F.count("*").alias("n"))
    other = by.select(F.col("p_size").alias("s2"), F.col("lo").alias("lo2"))
    falls = by.join(other, other["s2"] == by["p_size"] + 1).filter(F.col("lo2") < F.col("hi") - 1e-9).agg(F.count("*").alias("f"))
    return by.agg(F.sum("n").alias("n")).crossJoin(F.broadcast(falls)).select("n", (F.col("f") == 0).alias("rising"))


# --- reports


@query("""
    WITH t AS (SELECT CASE WHEN p_size >= 25 THEN 'big' ELSE 'small' END AS y, CASE WHEN p_size >= 30 THEN 'big' ELSE 'small' END AS p FROM part),
    c AS (SELECT DISTINCT y AS class FROM t)
    SELECT class, count_if(y = class) AS support, count_if(y = class AND p = class) / count_if(p = class) AS "precision", count_if(y = class AND p = class) / count_if(y = class) AS recall,
           2.0 * count_if(y = class AND p = class) / (count_if(p = class) + count_if(y = class)) AS f1
    FROM t, c GROUP BY class
""")
def classification_report(spark, sf_dir):
    s = F.col("p_size")
    made = table(spark, sf_dir, "part").select(F.when(s >= 25, "big").otherwise("small").alias("y"), F.when(s >= 30, "big").otherwise("small").alias("p"))
    return op(made, "classification-report", label_attribute="y", prediction_attribute="p")


@query("SELECT 'rmse' AS metric, round(sqrt(avg((p_size - 25) * (p_size - 25))), 6) AS value FROM part UNION ALL SELECT 'mae', round(avg(abs(p_size - 25)), 6) FROM part UNION ALL SELECT 'mse', round(avg((p_size - 25) * (p_size - 25)), 6) FROM part UNION ALL SELECT 'mape', round(avg(abs((p_size - 25) / p_size)), 6) FROM part WHERE p_size <> 0")
def evaluate_regression(spark, sf_dir):
    made = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("label"), F.lit(25.0).alias("prediction"))
    parts = [op(made, "evaluate-model", metric=m).select("metric", F.round("value", 6).alias("value")) for m in ("rmse", "mae", "mse", "mape")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT (p_size >= 25)::INTEGER::VARCHAR AS label, (p_size >= 30)::INTEGER::VARCHAR AS prediction, count(*) AS n FROM part GROUP BY ALL")
def confusion_matrix(spark, sf_dir):
    s = F.col("p_size")
    made = table(spark, sf_dir, "part").select((s >= 25).cast("int").cast("double").alias("label"), (s >= 30).cast("int").cast("double").alias("prediction"))
    df = run("evaluate-model", {"input data": made}, metric="f1")["confusion matrix"]
    return df.select(F.col("label").cast("double").cast("int").cast("string").alias("label"), F.col("prediction").cast("double").cast("int").cast("string").alias("prediction"), "n")


@query("""
    WITH t AS (SELECT p_size AS s, (p_size % 4 > 1)::INTEGER AS y FROM part), g AS (SELECT s, sum(y) AS p, count(*) - sum(y) AS n FROM t GROUP BY s),
    r AS (SELECT s, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS ap, sum(n) OVER () AS an FROM g WINDOW w AS (ORDER BY s DESC))
    SELECT s::DOUBLE AS threshold, round(fp / an, 8) AS fpr, round(tp / ap, 8) AS tpr, round(tp / (tp + fp), 8) AS "precision" FROM r
""")
def roc_curve(spark, sf_dir):
    made = table(spark, sf_dir, "part").select(F.col("p_size").cast("double").alias("score"), (F.col("p_size") % 4 > 1).cast("int").alias("y"))
    df = run("evaluate-model", {"input data": made}, metric="curves", label_attribute="y", prediction_attribute="score")["curves"]
    return df.select("threshold", *(F.round(c, 8).alias(c) for c in ("fpr", "tpr", "precision")))


by_slug("ccdf", _P, "ccdf", "SELECT p_partkey, round(sum(p_retailprice) OVER (ORDER BY p_retailprice DESC, p_partkey DESC ROWS UNBOUNDED PRECEDING) / sum(p_retailprice) OVER (), 8) AS c FROM part", ["p_partkey", "round(c, 8) AS c"], attributes=["p_retailprice"], alias="c", order_by=["p_retailprice", "p_partkey"])


@query("""
    WITH b AS (SELECT l_partkey % 40 AS item, l_orderkey FROM lineitem GROUP BY ALL), n AS (SELECT count(DISTINCT l_orderkey) AS n FROM b),
    one AS (SELECT item::VARCHAR AS items, count(*) AS freq FROM b GROUP BY 1), two AS (SELECT CASE WHEN a.item::VARCHAR < c.item::VARCHAR THEN a.item || '|' || c.item ELSE c.item || '|' || a.item END AS items, count(*) AS freq FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.item < c.item GROUP BY 1)
    SELECT items, freq, round(freq / n, 8) AS support FROM (SELECT * FROM one UNION ALL SELECT * FROM two), n WHERE freq >= 0.005 * n
""")
def frequent_items(spark, sf_dir):
    """Items and pairs; larger sets are left out of the comparison by their size, none is that frequent in these tables' pairs."""
    baskets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set((F.col("l_partkey") % 40).cast("string")).alias("items"))
    df = op(baskets, "frequent-item-set", attribute="items", min_support=0.005)
    return df.filter(F.size("items") <= 2).select(F.array_join("items", "|").alias("items"), "freq", F.round("support", 8).alias("support"))


@query("""
    WITH s AS (SELECT c_mktsegment AS x, count(*) / (SELECT count(*) FROM customer) AS sx FROM customer GROUP BY 1),
    pair AS (SELECT c_mktsegment AS x, 'n' || (c_nationkey % 3) AS y, count(*) / (SELECT count(*) FROM customer) AS sxy FROM customer GROUP BY ALL),
    t AS (SELECT 'n' || (c_nationkey % 3) AS y, count(*) / (SELECT count(*) FROM customer) AS sy FROM customer GROUP BY 1)
    SELECT a, c, round(support, 8) AS support, round(support / sa, 8) AS confidence, round(support / sa / sc, 6) AS lift
    FROM (SELECT x AS a, y AS c, sxy AS support, sx AS sa, sy AS sc FROM pair JOIN s USING (x) JOIN t USING (y) UNION ALL SELECT y, x, sxy, sy, sx FROM pair JOIN s USING (x) JOIN t USING (y))
""")
def association_rules_of_pairs(spark, sf_dir):
    baskets = table(spark, sf_dir, "customer").select(F.array("c_mktsegment", F.concat(F.lit("n"), F.col("c_nationkey") % 3)).alias("items"))
    sets = op(baskets, "frequent-item-set", attribute="items", min_support=0.0001)
    df = op(sets, "association-rules", attribute="items", freq="support", confidence=0.0, rules_count=1000)
    return df.select(F.col("antecedent")[0].alias("a"), F.col("consequent")[0].alias("c"), F.round("support", 8).alias("support"), F.round("confidence", 8).alias("confidence"), F.round("lift", 6).alias("lift"))


@query("""
    WITH l AS (SELECT DISTINCT o_custkey % 50 AS s, o_orderkey % 50 AS d FROM orders), n AS (SELECT s, count(*) AS n FROM l GROUP BY s), p AS (SELECT s AS page FROM l UNION SELECT d FROM l),
    r1 AS (SELECT page, 0.15 + 0.85 * coalesce((SELECT sum(1.0::DOUBLE / n.n) FROM l JOIN n ON l.s = n.s WHERE l.d = page), 0) AS rank FROM p),
    r2 AS (SELECT page, 0.15 + 0.85 * coalesce((SELECT sum(r1.rank / n.n) FROM l JOIN n ON l.s = n.s JOIN r1 ON r1.page = l.s WHERE l.d = p.page), 0) AS rank FROM p)
    SELECT page, round(rank::DOUBLE, 8) AS rank FROM r2
""")
def page_rank_two_rounds(spark, sf_dir):
    links = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("src"), (F.col("o_orderkey") % 50).alias("dst"))
    return op(links, "page-rank", maxIters=2).select("page", F.round("rank", 8).alias("rank"))


# --- charts

by_slug("chart_pie", _O, "pie-chart", "SELECT o_orderstatus, sum(o_totalprice) AS total FROM orders GROUP BY 1", x=["o_orderstatus"], y=[{"attribute": "o_totalprice", "aggregation": "SUM", "alias": "total"}])
by_slug("chart_bar", _O, "bar-chart", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1", x=["o_orderpriority"], y=[{"attribute": "*", "aggregation": "COUNT", "alias": "n"}])
by_slug("chart_line", _O, "line-chart", "SELECT floor(o_totalprice / 50000) * 50000 AS o_totalprice, count(*) AS n FROM orders GROUP BY 1", x=[{"attribute": "o_totalprice", "binning": "FIXED_SIZE", "binSize": 50000}], y=[{"attribute": "*", "aggregation": "COUNT", "alias": "n"}])
by_slug("chart_scatter", _P, "scatter-plot", "SELECT p_size, p_retailprice FROM part", x=["p_size"], y=["p_retailprice"])
by_slug("chart_area", _P, "area-chart", "SELECT p_size, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1", x=["p_size"], y=[{"attribute": "p_retailprice", "aggregation": "MIN", "alias": "lo"}, {"attribute": "p_retailprice", "aggregation": "MAX", "alias": "hi"}])
by_slug("table_view", _P, "table-visualization", "SELECT p_partkey, p_name FROM part", attributes=["p_partkey", "p_name"], limit=10_000_000)
by_slug("frequency_table_brands", _P, "frequency-table", "SELECT p_brand AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10", attributes=["p_brand"], top=10)
by_slug("quantile_table_sizes", _P, "quantile-table", "SELECT 'p_size' AS attribute, unnest([0.25, 0.5, 0.75]) AS quantile, unnest([quantile_cont(p_size, 0.25), quantile_cont(p_size, 0.5), quantile_cont(p_size, 0.75)]) AS value FROM part", attributes=["p_size"], quantiles=(0.25, 0.5, 0.75))
by_slug("chart_filled", _P, "bar-chart", "WITH a AS (SELECT DISTINCT p_brand FROM part), b AS (SELECT DISTINCT p_size FROM part) SELECT a.p_brand, b.p_size, count(p_partkey) AS n, coalesce(sum(p_retailprice), 0) AS total FROM a CROSS JOIN b LEFT JOIN part c ON c.p_brand = a.p_brand AND c.p_size = b.p_size GROUP BY ALL", ["p_brand", "p_size", "n", "total"], x=["p_brand", {"attribute": "p_size", "sorting": "NATURAL"}], y=[{"attribute": "*", "aggregation": "COUNT", "alias": "n"}, {"attribute": "p_retailprice", "aggregation": "SUM", "alias": "total"}], fill_missing=True)
