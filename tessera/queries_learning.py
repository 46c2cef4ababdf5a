"""Queries over whole tables for neighbours, clusters, models and attribute analysis, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.registry import IN, OUT, run
from tessera.queries import op, query, table

# --- neighbours and what is built on them


@query("""
    WITH d AS (SELECT a.p_partkey AS k, b.p_partkey AS o, b.p_brand, sqrt((a.p_size - b.p_size) * (a.p_size - b.p_size) + (a.p_retailprice - b.p_retailprice) * (a.p_retailprice - b.p_retailprice)) AS dist
        FROM part a JOIN part b ON a.p_partkey <> b.p_partkey),
    n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY dist, o) <= 7),
    v AS (SELECT k, p_brand, count(*) AS votes FROM n GROUP BY ALL)
    SELECT k AS p_partkey, arg_min(p_brand, {'v': -votes, 'b': p_brand}) AS prediction FROM v GROUP BY k
""")
def nearest_brands(spark, sf_dir):
    """The brand that most of the seven nearest other parts by size and price have."""
    df = table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double"))
    return run("knn-classifier", {IN: df}, features=["p_size", "p_retailprice"], label="p_brand", key="p_partkey", n_neighbors=7)[OUT].select("p_partkey", "prediction")


@query("""
    WITH d AS (SELECT a.c_custkey AS k, b.c_custkey AS o, abs(a.c_acctbal - b.c_acctbal) + abs(a.c_nationkey - b.c_nationkey) AS dist FROM customer a JOIN customer b ON a.c_custkey <> b.c_custkey),
    n AS MATERIALIZED (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY k ORDER BY dist, o) <= 5),
    r AS (SELECT k, max(dist) AS reach FROM n GROUP BY k),
    l AS MATERIALIZED (SELECT n.k, 1 / greatest(avg(greatest(dist, reach)), 1e-12) AS lrd FROM n JOIN r ON n.o = r.k GROUP BY n.k)
    SELECT n.k AS c_custkey, round(avg(o.lrd) / any_value(m.lrd), 6) AS lof FROM n JOIN l o ON n.o = o.k JOIN l m ON n.k = m.k GROUP BY n.k
""")
def outlier_factors(spark, sf_dir):
    """How much sparser than around its neighbours it is at each customer, by balance and nation in Manhattan distance."""
    df = table(spark, sf_dir, "customer")
    out = run("local-outlier-factor", {IN: df}, features=["c_acctbal", "c_nationkey"], n_neighbors=5, key="c_custkey", metric="manhattan")[OUT]
    return out.select("c_custkey", F.round("lof", 6).alias("lof"))


@query("""
    WITH g AS (SELECT *, CASE WHEN c_acctbal - lag(c_acctbal) OVER (ORDER BY c_acctbal) >= 12.345 THEN 1 ELSE 0 END AS cut FROM customer),
    s AS (SELECT *, sum(cut) OVER (ORDER BY c_acctbal) AS part FROM g),
    f AS (SELECT part, row_number() OVER (ORDER BY min(c_custkey)) - 1 AS cluster FROM s GROUP BY part)
    SELECT c_custkey, cluster::INTEGER AS cluster FROM s JOIN f USING (part)
""")
def linked_balances(spark, sf_dir):
    """Single-linkage clusters of balances: on a line, they end where the next balance is as far away as the threshold."""
    df = table(spark, sf_dir, "customer")
    return op(df, "agglomerative-clustering", attributes=["c_acctbal"], linkage="single", distance_threshold=12.345, alias="cluster", key="c_custkey").select("c_custkey", "cluster")


# --- attribute analysis


def _string_clusters_sql(table: str, column: str) -> str:
    return f"""
        WITH RECURSIVE v AS MATERIALIZED (SELECT {column} AS value, count(*) AS count, list_distinct([{column}[i : i + 2] for i in range(1, greatest(length({column}) - 1, 2))]) AS g FROM {table} WHERE {column} IS NOT NULL GROUP BY ALL),
        p AS (SELECT a.value AS a, b.value AS b, len(list_intersect(a.g, b.g)) AS common, len(a.g) + len(b.g) AS sizes FROM v a JOIN v b ON a.value <> b.value),
        l AS MATERIALIZED (SELECT a, b FROM p WHERE common >= 0.8 * (sizes - common) - 1e-12),
        r(a, b) AS (SELECT value, value FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a AS value, min(b) AS first FROM r GROUP BY a QUALIFY count(*) OVER (PARTITION BY min(b)) > 1)
        SELECT dense_rank() OVER (ORDER BY first) - 1 AS cluster, value, count FROM c JOIN v USING (value)
    """


@query(_string_clusters_sql("customer", "c_name"))
def like_names(spark, sf_dir):
    return op(table(spark, sf_dir, "customer"), "string-clusters", attributes=["c_name"])


@query(_string_clusters_sql("pages", "url"))
def like_addresses(spark, sf_dir):
    return run("attribute-analysis", {IN: table(spark, sf_dir, "pages")}, attributes=["url"], cluster=True)["clusters"]["url"]


@query("""
    WITH q AS (SELECT quantile_cont(n_chars, 0.25) AS a, quantile_cont(n_chars, 0.75) AS b FROM documents)
    SELECT 'n_chars' AS attribute, value FROM (SELECT DISTINCT n_chars::DOUBLE AS value FROM documents, q WHERE n_chars NOT BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) ORDER BY value LIMIT 10
""")
def outlying_lengths(spark, sf_dir):
    return run("attribute-analysis", {IN: table(spark, sf_dir, "documents")}, attributes=["n_chars"])["outliers"]


# --- places: customers' balances and nations as a plane


_RINGS = {"low": [[-0.5, -1000.0], [10.5, -1000.0], [10.5, 2500.0], [-0.5, 2500.0]], "wedge": [[5.5, 0.5], [24.5, 4000.5], [24.5, 9000.5], [15.5, 9000.5]], "top": [[0.5, 8000.5], [12.5, 8000.5], [6.5, 10001.5]]}


def _within_sql() -> str:
    """Even-odd ray test of every customer against every ring."""
    edges = []
    for name, ring in _RINGS.items():
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            edges.append(f"('{name}', {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)")
    return f"""
        WITH e(name, x1, y1, x2, y2) AS (VALUES {", ".join(edges)}),
        h AS (SELECT c_custkey, name FROM customer, e WHERE (y1 > c_acctbal) <> (y2 > c_acctbal) AND c_nationkey < (x2 - x1) * (c_acctbal - y1) / CASE WHEN y2 <> y1 THEN y2 - y1 ELSE 1 END + x1
            GROUP BY ALL HAVING count(*) % 2 = 1)
        SELECT c_custkey, min(name) AS name FROM customer LEFT JOIN h USING (c_custkey) GROUP BY c_custkey
    """


@query(_within_sql())
def customers_in_areas(spark, sf_dir):
    shapes = spark.createDataFrame(list(_RINGS.items()), "name string, points array<array<double>>")
    df = table(spark, sf_dir, "customer")
    out = run("within", {IN: df, "geo data": shapes}, polygon_attributes=["name"], latitude="c_acctbal", longitude="c_nationkey", key="c_custkey")[OUT]
    return out.select("c_custkey", "name")


@query("""
    WITH RECURSIVE e AS (SELECT user_id, ts, list_position(['view', 'click', 'signup', 'purchase'], event_type) - 1 AS place, row_number() OVER (PARTITION BY user_id ORDER BY ts, list_position(['view', 'click', 'signup', 'purchase'], event_type)) AS n
        FROM events WHERE event_type <> 'error'),
    w(user_id, n, reached, since) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, NULL::TIMESTAMP FROM e
        UNION ALL SELECT w.user_id, e.n, CASE WHEN place = reached THEN reached + 1 ELSE reached END, CASE WHEN place = reached THEN ts ELSE since END FROM w JOIN e ON w.user_id = e.user_id AND e.n = w.n + 1)
    SELECT user_id, max(reached) AS reached, max(since) AS since FROM w GROUP BY user_id HAVING max(reached) > 0
""")
def paths_of_users(spark, sf_dir):
    """How far each user came from a view to a purchase."""
    from tessera.streaming.streams import paths

    out = paths(table(spark, sf_dir, "events"), "user_id", "ts", "event_type", ["view", "click", "signup", "purchase"])
    return out.select("user_id", "reached", F.col("since").cast("timestamp_ntz").alias("since"))


# --- files there and back: what is written and read again is the table


def _there_and_back(df, kind: str, attributes: list[dict] | None = None, **how):
    from tessera.operators.durable import scratch

    path = scratch(df.sparkSession, f"there-and-back-{kind.lower()}")
    run("save", {IN: df}, path=path, format=kind)
    return run("data-reader", {}, spark=df.sparkSession, data_source={"url": path, "format": kind, "attributes": attributes, **how})[OUT]


@query("SELECT doc_id, text, lang, source, n_chars FROM documents")
def documents_by_csv(spark, sf_dir):
    """Texts with quotes, line ends and separators."""
    kinds = [{"name": n, "type": t} for n, t in (("doc_id", "LONG"), ("text", "CHARACTER"), ("lang", "CHARACTER"), ("source", "CHARACTER"), ("n_chars", "LONG"))]
    return _there_and_back(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars"), "CSV", kinds, is_first_line_header=True, is_multiline=True)


@query("SELECT doc_id, text, source FROM documents")
def documents_by_json(spark, sf_dir):
    kinds = [{"name": n, "type": t} for n, t in (("doc_id", "LONG"), ("text", "CHARACTER"), ("source", "CHARACTER"))]
    return _there_and_back(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "JSON", kinds)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def lines_by_orc(spark, sf_dir):
    return _there_and_back(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"), "ORC")


# --- models with a closed form, and verbs on texts that they change


@query("""
    WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag AS c, l_quantity AS a, l_linenumber::DOUBLE AS b FROM lineitem),
    t AS (SELECT c, count(*) AS n, sum(a) AS a, sum(b) AS b FROM r GROUP BY c),
    m AS (SELECT c, n, ln(n + 1.0) - ln((SELECT sum(n) FROM t) + (SELECT count(*) FROM t)) AS prior, ln(a + 1) - ln(a + b + 2) AS la, ln(b + 1) - ln(a + b + 2) AS lb FROM t)
    SELECT prediction, count(*) AS n, sum(l_linenumber) AS lines FROM (SELECT l_linenumber, arg_max(m.c, prior + r.a * la + r.b * lb) AS prediction FROM r, m GROUP BY l_orderkey, l_linenumber, l_partkey, r.a, r.b, r.c) GROUP BY prediction
""")
def naive_bayes_flags(spark, sf_dir):
    """Return flags that a multinomial naive Bayes model of quantity and line number predicts, against its counts by hand."""
    df = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_linenumber").cast("double"))
    made = run("naive-bayes-classifier-model", {IN: df}, features=["l_quantity", "line"], label="l_returnflag", smoothing=1.0)[OUT]
    return made.groupBy("prediction").agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines"))


@query("""
    WITH g AS (SELECT l_returnflag AS g, count(*) AS group_size, count(*) FILTER (s AND y) AS tp, count(*) FILTER (s AND NOT y) AS fp, count(*) FILTER (NOT s AND y) AS fn, count(*) FILTER (NOT s AND NOT y) AS tn
        FROM (SELECT l_returnflag, l_quantity > 25 AS y, l_extendedprice > 40000 AS s FROM lineitem) GROUP BY ALL)
    SELECT g.g AS "group", g.tp, g.fp, g.fn, g.tn, round(g.fp / (g.fp + g.tn), 6) AS fpr, round((g.fp / (g.fp + g.tn)) / (b.fp / (b.fp + b.tn)), 6) AS fpr_disparity, (g.fp / (g.fp + g.tn)) / (b.fp / (b.fp + b.tn)) BETWEEN 0.8 AND 1.25 AS fpr_fair
    FROM g, (SELECT * FROM g WHERE g = 'A') b
""")
def fairness_of_flags(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") > 25).cast("int").alias("y"), (F.col("l_extendedprice") > 40000).cast("int").alias("s"))
    out = op(df, "fairness-evaluator", attributes=["l_returnflag"], label="y", score="s", baseline="A")
    return out.select("group", "tp", "fp", "fn", "tn", F.round("fpr", 6).alias("fpr"), F.round("fpr_disparity", 6).alias("fpr_disparity"), "fpr_fair")


@query("SELECT doc_id, md5(trim(concat('  ', text, '   '))) AS trimmed, md5(upper(replace(text, 'ß', 'ss'))) AS upper, md5(strip_accents(text)) AS plain FROM documents")
def verbs_on_texts(spark, sf_dir):
    """Trimming blanks, upper case and removing accents where there are some."""
    df = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("  "), "text", F.lit("   ")).alias("trimmed"), F.replace("text", F.lit("ß"), F.lit("ss")).alias("upper"), F.col("text").alias("plain"))
    df = op(df, "trim", attributes=["trimmed"])
    df = op(df, "to-upper", attributes=["upper"])
    df = op(df, "remove-accents", attributes=["plain"])
    return df.select("doc_id", *(F.md5(c).alias(c) for c in ("trimmed", "upper", "plain")))


@query("SELECT true AS disjoint, true AS whole, true AS fair")
def split_is_a_partition(spark, sf_dir):
    """Both parts of a split share no row, are the table together, and have their shares within five standard deviations."""
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    made = run("split", {IN: df}, weights=30, seed=5)
    one, two = (made[p].withColumn("part", F.lit(i)) for i, p in enumerate(("splitted data 1", "splitted data 2")))
    rows = one.unionByName(two).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum(1 - F.col("part")).alias("first"))
    told = rows.agg((F.max("n") == 1).alias("disjoint"), F.count("*").alias("n"), F.sum("first").alias("k")).crossJoin(F.broadcast(df.agg(F.count("*").alias("all"))))
    return told.select("disjoint", (F.col("n") == F.col("all")).alias("whole"), (F.abs(F.col("k") - 0.3 * F.col("n")) < 5 * F.sqrt(F.col("n") * 0.21)).alias("fair"))
