"""Connected components of a link table that never leaves the executors."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize


#: Links that one task may hold.
FEW = 50_000


def _contract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links: at most one link (node, smallest node of its tree) per node stays."""
    parent: dict = {}

    def root(x):
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    kind, names = None, ("a", "b")
    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                a, b = max(a, b), min(a, b)
                parent[a] = b
                parent.setdefault(b, b)
    pairs = [(x, r) for x in parent if (r := root(x)) != x]
    for at in range(0, len(pairs), 50_000):
        part = pairs[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in part], type=kind) for i in (0, 1)], names=names)


def connected_components(spark: SparkSession, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links(a, b)``; component is the smallest node that can be reached.

    Each partition first contracts its links to a forest; then alternating large-star and small-star rounds, each
    written to the shared folder, run until nothing changes; ``FEW`` links and fewer are settled by one task at once. A node's minimum is found with map-side combining, written,
    and joined back between two plain exchanges, so a hub's links can be split between tasks. Empty input gives an empty table; links with a null end
    and self-links are ignored.
    """
    kind = links.schema[0].dataType.simpleString()
    links = links.toDF("a", "b").filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = materialize(spark, links.mapInArrow(_contract, f"a {kind}, b {kind}"), "links")
    print_of = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.expr("sum(cast(hash(a, b) as bigint))")).first()
        if now[0] == 0 or now == print_of:
            break
        if now[0] <= FEW:
            edges = materialize(spark, edges.coalesce(1).mapInArrow(_contract, f"a {kind}, b {kind}"), "links")
            break
        print_of = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(spark, both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = materialize(spark, large, "large-star")
        least = materialize(spark, large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # a itself also hangs on its minimum; where b is the minimum that row is already there
        edges = materialize(spark, small.distinct(), "small-star")
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
