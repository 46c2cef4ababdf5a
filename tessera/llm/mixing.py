"""Mixing sources to target weights by balanced sampling with the cube method.

A source is to give ``target`` words of its ``source_size``: each of its documents is taken floor(target / source_size) times
for certain and once more with the remaining probability. Which documents are, the cube method decides: the vector of
probabilities moves along directions in the null space of the balancing constraints (number of documents, number of words),
so both totals stay what they were, until in each move one document's probability has become 0 or 1.

With two constraints three documents suffice for a move, so the flight takes a chunk's documents one after another, long
ones first, and leaves at most two open, which are short. Chunks of a source fly in parallel; what they leave open flies again in fewer chunks, and in the
last chunk the landing, a choice of at most two documents, minimises the error of the word total.

Which chunk and place a document has follows from a hash of its id and size, and so do the random numbers: reruns agree
whatever the partitioning. Rows that repeat both are interchangeable.

Nulls: a null text has size 0; documents without a source are a source of their own, last in order; a null doc_id is an id
like another. A source of size 0 has target 0. Empty table: no rows.
Sizes of texts of any length are counted whole. Ties of the order by which a chunk is flown go by the hash. Further columns, whatever
their names, are carried along by ``mixed`` and play no part.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import WORD, materialize

CHUNK = 4096
WEIGHTS = (3, 1, 2)
_NEAR = 1e-9


def word_count(text: str | F.Column) -> F.Column:
    return F.regexp_count(F.coalesce(text if isinstance(text, F.Column) else F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words each source is to give: ``share`` of all words dealt out by weight, at most ``most`` times what it has; what is
    over goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        per = left / sum(weight[s] for s in free)
        full = [s for s in free if per * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: per * weight[s] for s in free}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def flight(pi: list[float], size: list[int], rng: random.Random) -> None:
    """Move ``pi`` in place; at most two entries stay strictly between 0 and 1, both totals stay."""
    open_, at, n = [], 0, len(pi)
    while True:
        while len(open_) < 3 and at < n:
            if _NEAR < pi[at] < 1 - _NEAR:
                open_.append(at)
            at += 1
        if len(open_) < 3:
            if len(open_) == 2 and size[open_[0]] == size[open_[1]]:
                move = (1.0, -1.0)
            else:
                return
        else:
            a, b, c = (size[k] for k in open_)
            move = (float(c - b), float(a - c), float(b - a))
            if not any(move):
                move = (1.0, -1.0, 0.0)
        steps = []
        for sign in (1, -1):
            steps.append(min((((1 - pi[k]) if sign * u > 0 else pi[k]) / abs(u)) for k, u in zip(open_, move, strict=True) if u))
        up, down = steps
        step = up if rng.random() * (up + down) < down else -down
        for k, u in zip(open_, move, strict=True):
            pi[k] = min(1.0, max(0.0, pi[k] + step * u))
            if pi[k] <= _NEAR or pi[k] >= 1 - _NEAR:
                pi[k] = float(round(pi[k]))
        open_ = [k for k in open_ if 0 < pi[k] < 1]


def land(pi: list[float], size: list[int]) -> None:
    """Decide what the flight left open, with the least error of the word total, then of the number of documents."""
    open_ = [k for k, p in enumerate(pi) if 0 < p < 1]
    best = None
    for choice in range(1 << len(open_)):
        off = [(choice >> i & 1) - pi[k] for i, k in enumerate(open_)]
        cost = (round(abs(sum(o * size[k] for o, k in zip(off, open_, strict=True))), 6), round(abs(sum(off)), 6), choice)
        best = cost if best is None or cost < best else best
    for i, k in enumerate(open_):
        pi[k] = float(best[2] >> i & 1)


def _fly(seed: int, level: int):
    """Rows sorted by (src, chunk, place) in; the same rows with moved probabilities out."""

    def moved(rows: list[dict]) -> pa.RecordBatch:
        pi, size = [r["pi"] for r in rows], [r["size"] for r in rows]
        first = rows[0]
        rng = random.Random(xxhash.xxh64_intdigest(f"{seed} {level} {first['src']} {first['chunk']}"))
        flight(pi, size, rng)
        if first["chunks"] == 1:
            land(pi, size)
        return pa.RecordBatch.from_pylist([r | {"pi": p} for r, p in zip(rows, pi, strict=True)], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("src", pa.int32()), ("size", pa.int64()), ("chunk", pa.int64()), ("chunks", pa.int64()), ("place", pa.int64()), ("pi", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if held and (held[0]["src"], held[0]["chunk"]) != (row["src"], row["chunk"]):
                    yield moved(held)
                    held = []
                held.append(row)
        if held:
            yield moved(held)

    return run


def decide(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, seed: int = 11, chunk: int = CHUNK) -> DataFrame:
    """From rows (doc_id long, source string, size long): those with source_size, target and copies, how often each is taken.

    The driver holds one row a source. Each level of chunks is written to the shared folder.
    """
    spark = rows.sparkSession
    rows = materialize(spark, rows.select("doc_id", "source", "size"), "sizes")
    known = [tuple(r) for r in rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect()]
    if not known:
        return rows.selectExpr("doc_id", "source", "size", "cast(0 as bigint) as source_size", "cast(0 as double) as target", "cast(0 as bigint) as copies")
    aims = targets({s: n for s, n, _ in known}, weights, share, most)
    table, chunks = [], {}
    for i, (s, n, count) in enumerate(sorted(known, key=lambda r: (r[0] is None, r[0] or ""))):
        rate = aims[s] / n if n else 0.0
        whole = math.floor(rate + _NEAR)
        table.append((s, i, n, aims[s], whole, max(0.0, rate - whole)))
        chunks[i] = -(-count // chunk)
    plan = spark.createDataFrame(table, "source string, src int, source_size long, target double, whole long, pi double")
    units = rows.join(plan, rows["source"].eqNullSafe(plan["source"])).select("doc_id", "src", "size", "pi")
    decided, level = None, 0
    while True:
        lots = spark.createDataFrame([(i, n) for i, n in chunks.items()], "src int, chunks long")
        placed = units.join(lots, "src").withColumn("place", F.xxhash64("doc_id", "size", F.lit(seed), F.lit(level))).withColumn("chunk", F.pmod(F.xxhash64("place"), F.col("chunks")))
        placed = placed.select("doc_id", "src", "size", "chunk", "chunks", "place", "pi").repartition("src", "chunk").sortWithinPartitions("src", "chunk", F.desc("size"), "place", "doc_id")
        flown = materialize(spark, placed.mapInArrow(_fly(seed, level), placed.schema), f"flight-{level}")
        done = flown.filter("pi = 0 OR pi = 1").select("doc_id", "src", "size", "pi")
        decided = done if decided is None else decided.unionByName(done)
        units = flown.filter("pi > 0 AND pi < 1").select("doc_id", "src", "size", "pi")
        chunks = {i: -(-2 * n // chunk) for i, n in chunks.items() if n > 1}
        if not chunks:
            break
        level += 1
    out = decided.join(plan.drop("pi"), "src")
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.col("pi").cast("long")).alias("copies"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count("text").alias("size"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    return decide(sized(docs), **options).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with the columns of ``docs``."""
    spark, names = docs.sparkSession, docs.columns
    decisions = decide(sized(docs), **options).groupBy(F.col("doc_id").alias("_i"), F.col("size").alias("_s")).agg(F.count("*").alias("_n"), F.sum("copies").alias("_t"))
    decisions = materialize(spark, decisions, "copies")
    at = {n: f"_c{i}" for i, n in enumerate(names)}
    own = list(at.values())
    rows = docs.toDF(*own)
    rows = rows.withColumn("_id", F.col(at["doc_id"]).cast("long")).withColumn("_size", word_count(at["text"]))
    # never broadcast: there is a decision for each document
    j = rows.join(decisions.filter("_t > 0").hint("merge"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_size") == F.col("_s")))
    repeat = lambda df, times: df.select(*own, F.explode(F.array_repeat(F.lit(1), times.cast("int"))).alias("_r")).select(own)
    out = repeat(j.filter("_n = 1"), F.col("_t"))
    if not decisions.filter("_n > 1").isEmpty():
        # rows that repeat id and size share their copies as evenly as can be
        several = j.filter("_n > 1").withColumn("_k", F.row_number().over(Window.partitionBy("_i", "_s").orderBy(F.lit(1))))
        out = out.unionByName(repeat(several, F.floor(F.col("_t") / F.col("_n")) + F.when(F.col("_k") <= F.col("_t") % F.col("_n"), 1).otherwise(0)))
    return out.toDF(*names)
