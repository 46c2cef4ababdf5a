"""Near-duplicate vectors within a label, by int8 tile products with error bounds.

A vector scaled to length one is rounded to multiples of its largest component / 127; the length of what rounding removed is
kept. For two vectors with remainders e and f the cosine is at most the integer product times both scales, plus e + f + e f.
Only pairs for which this bound reaches the threshold are computed again, in double precision from the given components, and
linked if that cosine reaches the threshold.

Equal vectors of a label are one class before anything is compared. The classes of a label are dealt by hash into blocks of
about ``BLOCK``; each pair of blocks is a task's tile. A tile returns, for each class in it, how many vectors it is linked to
and one link of a spanning forest, never its pairs.

Not linked at all: vectors that are null, empty, zero or hold a null or a component that is not finite, and those without
label. Vectors of unlike length are not compared. Repeated rows are copies of one another. A null vec_id keeps its row and
counts as larger than every id. Vectors of any length are compared whole. Further columns, whatever their names, play no part.
Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices
from tessera.llm.graph import connected_components
from tessera.llm.simhash import merge_labels

BLOCK = 2048
_STRIP = 256
#: More than what rounding in double precision can add to a bound.
_SLACK = 1e-9


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and bound of the remainder's length for each row, none of them zero."""
    top = np.abs(v).max(axis=1, keepdims=True)
    unit = v / top  # keeps squares in range
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale)
    rest = unit - codes * scale
    return codes.astype(np.int8), scale[:, 0], np.sqrt((rest * rest).sum(axis=1)) + 1e-12


def cosines(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    v, w = v / np.abs(v).max(axis=1, keepdims=True), w / np.abs(w).max(axis=1, keepdims=True)
    return (v * w).sum(axis=1) / np.sqrt((v * v).sum(axis=1) * (w * w).sum(axis=1))


def linked(v: np.ndarray, w: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with a cosine of v[i] and w[j] of at least the threshold, in lots."""
    qv, sv, ev = quantise(v)
    qw, sw, ew = quantise(w)
    exact = np.float32 if v.shape[1] * 127 * 127 < 1 << 24 else np.float64  # integers that this type holds exactly
    right = qw.astype(exact).T
    for at in range(0, len(v), _STRIP):
        e = ev[at : at + _STRIP, None]
        bound = (qv[at : at + _STRIP].astype(exact) @ right).astype(np.float64)
        bound *= sv[at : at + _STRIP, None] * sw
        bound += e + ew + e * ew + _SLACK
        i, j = np.nonzero(bound >= threshold)
        i += at
        for k in range(0, len(i), 32_768):
            a, b = i[k : k + 32_768], j[k : k + 32_768]
            true = cosines(v[a], w[b]) >= threshold
            yield a[true], b[true]


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, key, label, vec): key is null for what cannot be linked, else a digest of label and components."""
    for batch in slices(batches, 1024):
        keys, vecs = [], []
        for label, v in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            key = data = None
            if label is not None and v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    data = (x + 0.0).tobytes()  # no negative zero
                    key = hashlib.sha256(label.encode() + b"\0" + data).digest()
            keys.append(key)
            vecs.append(data)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1), pa.array(vecs, pa.binary())], names=["vec_id", "key", "label", "vec"])


def _tile(threshold: float):
    def compare(rows: list[tuple]) -> pa.RecordBatch | None:
        """Rows (key, size, vec, chunk, a, b) of one tile."""
        a, b = rows[0][4:6]
        keys = [r[0] for r in rows]
        v = np.frombuffer(b"".join(r[2] for r in rows), np.float64).reshape(len(rows), -1)
        sizes = np.array([r[1] for r in rows], np.int64)
        chunk = np.array([r[3] for r in rows])
        left = np.flatnonzero(chunk == a)
        right = left if a == b else np.flatnonzero(chunk == b)
        links, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        if len(left) and len(right):
            for i, j in linked(v[left], v[right], threshold):
                i, j = left[i], right[j]
                other = i != j
                i, j = i[other], j[other]
                links += np.bincount(i, sizes[j], len(rows)).astype(np.int64)
                if a != b:
                    links += np.bincount(j, sizes[i], len(rows)).astype(np.int64)
                merge_labels(label, i, j)
        some = np.flatnonzero(links)
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([pa.array([keys[k] for k in some], pa.binary()), pa.array([keys[k] for k in label[some]], pa.binary()), pa.array(links[some])], names=["key", "root", "links"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile = [], None
        for batch in slices(batches, 1024):
            columns = [batch.column(c).to_pylist() for c in ("key", "size", "vec", "chunk", "a", "b")]
            for name, dim, *row in zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), *columns, strict=True):
                if (name, dim, *row[4:]) != tile:
                    if len(held) > 1 and (out := compare(held)) is not None:
                        yield out
                    held, tile = [], (name, dim, *row[4:])
                held.append(tuple(row))
        if len(held) > 1 and (out := compare(held)) is not None:
            yield out

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors(vec_id, embedding, label)``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding"))
    rows = materialize(spark, rows.mapInArrow(_classes, "vec_id long, key binary, label string, vec binary"), "vectors")
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = materialize(spark, classes.withColumn("dim", F.octet_length("vec")), "vector-classes")
    counts = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    j = classes.join(counts, ["label", "dim"]).withColumn("chunk", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tiled = j.select("label", "dim", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), "chunk", "key", "size", "vec")
    found = tiled.repartition("label", "dim", "a", "b").sortWithinPartitions("label", "dim", "a", "b").mapInArrow(_tile(threshold), "key binary, root binary, links long")
    found = materialize(spark, found, "tiles")
    components = materialize(spark, connected_components(spark, found.select("key", "root")).toDF("key", "component"), "components")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    own = classes.select("key", "least", "size").join(components, "key", "left").join(links, "key", "left")
    own = materialize(spark, own.withColumn("component", F.coalesce("component", "key")), "labelled")
    # one component, or one class, may hold a third of all rows: what joins them is a table of its own, so that the joins can be split
    least = materialize(spark, own.groupBy("component").agg(F.min("least").alias("component_id")), "group-minima")
    known = own.join(least, "component").select("key", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    known = materialize(spark, known, "class-results")
    alone = rows.filter("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = rows.filter("key IS NOT NULL").select("vec_id", "key").join(known, "key").select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
