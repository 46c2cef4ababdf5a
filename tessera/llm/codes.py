"""Vector codes: each quarter of a vector becomes the index of its nearest entry in a trained codebook (product quantisation).

The nearest entry is found by annular norm pruning. Entries are sorted by norm. For a part x with some entry at distance d, no
entry whose norm differs from x's by more than d can be nearer, so two binary searches bound the annulus of entries that can be,
ends included; those and no others are compared, exactly. d comes from the ``PROBES`` entries with the nearest norms.

Components are integers, floor(1024 x), so distances, sums and rounds are exact and the same in every layout. A task sends
sums and counts of each entry's parts, which Spark adds up; the driver holds codebooks (at most 256 entries of each part).

Nulls and odd vectors: a row whose vector is null or holds a null or a component that is not finite is dropped; a null vec_id
comes after every other and its row gets a code too. Integers are held to ``LIMIT`` in either direction, so that sums of squares
stay exact. Vectors that are shorter than the longest, or whose length four does not divide, are filled up with zeros; so
vectors without components have zeros only. Fewer than 256 rows give fewer entries. Ties: equal distances go to the
lower index, repeated vec_ids enter the codebook in the order of their components, and repeated rows get equal rows. Further columns,
whatever their names, play no part. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE, LIMIT = 1024, 1 << 24
PROBES = 8
#: Labels with more than this part of all rows (at most so many labels) meet their sums in place.
HOT = 256
_STRIP = 256
#: Float products of integers below this are exact.
_EXACT = 1 << 52


class Codebook:
    """Entries of one part position, sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        norms = np.sqrt((self.entries.astype(np.float64) ** 2).sum(axis=1))
        self.order = np.argsort(norms, kind="stable")
        self.norms = norms[self.order]

    def distances(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Squared distances of each row to these entries, exactly."""
        e = self.entries[at]
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(e).max(initial=0)))
        if top * top * 4 * max(x.shape[1], 1) < _EXACT:
            f, g = x.astype(np.float64), e.astype(np.float64)
            return ((f * f).sum(axis=1)[:, None] - 2 * (f @ g.T) + (g * g).sum(axis=1)).astype(np.int64)
        return np.stack([((x - row) ** 2).sum(axis=1) for row in e], axis=1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row (ties: the lower one) and its squared distance."""
        code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        norm = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
        rows = np.argsort(norm, kind="stable")  # rows with like norms share an annulus
        for start in range(0, len(rows), _STRIP):
            some = rows[start : start + _STRIP]
            part, length = x[some], norm[some]
            middle = np.searchsorted(self.norms, length)
            low = max(int(middle.min()) - PROBES // 2, 0)
            probes = self.order[low : int(middle.max()) + PROBES // 2]
            best = np.sqrt(self.distances(part, probes).min(axis=1).astype(np.float64))
            slack = 1e-9 * (1 + length + best)  # more than rounding can take away
            first = np.searchsorted(self.norms, length - best - slack, "left")
            last = np.searchsorted(self.norms, length + best + slack, "right")
            ring = np.arange(first.min(), last.max())
            ring = ring[np.argsort(self.order[ring], kind="stable")]  # by index, so that the first of equals is the lower one
            far = (ring < first[:, None]) | (ring >= last[:, None])
            d = self.distances(part, self.order[ring])
            d[far] = np.iinfo(np.int64).max
            k = d.argmin(axis=1)
            code[some], error[some] = self.order[ring][k], d[np.arange(len(some)), k]
        return code, error


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, parts): vectors that are kept, as integers, all of one length that four divides."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    held = lambda v: F.least(F.greatest(F.floor(F.least(F.greatest(v * SCALE, F.lit(-2.0 * LIMIT)), F.lit(2.0 * LIMIT))), F.lit(-LIMIT)), F.lit(LIMIT))
    kept = vectors.filter(F.col("embedding").isNotNull() & ~bad)
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.transform(x, lambda v: held(v).cast("int")).alias("parts"))
    width = kept.agg(F.max(F.size("parts"))).first()[0] or 0
    width += -width % PARTS or (0 if width else PARTS)
    return kept.withColumn("parts", F.concat("parts", F.array_repeat(F.lit(0), F.lit(width) - F.size("parts"))))


def _matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _sums(books: list[np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        sums, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in slices(batches, 4096):
            rows = _matrix(batch.column(0))
            for p, (book, x) in enumerate(zip(found, np.split(rows, PARTS, axis=1), strict=True)):
                code, _ = book.nearest(x)
                order = np.argsort(code, kind="stable")
                used, first = np.unique(code[order], return_index=True)
                sums[p][used] += np.add.reduceat(x[order], first, axis=0)
                counts[p] += np.bincount(code, minlength=len(counts[p]))
        for p in range(PARTS):
            used = np.nonzero(counts[p])[0]
            d = sums[p].shape[1]
            columns = (np.full(len(used) * d, p), np.repeat(used, d), np.tile(np.arange(d), len(used)), sums[p][used].ravel(), np.repeat(counts[p][used], d))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["part", "entry", "place", "total", "n"])

    return run


def _codes(books: list[np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b) for b in books]
        for batch in slices(batches, 4096):
            parts = np.split(_matrix(batch.column("parts")), PARTS, axis=1)
            told = [book.nearest(x) for book, x in zip(found, parts, strict=True)]
            code = np.stack([c for c, _ in told], axis=1).astype(np.uint8)
            names = [c for c in batch.schema.names if c != "parts"]
            columns = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(sum(e for _, e in told), pa.int64())], names=[*names, "code", "error"])

    return run


def train(kept: DataFrame, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part position: parts of the first vectors, then floors of means over all vectors."""
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(ENTRIES).select("parts").collect()
    books = np.split(np.array([r[0] for r in first], np.int64), PARTS, axis=1)
    for _ in range(rounds):
        sums = kept.select("parts").mapInArrow(_sums(books), "part long, entry long, place long, total long, n long")
        for part, entry, place, total, n in sums.groupBy("part", "entry", "place").agg(F.sum("total"), F.sum("n")).toLocalIterator():
            books[part][entry, place] = total // n
    return books


def digest(books: list[np.ndarray]) -> str:
    """Lowercase hex of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, hot: int = HOT) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that is kept."""
    spark = vectors.sparkSession
    kept = materialize(spark, integers(vectors), "integers")
    if kept.isEmpty():
        none = kept.select("vec_id", *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))))
        return none
    books = train(kept)
    fields = kept.select("vec_id", "label").schema.add("code", "string").add("error", "long")
    coded = materialize(spark, kept.mapInArrow(_codes(books), fields), "codes")
    sums = materialize(spark, coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    many = F.col("_n") > coded.count() // hot
    large = F.broadcast(sums.filter(many))  # fewer than ``hot`` labels have so many rows
    same = coded["label"].eqNullSafe(F.col("_label"))
    here = coded.join(large, same)
    rest = coded.join(large, same, "left_anti").join(sums.filter(~many).hint("merge"), same)
    out = here.select("vec_id", "code", "error", "label_error").unionByName(rest.select("vec_id", "code", "error", "label_error"))
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))
