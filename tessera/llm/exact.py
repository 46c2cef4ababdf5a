"""Exact de-duplication by content sort.

Texts are compared after deleting every character of ``[\\x20\\x09-\\x0D]``. Equal texts of one task are combined before
anything is sent. Sampled splitters then range-partition the normalised bytes, the external sort of each partition places
equal texts next to each other, and each text is compared in full with its neighbour. The range key is a prefix of the
bytes and, against prefixes that many texts share, eight bytes of their digest; so what the sampling sends to the driver
has a fixed size per row, and no prefix makes a hot partition.

Texts of any length are compared whole. Ties of code points go to the smallest doc_id.

Nulls: a null text is an empty text. A null doc_id sorts after every other. Empty table: no rows. Rows that repeat both
text and doc_id count in ``group_size`` one by one; the report marks all repeats of the row that stays as kept, and
``deduplicate`` keeps one of them. Other columns are not touched, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACES, materialize, slices, text_of, utf8_bytes

_PREFIX = 24
#: Bytes of normalised text that a task may hold for combining before it sends them on.
_HELD = 32 << 20
_PARTIAL = "key binary, norm binary, n_cp long, doc_id long, n long, n_best long"
_GROUP = "text_sha256 string, keep_id long, keep_cp long, group_size long, n_best long"


def _better(a: tuple, b: tuple) -> tuple:
    """(n_cp, doc_id, n, n_best) of two lots of equal texts: most code points, then smallest id, null last."""
    ka, kb = ((-x[0], x[1] is None, x[1] or 0) for x in (a, b))
    n = a[2] + b[2]
    if ka == kb:
        return (a[0], a[1], n, a[3] + b[3])
    best = a if ka < kb else b
    return (best[0], best[1], n, best[3])


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=kinds[t]) for i, (_, t) in enumerate(fields)], names=[f[0] for f in fields])


def _combine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes, tuple] = {}
    size = 0
    for batch in slices(batches):
        lengths = pc.utf8_length(batch.column(1)).to_pylist()
        for doc_id, raw, n_cp in zip(batch.column(0).to_pylist(), utf8_bytes(batch.column(1)), lengths, strict=True):
            norm = raw.translate(None, SPACES)
            mine, there = (n_cp, doc_id, 1, 1), held.get(norm)
            if there is None:
                size += len(norm) + 200
            held[norm] = mine if there is None else _better(there, mine)
        if size > _HELD:
            yield from _partials(held)
            held, size = {}, 0
    yield from _partials(held)


def _partials(held: dict[bytes, tuple]) -> Iterator[pa.RecordBatch]:
    rows = []
    for norm, best in held.items():
        rows.append((norm[:_PREFIX] + hashlib.sha256(norm).digest()[:8], norm, *best))
        if len(rows) == 512:
            yield _batch(rows, _PARTIAL)
            rows = []
    if rows:
        yield _batch(rows, _PARTIAL)


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, one row for each text that occurs more than once out."""
    last, best, out = None, None, []
    for batch in slices(batches, 512):
        norms = batch.column("norm").to_pylist()
        others = zip(*(batch.column(c).to_pylist() for c in ("n_cp", "doc_id", "n", "n_best")), strict=True)
        for norm, mine in zip(norms, others, strict=True):
            if norm == last:
                best = _better(best, mine)
                continue
            if best is not None and best[2] > 1:
                out.append((hashlib.sha256(last).hexdigest(), best[1], best[0], best[2], best[3]))
            last, best = norm, mine
        if len(out) >= 2048:
            yield _batch(out, _GROUP)
            out = []
    if best is not None and best[2] > 1:
        out.append((hashlib.sha256(last).hexdigest(), best[1], best[0], best[2], best[3]))
    if out:
        yield _batch(out, _GROUP)


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """One row for each normalised text that more than one row has."""
    partial = text_of(docs).mapInArrow(_combine, _PARTIAL)
    return partial.repartitionByRange(F.col("key")).sortWithinPartitions("key", "norm").mapInArrow(_neighbours, _GROUP)


def _digest(text: str) -> F.Column:
    return F.sha2(F.translate(F.coalesce(F.col(text), F.lit("")), SPACES.decode(), ""), 256)


def exact_report(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; texts without a double need no partner in the join."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_cp"), _digest("text").alias("text_sha256"))
    # never broadcast: nothing bounds the number of groups
    j = rows.join(duplicate_groups(docs).hint("merge"), "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return j.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_cp") == F.col("keep_cp")))).alias("kept"),
        "text_sha256",
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    own = {c: f"_x{i}" for i, c in enumerate(("sha", "keep_id", "keep_cp", "size", "best"))}
    groups = materialize(docs.sparkSession, duplicate_groups(docs), "copies").toDF(*own.values())
    names = docs.columns
    marked = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    at = {n: f"_c{i}" for i, n in enumerate(names)}
    marked = marked.withColumn("_x0", _digest(at["text"]))
    j = marked.join(groups.hint("merge"), "_x0", "left")  # never broadcast: nothing bounds the number of groups
    n_cp = F.char_length(F.coalesce(F.col(at["text"]), F.lit("")))
    stays = F.col("_x3").isNull() | (F.col(at["doc_id"]).eqNullSafe(F.col("_x1")) & (n_cp == F.col("_x2")))
    j = j.filter(stays)
    cols = [f"_c{i}" for i in range(len(names))]
    if groups.filter("_x4 > 1").isEmpty():
        return j.select(cols).toDF(*names)
    # somewhere the same document was read more than once: one of its rows stays
    once = j.filter("_x4 IS NULL OR _x4 = 1")
    again = j.filter("_x4 > 1").dropDuplicates(["_x0"])
    return once.select(cols).unionByName(again.select(cols)).toDF(*names)
