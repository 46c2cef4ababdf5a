"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines, cut at sentence ends and, where a piece is still longer than ``LONG`` bytes, after words whose
own checksum says so; equal paragraphs of a text are told apart by their number. Each paragraph's 64-bit digest goes to one cell
in each of three rows of a sketch; a cell holds a count, the exclusive or of its digests and of their checks. Two sketches are
subtracted cell by cell, and what remains is peeled: a cell with one digest left gives it away, which removes it from its other
cells. If everything peels, the digests that only one of the two texts has are known, and with them the likeness: common
paragraphs over all paragraphs. If not, both sketches are built again with twice the cells, until they peel.

The fingerprint is the hex of the smallest sketch: the number of paragraphs, then its cells. It is a function of the
text alone, so equal texts have equal fingerprints.

``fingerprints`` also compares each text with an edited one and with its successor. Documents are dealt by sampled splitters of
(doc_id, hash of the text) into ranges and sorted there; the first document of each range is sent to the range before it too. So each text
moves once, and no range depends on how often one id occurs.

Nulls: a null text is empty, and an empty text has no paragraphs; two texts without paragraphs have a likeness of 1. A null
doc_id comes last. Rows that share a doc_id follow one another by a hash of their texts and then by the texts; rows that
repeat both are documents like others, and get equal rows but for their successors. A single document is its own successor.
Texts of any length are read whole. Empty table: no rows. Further columns, whatever their names, play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import count_partitions, slices, text_of

#: Cells in each of the three rows of the smallest sketch.
CELLS = 4
ROWS = 3
#: A paragraph longer than this many bytes is cut after about every eighth word.
LONG = 256
#: Keys sampled for each range.
SAMPLE = 32
#: Documents and characters that are compared at a time.
_WINDOW, _WINDOW_CHARS = 256, 1 << 20
_PIECE = re.compile(rb"[.!?]+[\x20\x09-\x0D]+|[\x0A\x0D]+")
_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")
_SPACES = b" \t\n\x0b\x0c\r"
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_CHECK = np.uint64(0xD6E8FEB86659FD93)


def paragraphs(raw: bytes) -> list[bytes]:
    """The pieces of a text, without white space around them."""
    out = []
    for piece in _PIECE.split(raw):
        if len(piece) <= LONG:
            out.append(piece.strip(_SPACES))
            continue
        at = 0
        for m in _WORD.finditer(piece):
            if zlib.crc32(m.group().strip(_SPACES)) % 8 == 0:
                out.append(piece[at : m.end()].strip(_SPACES))
                at = m.end()
        out.append(piece[at:].strip(_SPACES))
    return [p for p in out if p]


def digests(text: str) -> np.ndarray:
    """One 64-bit digest for each paragraph, none twice but by chance; zero stands for an empty cell and is not given."""
    pieces = paragraphs(text.encode("utf-8", "surrogatepass"))
    found = [xxhash.xxh64_intdigest(p) for p in pieces]
    if len(set(found)) < len(found):
        seen: Counter = Counter()
        for i, p in enumerate(pieces):
            if seen[p]:
                found[i] = xxhash.xxh64_intdigest(p, seen[p])
            seen[p] += 1
    return np.array([x or 1 for x in found], np.uint64)


def _mixed(d: np.ndarray) -> np.ndarray:
    d = d ^ (d >> np.uint64(29))
    return d * _CHECK


def _places(d: np.ndarray, cells: int) -> np.ndarray:
    """A cell in each row of the sketch for each digest: (digests, ROWS)."""
    h = (d[:, None] ^ (d[:, None] >> np.uint64(32))) * _FACTORS
    return ((h >> np.uint64(32)) % np.uint64(cells)).astype(np.int64) + np.arange(ROWS) * cells


class Sketches:
    """Sketches of many texts with ``cells`` cells in each of their rows: counts, digests and checks, (texts, ROWS x cells)."""

    def __init__(self, texts: list[np.ndarray], cells: int = CELLS):
        self.cells, self.sizes = cells, np.array([len(d) for d in texts], np.int64)
        shape = len(texts), ROWS * cells
        self.count, self.key, self.check = (np.zeros(shape, t) for t in (np.int64, np.uint64, np.uint64))
        d = np.concatenate([np.zeros(0, np.uint64), *texts])
        self.add(np.repeat(np.arange(len(texts)), self.sizes), d, np.ones(len(d), np.int64))

    def add(self, text: np.ndarray, d: np.ndarray, times: np.ndarray) -> None:
        """Digests d go into these texts' sketches, so many times; minus one time takes one out."""
        at = (_places(d, self.cells) + (text * ROWS * self.cells)[:, None]).ravel()
        np.add.at(self.count.reshape(-1), at, np.repeat(times, ROWS))
        np.bitwise_xor.at(self.key.reshape(-1), at, np.repeat(d, ROWS))
        np.bitwise_xor.at(self.check.reshape(-1), at, np.repeat(_mixed(d), ROWS))

    def of(self, some: np.ndarray) -> Sketches:
        out = object.__new__(Sketches)
        out.cells, out.sizes = self.cells, self.sizes[some]
        out.count, out.key, out.check = self.count[some], self.key[some], self.check[some]
        return out

    def hex(self) -> list[str]:
        """Number of paragraphs, then for each cell its count modulo 2^16, its digests and 16 bits of their checks."""
        cells = np.zeros(self.count.shape, [("n", ">u2"), ("key", ">u8"), ("check", ">u2")])
        cells["n"], cells["key"], cells["check"] = self.count & 0xFFFF, self.key, self.check >> np.uint64(48)
        return [struct.pack(">I", n).hex() + c.tobytes().hex() for n, c in zip(self.sizes.tolist(), cells, strict=True)]


def difference(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subtract and peel pair by pair: (pair, digest, sign) of what only a (1) or only b (-1) holds, and which pairs peeled."""
    rest = a.of(np.arange(len(a.sizes)))
    rest.count, rest.key, rest.check = a.count - b.count, a.key ^ b.key, a.check ^ b.check
    width, told = ROWS * a.cells, []
    for _ in range(int((a.sizes + b.sizes).max(initial=0)) + 1):  # each round gives a digest of each pair that goes on
        pure = np.nonzero((np.abs(rest.count) == 1).ravel() & (_mixed(rest.key) == rest.check).ravel())[0]
        if not len(pure):
            break
        pair, d, sign = pure // width, rest.key.ravel()[pure], rest.count.ravel()[pure]
        order = np.lexsort((d, pair))
        pair, d, sign = pair[order], d[order], sign[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (d[1:] != d[:-1])
        pair, d, sign = pair[new], d[new], sign[new]
        told.append((pair, d, sign))
        rest.add(pair, d, -sign)
    done = ~(rest.count.any(axis=1) | rest.key.any(axis=1) | rest.check.any(axis=1))
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    pair, d, sign = (np.concatenate(c) for c in zip(empty, *told, strict=True))
    kept = done[pair]
    return pair[kept], d[kept], sign[kept], done


def recovered(a: list[np.ndarray], b: list[np.ndarray], sa: Sketches | None = None, sb: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, digest, sign) of all digests that only one text of a pair holds, from sketches of growing size."""
    open_, cells, told = np.arange(len(a)), CELLS, []
    sizes = np.array([[len(x), len(y)] for x, y in zip(a, b, strict=True)], np.int64).reshape(-1, 2)
    while len(open_):
        # sketches with fewer cells than the sizes differ by cannot peel
        now = open_[np.abs(sizes[open_, 0] - sizes[open_, 1]) < ROWS * cells]
        first = cells == CELLS and sa is not None and sb is not None
        left, right = (sa.of(now), sb.of(now)) if first else (Sketches([a[i] for i in now], cells), Sketches([b[i] for i in now], cells))
        pair, d, sign, done = difference(left, right)
        told.append((now[pair], d, sign))
        open_ = np.setdiff1d(open_, now[done])
        cells *= 2
        for i in open_[cells > 64 * (sizes[open_].sum(axis=1) + CELLS)]:  # digests that share their cells at every size: as sets
            mine, theirs = np.setdiff1d(a[i], b[i]), np.setdiff1d(b[i], a[i])
            told.append((np.full(len(mine) + len(theirs), i), np.concatenate([mine, theirs]), np.repeat([1, -1], [len(mine), len(theirs)])))
            open_ = open_[open_ != i]
    empty = (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return tuple(np.concatenate(c) for c in zip(empty, *told, strict=True))


def likeness(a: list[np.ndarray], b: list[np.ndarray], sa: Sketches | None = None, sb: Sketches | None = None) -> np.ndarray:
    """Common paragraphs over all paragraphs, pair by pair."""
    pair, _, sign = recovered(a, b, sa, sb)
    mine, theirs = (np.bincount(pair[sign == s], minlength=len(a)) for s in (1, -1))
    sizes = np.array([len(x) for x in a], np.int64)
    union = sizes + theirs
    return np.where(union > 0, (sizes - mine) / np.maximum(union, 1), 1.0)


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_paragraphs long"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
_NAMES = [f.split()[0] for f in _SCHEMA.split(", ")]


def _compared(rows: list[tuple[int | None, str, np.ndarray]]) -> pa.RecordBatch:
    """All but the last of these consecutive documents, each with its edited text and its successor."""
    texts, own = [r[1] for r in rows], [r[2] for r in rows]
    edited = [t[: len(t) - len(t) // 2] + f[: len(t) // 2] for t, f in zip(texts, texts[1:], strict=False)]
    changed = [digests(t) for t in edited]
    n = np.arange(len(edited))
    s, e = Sketches(own), Sketches(changed)
    mine = s.of(n)
    columns = (
        [r[0] for r in rows[:-1]],
        [len(t) for t in texts[:-1]],
        [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
        mine.hex(),
        e.hex(),
        likeness(own[:-1], changed, mine, e),
        likeness(own[:-1], own[1:], mine, s.of(n + 1)),
        [len(d) for d in own[:-1]],
    )
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, _KINDS, strict=True)], names=_NAMES)


def _follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (lot, guest, doc_id, text): each document is compared with the one after it; a guest closes its range."""
    rows: list[tuple] = []
    lot, chars, closed = None, 0, False
    for batch in slices(batches, 64):
        for of, guest, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if of != lot:
                rows, lot, chars, closed = [], of, 0, False
            if closed:
                continue  # a further copy of the document that closed its range
            rows.append((doc_id, text, digests(text)))
            chars, closed = chars + len(text), guest
            if guest or len(rows) > _WINDOW or chars > _WINDOW_CHARS:
                if len(rows) > 1:
                    yield _compared(rows)
                rows, chars = rows[-1:], 0


def _ranges(docs: DataFrame, parts: int, sample: int = SAMPLE) -> list[tuple]:
    """Keys (doc_id, hash) at which ranges begin, in descending order: every ``sample``-th of the keys with the least hashes.

    The driver holds ``sample`` keys a range."""
    least = docs.select("doc_id", "hash", F.xxhash64("doc_id", "hash", F.lit(7)).alias("luck")).distinct().orderBy("luck", "doc_id", "hash").limit(parts * sample).select("doc_id", "hash").collect()
    keys = sorted(set((r[0], r[1]) for r in least), key=_key)
    return keys[sample // 2 :: sample][: parts - 1] if len(keys) > parts else keys[1::2]


def _key(k: tuple) -> tuple:
    """Order of documents: descending doc_id, null last, then the hash."""
    return (k[0] is None, -(k[0] or 0), k[1])


def _sent(bounds: list[tuple], guests: list[tuple[tuple, int]] = ()):
    """Ranges to which a row goes: its own and, for the first document of a range, the one before it, as -1 - its number."""
    cuts, before = [_key(k) for k in bounds], dict(guests)

    @F.pandas_udf("array<int>")
    def lots(none: pd.Series, doc_id: pd.Series, h: pd.Series) -> pd.Series:
        out = []
        for n, i, x in zip(none.tolist(), doc_id.tolist(), h.tolist(), strict=True):
            k = (None if n else i, x)
            own = bisect.bisect_right(cuts, _key(k))
            out.append([own, -1 - before[k]] if k in before else [own])
        return pd.Series(out)

    return lots(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("hash"))


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row for each document: its fingerprint, its edited text's, and how like it is to that and to the next document."""
    texts = text_of(docs).withColumn("hash", F.xxhash64("text"))
    parts = parts or max(count_partitions(docs.sparkSession), 1)
    bounds = _ranges(texts, parts)
    place = F.struct(F.col("doc_id").isNull(), (-F.coalesce(F.col("doc_id").cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))), F.col("hash"))
    firsts = texts.withColumn("lot", _sent(bounds)[0]).groupBy("lot").agg(F.min_by(F.struct("doc_id", "hash"), place).alias("k"))
    firsts = sorted(((r[0], tuple(r[1])) for r in firsts.collect()), key=lambda r: r[0])  # one row a range
    guests = [(k, firsts[n - 1][0]) for n, (_, k) in enumerate(firsts)]  # the first range follows the last
    dealt = texts.select("doc_id", "text", "hash", F.explode(_sent(bounds, guests)).alias("to"))
    dealt = dealt.withColumns({"guest": F.col("to") < 0, "lot": F.when(F.col("to") < 0, -1 - F.col("to")).otherwise(F.col("to"))})
    dealt = dealt.repartition(parts, "lot").sortWithinPartitions("lot", "guest", F.col("doc_id").desc_nulls_last(), "hash", "text")
    return dealt.select("lot", "guest", "doc_id", "text").mapInArrow(_follow, _SCHEMA)
