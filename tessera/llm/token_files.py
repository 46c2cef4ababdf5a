"""Token ids in compact binary files: canonical length-limited Huffman coding.

Writing takes three steps. Texts are encoded and dealt by doc_id into shards, cut at sampled ids, and each shard's documents
are packed in ascending order into blocks of whole documents. The ids of all blocks are counted; package-merge finds the best
code whose words have at most ``limit`` bits, and the canonical form makes a list of code lengths enough to rebuild it. Each
block is then coded on its own, with the bit offset of every ``STRIDE``-th id kept as a checkpoint.

Reading needs no order: a block is decoded by one table look-up an id, all its checkpoints in parallel.

On disk: ``<path>/codebook`` (id, bits) and ``<path>/blocks`` (shard, block, start, doc_ids, lengths, checkpoints, payload),
both Parquet, so that any store Spark can write to will do and failed tasks leave nothing behind.

Nulls: a null text is empty and yields the end id alone; null doc_ids come first in order. Rows that repeat a doc_id stay
separate documents, ordered by their ids. Empty table: files without blocks.
Texts of any length are encoded whole; a block holds at least one document, however long. Ties of counts in the code go by
id. Further columns, whatever their names, play no part.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import count_partitions, materialize, released_shuffles, scratch, slices, text_of

BLOCK = 1 << 17
STRIDE = 128
LIMIT = 18
#: Units that a worker keeps, and bytes of text that are cut in one go.
CACHE, _LOT = 1_600_000, 4 << 20
#: Units a line that goes to the library, and how byte-level vocabularies write a blank.
_LINE, _BLANK = 256, "\u0120"


# --- encoding texts

#: Classes of characters: letters, digits, other ASCII, apostrophes, white space, blanks, others that are no white space, and
#: those of which nothing is assumed.
_L, _N, _P, _Q, _W, _B, _U, _X = range(8)


def _classes() -> np.ndarray:
    """By first byte of a character."""
    table = np.full(256, _U, np.uint8)
    for c in range(128):
        table[c] = _L if chr(c).isalpha() else _N if chr(c).isdigit() else _P if 32 < c < 127 else _X
    table[[9, 10, 13]], table[32], table[39] = _W, _B, _Q
    table[0xC3:0xCA] = _L  # U+00C0 to U+024F are letters but for two
    table[[0xC2, 0xE1]] = _X
    return table


_CLASS = _classes()


def unit_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where to cut UTF-8 texts that stand one behind the other, so that the byte-level pattern has the same matches in each
    part alone as in the whole text.

    data: all bytes; begins: where each text that is not empty begins. A run of letters or digits ends before any other
    character, one of other signs before all but apostrophes, and what is no white space before white space. Of white space
    before something else the last character stands alone, or with what follows if it is a blank. Next to characters that
    may or may not be white space nothing is cut.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    lead = data[at]
    c = _CLASS[lead]
    high = np.flatnonzero((lead == 0xC3) | (lead == 0xE2) | (lead == 0xE3))
    if len(high):
        first, second = lead[high], data[np.minimum(at[high] + 1, len(data) - 1)]
        c[high[(first == 0xC3) & ((second == 0x97) | (second == 0xB7))]] = _U
        c[high[((first == 0xE2) & (second <= 0x81)) | ((first == 0xE3) & (second == 0x80))]] = _X
    n = len(c)
    first = np.zeros(n, bool)
    first[np.searchsorted(at, begins)] = True
    white, sure = (c == _W) | (c == _B), c != _X
    solid = ~white & sure
    before, after = np.concatenate((c[:1], c[:-1])), np.concatenate((solid[1:] & ~first[1:], [False]))
    was_white, was_solid = np.concatenate(([False], white[:-1])), np.concatenate(([False], solid[:-1]))
    was_sure = np.concatenate(([True], sure[:-1])) | first
    # two characters back, within the same text
    sure_twice = np.concatenate(([True], was_sure[:-1])) | np.concatenate(([False], first[:-1]))
    cut = was_solid & white
    cut |= (before <= _N) & sure & (c != before) & (c != _U)
    cut |= (before == _P) & (c <= _N)
    cut |= was_white & white & after
    cut |= (before == _W) & solid & sure_twice
    return at[cut | first]


class Encoder:
    """The tokenizers library behind a cache of units, see ``unit_starts``.

    New units go to the library, those of a blank and what follows in lines of many: there a unit begins at each id whose
    token begins with a blank. Texts that hold an added token go to the library whole, and with a tokenizer of any other make
    all texts do.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made.get("pre_tokenizer") or {}
        self.cuts = made.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.added = [t["content"] for t in made.get("added_tokens", [])]
        small = self.library.get_vocab_size() <= 1 << 16
        self.kind, self._item = (np.dtype("<u2"), "H") if small else (np.dtype("<u4"), "I")
        self.begins = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.begins[i] = token[:1] == _BLANK
        self._empty()

    def _empty(self) -> None:
        """No units: their numbers, ids one behind the other, and where each unit's ids begin."""
        self.cache: dict[bytes, int] = {}
        self.flat, self.used = np.empty(1 << 16, self.kind), 0
        self.offsets = np.zeros(1 << 12, np.int64)

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(array(self._item, e.ids), self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, units: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n = len(self.cache)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty_like(self.flat)))
        while n + len(units) + 1 > len(self.offsets):
            self.offsets = np.concatenate((self.offsets, np.zeros_like(self.offsets)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.offsets[n + 1 : n + 1 + len(units)] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.cache.update(zip(units, range(n, n + len(units)), strict=True))

    def _learn(self, new: list[bytes]) -> None:
        plain, odd = [], []
        for u in new:
            (plain if u[:1] == b" " and len(u) > 1 and _CLASS[u[1]] <= _Q and b" " not in u[1:] else odd).append(u)
        if plain:
            ids = np.concatenate(self._library([b"".join(plain[at : at + _LINE]).decode() for at in range(0, len(plain), _LINE)]))
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(plain):
                self._keep(plain, ids, np.diff(np.concatenate((starts, [len(ids)]))))
            else:  # a vocabulary with tokens of several blanks
                odd += plain
        if odd:
            found = self._library([u.decode() for u in odd])
            self._keep(odd, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))

    def encode(self, texts: pa.StringArray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (none null) one behind the other, each text's followed by ``end``, and where each text's end."""
        whole = pa.array([False] * len(texts), pa.bool_())
        for token in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        if not self.cuts or pc.any(whole).as_py():
            return self._by_rows(texts, whole.to_pylist() if self.cuts else [True] * len(texts), end)
        if len(self.cache) > CACHE:
            self._empty()
        _, offsets, raw = texts.buffers()
        edges = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw else np.empty(0, np.uint8)
        ends, sizes = edges[1:] - edges[0], np.diff(edges)
        starts = unit_starts(data, (ends - sizes)[sizes > 0])
        edges = pa.array(np.append(starts, len(data)), pa.int64())
        units = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, edges.buffers()[1], pa.py_buffer(data)]).dictionary_encode()
        distinct = units.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = list(map(self.cache.get, distinct))
        if None in number:
            self._learn([u for u, n in zip(distinct, number, strict=True) if n is None])
            number = list(map(self.cache.__getitem__, distinct))
        number = np.array(number, np.int64)[units.indices.to_numpy()]
        first, length = self.offsets[number], self.offsets[number + 1] - self.offsets[number]
        stop = np.cumsum(length)
        last = np.concatenate(([0], stop))[np.searchsorted(starts, ends)]
        ids = self.flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(first - stop + length, length)]
        if end is None:
            return ids, last
        return np.insert(ids, last, end), last + np.arange(1, len(texts) + 1)

    def _by_rows(self, texts: pa.StringArray, whole: list[bool], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        parts, last = [np.empty(0, self.kind)], [] if end is None else [np.array([end], self.kind)]
        sizes = []
        for at, by_library in enumerate(whole):
            one = texts.slice(at, 1)
            ids = [*(self._library(one.to_pylist()) if by_library else [self.encode(one)[0]]), *last]
            parts += ids
            sizes.append(sum(map(len, ids)))
        return np.concatenate(parts), np.cumsum(np.array(sizes, np.int64))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _lots(batches: Iterable[pa.RecordBatch], size: int = _LOT) -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``size`` bytes of text; a longer text stands alone."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")) - at)
            yield batch.slice(at, n)
            at += n


def _tokens(path: str, cuts: list[int], end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        edges = np.array(cuts, np.int64)
        wide = encoder.kind.itemsize
        for batch in _lots(batches):
            ids, last = encoder.encode(pc.cast(batch.column(1), pa.string()), end)
            docs = pc.fill_null(batch.column(0), -(1 << 63)).to_numpy(zero_copy_only=False)
            shard = np.where(batch.column(0).is_valid().to_numpy(zero_copy_only=False), np.searchsorted(edges, docs, side="right"), 0)
            offsets = pa.array(np.concatenate(([0], last * wide)), pa.int32())
            column = pa.BinaryArray.from_buffers(pa.binary(), len(docs), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(ids))])
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), batch.column(0), column, pa.array(np.full(len(docs), wide, np.int32))], names=["shard", "doc_id", "ids", "width"])

    return run


_RAW = "shard int, block int, first long, n long, width int, doc_ids array<long>, lengths array<long>, ids binary"
_RAW_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("ids", pa.binary())])


def _pack(size: int):
    """Documents in order in, blocks of whole documents out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first, docs, lengths, parts, width, held = None, 0, 0, [], [], [], 2, 0

        def out() -> pa.RecordBatch:
            row = {"shard": shard, "block": block, "first": first, "n": held, "width": width, "doc_ids": docs, "lengths": lengths, "ids": b"".join(parts)}
            return pa.RecordBatch.from_pylist([row], schema=_RAW_ARROW)

        for batch in slices(batches):
            for s, doc, ids, w in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if docs and (s != shard or held >= size):
                    yield out()
                    block, first = (block + 1, first + held) if s == shard else (0, 0)
                    docs, lengths, parts, held = [], [], [], 0
                shard, width = s, w
                docs.append(doc)
                lengths.append(len(ids) // w)
                held += lengths[-1]
                parts.append(ids)
        if docs:
            yield out()

    return run


# --- the code


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits of each symbol with a positive count (0 for others), by package-merge; the limit grows if it is too small."""
    used = np.flatnonzero(counts)
    bits = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        bits[used] = 1
        return bits
    limit = max(limit, int(np.ceil(np.log2(len(used)))) + 1)
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    leaf_levels, packages = [], np.empty(0)
    for _ in range(limit):
        merged = np.concatenate((weight, packages))
        at = np.argsort(merged, kind="stable")  # leaves first among equals
        leaf_levels.append(np.cumsum(at < len(weight)))
        merged = merged[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(weight) - 2
    for leaves in reversed(leaf_levels):
        if not take:
            break
        n = int(leaves[take - 1])
        bits[order[:n]] += 1
        take = 2 * (take - n)
    return bits


def canonical(bits: np.ndarray) -> np.ndarray:
    """Code words: by length, then by symbol, counting up."""
    codes, code, last = np.zeros(len(bits), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(bits)), bits))
    for s in order[np.searchsorted(bits[order], 1) :].tolist():
        b = int(bits[s])
        code <<= b - last
        codes[s], last = code, b
        code += 1
    return codes


def decoding_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(symbol, bits) for every value of the next ``width`` bits, and the width."""
    width = int(bits.max()) if len(bits) else 0
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[np.searchsorted(bits[order], 1) :]
    span = np.left_shift(np.int64(1), width - bits[order])
    symbol, length = np.zeros(1 << width, np.int32), np.ones(1 << width, np.int64)
    n = int(span.sum())
    symbol[:n], length[:n] = np.repeat(order, span), np.repeat(bits[order], span)
    return symbol, length, width


def compress(ids: np.ndarray, bits: np.ndarray, codes: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """The bit stream and the bit offsets of every stride-th id."""
    length = bits[ids]
    ends = np.cumsum(length)
    starts = ends - length
    total = int(ends[-1]) if len(ids) else 0
    # each code word is moved to its place in the 64 bits in which it begins; what does not fit begins the next 64
    code, word, room = codes[ids], starts >> 6, 64 - (starts & 63) - length
    part = np.where(room < 0, code >> np.maximum(-room, 0).astype(np.uint64), code << np.maximum(room, 0).astype(np.uint64))
    out = np.zeros((total + 63) // 64 + 1, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        out[word[first]] = np.bitwise_or.reduceat(part, first)
        over = np.flatnonzero(room < 0)
        out[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    return out.astype(">u8").tobytes()[: (total + 7) // 8], starts[::stride]


def expand(payload: bytes, n: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray, int], stride: int = STRIDE) -> np.ndarray:
    """The n ids of a block; from each checkpoint one id is read a step."""
    symbol, length, width = table
    data = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    word = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    out = np.zeros((len(checkpoints), stride), np.int32)
    at = checkpoints.astype(np.int64)
    shift = np.uint32(32 - width)
    rest = n - (len(checkpoints) - 1) * stride if len(checkpoints) else 0
    for step in range(min(stride, n)):
        if step == rest:
            at = at[:-1]
        peek = (word[at >> 3] << (at & 7).astype(np.uint32)) >> shift
        out[: len(at), step] = symbol[peek]
        at = at + length[peek]
    return out.reshape(-1)[:n]


# --- files


def _bincount(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in slices(batches, 1):
        ids = np.frombuffer(batch.column(0)[0].as_py(), f"<u{batch.column(1)[0].as_py()}")
        n = np.bincount(ids)
        if len(n) > len(total):
            total = np.concatenate((total, np.zeros(len(n) - len(total), np.int64)))
        total[: len(n)] += n
    ids = np.flatnonzero(total)
    if len(ids):
        yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int32)), pa.array(total[ids])], names=["id", "n"])


_BLOCKS = "shard int, block int, start long, doc_ids array<long>, lengths array<long>, checkpoints binary, payload binary"
_BLOCKS_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("checkpoints", pa.binary()), ("payload", pa.binary())])


def write_tokens(docs: DataFrame, tokenizer: str, path: str | None = None, end: int = 0, block: int = BLOCK, limit: int = LIMIT) -> str:
    """Encode all texts, append the end id to each, write the files and return their path.

    The driver holds one number a shard and one a vocabulary entry.
    """
    spark = docs.sparkSession
    path = path or scratch(spark, "token-file")
    shards = count_partitions(spark)
    texts = text_of(docs)
    cuts = texts.agg(F.percentile_approx("doc_id", F.array(*(F.lit((i + 1) / shards) for i in range(shards - 1))), F.lit(max(10_000, 20 * shards)))).first()[0] if shards > 1 else None
    tokens = texts.mapInArrow(_tokens(tokenizer, sorted(set(cuts or [])), end), "shard int, doc_id long, ids binary, width int")
    packed = tokens.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("doc_id"), "ids").mapInArrow(_pack(block), _RAW)
    raw = materialize(spark, packed, "token-blocks")
    counted = raw.select("ids", "width").mapInArrow(_bincount, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(max((r.id for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    bits = code_lengths(counts, limit)
    base, at = {}, 0
    for s, n in sorted((r[0], r[1]) for r in raw.groupBy("shard").agg(F.sum("n")).collect()):
        base[s], at = at, at + n
    shared = spark.sparkContext.broadcast((bits, canonical(bits), base))

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, codes, base = shared.value
        for batch in slices(batches, 1):
            r = batch.to_pylist()[0]
            payload, checkpoints = compress(np.frombuffer(r["ids"], f"<u{r['width']}"), bits, codes)
            row = {"shard": r["shard"], "block": r["block"], "start": base[r["shard"]] + r["first"], "doc_ids": r["doc_ids"], "lengths": r["lengths"], "checkpoints": checkpoints.astype("<u8").tobytes(), "payload": payload}
            yield pa.RecordBatch.from_pylist([row], schema=_BLOCKS_ARROW)

    book = [(int(i), int(bits[i])) for i in np.flatnonzero(bits)]
    with released_shuffles(spark):
        spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{path}/codebook")
        raw.mapInArrow(code, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if asked for, ids for every document of the files."""
    book = spark.read.schema("id int, bits int").parquet(f"{path}/codebook").collect()  # one row a vocabulary entry
    bits = np.zeros(max((r.id for r in book), default=0) + 1, np.int64)
    for r in book:
        bits[r.id] = r.bits
    shared = spark.sparkContext.broadcast(bits)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(shared.value)
        for batch in slices(batches, 1):
            r = batch.to_pylist()[0]
            lengths = np.array(r["lengths"], np.int64)
            ids = expand(r["payload"], int(lengths.sum()), np.frombuffer(r["checkpoints"], "<u8"), table).astype("<u4")
            ends = np.cumsum(lengths)
            each = [ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            columns = [pa.array(r["doc_ids"], pa.int64()), pa.array(r["start"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))] * with_ids], names=names)

    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    return blocks.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)
