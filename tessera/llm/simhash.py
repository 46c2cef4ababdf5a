"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint's bit is 1 if it is set in over half of the hashes of the text's word shingles (repeats count). Fingerprints
that differ in at most ``radius`` bits are linked, and linked documents form a group.

Which fingerprints meet is decided by keys, each a set of bit positions on which two fingerprints must agree:

* ``pigeonhole_tables`` (64 bits, radius 2) is exact. The bits fall into three blocks, of which two differing bits leave one
  untouched; the other two blocks fall into three blocks again, so that every linked pair shares one of nine keys of
  35 bits or more. 2**35 keys keep buckets near one fingerprint for billions of documents.
* ``sampled_tables`` (256 bits, large radius) shares a key with a known probability, see there. What these propose is then
  decided by the sets of shingles themselves (``similar_groups``).

Inside a bucket the fingerprints are turned into vertical bit planes: word w of plane j holds bit j of 64 fingerprints.
A query is compared with 64 fingerprints at a time; three planes go through a full adder into carry-save counters, and a
word is abandoned as soon as all its 64 distances exceed the radius. Equal fingerprints are one node from the start, and a
task returns a spanning forest of the links it found, never the pairs. A bucket of more than ``TILE`` fingerprints is cut
into chunks whose pairs are separate tasks.

Nulls: a null text is empty; a text without words has fingerprint zero and is linked like any other. A null doc_id keeps
its row and counts as larger than every id. Rows that repeat stay separate rows in groups; ``near_deduplicate`` keeps one of them. Empty table: no rows.
Texts of any length are read whole. Ties: a bit set in exactly half of the hashes is 0; of rows of a group with the same doc_id the one
with the smallest hash of its text stays. Further columns, whatever their names, play no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import materialize, slices, text_of, utf8_bytes
from tessera.llm.graph import connected_components

TILE = 4096
#: Texts with their sets of shingles in a chunk of a tile.
SETTLE = 512
#: Rows of whole groups that are compared in one go, and pairs of a query with a word of 64 lanes that share the caches.
_ROWS, _PAIRS = 16_384, 8_192
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``width`` words; fewer words make one shingle, none makes no hash."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    return np.array([h(joined[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def _expand(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) 64-bit hashes from one: the hash itself, then splitmix64 of it with other offsets."""
    out = [h]
    for i in range(1, words):
        z = h + np.uint64((0x9E3779B97F4A7C15 * i) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out.append(z ^ (z >> np.uint64(31)))
    return np.stack(out, axis=1)


def fingerprint(raw: bytes, width: int = 3, words: int = 1) -> bytes:
    """The fingerprint, most significant byte first, in 8 * ``words`` bytes."""
    return _majority(shingle_hashes(raw, width), words)


def _majority(h: np.ndarray, words: int) -> bytes:
    total = np.zeros(64 * words, np.int64)
    for at in range(0, len(h), 4096):
        part = np.ascontiguousarray(_expand(h[at : at + 4096], words).astype(">u8"))
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1)
        # uint8 sums of 255 rows cannot overflow and are several times faster than wide ones
        for k in range(0, len(bits), 255):
            total += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(h)).tobytes() if len(h) else bytes(8 * words)


def pigeonhole_tables() -> list[np.ndarray]:
    """Nine sets of positions of 64 bits; fingerprints at distance 2 or less agree on one of them."""
    blocks = np.array_split(np.arange(64), 3)
    tables = []
    for i in range(3):
        rest = np.concatenate([blocks[k] for k in range(3) if k != i])
        tables += [np.concatenate([blocks[i], part]) for part in np.array_split(rest, 3)]
    return tables


def sampled_tables(bits: int = 256, key_bits: int = 16, tables: int = 64, seed: int = 7) -> list[np.ndarray]:
    """Random sets of positions. Two texts at an angle t agree on a bit with probability 1 - t / pi, so a pair of shingle
    similarity 0.8 (0.85, 0.9) shares a key with probability 0.991 (0.9996, 1.0) at the defaults."""
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(bits, key_bits, replace=False)) for _ in range(tables)]


def _fingerprints(width: int, words: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [fingerprint(raw, width, words) for raw in utf8_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], names=["doc_id", "fp"])

    return run


def _set_prints(width: int, words: int):
    """(doc_id, h, fp) of (doc_id, text, h): the fingerprint of the set of shingles, followed by a digest of that set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            prints = [_set_print(np.unique(shingle_hashes(raw, width)), words) for raw in utf8_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints, pa.binary())], names=["doc_id", "h", "fp"])

    return run


def _set_print(shingles: np.ndarray, words: int) -> bytes:
    return _majority(shingles, words) + xxhash.xxh3_128_digest(shingles.astype("<u8").tobytes())


def _shingle_sets(width: int, words: int):
    """(fp, shingles) of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(shingle_hashes(raw, width)) for raw in utf8_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([_set_print(x, words) for x in sets], pa.binary()), pa.array([x.astype("<u8").tobytes() for x in sets], pa.binary())], names=["fp", "shingles"])

    return run


def _similar(least: float):
    """Rows (a, b, x, y) with the shingle sets x and y in; (a, b, similar) out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                out.append(_alike(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), least))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.bool_())], names=["a", "b", "similar"])

    return run


def _keys(tables: list[np.ndarray], size: int | None = None):
    """(key, fp) for every table; of a longer fp the first ``size`` bytes are the fingerprint."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            prints = batch.column(0).to_pylist()
            bits = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)[:, :size], axis=1)
            keys = []
            for t, at in enumerate(tables):
                powers = np.left_shift(np.int64(1), np.arange(len(at), dtype=np.int64))
                keys.append(bits[:, at].astype(np.int64) @ powers + (np.int64(t) << np.int64(56)))
            fps = pa.array(prints, pa.binary())
            for k in keys:
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), fps], names=["key", "fp"])

    return run


def _add(counter: list[np.ndarray], x: np.ndarray, level: int, over: np.ndarray) -> None:
    """Add the bits x, of weight 2**level, to vertical counters; what runs out at the top is marked for good."""
    for i in range(level, len(counter)):
        carry = counter[i] & x
        counter[i] ^= x
        x = carry
    over |= x


def within(bits: np.ndarray, group: np.ndarray, side: np.ndarray, crossed: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query row, other row) of one group within the radius, in lots.

    bits: (n, b) of 0 and 1, rows of a group together; side: which chunk a row is of; crossed: by row, whether its group
    compares chunk 0 with chunk 1 only instead of all rows with all.
    """
    n, width = bits.shape
    lane = (~crossed) | (side == 1)
    asks = (~crossed) | (side == 0)
    # lanes: each group's rows are packed into words of 64
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    number = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]).astype(np.int64))))
    before = np.cumsum(lane) - lane
    rank = before - before[starts][number]
    lanes = np.add.reduceat(lane.astype(np.int64), starts)
    words = (lanes + 63) // 64
    base = np.cumsum(words) - words
    total = int(words.sum())
    if not total:
        return
    slot = (base[number] * 64 + rank)[lane]
    grid = np.zeros((total * 64, width), np.uint8)
    grid[slot] = bits[lane]
    owner = np.full(total * 64, -1, np.int64)
    owner[slot] = np.flatnonzero(lane)
    filled = np.packbits((owner >= 0).reshape(total, 64), axis=1, bitorder="little").view(np.uint64)[:, 0]
    packed = np.packbits(grid.reshape(total, 64, width), axis=1, bitorder="little")  # (total, 8, width)
    planes = np.ascontiguousarray(packed.transpose(2, 0, 1)).view(np.uint64)[:, :, 0]
    del grid, packed
    queries = np.flatnonzero(asks)
    per = words[number[queries]]
    ends = np.cumsum(per)
    count = max(1, radius.bit_length())
    offset = (1 << count) - 1 - radius  # a count over the radius then runs out of the counters
    for lo in range(0, int(ends[-1]) if len(ends) else 0, _PAIRS):
        hi = min(lo + _PAIRS, int(ends[-1]))
        pair = np.arange(lo, hi)
        which = np.searchsorted(ends, pair, side="right")
        q = queries[which]
        w = base[number[q]] + pair - (ends[which] - per[which])
        counter = [np.full(len(q), _FULL if offset >> i & 1 else 0, np.uint64) for i in range(count)]
        over = ~filled[w]
        for j in range(0, width, 3):
            x = [planes[k][w] ^ (np.uint64(0) - bits[q, k].astype(np.uint64)) for k in range(j, min(j + 3, width))]
            if len(x) == 3:
                half = x[0] ^ x[1]
                _add(counter, (x[0] & x[1]) | (x[2] & half), 1, over) if count > 1 else np.bitwise_or(over, (x[0] & x[1]) | (x[2] & half), out=over)
                _add(counter, half ^ x[2], 0, over)
            else:
                for y in x:
                    _add(counter, y, 0, over)
            if j % 24 == 21:
                alive = over != _FULL
                if not alive.all():
                    q, w, over, counter = q[alive], w[alive], over[alive], [c[alive] for c in counter]
                    if not len(q):
                        break
        if len(q):
            hit = np.unpackbits((~over).view(np.uint8).reshape(len(q), 8), axis=1, bitorder="little")
            at, bit = np.nonzero(hit)
            left, right = q[at], owner[w[at] * 64 + bit]
            other = left != right
            yield left[other], right[other]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let linked rows, and all that share their labels, share the smallest label."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return
        hi, lo = np.maximum(la[differ], lb[differ]), np.minimum(la[differ], lb[differ])
        np.minimum.at(label, hi, lo)
        while not np.array_equal(up := label[label], label):
            label[:] = up


def spanning(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As ``merge_labels``; gives the pairs (by place) that joined two labels, a spanning forest of the pairs' graph."""
    out = []
    while True:
        la, lb = label[a], label[b]
        differ = np.flatnonzero(la != lb)
        if not len(differ):
            return np.concatenate(out) if out else np.empty(0, np.int64)
        hi, lo = np.maximum(la[differ], lb[differ]), np.minimum(la[differ], lb[differ])
        roots, first = np.unique(hi, return_index=True)
        label[roots] = lo[first]
        out.append(differ[first])
        while not np.array_equal(up := label[label], label):
            label[:] = up


def _forest(radius: int, size: int | None = None):
    """Sorted (key, a, b, chunk, fp) rows in; pairs (fp, fp) within the radius out that span what all pairs join."""

    def compare(names: np.ndarray, chunk: np.ndarray, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        """names: rows (key, a, b); prints: rows of bytes."""
        change = (names[1:] != names[:-1]).any(axis=1)
        new = np.concatenate(([True], change))
        alone = new & np.concatenate((change, [True]))
        some = np.flatnonzero(~alone)
        if not len(some):
            return
        names, chunk, prints, new = names[some], chunk[some], np.ascontiguousarray(prints[some]), new[some]
        bits = np.unpackbits(prints[:, :size], axis=1)
        label = np.arange(len(some))
        a, b = names[:, 1], names[:, 2]
        own = prints.view(f"V{prints.shape[1]}")[:, 0]
        for x, y in within(bits, np.cumsum(new) - 1, (chunk == b).astype(np.int64), a != b, radius):
            joined = spanning(label, x, y)
            x, y = x[joined], y[joined]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in own[z]], pa.binary()) for z in (x, y)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        rows, wait = 0, _ROWS // 4

        def block(last: bool) -> Iterator[pa.RecordBatch]:
            """Whole groups are compared; the last group may have more rows to come."""
            nonlocal held, rows
            if not rows:
                return
            names, chunk, prints = (np.concatenate([h[i] for h in held]) for i in range(3))
            n = rows
            if not last:
                other = np.flatnonzero((names != names[-1]).any(axis=1))
                n = int(other[-1]) + 1 if len(other) else 0
            if n:
                yield from compare(names[:n], chunk[:n], prints[:n])
            held, rows = [(names[n:], chunk[n:], prints[n:])], rows - n

        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "a", "b")], axis=1)
            prints = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            held.append((names, batch.column("chunk").to_numpy(), prints))
            rows += batch.num_rows
            if rows >= wait:
                yield from block(False)
                wait = max(_ROWS // 4, 2 * rows)
        yield from block(True)

    return run


def _alike(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sets of shingles have this Jaccard similarity; their sizes alone may tell."""
    if min(len(x), len(y)) < least * max(len(x), len(y)) - 1e-9:
        return False
    both = np.sort(np.concatenate((x, y)))
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(both) - common) - 1e-9


def _settle(radius: int, size: int, least: float):
    """Sorted (top, a, b, chunk, fp, label, shingles) rows in; links (label, label) out that join what some similar pair within
    the radius joins. Pairs are looked at where they are; at most one a label goes on."""

    def compare(rows: list[tuple]) -> pa.RecordBatch | None:
        """Rows (a, b, chunk, fp, label, shingles) of one tile."""
        bits = np.unpackbits(np.frombuffer(b"".join(r[3][:size] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
        names, label = np.unique(np.array([r[4] for r in rows], dtype=object), return_inverse=True)
        crossed = rows[0][0] != rows[0][1]
        side = np.array([r[2] == r[1] for r in rows], np.int64)
        sets = [np.frombuffer(r[5], "<u8") for r in rows]
        root = np.arange(len(names))
        links = []
        for x, y in within(bits, np.zeros(len(rows), np.int64), side, np.full(len(rows), crossed), radius):
            once = x < y if not crossed else np.ones(len(x), bool)
            for i, j in zip(x[once].tolist(), y[once].tolist(), strict=True):
                p, q = int(root[label[i]]), int(root[label[j]])
                if p != q and _alike(sets[i], sets[j], least):
                    root[root == max(p, q)] = min(p, q)
                    links.append((names[label[i]], names[label[j]]))
        if not links:
            return None
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in links], pa.binary()) for i in (0, 1)], names=["a", "b"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tile = [], None
        for batch in slices(batches, 256):
            for top, *row in zip(*(batch.column(c).to_pylist() for c in ("top", "a", "b", "chunk", "fp", "label", "shingles")), strict=True):
                if (top, row[0], row[1]) != tile:
                    if len(held) > 1 and (out := compare(held)) is not None:
                        yield out
                    held, tile = [], (top, row[0], row[1])
                held.append(tuple(row))
        if len(held) > 1 and (out := compare(held)) is not None:
            yield out

    return run


def _tiled(rows: DataFrame, key: str, counts: DataFrame, tile: int) -> DataFrame:
    """Each row once for every pair of chunks of its key's rows that has its chunk: key, a, b, chunk and the other columns."""
    j = rows.join(counts, key).withColumn("chunks", F.ceil(F.col("n") / tile).cast("int")).drop("n")
    j = j.withColumn("chunk", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int"))
    j = j.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiled = j.withColumns({"a": F.least("chunk", "other"), "b": F.greatest("chunk", "other")}).drop("chunks", "other")
    return tiled.repartition(key, "a", "b").sortWithinPartitions(key, "a", "b")


def near_links(spark: SparkSession, prints: DataFrame, tables: list[np.ndarray], radius: int, tile: int = TILE, size: int | None = None) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``prints(fp)``; their components are those of all pairs within the radius
    that share a key."""
    keyed = prints.mapInArrow(_keys(tables, size), "key long, fp binary")
    # a table of its own, so that the join has two plain exchanges and can split a key with many fingerprints
    crowd = materialize(spark, keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "crowded-keys")
    return _tiled(keyed, "key", crowd, tile).mapInArrow(_forest(radius, size), "a binary, b binary")


def _labelled(spark: SparkSession, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes(fp) with the component of each; one without links is its own."""
    found = connected_components(spark, links.select("a", "b")).toDF("fp", "label")
    return materialize(spark, nodes.join(found, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")), "labels")


def _between(links: DataFrame, labels: DataFrame) -> DataFrame:
    """Links (a, b) between nodes as links between their labels, where these differ."""
    ends = links.select("a", "b").join(labels.toDF("a", "x"), "a").join(labels.toDF("b", "y"), "b")
    return ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))


def _lowest(spark: SparkSession, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(fp, component_id): the smallest least_id of each label, for nodes(fp, least_id) and labels(fp, label)."""
    own = materialize(spark, nodes.join(labels, "fp").select("fp", "label", "least_id"), "labelled")
    # one label may hold a third of all nodes: minima are a table of their own, so that the join can be split
    least = materialize(spark, own.groupBy("label").agg(F.min("least_id").alias("component_id")), "group-minima")
    return own.join(least, "label").select("fp", "component_id")


def simhash_groups(docs: DataFrame, width: int = 3, words: int = 1, radius: int = 2, tables: list[np.ndarray] | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (lowercase hex), component_id (smallest doc_id that can be reached) for every row."""
    spark = docs.sparkSession
    prints = materialize(spark, text_of(docs).mapInArrow(_fingerprints(width, words), "doc_id long, fp binary"), "fingerprints")
    distinct = materialize(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    links = near_links(spark, distinct.select("fp"), tables or pigeonhole_tables(), radius, tile)
    ids = materialize(spark, _lowest(spark, distinct, _labelled(spark, distinct.select("fp"), links)), "components")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def _similar_labels(docs: DataFrame, similarity: float, width: int, words: int, radius: int, tables: list[np.ndarray], tile: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, h, fp) of every row, h a hash of its text; (fp, least_id) of every set of shingles; (fp, label), its group.

    Fingerprints propose, the sets of shingles decide. First one spanning forest of the proposed pairs is checked. Where a pair
    of it fails, the groups around it meet in tiles with their sets, and every pair within the radius between groups that
    are not joined yet is checked there, so that no good pair is missed; only what joins two groups leaves a tile. Texts with
    the same set of shingles are one node; a text without words is linked with its like only.
    """
    spark, size = docs.sparkSession, 8 * words
    texts = text_of(docs)
    prints = texts.withColumn("h", F.xxhash64("text")).mapInArrow(_set_prints(width, words), "doc_id long, h long, fp binary")
    prints = materialize(spark, prints, "fingerprints")
    nodes = materialize(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")

    def sets_of(some: DataFrame) -> DataFrame:
        """(fp, shingles) of these nodes, and of few others: an id may have several texts."""
        wanted = nodes.join(some, "fp", "left_semi").select(F.col("least_id").alias("doc_id")).distinct()
        found = texts.join(wanted.hint("merge"), texts["doc_id"].eqNullSafe(wanted["doc_id"]), "left_semi").select("text")
        sets = found.mapInArrow(_shingle_sets(width, words), "fp binary, shingles binary")
        return materialize(spark, sets.groupBy("fp").agg(F.first("shingles").alias("shingles")), "shingle-sets")

    links = near_links(spark, nodes.select("fp"), tables, radius, tile, size)
    links = materialize(spark, links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "proposed")
    sets = sets_of(links.select(F.col("a").alias("fp")).unionByName(links.select(F.col("b").alias("fp"))).distinct())
    j = links.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b").select("a", "b", "x", "y")
    first = materialize(spark, j.mapInArrow(_similar(similarity), "a binary, b binary, similar boolean"), "checked")
    labels = _labelled(spark, nodes.select("fp"), first.filter("similar"))
    apart = materialize(spark, _between(first.filter("NOT similar"), labels), "apart")
    if not apart.isEmpty():
        around = materialize(spark, connected_components(spark, apart).toDF("label", "top"), "around")
        open_ = materialize(spark, labels.join(around, "label").select("fp", "label", "top").join(sets, "fp"), "unsettled")
        counts = materialize(spark, open_.groupBy("top").agg(F.count("*").alias("n")), "unsettled-sizes")
        tiles = _tiled(open_, "top", counts, min(tile, SETTLE)).select("top", "a", "b", "chunk", "fp", "label", "shingles")
        good = tiles.mapInArrow(_settle(radius, size, similarity), "a binary, b binary")
        joined = materialize(spark, connected_components(spark, good).toDF("label", "more"), "joined")
        labels = materialize(spark, labels.join(joined, "label", "left").select("fp", F.coalesce("more", "label").alias("label")), "labels")
    return prints, nodes, labels


def similar_groups(docs: DataFrame, similarity: float, width: int, words: int, radius: int, tables: list[np.ndarray], tile: int = TILE) -> DataFrame:
    """doc_id, component_id (smallest doc_id that can be reached) for every row; texts are linked if their sets of shingles
    have this Jaccard similarity, among those whose fingerprints share a key and lie within the radius."""
    spark = docs.sparkSession
    prints, nodes, labels = _similar_labels(docs, similarity, width, words, radius, tables, tile)
    ids = materialize(spark, _lowest(spark, nodes, labels), "components")
    return prints.join(ids, "fp").select("doc_id", "component_id")


def near_deduplicate(docs: DataFrame, similarity: float, width: int, words: int, radius: int, tables: list[np.ndarray], tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns: of each group of ``similar_groups`` the row with the smallest doc_id.

    Rows go, not ids: a row is told by its id and a hash of its text, so an id that several texts share, or none, loses no
    text. Among rows with the same id (null comes last) the smallest hash stays; of rows that repeat both, one.
    """
    spark, names = docs.sparkSession, docs.columns
    prints, _, labels = _similar_labels(docs, similarity, width, words, radius, tables, tile)
    own = prints.join(labels, "fp").groupBy("label", "doc_id", "h").agg(F.count(F.lit(1)).alias("n"))
    own = materialize(spark, own, "labelled")
    # one label may hold a third of all rows: what stays is a table of its own, so that the join can be split
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "n")).alias("s")
    stays = materialize(spark, own.groupBy("label").agg(first), "group-firsts")
    gone = own.join(stays, "label").filter(~(F.col("doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("h") == F.col("s.h"))))
    gone = gone.select(F.col("doc_id").alias("_gone"), F.col("h").alias("_h"))
    marked = docs.toDF(*(f"_c{i}" for i in range(len(names))))
    id_, text = (F.col(f"_c{names.index(c)}") for c in ("doc_id", "text"))
    marked = marked.withColumn("_own", F.xxhash64(F.coalesce(text, F.lit(""))))

    def same(other: DataFrame) -> F.Column:
        return id_.cast("long").eqNullSafe(other["_gone"]) & (F.col("_own") == other["_h"])

    # never broadcast: nothing bounds the number of copies
    left = marked.join(gone.hint("merge"), same(gone), "left_anti")
    columns = [f"_c{i}" for i in range(len(names))]
    twice = stays.filter("s.n > 1").select(F.col("s.doc_id").alias("_gone"), F.col("s.h").alias("_h"))
    if twice.isEmpty():
        return left.select(columns).toDF(*names)
    once = left.join(twice.hint("merge"), same(twice), "left_anti").select(columns)
    again = left.join(twice.hint("merge"), same(twice), "left_semi").dropDuplicates([columns[names.index("doc_id")], "_own"]).select(columns)
    return once.unionByName(again).toDF(*names)
