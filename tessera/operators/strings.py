"""Clusters of like strings: prefixes of rare 3-grams propose, their 3-grams decide, components.

Of two strings with a Jaccard similarity of at least t, each has a share of t of its 3-grams in common with the other. In one order
of all 3-grams, rare ones first, their first d common 3-grams therefore stand among the first (n - ceil(t n)) + d of each. Strings
meet under their first 3-grams (d = 1); a group with too many pairs goes on to d = 2 and so on, whose groups are smaller, so that
no link is lost and work follows the pairs that share rare 3-grams instead of all pairs. Strings that are linked already are not
compared again.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.durable import numbered, stored
from tessera.operators.geo import spread
from tessera.operators.registry import IN, OUT, names, need, operator

#: Counters of 3-grams (by hash); their numbers only order the 3-grams, so that any would give the same clusters.
COUNTERS = 1 << 16
#: Strings of a tile's side.
TILE = 512
#: Pairs a group may have for each row of the next depth before it goes on there (a tile's pairs are counted all at once, so that a
#: row costs as much as some hundreds of them); depths at most; and rows of a depth for each string,
#: beyond which all groups are compared in tiles.
PAIRS, DEPTHS, ROWS = 256, 8, 256


def grams(value: str) -> frozenset[str]:
    """The 3-grams of a string's characters; a shorter string is one itself."""
    return frozenset(value[i : i + 3] for i in range(len(value) - 2)) or frozenset((value,))


def _crc(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass"))


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(value) to (counter, n) of the strings' 3-grams."""
    n = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for value in batch.column(0).to_pylist():
            n[[_crc(g) % COUNTERS for g in grams(value)]] += 1
    used = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(n[used])], names=["counter", "n"])


def _ordered(count: np.ndarray, threshold: float):
    """(id, value) to (id, value, codes, spare, least): the first 3-grams by rarity, how many may be missing in a like string, and how
    many may not."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, spare, least = [], [], []
            for value in batch.column(1).to_pylist():
                found = sorted((int(count[(c := _crc(g)) % COUNTERS]), c, g) for g in grams(value))
                shared = min(len(found), max(1, math.ceil(threshold * len(found) - 1e-9)))
                codes.append([c for _, c, _ in found[: len(found) - shared + DEPTHS]])
                spare.append(len(found) - shared)
                least.append(shared)
            made = [pa.array(codes, pa.list_(pa.int64())), pa.array(spare, pa.int32()), pa.array(least, pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["id", "value", "codes", "spare", "least"])

    return run


def _like(x: frozenset[str], y: frozenset[str], threshold: float) -> bool:
    common = len(x & y)
    return common >= threshold * (len(x) + len(y) - common) - 1e-12


def _verified(threshold: float):
    """Pairs (a, b, va, vb) that are alike."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_like(grams(x), grams(y), threshold) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


_TILE_KEY = ["depth", "sig", "i", "j"]


#: 3-grams counted in common at once in a tile, and 3-grams and strings that a task remembers.
_COLUMNS, _REMEMBERED = 4096, 1 << 18


def _in_common(rows: list[np.ndarray]) -> np.ndarray:
    """How many numbers each two of these sets have in common."""
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    names_, at, n = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
    shared = n > 1
    column = np.cumsum(shared) - 1
    of, at = of[shared[at]], column[at[shared[at]]]
    common = np.diag([len(r) for r in rows]).astype(np.float32)  # the diagonal plays no part
    for lo in range(0, int(shared.sum()), _COLUMNS):
        here = (at >= lo) & (at < lo + _COLUMNS)
        has = np.zeros((len(rows), min(_COLUMNS, int(shared.sum()) - lo)), np.float32)
        has[of[here], at[here] - lo] = 1
        common += has @ has.T
    return common.astype(np.float64)


def _forest(meets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric graph."""
    left = np.ones(len(meets), bool)
    for start in range(len(meets)):
        todo = [start] if left[start] else []
        left[start] = False
        while todo:
            x = todo.pop()
            new = np.flatnonzero(meets[x] & left)
            left[new] = False
            for y in new.tolist():
                todo.append(y)
                yield x, y


def _tiles(threshold: float):
    """Links (a, b) between labels of like strings, a spanning forest of each tile. Rows come tile by tile."""
    number: dict[str, int] = {}
    known: dict[str, np.ndarray] = {}

    def numbers(value: str) -> np.ndarray:
        if (out := known.get(value)) is None:
            out = known[value] = np.array([number.setdefault(g, len(number)) for g in grams(value)])
        return out

    def links(chunk: np.ndarray, one: bool, values: list[str], labels: np.ndarray) -> Iterator[tuple[int, int]]:
        if (labels == labels[0]).all():
            return
        if max(len(known), len(number)) > _REMEMBERED:
            known.clear()
            number.clear()
        sets = [numbers(v) for v in values]
        size = np.array([len(s) for s in sets], np.float64)
        common = _in_common(sets)
        meets = common >= threshold * (size[:, None] + size - common) - 1e-12
        if not one:
            meets &= chunk[:, None] != chunk
        meets |= labels[:, None] == labels
        for x, y in _forest(meets):
            if labels[x] != labels[y]:
                yield int(labels[x]), int(labels[y])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full() -> Iterator[pa.Table]:
            """Tables of whole tiles."""
            kept: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys = [batch.column(c).to_numpy() for c in _TILE_KEY]
                new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                last = [kept[-1].column(c)[kept[-1].num_rows - 1].as_py() for c in _TILE_KEY] if kept else None
                if last is not None and last != [int(k[0]) for k in keys]:
                    yield pa.Table.from_batches(kept)
                    kept = []
                if len(new):
                    yield pa.Table.from_batches([*kept, batch.slice(0, int(new[-1]))])
                    kept = []
                kept.append(batch.slice(int(new[-1])) if len(new) else batch)
            if kept:
                yield pa.Table.from_batches(kept)

        for table in full():
            keys = [table[c].to_numpy() for c in _TILE_KEY]
            edges = [0, *(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), table.num_rows]
            chunk, label, values, out = table["chunk"].to_numpy(), table["label"].to_numpy(), table["value"].to_pylist(), []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                out.extend(links(chunk[lo:hi], keys[2][lo] == keys[3][lo], values[lo:hi], label[lo:hi]))
            out = sorted({(min(o), max(o)) for o in out})
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def _components(links: DataFrame, key: str) -> DataFrame:
    """(key, label) of all ends of links (a, b): the smallest end that hangs together with it."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return spread(both.select(F.col("a").alias(key)).distinct().withColumn("label", F.col(key)), both, key)


def string_clusters(df: DataFrame, attribute: str, threshold: float = 0.8, seed: int = 1, tile: int = TILE, pairs: int = PAIRS, report: dict | None = None) -> DataFrame:
    """(cluster, value, count): distinct values that hang together by a 3-gram Jaccard similarity of at least ``threshold``, clusters of
    two and more, numbered from 0 by their first value. Nulls are left out. All links are found, whatever the ``seed``, which stays
    for callers that name it. ``report`` gets ``rows``, distinct strings, and ``sent``, how many rows went to tiles."""
    values = df.select(F.col(attribute).cast("string").alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    values = stored(numbered(values, "id", [F.asc("value")]), "values")
    count = np.zeros(COUNTERS, np.int64)
    for r in values.select("value").mapInArrow(_counts, "counter int, n long").groupBy("counter").agg(F.sum("n")).collect():  # a row a counter
        count[r[0]] = r[1]
    known = stored(values.select("id", "value").mapInArrow(_ordered(count, threshold), "id long, value string, codes array<long>, spare int, least int"), "ordered")
    total = known.count()
    rows = known.select(F.posexplode(F.expr("slice(codes, 1, spare + 1)")).alias("pos", "code"), "id", "spare", "least")
    rows = stored(rows.select(F.xxhash64("code").alias("sig"), "id", "pos", (F.col("spare") + 1 - F.col("pos")).alias("more"), "least"), "depth")
    # neighbours in order, and the first string of each group: what is linked here need not be compared in groups
    heads = rows.groupBy("sig").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = rows.join(heads.hint("merge"), "sig").filter("id <> a").select("a", F.col("id").alias("b"))
    near = stars.unionByName(values.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))).distinct()
    texts = known.select("id", "value")
    near = near.join(texts.toDF("a", "va").hint("merge"), "a").join(texts.toDF("b", "vb").hint("merge"), "b").select("a", "b", "va", "vb")
    first = stored(_components(stored(near.mapInArrow(_verified(threshold), "a long, b long"), "near"), "id"), "first")
    known = stored(known.join(first.hint("merge"), "id", "left").withColumn("label", F.coalesce("label", "id")), "known")
    found = []
    for depth in range(1, DEPTHS + 1):
        labelled = rows.join(known.select("id", "label").hint("merge"), "id")
        groups = labelled.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("c"), F.sum("more").alias("more"))
        groups = groups.groupBy("sig").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.sum("more").alias("more"))
        # those of one label have no pair to compare
        groups = groups.filter("n * n > squares").withColumn("deep", (F.col("n") * F.col("n") - F.col("squares")) / 2 > pairs * F.col("more"))
        groups = stored(groups.select("sig", "n", "more", "deep"), "groups")
        more = groups.filter("deep").agg(F.sum("more")).first()[0] or 0
        if depth == DEPTHS or more > ROWS * total:
            groups, more = groups.withColumn("deep", F.lit(False)), 0
        met = rows.join(groups.drop("more").hint("merge"), "sig")
        # a string that a like one may share no further 3-gram with is compared here as well
        here = met.filter(F.expr(f"NOT deep OR least <= {depth}")).withColumn("c", F.ceil(F.col("n") / tile).cast("int"))
        here = here.withColumn("chunk", F.pmod("id", F.col("c")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
        found.append(here.select(F.lit(depth).alias("depth"), "sig", F.least("chunk", "o").alias("i"), F.greatest("chunk", "o").alias("j"), "chunk", "id"))
        if not more:
            break
        deeper = met.filter(F.expr(f"deep AND least > {depth} AND more > 0")).select("sig", "id", "pos", "least")
        deeper = deeper.join(known.select("id", "codes", "spare").hint("merge"), "id").withColumn("p", F.explode(F.expr(f"sequence(pos + 1, spare + {depth})")))
        # one more 3-gram; the next depth looks one place further
        deeper = deeper.select(F.xxhash64("sig", F.expr("codes[p]")).alias("sig"), "id", F.col("p").alias("pos"), (F.col("spare") + depth + 1 - F.col("p")).alias("more"), "least")
        rows = stored(deeper, "depth")
    if report is not None:
        report["rows"], report["sent"] = total, sum(here.count() for here in found)
    links = None
    for here in found:
        tiles = here.join(known.select("id", "value", "label").hint("merge"), "id").repartition(*_TILE_KEY).sortWithinPartitions(*_TILE_KEY)
        made = stored(tiles.select(*_TILE_KEY, "chunk", "label", "value").mapInArrow(_tiles(threshold), "a long, b long").distinct(), "links")
        links = made if links is None else links.unionByName(made)
    joined = _components(links, "k").toDF("label", "top")
    at = known.select("id", "label").join(joined.hint("merge"), "label", "left").select("id", F.coalesce("top", "label").alias("label"))
    tops = at.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("label")
    order = numbered(tops, "cluster", [F.asc("label")])
    clusters = at.join(order.hint("merge"), "label").select("id", "cluster")
    return values.join(clusters.hint("merge"), "id").select("cluster", "value", "count")


@operator("string-clusters")
def clusters_of_strings(inputs, attributes=None, threshold=0.8, seed=1, **_):
    return {OUT: string_clusters(inputs[IN], names(need(attributes, "attributes"))[0], float(threshold), int(seed))}
