"""Exact nearest neighbours by pivots, and what is built on them: minimum spanning trees and their clusters.

Points are dealt to the cell of their nearest pivot. A query carries a distance within which its neighbours surely lie, from the
distances of pivots to the points nearest to them; by the triangle inequality it is sent only to the cells that can hold a point
that near. Cells are cut into tiles of at most ``TILE`` points and ``TILE`` queries, so no task holds a cell. Points with the same
coordinates are one point, so that copies cost nothing.

Rows with a null or a coordinate that is not finite have no neighbours and are no neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.durable import stored
from tessera.operators.registry import ParameterError

#: Points, and queries, of a tile; pivots at most; pointers that one task follows to their ends.
TILE, PIVOTS, FEW = 4096, 2048, 1 << 17
METRICS = ("euclidean", "manhattan")
#: More than rounding can add to a sum of squares or its root, relative to it.
_SLACK = 1e-9


def pairwise(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of all rows of a to all rows of b, summed coordinate by coordinate, so that they do not depend on the tile."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        d = a[:, j, None] - b[:, j]
        out += d * d if metric == "euclidean" else np.abs(d)
    return np.sqrt(out) if metric == "euclidean" else out


def _rows(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def points_of(df: DataFrame, features: list[str], key: str, unit: bool = False) -> DataFrame:
    """(k, x): key and coordinates of rows that have them all; ``unit`` scales to length one, as for cosine distances."""
    x = F.array(*(F.col(f).cast("double") for f in features)) if len(features) > 1 or not dict(df.dtypes)[features[0]].startswith("array") else F.col(features[0]).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("k"), x.alias("x"))
    rows = rows.filter(~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.col("k").isNotNull())
    if unit:
        length = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v))
        rows = rows.withColumn("_n", length).select("k", F.when(F.col("_n") > 0, F.transform("x", lambda v: v / F.col("_n"))).otherwise(F.col("x")).alias("x"))
    return rows.withColumn("x", F.transform("x", lambda v: v + 0.0))  # no negative zero


def classes_of(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Points (id, x), one for each place, under its smallest key; and (id, k) of up to ``most`` smallest keys at each.

    A place may hold a third of all rows: keys are cut to ``most`` by salt first."""
    w = Window.partitionBy("x", F.pmod("k", F.lit(64))).orderBy("k")
    few = rows.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= most)
    w = Window.partitionBy("x").orderBy("k")
    few = few.withColumns({"n": F.row_number().over(w), "id": F.min("k").over(Window.partitionBy("x"))}).filter(F.col("n") <= most)
    few = stored(few.select("id", "k", "n", "x"), "places")
    return few.filter("n = 1").select("id", "x"), few.select("id", "k")


@dataclass
class Cells:
    placed: DataFrame  # id, x, cell, far (distance to the pivot)
    pivots: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    near: np.ndarray  # distances of each pivot to the points of its cell nearest to it, inf where there are fewer
    metric: str


def place(points: DataFrame, metric: str = "euclidean", k: int = 8, pivots: int | None = None) -> Cells:
    """Deal points (id, x) into cells; pivots are places with the least hashes, a square root of their number, so that the
    driver holds ``PIVOTS`` places and k distances for each."""
    if metric not in METRICS:
        raise ParameterError(f"metric must be one of {METRICS}")
    n = points.count()
    m = pivots or min(PIVOTS, max(1, math.isqrt(n)))
    chosen = np.array([r[0] for r in points.orderBy(F.xxhash64("x"), "x").limit(m).select("x").collect()], np.float64)
    if not n:
        return Cells(points.select("id", "x", F.lit(0).alias("cell"), F.lit(0.0).alias("far")), np.zeros((0, 0)), *(np.zeros(0),) * 2, np.zeros((0, k)), metric)

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            d = pairwise(_rows(batch.column(1), chosen.shape[1]), chosen, metric)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=["id", "x", "cell", "far"])

    def summary(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, radius, near = np.zeros(len(chosen), np.int64), np.zeros(len(chosen)), np.full((len(chosen), k), np.inf)
        for batch in _pieces(batches, 8192):
            cell, far = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            count += np.bincount(cell, minlength=len(chosen))
            np.maximum.at(radius, cell, far)
            for c in np.unique(cell):
                near[c] = np.sort(np.concatenate([near[c], far[cell == c]]))[:k]
        used = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(radius[used]), pa.array(list(near[used]), pa.list_(pa.float64()))], names=["cell", "n", "radius", "near"])

    placed = stored(points.select("id", "x").mapInArrow(assign, "id long, x array<double>, cell int, far double"), "cells")
    told = placed.select("cell", "far").mapInArrow(summary, "cell int, n long, radius double, near array<double>")
    told = told.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.slice(F.sort_array(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    count, radius, near = np.zeros(len(chosen), np.int64), np.zeros(len(chosen)), np.full((len(chosen), k), np.inf)
    for cell, size, r, close in told.collect():
        count[cell], radius[cell], near[cell] = size, r, close
    return Cells(placed, chosen, radius, count, near, metric)


def _route(cells: Cells, k: int, alone: dict[int, int] | None = None):
    """Queries (id, x, bound, group) to (cell, id, x, bound, group) for each cell that can hold one of the k nearest points.

    Without a bound, it is the k-th smallest distance through a pivot. alone: cells all of whose points have one group, which
    queries of that group need not visit."""
    pivots, radius, count, near, metric = cells.pivots, cells.radius, cells.count, cells.near, cells.metric
    pure = np.full(len(pivots), np.iinfo(np.int64).min)
    for c, g in (alone or {}).items():
        pure[c] = g

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between: dict[int, np.ndarray] = {}
        for batch in _pieces(batches, 256):
            x = _rows(batch.column("x"), pivots.shape[1])
            d = pairwise(x, pivots, metric)
            bound = batch.column("bound").to_numpy(zero_copy_only=False).astype(np.float64)
            if (lost := np.isnan(bound)).any():
                some = d[lost]
                first = np.argsort(some, axis=1, kind="stable")[:, : max(8, k)]
                through = (np.take_along_axis(some, first, axis=1)[:, :, None] + near[first][:, :, :k]).reshape(len(some), -1)
                bound[lost] = np.sort(through, axis=1)[:, k - 1] if through.shape[1] >= k else np.inf
            home = d.argmin(axis=1)
            for h in np.unique(home):
                if h not in between:
                    between[h] = pairwise(pivots[h][None], pivots, metric)[0]
            gap = np.stack([between[h] for h in home])
            mine = d[np.arange(len(d)), home][:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                # a point of another cell is nearer to that cell's pivot than to the query's
                edge = (d * d - mine * mine) / (2 * gap) if metric == "euclidean" else (d - mine) / 2
            edge[np.arange(len(d)), home] = 0
            edge[~np.isfinite(edge)] = 0
            limit = (bound * (1 + _SLACK))[:, None] + _SLACK * (d + radius)
            group = batch.column("group").to_numpy(zero_copy_only=False)
            goes = (count > 0) & (d - radius <= limit) & (edge <= limit) & (pure != group[:, None])
            row, cell = np.nonzero(goes)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *(batch.column(c).take(pa.array(row)) for c in ("id", "x")), pa.array(bound[row]), pa.array(group[row])], names=["cell", "id", "x", "bound", "group"])

    return run


def _tile(k: int, width: int, metric: str, grouped: bool):
    """The k nearest points (distance, then id) of each query of a tile; not itself, or not its own group."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        pid, qid = points["id"].to_numpy(), queries["id"].to_numpy()
        order = np.argsort(pid, kind="stable")
        pid, px, pg = pid[order], _rows(points["x"], width)[order] if len(pid) else None, points["group"].to_numpy()[order]
        qx, qg, bound = _rows(queries["x"], width) if len(qid) else None, queries["group"].to_numpy(), queries["bound"].to_numpy()
        out: list[tuple] = []
        for at in range(0, len(qid) if len(pid) else 0, 256):
            part = slice(at, at + 256)
            d = pairwise(qx[part], px, metric)
            same = qg[part, None] == pg if grouped else qid[part, None] == pid
            d[same | (d > (bound[part] * (1 + _SLACK) + _SLACK)[:, None])] = np.inf
            n = min(k, len(pid))
            last = np.partition(d, n - 1, axis=1)[:, n - 1]
            row, col = np.nonzero((d <= last[:, None]) & np.isfinite(d))
            far = d[row, col]
            by = np.lexsort((col, far, row))  # columns go by id
            row, col, far = row[by], col[by], far[by]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            row, col, far = (v[rank < k] for v in (row, col, far))
            out.append((qid[part][row], far, pid[col]))
        cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.float64, np.int64))]
        return pa.table({"id": pa.array(cols[0]), "dist": pa.array(cols[1]), "other": pa.array(cols[2])})

    return run


def search(cells: Cells, queries: DataFrame, k: int, groups: DataFrame | None = None, alone: dict[int, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, dist, other): the k nearest points of each query (id, x[, bound, group]), and what was sent (cell, id ...).

    A query does not find the point with its id; with ``groups`` (id, group) of the points, none of its own group."""
    spark, width = queries.sparkSession, cells.pivots.shape[1]
    if not len(cells.pivots):
        none = queries.select("id", F.lit(0.0).alias("dist"), F.col("id").alias("other"), F.lit(0).alias("cell")).limit(0)
        return none.drop("cell"), none
    for name, kind in (("bound", "double"), ("group", "long")):
        if name not in queries.columns:
            queries = queries.withColumn(name, F.lit(None if name == "bound" else -1).cast(kind))
    sent = queries.select("id", "x", "bound", "group").mapInArrow(_route(cells, k + 1, alone), "cell int, id long, x array<double>, bound double, `group` long")
    sent = stored(sent, "sent")
    asked = {r[0]: r[1] for r in sent.groupBy("cell").count().collect()}  # one row a pivot
    parts = [(c, -(-int(cells.count[c]) // TILE), -(-n // TILE)) for c, n in asked.items()]
    parts = F.broadcast(spark.createDataFrame(parts, "cell int, np int, nq int"))  # at most PIVOTS rows
    points = cells.placed if groups is None else cells.placed.join(groups.hint("merge"), "id")
    points = points.withColumn("group", F.col("group") if groups is not None else F.lit(-1).cast("long")).join(parts, "cell")
    salt = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = points.select("cell", salt("np").alias("p"), every("nq").alias("q"), "id", "x", "group")
    right = sent.join(parts, "cell").select("cell", every("np").alias("p"), salt("nq").alias("q"), "id", "x", "bound", "group")
    keys = ["cell", "p", "q"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_tile(k, width, cells.metric, groups is not None), "id long, dist double, other long")
    w = Window.partitionBy("id").orderBy("dist", "other")
    return near.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k).drop("_r"), sent


def nearest(df: DataFrame, features: list[str], k: int, key: str, queries: DataFrame | None = None, metric: str = "euclidean", report: dict | None = None) -> DataFrame:
    """(k, other, dist): the k nearest other rows of each row, or of each row of ``queries`` (same columns), by distance and then
    key. ``key`` must be unique. ``report`` gets ``rows``, distinct places, and ``sent``, how often their queries were sent."""
    unit = metric == "cosine"
    rows = points_of(df, features, key, unit)
    places, keys = classes_of(rows, k + 1)
    cells = place(places, "euclidean" if unit else metric, k + 1)
    if queries is None:
        asked, near_self = places, True
        members = rows
    else:
        members = points_of(queries, features, key, unit)
        asked, _ = classes_of(members, 1)
        # ids of queries are keys of another table: they are told apart from the points' by their sign
        asked, near_self = asked.select((-1 - F.col("id")).alias("id"), "x"), False
    near, sent = search(cells, asked, k)
    if report is not None:
        report["rows"], report["sent"] = asked.count(), sent.count()
    near = stored(near, "near-places")
    # back from places to rows: up to k keys at each place that is near, and at a row's own place
    told = near.join(keys.toDF("other", "n"), "other").select("id", "dist", "n")
    if near_self:
        told = told.unionByName(keys.select("id", F.lit(0.0).alias("dist"), F.col("k").alias("n")))
    w = Window.partitionBy("id").orderBy("dist", "n")
    told = stored(told.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1).groupBy("id").agg(F.sort_array(F.collect_list(F.struct("dist", "n"))).alias("near")), "near-rows")
    at = asked.join(told, "id").select(F.col("x").alias("_x"), "near")
    j = members.join(at.hint("merge"), members["x"] == at["_x"])  # a place may hold a third of all rows: a join that can be split
    others = F.filter("near", lambda r: r["n"] != F.col("k")) if near_self else F.col("near")
    j = j.select("k", F.explode(F.slice(others, 1, k)).alias("r"))
    found = j.select("k", F.col("r.n").alias("other"), F.col("r.dist").alias("dist"))
    return found.withColumn("dist", F.col("dist") * F.col("dist") / 2) if unit else found


# --- spanning trees


def _followed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(batches)
    if not batches:
        return
    c, p = (np.concatenate([b.column(i).to_numpy() for b in batches]) for i in (0, 1))
    order = np.argsort(c)
    c, p = c[order], p[order]
    at = np.searchsorted(c, p)
    while not (at == (new := at[at])).all():
        at = new
    yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(c[at])], names=["c", "p"])


def follow(pointers: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (id, group) after each group followed its pointer (c, p) to the end; the smaller of two groups that point at each
    other is an end, and so is a group without pointer. There are no longer cycles."""
    back = pointers.toDF("_c", "_p").hint("merge")
    mutual = pointers.join(back, (pointers["p"] == back["_c"]) & (pointers["c"] == back["_p"]), "left_semi").filter("c < p").select("c")
    heads = pointers.join(mutual.hint("merge"), "c", "left_anti")
    every = labels.select(F.col("group").alias("c")).distinct()
    now = stored(every.join(heads.hint("merge"), "c", "left").select("c", F.coalesce("p", "c").alias("p")), "pointers")
    if now.count() <= FEW:
        now = stored(now.coalesce(1).mapInArrow(_followed, "c long, p long"), "ends")
    else:
        while True:
            new = stored(now.join(now.toDF("p", "_q").hint("merge"), "p").select("c", F.col("_q").alias("p")), "pointers")
            if new.join(now.toDF("c", "_o").hint("merge"), "c").filter("p <> _o").isEmpty():
                break
            now = new
    ends = now.toDF("group", "_end").hint("merge")
    return stored(labels.join(ends, "group").select("id", F.col("_end").alias("group")), "labels")


def _through(cells: Cells, best: np.ndarray, groups: np.ndarray):
    """(group, bound): of each query (id, x, group), the least distance to another group's point through a pivot; best and groups
    hold, for each cell, the two smallest distances of different groups' points to its pivot."""
    pivots, metric = cells.pivots, cells.metric

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            d = pairwise(_rows(batch.column("x"), pivots.shape[1]), pivots, metric)
            own = batch.column("group").to_numpy()
            foreign = np.where(groups[:, 0] == own[:, None], best[:, 1], best[:, 0])
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array((d + foreign).min(axis=1))], names=["group", "bound"])

    return run


def spanning_tree(points: DataFrame, metric: str = "euclidean", k: int = 8, cells: Cells | None = None) -> DataFrame:
    """(round, c, a, b, dist): a minimum spanning tree of points (id, x) by Borůvka's rounds.

    In each round every group takes its shortest edge to another one (ties by the smaller ends), so that groups at least halve.
    Tables that grow with the points are joined by shuffles and merges: sent to all tasks they would pass through the driver.
    The k nearest points of each give most of these edges. A group searches further only with the points whose k-th neighbour
    is nearer than the shortest edge known to its group, and only so far. c is the group whose edge it is."""
    cells = cells or place(points, metric, k + 1)
    near = stored(search(cells, points, k)[0], "neighbours")
    reach = near.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("reach"))
    reach = stored(points.join(reach.hint("merge"), "id", "left").select("id", "x", F.when(F.col("n") >= k, F.col("reach")).otherwise(F.lit(0.0)).alias("reach")), "reach")
    labels, edges, number = points.select("id", F.col("id").alias("group")), None, 0
    edge = F.struct("dist", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"), "a", "b").alias("e")
    while labels.select("group").distinct().limit(2).count() > 1:
        named = near.join(labels.hint("merge"), "id").join(labels.toDF("other", "_g").hint("merge"), "other").filter(F.col("group") != F.col("_g"))
        known = stored(named.select("group", F.col("id").alias("a"), F.col("other").alias("b"), "dist").groupBy("group").agg(F.min(edge).alias("e")), "known")
        rows = reach.join(labels.hint("merge"), "id")
        # points that may have a nearer foreign point than their group knows of: their k neighbours end before it
        unsure = rows.join(known.select("group", F.col("e.dist").alias("bound")).hint("merge"), "group", "left").filter("bound IS NULL OR reach <= bound")
        unsure = stored(unsure.select("id", "x", "group", "bound"), "unsure")
        found = known
        if not unsure.isEmpty():
            firsts = cells.placed.join(labels.hint("merge"), "id").groupBy("cell", "group").agg(F.min("far").alias("far"))
            two = firsts.withColumn("_r", F.row_number().over(Window.partitionBy("cell").orderBy("far", "group"))).filter("_r <= 2").collect()  # two rows a pivot
            best, groups = np.full((len(cells.pivots), 2), np.inf), np.full((len(cells.pivots), 2), -1, np.int64)
            for r in two:
                best[r.cell, r._r - 1], groups[r.cell, r._r - 1] = r.far, r.group
            alone = {c: int(groups[c, 0]) for c in range(len(best)) if np.isfinite(best[c, 0]) and not np.isfinite(best[c, 1])}
            limits = unsure.filter("bound IS NULL").select("id", "x", "group").mapInArrow(_through(cells, best, groups), "`group` long, bound double")
            limits = limits.groupBy("group").agg(F.min("bound").alias("_limit"))
            unsure = unsure.join(limits.hint("merge"), "group", "left").select("id", "x", "group", F.coalesce("bound", "_limit").alias("bound"))
            more = search(cells, unsure, 1, groups=labels, alone=alone)[0]
            more = more.join(labels.hint("merge"), "id").select("group", F.col("id").alias("a"), F.col("other").alias("b"), "dist")
            found = known.unionByName(more.groupBy("group").agg(F.min(edge).alias("e"))).groupBy("group").agg(F.min("e").alias("e"))
        chosen = stored(found.select(F.lit(number).alias("round"), F.col("group").alias("c"), "e.a", "e.b", "e.dist"), "edges")
        pointers = chosen.join(labels.toDF("b", "p").hint("merge"), "b").select("c", "p")
        labels = follow(pointers, labels)
        edges, number = chosen if edges is None else edges.unionByName(chosen), number + 1
    if edges is None:
        return points.select(F.lit(0).alias("round"), F.col("id").alias("c"), F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("dist")).limit(0)
    return edges


def cut_tree(points: DataFrame, edges: DataFrame, clusters: int | None = None, threshold: float | None = None) -> DataFrame:
    """(id, group): single-linkage clusters; a tree without its ``clusters`` - 1 longest edges (ties: greater ends first), or
    without those of at least ``threshold``. group is the smallest id of a cluster."""
    low, high = F.least("a", "b"), F.greatest("a", "b")
    if threshold is not None:
        kept = edges.filter(F.col("dist") < threshold)
    elif clusters and clusters > 1:
        tree = edges.select("dist", low.alias("low"), high.alias("high")).distinct()  # groups may have taken the same edge
        gone = stored(tree.orderBy(F.desc("dist"), F.desc("low"), F.desc("high")).limit(clusters - 1).select("low", "high"), "cut")
        kept = edges.join(gone.hint("merge"), (low == gone["low"]) & (high == gone["high"]), "left_anti")
    else:
        kept = edges
    labels = points.select("id", F.col("id").alias("group"))
    # round by round as the tree grew: without the cut edges, still each part has one edge of its own at most
    for (number,) in sorted(map(tuple, kept.select("round").distinct().collect())):
        some = kept.filter(F.col("round") == number)
        ends = some.join(labels.toDF("a", "c0").hint("merge"), "a").join(labels.toDF("b", "p").hint("merge"), "b").filter("c0 <> p").select(F.col("c0").alias("c"), "p").distinct()
        labels = follow(ends, labels)
    least = labels.groupBy("group").agg(F.min("id").alias("_least"))
    return labels.join(least.hint("merge"), "group").select("id", F.col("_least").alias("group"))

