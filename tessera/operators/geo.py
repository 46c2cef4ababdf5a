"""Places: points in polygons, projections, clusters in space and time."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.operators.durable import numbered, stored
from tessera.operators.registry import IN, OUT, ParameterError, names, need, operator


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring of [x, y] points, by counting the edges that a ray crosses."""
    n = F.size(ring)
    edges = F.zip_with(ring, F.concat(F.slice(ring, 2, n), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    crossed = F.filter(edges, lambda e: ((e["a"][1] > y) != (e["b"][1] > y)) & (x < (e["b"][0] - e["a"][0]) * (y - e["a"][1]) / F.when(e["b"][1] != e["a"][1], e["b"][1] - e["a"][1]).otherwise(1.0) + e["a"][0]))
    return F.size(crossed) % 2 == 1


#: Cells of a polygon's cover, at most but for its first ones; halvings of the whole extent from one level to the next, and in all.
COVER, FINER, DEEPEST = 2048, 2, 26


def _touches(edges: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """(cells, edges): whether an edge (x1, y1, x2, y2) meets a cell, ends included."""
    x1, y1, x2, y2 = (edges[:, i] for i in range(4))
    box = (np.maximum(x1, x2) >= low[:, None, 0]) & (np.minimum(x1, x2) <= high[:, None, 0]) & (np.maximum(y1, y2) >= low[:, None, 1]) & (np.minimum(y1, y2) <= high[:, None, 1])
    # the line through the edge has corners of the cell on both sides
    sides = [(x2 - x1) * (cy[:, None] - y1) - (y2 - y1) * (cx[:, None] - x1) for cx in (low[:, 0], high[:, 0]) for cy in (low[:, 1], high[:, 1])]
    return box & (np.minimum.reduce(sides) <= 0) & (np.maximum.reduce(sides) >= 0)


def _holds(ring: np.ndarray, x: float, y: float) -> bool:
    (x1, y1), (x2, y2) = ring.T, np.roll(ring, -1, axis=0).T
    crossed = (y1 > y) != (y2 > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        return bool((crossed & (x < (x2 - x1) * (y - y1) / np.where(crossed, y2 - y1, 1.0) + x1)).sum() % 2)


def cover(ring: np.ndarray, origin: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int, bool]]:
    """A polygon's cells (level, column, row, whole): quadtree cells that it fills, and those that its outline meets, ever finer
    where the outline is until there would be more than ``COVER`` of them."""
    edges = np.concatenate([ring, np.roll(ring, -1, axis=0)], axis=1)
    extent = max(float(((ring.max(axis=0) - ring.min(axis=0)) / size).max()), 2.0**-DEEPEST)
    level = max(0, min(DEEPEST, int(-math.log2(extent))) // FINER * FINER)
    step = size / 2.0**level
    first, last = (np.floor((f(axis=0) - origin) / step).astype(int) for f in (ring.min, ring.max))
    open_ = [(cx, cy) for cx in range(first[0], last[0] + 1) for cy in range(first[1], last[1] + 1)]
    done: list[tuple[int, int, int, bool]] = []
    while True:
        step = size / 2.0**level
        at = np.array(open_, np.int64).reshape(-1, 2)
        low = origin + at * step - 1e-9 * (step + np.abs(origin))
        met = np.zeros(len(at), bool)
        for k in range(0, len(at), 64):
            met[k : k + 64] = _touches(edges, low[k : k + 64], low[k : k + 64] + step + 2e-9 * (step + np.abs(origin))).any(axis=1)
        for (cx, cy), m in zip(open_, met, strict=True):
            if not m and _holds(ring, *(origin + (np.array([cx, cy]) + 0.5) * step)):
                done.append((level, cx, cy, True))
        edge = [c for c, m in zip(open_, met, strict=True) if m]
        finer = 1 << FINER
        if level + FINER > DEEPEST or len(done) + len(edge) * finer * finer > COVER or not edge:
            return done + [(level, cx, cy, False) for cx, cy in edge]
        open_ = [(cx * finer + i, cy * finer + j) for cx, cy in edge for i in range(finer) for j in range(finer)]
        level += FINER


def _covers(origin: np.ndarray, size: np.ndarray):
    def run(batches):
        for batch in batches:
            out = []
            for i, ring in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ring = np.array([p[:2] for p in ring], np.float64)
                out += [(i, *c) for c in cover(ring, origin, size)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["_s", "_level", "_cx", "_cy", "_whole"])

    return run


@operator("within")
def within(inputs, polygon="points", polygon_attributes=None, latitude="latitude", longitude="longitude", alias=None, key=None, **_):
    """Attributes of the first polygon (by order of its attributes) that holds each point, null where none does.

    Each polygon is covered by at most ``COVER`` quadtree cells, whatever its size, and points meet it by equal cells of the levels in use. In a
    cell that the polygon fills there is nothing to test; in one that its outline meets, the ray test decides. Polygons are rings of
    at least three [x, y] places; others, and points with a null place, are in nothing."""
    points, shapes = inputs[IN], inputs["geo data"]
    wanted = names(polygon_attributes)
    ring = F.transform(F.col(polygon), lambda p: F.transform(p, lambda v: v.cast("double")))
    s = shapes.select(ring.alias("_ring"), *(F.col(a).alias(f"_a{i}") for i, a in enumerate(wanted)))
    s = s.filter((F.size("_ring") >= 3) & ~F.exists("_ring", lambda p: p[0].isNull() | p[1].isNull() | F.isnan(p[0]) | F.isnan(p[1])))
    s = numbered(s, "_s")
    bound = lambda f, i: f(F.transform("_ring", lambda p: p[i]))
    box = s.agg(F.min(bound(F.array_min, 0)), F.min(bound(F.array_min, 1)), F.max(bound(F.array_max, 0)), F.max(bound(F.array_max, 1))).first()
    new = [x.strip() for x in (alias.split(",") if isinstance(alias, str) else alias or [])] or wanted
    p = stored(points.withColumn("_id", F.monotonically_increasing_id()), "points") if key is None else points.withColumn("_id", F.col(key))
    if box[0] is None:
        kinds = dict(shapes.dtypes)
        return {OUT: p.withColumns({b: F.lit(None).cast(kinds[a]) for a, b in zip(wanted, new, strict=True)}).drop("_id")}
    origin = np.array([box[0], box[1]])
    size = np.maximum(np.array([box[2] - box[0], box[3] - box[1]]), 1e-9 * (1 + np.abs(origin))) * (1 + 1e-9)
    cells = stored(s.select("_s", "_ring").mapInArrow(_covers(origin, size), "_s long, _level int, _cx long, _cy long, _whole boolean"), "cover")
    levels = sorted(r[0] for r in cells.select("_level").distinct().collect())  # at most DEEPEST / FINER + 1
    x, y = F.col(longitude).cast("double"), F.col(latitude).cast("double")
    at = lambda v, i, level: F.floor((v - float(origin[i])) / float(size[i] / 2.0**level)).cast("long")
    places = F.array(*(F.struct(F.lit(v).alias("_level"), at(x, 0, v).alias("_cx"), at(y, 1, v).alias("_cy")) for v in levels))
    here = x.between(box[0], box[2]) & y.between(box[1], box[3])
    asked = p.filter(here).select("_id", x.alias("_x"), y.alias("_y"), F.explode(places).alias("c")).select("_id", "_x", "_y", "c.*")
    j = asked.join(cells, ["_level", "_cx", "_cy"]).select("_id", "_x", "_y", "_s", "_whole")
    sure = j.filter("_whole").select("_id", "_s")
    tested = j.filter("NOT _whole").join(s.select("_s", "_ring"), "_s").filter(inside(F.col("_x"), F.col("_y"), F.col("_ring"))).select("_id", "_s")
    first = F.min(F.struct(*(f"_a{i}" for i in range(len(wanted))))).alias("_f")
    best = sure.unionByName(tested).join(s.drop("_ring"), "_s").groupBy("_id").agg(first)
    out = p.join(best, "_id", "left").withColumns({b: F.col("_f")[f"_a{i}"] for i, b in enumerate(new)})
    return {OUT: out.drop("_id", "_f")}


_RADIUS = 6378137.0


@operator("cartographic-projection")
def projection(inputs, src_projection=4326, dst_projection=3857, col_lat="lat", col_lon="lon", alias_lat="y", alias_lon="x", **_):
    """WGS 84 degrees (4326), Web Mercator (3857) and UTM on WGS 84 (326zz north, 327zz south)."""
    src, dst = int(src_projection), int(dst_projection)
    y, x = F.col(col_lat).cast("double"), F.col(col_lon).cast("double")
    if src == 3857:
        x, y = F.degrees(x / _RADIUS), F.degrees(2 * F.atan(F.exp(y / _RADIUS)) - F.lit(3.141592653589793) / 2)
    elif src != 4326:
        raise ParameterError(f"no projection from {src}")
    if dst == 3857:
        x, y = F.radians(x) * _RADIUS, F.log(F.tan(F.lit(3.141592653589793) / 4 + F.radians(y) / 2)) * _RADIUS
    elif 32601 <= dst <= 32660 or 32701 <= dst <= 32760:
        x, y = utm(y, x, dst % 100, dst > 32700)
    elif dst != 4326:
        raise ParameterError(f"no projection to {dst}")
    return {OUT: inputs[IN].withColumns({alias_lon: x, alias_lat: y})}


def utm(lat: Column, lon: Column, zone: int, south: bool) -> tuple[Column, Column]:
    """Easting and northing by the series of the transverse Mercator projection."""
    e2, k0 = 0.00669437999014, 0.9996
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    n = _RADIUS / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t, c, a = F.tan(phi) ** 2, ep2 * F.cos(phi) ** 2, F.cos(phi) * lam
    m = _RADIUS * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi))
    east = k0 * n * (a + (1 - t + c) * a**3 / 6 + (5 - 18 * t + t**2 + 72 * c - 58 * ep2) * a**5 / 120) + 500000.0
    north = k0 * (m + n * F.tan(phi) * (a**2 / 2 + (5 - t + 9 * c + 4 * c**2) * a**4 / 24 + (61 - 58 * t + t**2 + 600 * c - 330 * ep2) * a**6 / 720))
    return east, north + (10000000.0 if south else 0.0)


def spread(labels, links, key: str = "k"):
    """Smallest label reachable over links (a, b), by rounds of minima and jumps until nothing changes; each round is a
    table in the shared folder, so that lineage stays short and nothing is left in memory."""
    keep = lambda df: stored(df, "labels")
    now = keep(labels)
    while True:
        near = links.join(now.toDF("b", "lb").hint("merge"), "b").groupBy("a").agg(F.min("lb").alias("m"))
        step = now.join(near.hint("merge"), now[key] == near["a"], "left").select(key, F.least("label", F.coalesce("m", "label")).alias("label"))
        jump = step.join(step.toDF("label", "up").hint("merge"), "label", "left").select(key, F.least("label", F.coalesce("up", "label")).alias("label"))
        new = keep(jump)
        changed = new.join(now.withColumnRenamed("label", "old").hint("merge"), key).filter("label <> old").isEmpty()
        now = new
        if changed:
            return now


def density_clusters(rows, links, least: int, alias: str):
    """Clusters of core rows (at least so many neighbours) and their borders; rows(k), links(a, b) both ways; -1 is noise."""
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    core = stored(degree.filter(F.col("n") >= least).select(F.col("a").alias("k")), "core")
    inner = links.join(core.toDF("a"), "a", "left_semi").join(core.toDF("b"), "b", "left_semi")
    labels = spread(core.withColumn("label", F.col("k")), inner)
    border = links.join(labels.toDF("b", "lb"), "b").groupBy("a").agg(F.min("lb").alias("near"))
    j = rows.join(labels, "k", "left").join(border, rows["k"] == border["a"], "left")
    ids = numbered(labels.select("label").distinct(), alias, [F.asc("label")])
    j = j.withColumn("label", F.coalesce("label", "near")).join(ids, "label", "left")
    return j.select("k", F.coalesce(alias, F.lit(-1)).alias(alias))


def grid_links(rows, axes: list[str], eps: list[float], test: Column):
    """Pairs (a, b) that pass the test, found among neighbouring cells of a grid with these widths."""
    cells = rows.withColumns({f"_c{i}": F.floor(F.col(a) / e).cast("long") for i, (a, e) in enumerate(zip(axes, eps, strict=True))})
    around = cells
    for i in range(len(axes)):
        around = around.withColumn(f"_c{i}", F.explode(F.array(F.col(f"_c{i}") - 1, F.col(f"_c{i}"), F.col(f"_c{i}") + 1)))
    left = around.select(*(F.col(c).alias(f"a_{c}") for c in rows.columns), *(f"_c{i}" for i in range(len(axes))))
    right = cells.select(*(F.col(c).alias(f"b_{c}") for c in rows.columns), *(f"_c{i}" for i in range(len(axes))))
    return left.join(right, [f"_c{i}" for i in range(len(axes))]).filter((F.col("a_k") != F.col("b_k")) & test).select(F.col("a_k").alias("a"), F.col("b_k").alias("b"))


@operator("stdbscan")
def st_dbscan(inputs, LAT="lat", LON="lon", DATETIME="time", key=None, spatial_threshold=500.0, thresold_temporal=60.0, min_sample=15, alias="cluster", zone=None, **_):  # noqa: N803
    """Density clusters of places and times: neighbours are within so many metres and seconds. Places are projected to metres
    around each row's own latitude band by Mercator scale."""
    df = inputs[IN]
    rows = df.select(F.col(need(key, "key")).cast("long").alias("k"), F.col(LAT).cast("double").alias("lat"), F.col(LON).cast("double").alias("lon"), F.col(DATETIME).cast("timestamp").cast("double").alias("t"))
    per = 111320.0
    rows = rows.withColumns({"y": F.col("lat") * per, "x": F.col("lon") * per * F.cos(F.radians("lat"))}).drop("lat", "lon")
    eps, gap = float(spatial_threshold), float(thresold_temporal)
    near = (F.pow(F.col("a_x") - F.col("b_x"), F.lit(2)) + F.pow(F.col("a_y") - F.col("b_y"), F.lit(2)) <= eps**2) & (F.abs(F.col("a_t") - F.col("b_t")) <= gap)
    links = stored(grid_links(rows, ["x", "y", "t"], [eps, eps, gap], near), "neighbours")
    found = density_clusters(rows.select("k"), links, int(min_sample), alias)
    return {OUT: df.join(found, df[key].cast("long") == found["k"]).drop("k")}


@operator("dbscan-clustering")
def dbscan(inputs, features=None, eps=0.5, min_samples=5, key=None, prediction="prediction", **_):
    """Density clusters of points; a row counts among its own neighbours. Pairs are looked for in the grid of the first two
    features and tested on all."""
    df, f = inputs[IN], names(need(features, "features"))
    rows = df.select(F.col(need(key, "key")).cast("long").alias("k"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(f)))
    test = reduce(lambda a, b: a + b, (F.pow(F.col(f"a_x{i}") - F.col(f"b_x{i}"), F.lit(2)) for i in range(len(f)))) <= float(eps) ** 2
    axes = [f"x{i}" for i in range(min(2, len(f)))]
    links = stored(grid_links(rows, axes, [float(eps)] * len(axes), test), "neighbours")
    found = density_clusters(rows.select("k"), links, int(min_samples) - 1, prediction)
    return {OUT: df.join(found, df[key].cast("long") == found["k"]).drop("k")}


@operator("entity-matching")
def entity_matching(inputs, algorithm=None, left_latitude="lat", left_longitude="lon", right_latitude="lat", right_longitude="lon", distance=100.0, left_key="id", right_key="id", left_order=None, right_order=None, **rest):
    """Rows of two tables whose places are within a distance in metres, by a grid join; with an ``algorithm`` or with orders, the routes
    (first table) that trajectories (second table) follow."""
    if algorithm or left_order or right_order:
        from tessera.operators.routes import route_matching

        given = {"left_order": left_order, "right_order": right_order} if left_order and right_order else {}
        return route_matching(inputs, left_key=left_key, right_key=right_key, left_latitude=left_latitude, left_longitude=left_longitude, right_latitude=right_latitude, right_longitude=right_longitude, distance=distance, **given, **rest)
    a, b = inputs["input data 1"], inputs["input data 2"]
    per, eps = 111320.0, float(distance)

    def placed(df, key, lat, lon, p):
        return df.select(F.col(key).alias(f"{p}_key"), (F.col(lat).cast("double") * per).alias(f"{p}_y"), (F.col(lon).cast("double") * per * F.cos(F.radians(F.col(lat).cast("double")))).alias(f"{p}_x"))

    left, right = placed(a, left_key, left_latitude, left_longitude, "a"), placed(b, right_key, right_latitude, right_longitude, "b")
    cell = lambda c: F.floor(c / eps).cast("long")
    left = left.withColumn("cx", F.explode(F.array(*(cell(F.col("a_x")) + i for i in (-1, 0, 1))))).withColumn("cy", F.explode(F.array(*(cell(F.col("a_y")) + i for i in (-1, 0, 1)))))
    j = left.join(right.withColumns({"cx": cell(F.col("b_x")), "cy": cell(F.col("b_y"))}), ["cx", "cy"])
    d = F.sqrt(F.pow(F.col("a_x") - F.col("b_x"), F.lit(2)) + F.pow(F.col("a_y") - F.col("b_y"), F.lit(2)))
    return {"output data 1": j.withColumn("distance", d).filter(F.col("distance") <= eps).select("a_key", "b_key", "distance")}
