"""Routes that trajectories follow: grid signatures propose, a Fréchet distance or time warping in order decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.durable import stored
from tessera.operators.registry import ParameterError, need, operator

#: Metres of a degree of latitude; points of a piece of a trajectory.
DEGREE, PIECE = 111_320.0, 1024
MEASURES = ("frechet", "dtw")


def metres(lat: np.ndarray, lon: np.ndarray, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """Distances of one place to many that are near."""
    dx = (lons - lon) * DEGREE * np.cos(np.radians((lats + lat) / 2))
    return np.hypot(dx, (lats - lat) * DEGREE)


def follows(track: np.ndarray, route: np.ndarray, limit: float) -> bool:
    """Whether all places of a track (lat, lon) lie within a distance of places of a route that come in the same order. Places of
    the route may be passed over, so a track may be sparse, have gaps or cover a part."""
    at = 0
    for lat, lon in track:
        near = metres(lat, lon, route[at:, 0], route[at:, 1]) <= limit
        first = int(near.argmax())
        if not near[first]:
            return False
        at += first  # the earliest place leaves most of the route to what comes
    return True


def frechet(track: np.ndarray, route: np.ndarray, limit: float) -> float:
    """The least distance within which the track follows the route, to a millimetre; inf over the limit. It is the discrete
    Fréchet distance to the places of the route that are not passed over."""
    if not follows(track, route, limit):
        return np.inf
    low, high = 0.0, limit
    while high - low > 0.001:
        middle = (low + high) / 2
        low, high = (low, middle) if follows(track, route, middle) else (middle, high)
    return high


def warped(track: np.ndarray, route: np.ndarray) -> float:
    """The least mean distance of the track's places to places of the route in the same order: time warping in which
    places of the route may be passed over."""
    cost = np.zeros(len(route))
    for lat, lon in track:
        cost = metres(lat, lon, route[:, 0], route[:, 1]) + np.minimum.accumulate(cost)
    return float(cost.min()) / len(track)


def _cell(lat: Column, lon: Column, size: float, dy: int = 0) -> tuple[Column, Column]:
    """Row and column of the grid; columns of each one-degree band are at least ``size`` metres wide everywhere in it."""
    row = F.floor(lat * (DEGREE / size)) + dy
    band = F.floor(row * size / DEGREE)
    width = F.greatest(F.cos(F.radians(F.greatest(F.abs(band), F.abs(band + 1)).cast("double"))), F.lit(1e-6))
    return row.cast("long"), F.floor(lon * width * (DEGREE / size)).cast("long")


def _points(df: DataFrame, key: str, order: str, lat: str, lon: str) -> DataFrame:
    p = df.select(F.col(key).alias("key"), F.col(order).alias("o"), F.col(lat).cast("double").alias("lat"), F.col(lon).cast("double").alias("lon"))
    return p.filter("key IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180").dropDuplicates()


def _filled(routes: DataFrame, step: float) -> DataFrame:
    """(route, o, f, lat, lon): the points of routes, and points between them no more than ``step`` metres apart."""
    w = Window.partitionBy("key").orderBy("o", "lat", "lon")
    r = routes.withColumns({"n": F.row_number().over(w), "lat2": F.lead("lat").over(w), "lon2": F.lead("lon").over(w)})
    east = (F.col("lon2") - F.col("lon")) * DEGREE * F.cos(F.radians((F.col("lat2") + F.col("lat")) / 2))
    steps = F.greatest(F.ceil(F.hypot(east, (F.col("lat2") - F.col("lat")) * DEGREE) / step), F.lit(1))
    r = r.withColumn("steps", F.coalesce(steps, F.lit(1)).cast("int")).withColumn("f", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    part = F.col("f") / F.col("steps")
    between = lambda a, b: F.col(a) + F.coalesce(part * (F.col(b) - F.col(a)), F.lit(0.0))
    return r.select(F.col("key").alias("route"), "n", "f", between("lat", "lat2").alias("lat"), between("lon", "lon2").alias("lon"))


def _decide(measure: str, tolerance: float):
    def run(batches):
        for batch in batches:
            out = []
            for track, route in zip(batch.column("track").to_pylist(), batch.column("line").to_pylist(), strict=True):
                t, r = (np.array([(p["lat"], p["lon"]) for p in x]) for x in (track, route))
                out.append(frechet(t, r, tolerance) if measure == "frechet" else warped(t, r))
            kept = [batch.column(c) for c in ("key", "piece", "route", "n", "hit")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.float64())], names=["key", "piece", "route", "n", "hit", "distance"])

    return run


def match_routes(routes: DataFrame, tracks: DataFrame, tolerance: float, measure: str = "frechet", share: float = 0.8, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """(key, route, distance, share): for each track the route it follows best, null where it follows none; and all it follows.

    Routes and tracks are (key, o, lat, lon). A route is filled up to points half the tolerance apart. A pair is looked at if at least
    ``share`` of the track's points lie in cells around the route; it matches if every piece of the track, of ``piece`` points at most,
    is within the tolerance of a part of the route. The distance is the largest of the pieces, for time warping their mean."""
    line = stored(_filled(routes, tolerance / 2), "routes")
    w = Window.partitionBy("key").orderBy("o", "lat", "lon")
    t = tracks.withColumn("i", F.row_number().over(w) - 1).withColumn("piece", F.floor(F.col("i") / piece).cast("long"))
    t = stored(t.select("key", "piece", "i", "lat", "lon"), "tracks")
    around = []
    for dy in (-1, 0, 1):
        row, column = _cell(F.col("lat"), F.col("lon"), tolerance, dy)
        around += [F.struct(row.alias("cy"), (column + dx).alias("cx")) for dx in (-1, 0, 1)]
    signature = line.select("route", F.explode(F.array(*around)).alias("c")).select("route", "c.cy", "c.cx").distinct()
    row, column = _cell(F.col("lat"), F.col("lon"), tolerance)
    cells = t.groupBy("key", "piece", row.alias("cy"), column.alias("cx")).agg(F.count(F.lit(1)).alias("hit"))  # points of a cell go as one
    sizes = t.groupBy("key", "piece").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("i", "lat", "lon"))).alias("track"))
    pairs = cells.join(signature, ["cy", "cx"]).groupBy("key", "piece", "route").agg(F.sum("hit").alias("hit"))
    pairs = pairs.join(sizes, ["key", "piece"]).filter(F.col("hit") >= share * F.col("n"))
    lines = line.groupBy("route").agg(F.sort_array(F.collect_list(F.struct("n", "f", "lat", "lon"))).alias("line"))
    kinds = dict(tracks.dtypes)["key"], dict(routes.dtypes)["key"]
    told = pairs.join(lines, "route").select("key", "piece", "route", "n", "hit", "track", "line")
    told = told.mapInArrow(_decide(measure, tolerance), f"key {kinds[0]}, piece long, route {kinds[1]}, n long, hit long, distance double").filter(F.col("distance") <= tolerance)
    pieces = t.groupBy("key").agg((F.max("piece") + 1).alias("pieces"))
    whole = F.max("distance") if measure == "frechet" else F.sum(F.col("distance") * F.col("n")) / F.sum("n")
    found = told.groupBy("key", "route").agg(F.count(F.lit(1)).alias("matched"), whole.alias("distance"), (F.sum("hit") / F.sum("n")).alias("share"))
    found = stored(found.join(pieces, "key").filter("matched = pieces").select("key", "route", "distance", "share"), "matches")
    best = found.groupBy("key").agg(F.min(F.struct("distance", "route", "share")).alias("b"))
    return pieces.select("key").join(best, "key", "left").select("key", "b.route", "b.distance", "b.share"), found


@operator("route-matching")
def route_matching(
    inputs, left_key="route_id", left_order="sequence", left_latitude="lat", left_longitude="lon", right_key="trip_id", right_order="time", right_latitude="lat", right_longitude="lon", distance=100.0, measure="frechet",
    share=0.8, **_,
):
    """Which route each trajectory follows. The first input holds routes as points in order, the second trajectories as places in time;
    a trajectory may cover a part of a route, with noise below ``distance`` metres and gaps of any length. ``output data 1`` has one row for each
    trajectory, ``output data 2`` all routes that each follows. Points with a null or impossible place, or no key, are left out."""
    if measure not in MEASURES:
        raise ParameterError(f"measure must be one of {MEASURES}")
    a, b = inputs["input data 1"], inputs["input data 2"]
    routes = _points(a, need(left_key, "left_key"), need(left_order, "left_order"), left_latitude, left_longitude)
    tracks = _points(b, need(right_key, "right_key"), need(right_order, "right_order"), right_latitude, right_longitude)
    best, every = match_routes(routes, tracks, float(distance), measure, float(share))
    return {"output data 1": best, "output data 2": every}
