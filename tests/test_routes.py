"""Route matching against brute force, and planted trajectories."""

import math

import numpy as np
import pytest

from tessera.operators import routes as R
from tessera.operators.registry import run


def brute(track, route, join):
    """Over all ways to give each place of the track one of the route in order."""
    d = [[float(R.metres(*p, np.array([q[0]]), np.array([q[1]]))[0]) for q in route] for p in track]
    best = {j: 0.0 for j in range(len(route))}
    for row in d:
        best = {j: min(join(row[j], best[k]) for k in range(j + 1)) for j in range(len(route))}
    return min(best.values())


def walk(rng, n, step=300, at=(-19.9, -43.9)):
    heading, out = rng.uniform(0, 6.3), [at]
    for _ in range(n):
        heading += rng.normal(0, 0.5)
        lat, lon = out[-1]
        out.append((lat + step * math.sin(heading) / R.DEGREE, lon + step * math.cos(heading) / R.DEGREE / math.cos(math.radians(lat))))
    return np.array(out)


def test_distances_are_those_of_all_walks():
    rng = np.random.default_rng(1)
    for _ in range(40):
        route = walk(rng, rng.integers(1, 25))
        track = route[rng.integers(0, len(route), rng.integers(1, 12))] if rng.random() < 0.3 else route[: rng.integers(1, len(route) + 1)]
        track = track + rng.normal(0, 0.001, track.shape)
        exact = brute(track, route, max)
        assert R.frechet(track, route, 1e6) == pytest.approx(exact, abs=0.002)
        assert R.frechet(track, route, exact * 0.99 - 0.01) == np.inf
        assert R.warped(track, route) == pytest.approx(brute(track, route, lambda a, b: a + b) / len(track))


def between(route, share):
    """The place after so much of a line of points."""
    at = share * (len(route) - 1)
    i = min(int(at), len(route) - 2)
    return route[i] + (at - i) * (route[i + 1] - route[i])


@pytest.mark.parametrize("measure", ["frechet", "dtw"])
def test_planted_trajectories(spark, measure):
    rng = np.random.default_rng(2)
    lines = {f"r{k}": walk(rng, 30, at=(-19.9 + 0.002 * k, -43.9)) for k in range(12)}
    lines["back"] = lines["r0"][::-1]
    trips, want = [], {}
    for n in range(40):
        name = f"r{n % 12}"
        low, high = sorted(rng.uniform(0, 1, 2)) if n % 3 else (0.0, 1.0)
        high = min(1.0, max(high, low + 0.4))
        shares = np.sort(rng.uniform(low, high, 40))
        shares = shares[(shares < 0.5) | (shares > 0.6)] if n % 2 else shares  # a gap
        noise = rng.normal(0, 12 / R.DEGREE, (len(shares), 2))
        want[n] = name if len(shares) else None
        trips += [(n, float(i), *map(float, between(lines[name], s) + e)) for i, (s, e) in enumerate(zip(shares, noise, strict=True))]
    trips += [(100, float(i), float(p[0]), float(p[1])) for i, p in enumerate(walk(rng, 30, at=(-19.0, -43.0)))]
    trips += [(101, 0.0, None, 1.0), (None, 1.0, -19.9, -43.9)]
    a = spark.createDataFrame([(k, i, float(p[0]), float(p[1])) for k, line in lines.items() for i, p in enumerate(line)], "route_id string, sequence int, lat double, lon double")
    b = spark.createDataFrame(trips, "trip_id int, time double, lat double, lon double").repartition(3)
    made = run("entity-matching", {"input data 1": a, "input data 2": b}, algorithm="routes", left_key="route_id", right_key="trip_id", left_order="sequence", right_order="time", distance=60.0, measure=measure)
    got = {r.key: r.route for r in made["output data 1"].collect()}
    assert got.pop(100) is None and 101 not in got
    assert got == want


def test_long_trajectories_go_in_pieces(spark):
    rng = np.random.default_rng(3)
    line = walk(rng, 40)
    a = spark.createDataFrame([("r", i, float(p[0]), float(p[1])) for i, p in enumerate(line)], "key string, o int, lat double, lon double")
    b = spark.createDataFrame([(1, i, *map(float, between(line, i / 299))) for i in range(300)], "key int, o int, lat double, lon double")
    (row,) = R.match_routes(a, b, 50.0, piece=64)[0].collect()
    (whole,) = R.match_routes(a, b, 50.0)[0].collect()
    assert row.route == whole.route == "r" and row.distance <= whole.distance + 0.002 and row.share == 1.0
