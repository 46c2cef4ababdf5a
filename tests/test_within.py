"""Points in polygons against ray tests of all pairs."""

import math

import numpy as np

from tessera.operators import geo
from tessera.operators.registry import run


def blob(rng, at, radius, n):
    angles = np.sort(rng.uniform(0, 2 * math.pi, n))
    r = radius * rng.uniform(0.5, 1.0, n)
    return np.stack([at[0] + r * np.cos(angles), at[1] + r * np.sin(angles)], axis=1)


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rings = {f"p{i:02d}": blob(rng, rng.uniform(-60, 60, 2), rng.choice([0.001, 0.3, 5, 30]), rng.integers(3, 60)) for i in range(25)}
    rings["a square"] = np.array([[0, 0], [0, 16], [16, 16], [16, 0]])
    points = rng.uniform(-90, 90, (1500, 2))
    points[:400] = np.concatenate([r[rng.integers(0, len(r), 16)] + rng.normal(0, 0.0005, (16, 2)) for r in rings.values()])[:400]
    points[400:410] = [[x, y] for x in (0.0, 4.0, 8.0, 16.0, 12.0) for y in (4.0, 8.0)]  # on borders of cells
    shapes = spark.createDataFrame([(k, [list(map(float, p)) for p in r]) for k, r in rings.items()] + [("line", [[0.0, 0.0], [1.0, 1.0]]), ("none", None)], "name string, points array<array<double>>")
    df = spark.createDataFrame([(i, float(p[0]), float(p[1])) for i, p in enumerate(points)] + [(9999, None, 1.0)], "id long, longitude double, latitude double").repartition(3)
    for key in ("id", None):
        got = {r.id: r.name for r in run("within", {"input data": df, "geo data": shapes}, polygon_attributes=["name"], key=key)["output data"].collect()}
        assert got.pop(9999) is None
        want = {i: min((k for k, r in rings.items() if geo._holds(r, *p)), default=None) for i, p in enumerate(points)}
        assert got == want and sum(v is not None for v in got.values()) > 300
    assert run("within", {"input data": df, "geo data": shapes.filter("name = 'none'")}, polygon_attributes=["name"])["output data"].filter("name IS NULL").count() == 1501


def test_covers_are_bounded_and_whole_cells_are_inside():
    rng = np.random.default_rng(5)
    country = blob(rng, (20.0, 40.0), 25, 5000)
    cells = geo.cover(country, np.array([-180.0, -90.0]), np.array([360.0, 180.0]))
    assert len(cells) <= geo.COVER and sum(c[3] for c in cells) > 20
    for level, cx, cy, whole in cells:
        step = np.array([360.0, 180.0]) / 2.0**level
        spots = [np.array([-180.0, -90.0]) + (np.array([cx, cy]) + rng.random(2)) * step for _ in range(5)]
        assert not whole or all(geo._holds(country, *p) for p in spots)
    # the rest of what is inside lies in cells that the outline meets
    found = {c[:3] for c in cells}
    for p in rng.uniform(0, 1, (400, 2)) * 50 + [-5.0, 15.0]:
        if geo._holds(country, *p):
            assert any((v, *(np.floor((p - [-180.0, -90.0]) / (np.array([360.0, 180.0]) / 2.0**v)).astype(int).tolist())) in found for v in {c[0] for c in cells})
