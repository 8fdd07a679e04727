import json

import numpy as np
import pytest

from tessera.operators import places as G

SQUARE = json.dumps({"type": "Polygon", "coordinates": [[[0, 0], [10, 0], [10, 10], [0, 10], [0, 0]], [[4, 4], [6, 4], [6, 6], [4, 6]]]})
PIECES = json.dumps({"type": "MultiPolygon", "coordinates": [[[[20, 0], [30, 0], [25, 9]]], [[[-30, -5], [-20, -5], [-20, 5], [-30, 5]]]]})
CONCAVE = json.dumps({"type": "Polygon", "coordinates": [[[5, -5], [15, -5], [15, 5], [10, -3], [5, 5]]]})


def inside(lon, lat, boundary):
    """Ray to the right, edge by edge."""
    g = json.loads(boundary)
    for rings in [g["coordinates"]] if g["type"] == "Polygon" else g["coordinates"]:
        odd = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if (y1 > lat) != (y2 > lat) and lon < x1 + (lat - y1) * (x2 - x1) / (y2 - y1):
                    odd = not odd
        if odd:
            return True
    return False


def tables(spark, n=3000, seed=3):
    rng = np.random.default_rng(seed)
    pts = [(k, float(x), float(y), "p") for k, (x, y) in enumerate(zip(rng.uniform(-35, 35, n), rng.uniform(-12, 12, n)))]
    pts += [(n + k, 1.0001, 1.0001, "hot") for k in range(n // 2)]  # a third of all points on one spot
    pts += [(-1, None, 1.0, "x"), (-2, float("nan"), 1.0, "x"), (-3, float("inf"), 1.0, "x"), (-4, 200.0, 95.0, "x")]
    st = [(f"S{k}", float(x), float(y), float(r)) for k, (x, y, r) in enumerate(zip(rng.uniform(-35, 35, 40), rng.uniform(-12, 12, 40), rng.uniform(1e4, 4e5, 40)))]
    st += [("hot", 1.0, 1.0, 100.0), (None, 0.0, 0.0, 1e7), ("bad", 0.0, 0.0, None), ("neg", 0.0, 0.0, -1.0)]
    zo = [("A", SQUARE), ("B", PIECES), ("C", CONCAVE), ("D", None), ("E", "no json"), (None, SQUARE), ("F", '{"type": "Point", "coordinates": [0, 0]}')]
    return (
        spark.createDataFrame(pts, "id long, lon double, lat double, place_id string"),
        spark.createDataFrame(st, "s string, lon double, lat double, r double"),
        spark.createDataFrame(zo, "z string, b string"),
        pts, st, zo,
    )


@pytest.mark.parametrize("cell_rows", [100_000, 200])
def test_against_brute_force(spark, cell_rows):
    p, s, z, pts, st, zo = tables(spark)
    got = [(r["id"], r["place_id"]) for r in G.points_at_places(p, ["id"], "lon", "lat", s, z, cell_rows=cell_rows).collect()]
    want = set()
    for i, x, y, _ in pts:
        if x is None or not np.isfinite(x):
            continue
        want |= {(i, n) for n, b in zo[:3] if inside(x, y, b)}
        if abs(x) <= 180 and abs(y) <= 90:
            want |= {(i, n) for n, a, b, r in st[:41] if G.great_circle_m(x, y, a, b) <= r}
    assert len(got) == len(set(got)) and set(got) == want


def test_empty_sides(spark):
    p, s, z, *_ = tables(spark, 20)
    run = lambda *a: G.points_at_places(a[0], ["id"], "lon", "lat", a[1], a[2]).count()
    assert run(p.limit(0), s, z) == 0 and run(p, s.limit(0), z.limit(0)) == 0 and run(p, None, None) == 0


def test_box_of_a_region_holds_its_points():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b, c, d = rng.uniform(-180, 180), rng.uniform(-90, 90), rng.uniform(0, 120), rng.uniform(0, 60)
        ring = np.array([[a, b], [a + c, b], [a + c, b + d], [a, b + d]])
        low, high = G._box_of([[ring]])
        xyz = G._unit(rng.uniform(a, a + c, 200), rng.uniform(b, b + d, 200))
        assert (xyz >= np.array(low) - 1e-9).all() and (xyz <= np.array(high) + 1e-9).all()


def test_tree_ball():
    rng = np.random.default_rng(1)
    xyz = G._unit(rng.uniform(-180, 180, 5000), rng.uniform(-90, 90, 5000))
    tree = G.KdTree(xyz)
    for r in (0.01, 0.3, 2.1):
        c = xyz[7]
        assert sorted(tree.ball(c, r)) == sorted(np.flatnonzero(((xyz - c) ** 2).sum(axis=1) <= r * r))
    same = G.KdTree(np.repeat(xyz[:1], 3000, axis=0))
    assert len(same.ball(xyz[0], 0.0)) == 3000 and len(G.KdTree(xyz[:0]).ball(xyz[0], 1.0)) == 0
