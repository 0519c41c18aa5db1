import math
import random

import numpy as np
from pyspark.sql import functions as F

from placeloom.operators import spatial as sp

RINGS = "array<array<struct<lon:double,lat:double>>>"


def square(w, s, e, n):
    return [(w, s), (e, s), (e, n), (w, n), (w, s)]


def brute(x, y, rings):
    hits = 0
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            hits += (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
    return hits % 2 == 1


REGIONS = [
    (1, [square(0, 0, 10, 10), square(2, 2, 4, 4)]),  # with a hole
    (2, [square(170, -5, 180, 5), square(-180, -5, -170, 5)]),  # on both sides of the 180th meridian
    (3, [square(-60, 70, 60, 89)]),
    (4, [[(20, 0), (35, 3), (22, 14), (20, 0)], square(40, 40, 40.2, 40.3)]),
    (5, []),
    (6, None),
]


def test_points_in_regions_match_brute_force(spark):
    rng = random.Random(4)
    points = [(i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(300)] + [(1000 + i, rng.uniform(-3, 42), rng.uniform(-3, 42)) for i in range(400)]
    points += [(9001, None, 3.0), (9002, float("nan"), 1.0), (9003, 200.0, 0.0), (9004, 179.9, 0.1), (9005, -179.9, 0.1), (1000, points[300][1], points[300][2])]
    pts = spark.createDataFrame(points, "id int, lon double, lat double").withColumn("geonameid", F.lit(7)).withColumn("rings", F.lit("other"))
    reg = spark.createDataFrame([(i, None if r is None else [[{"lon": float(x), "lat": float(y)} for x, y in ring] for ring in r]) for i, r in REGIONS], f"geonameid int, rings {RINGS}").withColumn("lon", F.lit("x"))
    want = sorted((i, r) for i, x, y in points if x is not None and -180 <= x <= 180 for r, rings in REGIONS if brute(x, y, rings or []))
    for most in (300_000, 0):  # broadcast and salted shuffle
        got = sorted(map(tuple, sp.points_in_regions(pts, reg, "id", "lon", "lat", "geonameid", "rings", max_broadcast_rows=most).collect()))
        assert got == want
    assert sp.points_in_regions(pts.limit(0), reg, "id", "lon", "lat", "geonameid", "rings").count() == 0
    assert sp.points_in_regions(pts, reg.limit(0), "id", "lon", "lat", "geonameid", "rings").count() == 0


def test_cover_is_exact_where_interior():
    edges = sp.ring_edges([[{"lon": x, "lat": y} for x, y in r] for r in REGIONS[0][1]])
    cells = sp.cover_region(edges, 9)
    for level, cx, cy, interior in cells:
        if interior:
            size = 360 / 2**level
            at = np.random.default_rng(1).uniform(0, size, (20, 2))
            assert sp.even_odd(edges, cx * size - 180 + at[:, 0], cy * size - 90 + at[:, 1]).all()


def metres(a, b):
    (x1, y1), (x2, y2) = a, b
    p, q = math.radians(y1), math.radians(y2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(x2 - x1) / 2) ** 2
    return 2 * sp.EARTH_RADIUS_M * math.asin(min(1, math.sqrt(h)))


def test_points_near_points_match_brute_force(spark):
    rng = random.Random(8)
    spots = [(0, 0), (179.99, 10), (-179.99, 10), (30, 89.99), (-150, 89.98), (12, -90)]
    a = [(i, *(lambda s: (max(-180.0, min(180.0, s[0] + rng.uniform(-0.1, 0.1))), max(-90.0, min(90.0, s[1] + rng.uniform(-0.1, 0.1)))))(rng.choice(spots))) for i in range(250)]
    b = [(i, *(lambda s: (max(-180.0, min(180.0, s[0] + rng.uniform(-0.1, 0.1))), max(-90.0, min(90.0, s[1] + rng.uniform(-0.1, 0.1)))))(rng.choice(spots))) for i in range(60)]
    pa, pb = spark.createDataFrame([*a, (999, None, 1.0)], "id int, lon double, lat double"), spark.createDataFrame(b, "g int, x double, y double").withColumn("lon", F.lit(1))
    want = sorted((i, j) for i, *p in a for j, *q in b if metres(p, q) < 5000)
    assert want
    for most in (300_000, 0):
        assert sorted(map(tuple, sp.points_near_points(pa, pb, "id", "lon", "lat", "g", "x", "y", 5000.0, max_broadcast_rows=most).collect())) == want


def test_post_point(spark):
    rows = [(1, (5.0, 6.0), None), (2, (0.0, 0.0), [170.0, 0.0, -170.0, 2.0]), (3, (200.0, 1.0), None), (4, None, [1.0, 2.0, 3.0, 4.0]), (5, None, None), (6, None, [1.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "id int, c struct<lon:double,lat:double>, b array<double>")
    got = {r["id"]: tuple(r["p"]) if r["p"] else None for r in df.select("id", sp.post_point(F.col("c"), F.col("b")).alias("p")).collect()}
    assert got == {1: (5.0, 6.0), 2: (180.0, 1.0), 3: None, 4: (2.0, 3.0), 5: None, 6: None}
