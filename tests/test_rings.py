"""Rings and regions: clipping, simplification, adjacency, against plain versions on made-up shapes."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import rings
from lodestar.operators import regions


def star(r, x, y, size, n):
    turns = sorted(r.random() * 2 * math.pi for _ in range(n))
    return [(x + size * (0.3 + 0.7 * r.random()) * math.cos(t), y + size * (0.3 + 0.7 * r.random()) * math.sin(t)) for t in turns]


def shoelace(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def inside(p, ring):
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1])) % 2 == 1


def gap(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    long = d[0] ** 2 + d[1] ** 2
    t = max(0, min(1, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / long)) if long else 0
    return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])


def crossing(a, b, c, d):
    side = lambda o, p, q: (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])
    return side(a, b, c) * side(a, b, d) < 0 and side(c, d, a) * side(c, d, b) < 0


def touching(one, two, distance):
    if inside(one[0], two) or inside(two[0], one):
        return True
    sides = lambda ring: list(zip(ring, ring[1:] + ring[:1]))
    return any(crossing(a, b, c, d) or min(gap(a, c, d), gap(b, c, d), gap(c, a, b), gap(d, a, b)) <= distance for a, b in sides(one) for c, d in sides(two))


SCHEMA = "id int, ring array<struct<x:double,y:double>>"


def test_adjacency_equals_all_pairs_on_two_hundred_shapes(spark):
    r = random.Random(12)
    shapes = {i: star(r, r.uniform(-12, 12), r.uniform(-9, 9), r.choice([0.1, 0.4, 0.8]), r.randint(3, 8)) for i in range(198)}
    shapes[198] = [(-14.0, -11.0), (-13.0, -11.0), (-13.0, 11.0), (-14.0, 11.0)]  # a long edge
    shapes[199] = star(r, 0, 0, 5.0, 12)
    rows = [(i, [*s, s[0]] if i % 2 else s) for i, s in shapes.items()] + [(500, []), (None, shapes[0]), (501, None)]
    got = {tuple(x) for x in regions.adjacent(spark.createDataFrame(rows, SCHEMA), 0.05, 0.5).collect()}
    want = {(a, b) for a in shapes for b in shapes if a < b and touching(shapes[a], shapes[b], 0.05)}
    assert got == want and len(want) > 40
    plan = regions.adjacent(spark.createDataFrame(rows, SCHEMA), 0.05, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def columns(spark, shapes, *made):
    return spark.createDataFrame([(i, s) for i, s in enumerate(shapes)], SCHEMA).select("id", *made).orderBy("id").collect()


def test_clipping_to_boxes_and_convex_rings(spark):
    r = random.Random(3)
    shapes = [star(r, r.uniform(-1, 1), r.uniform(-1, 1), 2.0, 7) for _ in range(40)] + [[(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)], [(-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5), (-0.5, -0.5)], []]
    hexagon = [(math.cos(k * math.pi / 3), math.sin(k * math.pi / 3)) for k in range(6)]
    six = F.array(*(rings.point(F.lit(x), F.lit(y)) for x, y in hexagon))
    ring = F.col("ring")
    got = columns(spark, shapes, rings.clip_box(ring, -1, -1, 1, 1).alias("box"), rings.clip_convex(ring, six).alias("six"), rings.signed_area(rings.clip_box(ring, -1, -1, 1, 1)).alias("area"))
    grid = [(-2 + (i + 0.5) * 0.04, -2 + (j + 0.5) * 0.04) for i in range(100) for j in range(100)]
    for x, s in zip(got, shapes):
        ring_ = s[:-1] if len(s) > 1 and s[0] == s[-1] else s
        for name, into in (("box", [(-1, -1), (1, -1), (1, 1), (-1, 1)]), ("six", hexagon)):
            clipped = [tuple(p) for p in x[name]]
            assert all(-1.000001 <= p[0] <= 1.000001 and -1.000001 <= p[1] <= 1.000001 for p in clipped)
            raster = sum(inside(p, ring_) and inside(p, into) for p in grid) * 0.04**2 if ring_ else 0
            assert abs(abs(shoelace(clipped)) - raster) < 0.12
        assert x["area"] == pytest.approx(shoelace([tuple(p) for p in x["box"]]))


def test_simplified_rings_stay_within_the_tolerance(spark):
    r = random.Random(5)
    shapes = [star(r, 0, 0, 3.0, 200), [(math.cos(t / 50), math.sin(t / 50)) for t in range(314)], [(0.0, 0.0)], []]
    for x, s in zip(columns(spark, shapes, rings.simplify(F.col("ring"), 0.05).alias("less")), shapes):
        less = [tuple(p) for p in x["less"]]
        assert set(less) <= set(s) and (len(s) < 3 or len(less) < len(s))
        if len(less) > 2:
            assert max(min(gap(p, a, b) for a, b in zip(less, less[1:] + less[:1])) for p in s) <= 0.05 + 1e-12
    assert rings.thinned(np.zeros((0, 2)), 1).tolist() == [] and rings.thinned(np.zeros((5, 2)), 1).tolist() == [True, False, False, False, True]


def test_areas_and_lengths_in_kilometres(spark):
    square = [(30.0, 60.0), (31.0, 60.0), (31.0, 61.0), (30.0, 61.0)]
    (x,) = columns(spark, [square], rings.area_km2(F.col("ring")).alias("a"), rings.length_km(F.col("ring")).alias("l"))
    assert x["a"] == pytest.approx(111.32**2 * math.cos(math.radians(60.5))) and x["l"] == pytest.approx(111.32 * (math.cos(math.radians(60)) + 1 + math.cos(math.radians(61))))


def test_what_a_disk_has_of_the_sea(spark):
    sea = spark.createDataFrame([(0, [(29.0, 40.0), (31.0, 40.0), (31.0, 45.0), (29.0, 45.0)]), (1, [(50.0, 0.0), (51.0, 0.0), (51.0, 1.0)])], "part int, ring array<struct<x:double,y:double>>")
    places = spark.createDataFrame([("in", 30.0, 42.0, 20.0), ("shore", 29.0, 42.0, 20.0), ("out", 10.0, 42.0, 20.0)], "place string, lon double, lat double, km double")
    got = {x["place"]: x for x in regions.reach(places, sea, 0.001).collect()}
    circle = 32 * math.sin(2 * math.pi / 64) * 20**2
    assert set(got) == {"in", "shore"} and got["in"]["km2"] == pytest.approx(circle, rel=1e-3) and got["shore"]["km2"] == pytest.approx(circle / 2, rel=1e-3)
    assert len(got["in"]["ring"]) < 64


def test_points_on_an_edge(spark):
    """Without edges, points on level, upright and slanted ones and on corners are out, on whatever side; a slope of one is exact."""
    from lodestar.functions import geo

    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((-100.0, -20.0), (0.0, -20.0), (80.0, 60.0), (-100.0, 60.0), (-100.0, -20.0))))
    rows = [(-50.0, -20.0), (-100.0, 10.0), (-100.0, -20.0), (0.0, -20.0), (80.0, 60.0), (10.0, 60.0), (20.5, 0.5), (20.0 + 7.33, 7.33), (-50.0, 0.0), (30.0, 0.0), (None, 0.0)]
    x = spark.createDataFrame(rows, "lon double, lat double")
    assert [tuple(r) for r in x.where(geo.in_ring("lon", "lat", ring, edge=False)).collect()] == [(-50.0, 0.0)]
    assert (-50.0, -20.0) in [tuple(r) for r in x.where(geo.in_ring("lon", "lat", ring)).collect()]


def test_a_clipped_ring_is_written_out_once(spark):
    """Sides that clip one after the other make an expression that grows by the side, not by a power of it."""
    text = str(rings.clip_box(F.col("the_ring"), 0, 0, 1, 1))
    assert text.count("the_ring") == 1 and len(text) < 50_000
