"""Overlay of polygons against a fine raster."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import overlay
from tests.test_rings import inside, star

SCHEMA = "id int, ring array<struct<x:double,y:double>>"
HEIGHT = 0.02


@pytest.fixture(scope="module")
def shapes():
    r = random.Random(21)
    return [star(r, r.uniform(-1, 1), r.uniform(-1, 1), 0.8, 7) for _ in range(5)]


def raster(shapes, step=0.04):
    at = np.arange(-2.5 + step / 2, 2.5, step)
    return at, np.array([[any(inside((x, y), s) for s in shapes) for x in at] for y in at])


def test_areas_of_unions_differences_and_intersections(spark, shapes):
    make = lambda some: overlay.spans(spark.createDataFrame(list(enumerate(some)), SCHEMA), HEIGHT).select("row", "lo", "hi")
    one, two = make(shapes[:3]), make(shapes[3:])
    _, a = raster(shapes[:3])
    _, b = raster(shapes[3:])
    for got, want in ((overlay.union(one), a), (overlay.minus(one, two), a & ~b), (overlay.both(one, two), a & b)):
        assert got.agg(overlay.size(got, HEIGHT)).first()[0] == pytest.approx(want.sum() * 0.04**2, abs=0.1)
        assert got.groupBy("row").agg(F.max("hi") - F.min("lo"), F.sum(F.col("hi") - F.col("lo")).alias("s")).where("s <= 0").count() == 0
    assert overlay.union(make([])).count() == 0 and overlay.union(make([[(0.0, 0.0), (1.0, 0.0)]])).count() == 0


def test_a_square_with_a_thin_arm_loses_it(spark):
    ring = [(0.0, 0.0), (2.0, 0.0), (2.0, 0.9), (4.0, 0.9), (4.0, 1.1), (2.0, 1.1), (2.0, 2.0), (0.0, 2.0)]
    area = overlay.spans(spark.createDataFrame([(0, ring)], SCHEMA), HEIGHT).select("row", "lo", "hi")
    got = overlay.opened(area, 0.3, HEIGHT)
    corners = 4 * (1 - math.pi / 4) * 0.3**2
    assert got.agg(F.max("hi")).first()[0] < 2.2 and got.agg(overlay.size(got, HEIGHT)).first()[0] == pytest.approx(4 - corners, abs=0.1)
    less, more = overlay.shrunk(area, 0.3, HEIGHT), overlay.grown(area, 0.3, HEIGHT)
    assert less.agg(overlay.size(less, HEIGHT)).first()[0] == pytest.approx(1.4**2, abs=0.1)
    assert more.agg(F.min("lo")).first()[0] == pytest.approx(-0.3, abs=0.01)


def test_front_is_where_occupied_meets_free(spark):
    country = spark.createDataFrame([(0, [(0.0, 0.0), (10.0, 0.0), (10.0, 4.0), (0.0, 4.0)])], SCHEMA)
    # Two overlapping parts hold the east, beyond the border too; a sliver is left free along it.
    occupied = spark.createDataFrame([(1, [(6.0, -1.0), (9.9, -1.0), (9.9, 5.0), (6.0, 5.0)]), (2, [(7.0, 1.0), (8.0, 1.0), (8.0, 3.0), (7.0, 3.0)])], SCHEMA)
    held, free, line = overlay.front(occupied, country, 0.3, 0.05, HEIGHT)
    assert held.agg(overlay.size(held, HEIGHT)).first()[0] == pytest.approx(3.9 * 4, abs=0.1)
    assert free.agg(overlay.size(free, HEIGHT)).first()[0] == pytest.approx(24 - 4 * (1 - math.pi / 4) * 0.09, abs=0.1)
    got = line.agg(overlay.length(line).alias("n"), F.min("ax"), F.max("bx")).first()
    assert got["n"] == pytest.approx(4, abs=0.5) and got[1] == got[2] == 6.0
