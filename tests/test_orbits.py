"""Orbits against published check vectors, a scalar reading of the same times, and a dense scan for passes."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import orbits

# Published test case of the near-earth model: elements of object 88888 and positions in km by minutes.
TEST = (16.05824518, 0.0086731, 72.8435, 115.9689, 52.6988, 110.5714, 0.66816e-4)
VECTORS = {
    0: (2328.97048951, -5995.22076416, 1719.97067261), 360: (2456.10705566, -6071.93853760, 1222.89727783), 720: (2567.56195068, -6112.50384522, 713.96397400),
    1080: (2663.09078980, -6115.48229980, 196.39640427), 1440: (2742.55133057, -6079.67144775, -326.38095856),
}
SCHEMA = "norad long, epoch timestamp, mean_motion double, eccentricity double, inclination double, node double, perigee double, anomaly double, bstar double, sensor string, access_km double"
EPOCH = dt.datetime(2024, 3, 1, 6)
START = EPOCH.replace(tzinfo=dt.UTC).timestamp()
SATS = [
    (1, EPOCH, 14.59, 0.0001, 98.18, 70.0, 80.0, 280.0, 2e-5, "sar", 350.0), (2, EPOCH, 15.2, 0.001, 51.6, 200.0, 30.0, 10.0, 1e-4, "optical", 900.0),
    (3, EPOCH, 1.0, 0.0002, 0.1, 10.0, 20.0, 30.0, 0.0, "optical", 900.0), (4, EPOCH, None, 0.001, 51.6, 200.0, 30.0, 10.0, 1e-4, "sar", 900.0), (5, EPOCH, 15.9, 0.0, 97.0, 20.0, 0.0, 5.0, 0.0, "optical", 1500.0),
]


def test_published_positions_within_a_kilometre():
    t = np.array([float(m) for m in VECTORS])
    place, ok = orbits.propagate(*(np.full(len(t), x) for x in TEST), t)
    assert ok.all() and np.abs(place - np.array(list(VECTORS.values()))).max() < 0.2


def test_heights_and_latitudes_stay_on_the_orbit(spark):
    got = orbits.positions(spark.createDataFrame(SATS, SCHEMA), F.lit(START), 6000, 60).collect()
    assert len(got) == 5 * 100
    by = {n: [x for x in got if x["norad"] == n] for n in range(1, 6)}
    assert all(680 < x["alt_km"] < 730 and abs(x["lat"]) <= 82 for x in by[1]) and all(abs(x["lat"]) <= 51.9 for x in by[2])
    assert not any(x["ok"] or x["lon"] is not None for n in (3, 4) for x in by[n])
    alone = [orbits.geodetic(orbits.propagate(*(np.array([float(v)]) for v in SATS[0][2:9]), np.array([k / 1.0]))[0], np.array([(START + 60 * k) / 86400 + 2440587.5])) for k in (0, 50, 99)]
    for (lon, lat, alt), k in zip(alone, (0, 50, 99)):
        row = next(x for x in by[1] if x["k"] == k)
        assert (row["lon"], row["lat"], row["alt_km"]) == pytest.approx((lon[0], lat[0], alt[0]))


def test_ground_tracks_leave_out_what_has_no_place(spark):
    got = {x["norad"]: x for x in orbits.ground_tracks(spark.createDataFrame(SATS, SCHEMA), F.lit(START)).collect()}
    assert set(got) == {1, 2, 5} and all(len(x["track"]) == 31 for x in got.values())
    assert got[1]["track"][0]["lon"] == pytest.approx(got[1]["lon"], abs=6e-4)


def scan(lon, lat, hours, step):
    out = []
    for norad, _, *el, sensor, reach in SATS:
        if None in el:
            continue
        inside = []
        for k in range(int(hours * 3600 / step)):
            place, ok = orbits.propagate(*(np.array([float(v)]) for v in el), np.array([k * step / 60]))
            x, y, _ = orbits.geodetic(place, np.array([(START + k * step) / 86400 + 2440587.5]))
            h = math.sin(math.radians(lat - y[0]) / 2) ** 2 + math.cos(math.radians(y[0])) * math.cos(math.radians(lat)) * math.sin(math.radians(lon - x[0]) / 2) ** 2
            km = 2 * 6371.0 * math.asin(math.sqrt(h))
            if ok[0] and km <= reach:
                if inside and inside[-1][1] == k - 1:
                    inside[-1][1:] = [k, min(km, inside[-1][2])]
                else:
                    inside.append([k, k, km])
        out += [(norad, round((START + a * step) * 1000), round((START + (b + 1) * step) * 1000), round(km)) for a, b, km in inside]
    return sorted(out)


def test_passes_equal_a_dense_scan(spark):
    places = spark.createDataFrame([("p", 33.5, 44.6), ("q", -179.9, -10.0)], "place string, lon double, lat double")
    got = orbits.passes(spark.createDataFrame(SATS, SCHEMA), places, F.lit(START), 14, 60).collect()
    for name, x, y in (("p", 33.5, 44.6), ("q", -179.9, -10.0)):
        assert sorted((r["norad"], r["start"], r["end"], r["closest_km"]) for r in got if r["place"] == name) == scan(x, y, 14, 60)
    assert all((r["daylight"] is None) == (r["sensor"] == "sar") for r in got)


def test_sun_over_a_place(spark):
    noon = dt.datetime(2026, 6, 21, 10, tzinfo=dt.UTC).timestamp()
    high, low = spark.range(1).select(*(orbits.sun_elevation(F.lit(30.5), F.lit(50.45), F.lit(noon + h * 3600)) for h in (0, 12))).first()
    assert high > 50 and low < -10


def test_one_file_of_satellites_is_many_tasks(spark, data):
    """A small file is read by one task, which would work out all times of all satellites."""
    from lodestar.plans.geography import _NOW, satellites
    from lodestar.registry import Tables

    sats = satellites(Tables(spark, data)).coalesce(1)
    x = orbits.positions(sats, F.lit(_NOW), 600, 60, ("access_km",))
    assert x.rdd.getNumPartitions() >= 4 and x.columns[3] == "access_km"


def test_the_query_gives_every_place_of_a_track(spark, data):
    """It gave their number alone."""
    from lodestar import catalogue
    from lodestar.plans import geography
    from lodestar.registry import Tables

    sats = geography.satellites(Tables(spark, data)).where("norad < 20")
    want = {(x["norad"], x["k"]): (round(x["lon"], 3), round(x["lat"], 3)) for x in orbits.positions(sats, F.lit(geography._NOW), 45 * 60 + 1, 90).where("ok").collect()}
    got = catalogue.QUERIES["v13_ground_tracks"](spark, data).where("norad < 20").collect()
    found = {(x["norad"], k): (p["lon"], p["lat"]) for x in got for k, p in enumerate(x["track"])}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-3) for k in want)
    assert all(len(x["track"]) == x["points"] == 31 for x in got)
