"""Facts of vessels, and the danger forecast's inputs against a plain grid."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lodestar.operators import briefs, danger


def test_facts_of_chosen_vessels_in_order(spark):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    make = spark.createDataFrame
    tables = {
        "vessels": make([("a", "Alba", "PA", None, "", "tanker"), ("b", None, None, "123", "2", None)], "vessel_id string, name string, flag string, imo string, mmsi string, vessel_type string"),
        "scores": make([("a", 70.0), ("b", 40.0), ("c", 39.9)], "vessel_id string, risk double"),
        "breakdown": make([("a", 10.0, "gap", "observed", "x"), ("a", 30.0, "port", "inferred", "y")], "vessel_id string, points double, reason string, provenance string, source string"),
        "gaps": make([("a", day(3, 5), 44.5, 33.25, True, None), ("a", day(2, 1), 44.0, 33.0, False, 30.4)], "vessel_id string, start timestamp, off_lat double, off_lon double, open boolean, duration_h double"),
        "encounters": make([("a", None, "z", day(5), 1.0, 2.0)], "vessel_id string, other_name string, other_vessel_id string, start timestamp, lat double, lon double"),
        "candidates": make([("a", "s1", day(6), True, "Bay"), ("a", "s2", day(6), False, None)], "vessel_id string, sar_id string, ts timestamp, consistent boolean, in_aoi string"),
    }
    chosen = briefs.worth(tables["scores"])
    got = {}
    for x in briefs.vessel_facts(chosen, tables).orderBy("vessel_id", "n").collect():
        got.setdefault(x["vessel_id"], []).append((x["fact"], x["text"]))
    assert set(got) == {"a", "b"} and [f for f, _ in got["a"]] == [f"F{i}" for i in range(1, 9)]
    text = [t for _, t in got["a"]]
    assert text[0] == "Vessel Alba (flag PA, IMO unknown, MMSI unknown, type tanker)." and text[1] == "Heuristic risk score 70 of 100." and text[2] == "+30 points: port (inferred, source y)."
    assert text[4] == "AIS gap starting 02 Jan 01:00 UTC at 44.00N 33.00E, reappeared after 30 h." and text[5].endswith("still dark.")
    assert text[6] == "Encounter with z on 05 Jan at 1.00N 2.00E." and text[7].endswith("inside Bay.")
    assert [t for _, t in got["b"]] == ["Vessel unnamed (flag unknown, IMO 123, MMSI 2, type unknown).", "Heuristic risk score 40 of 100."]


ALERTS = "region string, start double, end double"


def features(spark, alerts, blocks=12):
    day = dt.date(2024, 1, 1)
    attacks = spark.createDataFrame([("x", day - dt.timedelta(days=5)), ("x", day - dt.timedelta(days=11)), ("y", day - dt.timedelta(days=4)), (None, day)], "region string, day date")
    weather = spark.createDataFrame([("x", day, 50.0, 1.0, 9.0)], "region string, day date, cloud double, precip double, wind double")
    pairs = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x")], "a string, b string")
    regions = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "region string")
    rows = danger.features(regions, spark.createDataFrame(alerts, ALERTS), attacks, weather, pairs, F.lit(1704067200), blocks).collect()
    return {(r["region"], r["block"]): r for r in rows}


def test_inputs_of_the_forecast(spark):
    o, h = 1704067200.0, 3600.0
    alerts = [("x", o - h, o + h), ("x", o + 5 * h, o + 13 * h), ("y", o + 6 * h, o + 7 * h), ("y", o - 9 * h, o - h), ("x", o + 900 * h, o + 901 * h), (None, o, o + h), ("w", o, o + h)]
    f = features(spark, alerts)
    assert len(f) == 36 and set(danger.FEATURES) <= set(f["x", 0].asDict())
    assert [f["x", b]["m_1"] for b in range(4)] == [120.0, 360.0, 60.0, 0.0] and [f["x", b]["m_4"] for b in (0, 1, 4)] == [120.0, 480.0, 420.0]
    assert [f["x", b]["active_at_issue"] for b in range(3)] == [1, 1, 0] and [f["x", b]["since_last_h"] for b in (0, 2, 3)] == [0.0, 5.0, 11.0] and f["z", 3]["since_last_h"] == 720.0
    assert f["x", 1]["nb_m_1"] == 60.0 and f["z", 1]["nb_m_1"] == 0.0 and f["x", 1]["nat_m_1"] == 420.0 and f["x", 1]["nat_regions_1"] == 2
    assert (f["x", 0]["y_active"], f["x", 0]["y_new"], f["y", 0]["y_new"], f["x", 11]["y_active"]) == (1, 0, 1, None)
    # Block 0 is issued on the first day: attacks of five days before count, later ones not yet.
    assert (f["x", 0]["attacks_region_7d"], f["x", 0]["attacks_region_28d"], f["x", 0]["attacks_national_7d"], f["y", 0]["attacks_region_7d"], f["y", 3]["attacks_region_7d"]) == (2, 2, 2, 0, 1)
    assert f["x", 0]["cloud"] == 50.0 and f["y", 0]["cloud"] is None and f["x", 4]["cloud"] is None
    assert (f["x", 0]["block_of_day"], f["x", 0]["dow"], f["x", 0]["month_sin"]) == (1, 0, pytest.approx(math.sin(math.pi / 6)))


def test_nothing_of_the_future_is_read(spark):
    o, h = 1704067200.0, 3600.0
    past = [("x", o + 2 * h, o + 3 * h), ("y", o + 13 * h, o + 14 * h)]
    a, b = features(spark, past), features(spark, [*past, ("x", o + 18 * h, o + 40 * h), ("y", o + 20 * h, o + 21 * h)])
    for (region, block), row in a.items():
        if block < 3:
            assert [row[c] for c in danger.FEATURES] == [b[region, block][c] for c in danger.FEATURES]
