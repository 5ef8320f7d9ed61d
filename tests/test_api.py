"""Endpoints over small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestar import api
from tests.test_operators import GRAPH


def test_ranked_entities_carry_reasons_and_flags(spark):
    s = spark.createDataFrame([("v1", 80.0, 1), ("v2", 20.0, 2)], "vessel_id string, risk double, rank int")
    e = spark.createDataFrame([("v1", f"s{i}", f"r{i}", float(i), str(i)) for i in range(5)], "entity string, signal string, reason string, points double, evidence_ref string")
    got = api.ranked(s, e, {"dark": spark.createDataFrame([("v1",)], "vessel_id string")}, min_risk=50).collect()
    assert len(got) == 1 and [x["reason"] for x in got[0]["top"]] == ["r4", "r3", "r2"] and got[0]["dark"]


def test_events_dossier_and_calls(spark):
    day = dt.datetime(2024, 1, 2)
    gaps = spark.createDataFrame([("g", "v", day, False, 1.0, 2.0, 3.0, 4.0), ("h", "v", day + dt.timedelta(days=3), True, 1.0, 2.0, None, None)], "gap_id string, vessel_id string, start timestamp, open boolean, off_lon double, off_lat double, on_lon double, on_lat double")
    t = {"gap": (gaps, "start")}
    got = api.events(t, "gap", last_day=F.lit(dt.date(2024, 1, 2)).cast("timestamp")).collect()
    assert [(r["gap_id"], r["geometry"], len(r["coordinates"])) for r in got] == [("g", "LineString", 2)]
    assert len(api.dossier("vessel_id", "v", {"gaps": gaps, "again": gaps}).first()["gaps"]) == 2
    calls = spark.createDataFrame([("v", "Kerch", "visit", "observed", day, "1"), ("v", "Kerch", "gap", "derived", day, "2")], "vessel_id string, aoi string, kind string, provenance string, ts timestamp, evidence_ref string")
    r = api.occupied_calls(calls, F.lit(day)).first()
    assert r["aois"] == ["Kerch"] and r["observed"] == 1 and len(r["evidence"]) == 2


def test_places_snapshot_and_meta(spark):
    places = spark.createDataFrame([("1", "Kyiv", 30.5, 50.4, 3_000_000, "київ"), ("2", "Kyivets", 24.0, 49.0, 500, "київець")], "id string, name string, lon double, lat double, population long, key string")
    assert [r["name"] for r in api.search_places(places, " КИЇВ").collect()] == ["Kyiv", "Kyivets"]
    up = spark.createDataFrame([("a", "aircraft", dt.datetime(2024, 1, 1, 0, 0), 1), ("a", "aircraft", dt.datetime(2024, 1, 1, 0, 1), 2)], "id string, kind string, ts timestamp, arrival int")
    live, alerts = api.snapshot(up, {"aircraft": 90}, F.lit(dt.datetime(2024, 1, 1, 0, 2)), up)
    assert live.count() == 1 and alerts.count() == 2
    assert {r["name"]: r["rows"] for r in api.meta({"up": up, "none": up.limit(0)}).collect()} == {"up": 2, "none": 0}


def test_rules_are_kept_only_if_they_run():
    rule = GRAPH | {"id": "r"}
    assert api.put_rule([rule], rule) == [rule] and api.delete_rule([rule], "r") == []
    with pytest.raises(ValueError):
        api.put_rule([], rule | {"edges": [["s", "f"], ["f", "s"]]})
    with pytest.raises(KeyError):
        api.delete_rule([], "r")


def test_a_change_is_all_or_nothing(spark, tmp_path):
    e = spark.createDataFrame([("a", "b")], "a string, b string")
    api.commit_change(e, str(tmp_path), "2024-01-01")
    with pytest.raises(ValueError):
        api.commit_change(e, str(tmp_path), "2024-01-01")
    with pytest.raises(Exception):
        api.commit_change(e.select(F.raise_error(F.lit("no")).alias("a"), "b"), str(tmp_path), "2024-01-02")
    assert spark.read.parquet(str(tmp_path)).count() == 1
    assert api.network(spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], "a string, b string, day int"), spark.createDataFrame([("a",)], "node string"), 9, 1).count() == 2
