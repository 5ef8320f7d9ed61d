"""Classification, vessel risk, reports and threat on known cases."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestar.operators import classify, reports, threat, vessels


@pytest.mark.parametrize("model,want", [
    ("Boeing KC-135R Stratotanker", ("tanker", None, "KC-135")), ("Sikorsky UH-60A", ("utility", "helicopter", "UH-60")), ("RQ-4B Global Hawk", ("isr", "uav", "RQ-4")),
    ("V-22 Osprey", ("unknown", "tiltrotor", "V-22")), ("CV-22B", ("airlift", "tiltrotor", "CV-22")), ("NKC-135", ("tanker", None, "NKC-135")), ("AN-26", None), ("Pilatus PC-12", None), ("Tu-134 A-3", None), ("Cessna 172", None), (None, None), ("BD-700 / E-11A", ("electronic", None, "E-11")),
])
def test_designations(spark, model, want):
    d = spark.createDataFrame([(model,)], "m string").select(classify.designation(F.col("m")).alias("d")).first()["d"]
    assert (d and tuple(d)) == want


def test_aircraft_classification(spark):
    live = spark.createDataFrame([("~43be10", None, "RCH913 ", None, 1, None, None), ("ae0001", "K35R", "FORTE10", "58-0001", 0, None, None), ("123456", None, None, None, 0, None, None), ("ae0002", "EUFI", None, "LX-N90", 1, "B6", None)], "hex string, type string, flight string, reg string, flags int, category string, desc string")
    reg = spark.createDataFrame([("ae0001", "r", "K35R", "KC-135R", "US AIR FORCE", "L4J")] + [(f"ff{i}", "r", "K35R", "KC-135R", None, None) for i in range(3)], "hex string, reg string, type string, model string, operator string, short_type string")
    blocks = spark.createDataFrame([(0x43BE00, 0x43BEFF, "Bermuda", "bm"), (0x400000, 0x43FFFF, "UK", "gb"), (0xADF7C8, 0xAFFFFF, "United States", "us")], "start long, end long, country string, code string")
    known = spark.createDataFrame([("EUFI", "fighter", "fixed_wing")], "type string, role string, airframe string")
    got = {r["hex"]: r for r in classify.aircraft(live, reg, blocks, known).collect()}
    assert got["43be10"]["state"] == "Bermuda" and got["43be10"]["callsign_family"] == "RCH" and got["43be10"]["org"] == "Bermuda military"
    a = got["ae0001"]
    assert (a["role"], a["org"], a["designation"]) == ("tanker", "United States Air Force", "KC-135") and "designation KC-135" in a["evidence"]
    assert not got["123456"]["military"] and got["123456"]["role"] is None and got["123456"]["evidence"] == []
    assert got["ae0002"]["role"] == "fighter" and got["ae0002"]["uav"] and got["ae0002"]["org"] == "NATO"


def test_learned_roles_need_votes_and_a_majority(spark):
    rows = [("A", "KC-135")] * 3 + [("A", "RC-135")] * 2 + [("B", "KC-1")] * 2 + [("C", "KC-1")] * 3 + [("C", "RC-1")] * 3
    assert {r["type"]: r["role"] for r in classify.learned_roles(spark.createDataFrame(rows, "type string, model string")).collect()} == {"A": "tanker"}


def test_naval_classes(spark):
    ships = spark.createDataFrame([("273000001", "USS COLE", 35), ("273000002", None, 55), ("002730000", "x", 70), ("273000003", "HS THING", None)], "mmsi string, name string, type_code int")
    got = {r["mmsi"]: r for r in classify.vessels(ships, spark.createDataFrame([("273", "ru", "Russia")], "mid string, code string, country string")).collect()}
    assert got["273000001"]["naval_role"] == "warship" and len(got["273000001"]["evidence"]) == 2 and got["273000001"]["org"] == "Russia Navy"
    assert got["273000002"]["naval_role"] == "law_enforcement" and not got["002730000"]["military"] and got["002730000"]["state"] is None and got["273000003"]["naval_role"] == "warship"


def at(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


@pytest.fixture(scope="module")
def fleet(spark):
    v = spark.createDataFrame([("v1", "A", "oil tanker", "1234567", "273000001"), ("v2", "B", "bulk_carrier", None, "273000002"), ("v3", "C", None, None, None)], "vessel_id string, name string, vessel_type string, imo string, mmsi string")
    gaps = [(f"g{i}", "v1", at(24 * i), at(24 * i + 20), 20.0, 36.0, 45.0, 37.0, 45.0, False) for i in range(5)] + [("bad", "v2", at(0), at(2), 2.0, 36.0, 45.0, 38.6, 45.0, False), ("open", "v2", at(0), None, None, 36.0, 45.0, None, None, True)]
    g = spark.createDataFrame(gaps, "gap_id string, vessel_id string, start timestamp, end timestamp, duration_h double, off_lon double, off_lat double, on_lon double, on_lat double, open boolean")
    sar = spark.createDataFrame([("on", at(8), 36.5, 45.0, 1), ("early", at(0), 37.0, 45.0, 1), ("far", at(8), 60.0, 45.0, 1)], "sar_id string, ts timestamp, lon double, lat double, detections int")
    e = vessels.envelopes(g, v)
    t = {"vessels": v, "gaps": g, "envelopes": e, "candidates": vessels.candidates(g, e, sar, 700), "near": spark.createDataFrame([("g1", "on", "Kerch", 12.0), ("g1", "off", "Kerch", 30.0), ("g0", "on", "Far", 99.0)], "gap_id string, end_at string, aoi string, km double")}
    t["encounters"] = spark.createDataFrame([(f"e{i}", "v1", "v2", at(i)) for i in range(3)], "enc_id string, vessel_id string, other_vessel_id string, start timestamp")
    t["port_visits"] = spark.createDataFrame([("p1", "v1", at(1), "Kerch", True)], "visit_id string, vessel_id string, start timestamp, aoi string, occupied_aoi boolean")
    t["identities"] = spark.createDataFrame([("v1", "A", "RU", at(1)), ("v1", "B", "RU", at(2)), ("v1", "B", None, at(3)), ("v1", "B", None, at(4))], "vessel_id string, name string, flag string, date_from timestamp")
    t["sanctions"] = spark.createDataFrame([("s1", None, ["273000002"], True, False, True)], "os_id string, imo string, mmsis array<string>, sanctioned boolean, shadow_fleet boolean, detained boolean")
    return t


def test_speed_classes_and_impossible_gaps(fleet):
    e = {r["gap_id"]: r for r in fleet["envelopes"].collect()}
    assert e["g0"]["vmax_kn"] == pytest.approx(16.5) and e["bad"]["vmax_kn"] == pytest.approx(15.4) and e["bad"]["speed_class"] == "cargo" and e["bad"]["impossible"] and "open" not in e


def test_detections_match_by_place_day_and_time(fleet):
    c = {(r["gap_id"], r["sar_id"]): r for r in fleet["candidates"].collect()}
    assert c["g0", "on"]["consistent"] and c["g0", "on"]["earliest"] == at(8) and c["g0", "on"]["gap_consistent_candidates"] == 1
    assert not c["g0", "early"]["consistent"] and c["g0", "early"]["earliest"] is None and ("g0", "far") not in c and ("g1", "on") not in c


def test_vessel_risk_caps_and_as_of(spark, fleet):
    ev = vessels.evidence(fleet)
    points = {(r["entity"], r["signal"]): r["p"] for r in ev.groupBy("entity", "signal").agg(F.sum("points").alias("p")).collect()}
    assert points == {("v1", "gap"): 30, ("v1", "gap_near_occupied"): 20, ("v1", "verified_dark"): 25, ("v1", "encounter"): 20, ("v1", "encounter_sanctioned"): 15, ("v1", "occupied_port_visit"): 20, ("v1", "identity_change"): 10,
                      ("v2", "sanctioned"): 30, ("v2", "psc_detention"): 5, ("v2", "gap"): 20, ("v2", "impossible_gap"): 15}
    r = {x["vessel_id"]: x for x in vessels.risk(fleet).collect()}
    assert r["v1"]["risk"] == 100 and r["v1"]["rank"] == 1 and r["v2"]["risk"] == 70 and r["v3"]["risk"] == 0
    for days in range(3):
        g = vessels.evidence(fleet, F.lit(at(24 * days + 1))).where("entity = 'v1' AND signal = 'gap'").agg(F.sum("points")).first()[0]
        assert g == 10 * (days + 1)


def test_reports(spark):
    places = spark.createDataFrame([("1", "Sumy", 50.9, 34.8, 250000, "суми"), ("2", "Bucha", 50.5, 30.2, 30000, "буча")], "id string, name string, lat double, lon double, population long, key string")
    posts = spark.createDataFrame([("a", "3х БпЛА на Сумщині курсом на Суми"), ("b", "2х реактивних повз Бучу"), ("c", "збито/подавлено 40. противник атакував 50 ударними БпЛА. влучання зафіксовано на 7 локаціях. Сумщина"), ("d", "Балістика!"), ("e", "Доброго ранку"),
         ("f", "Збито/подавлено 12. Влучання уточнюють. Влучання 3 ракет на 5 локаціях, падіння збитих (уламки) на 9 локаціях"), ("g", "БпЛА курсом на Роменського, вектор на на Бучу")], "id string, text string")
    r = {x["id"]: x for x in reports.parse(posts, places).collect()}
    assert (r["a"]["weapon"], r["a"]["count"], r["a"]["region"], r["a"]["to_place"]) == ("uav", 3, "UA-59", "Sumy")
    assert (r["b"]["weapon"], r["b"]["at_place"]) == ("jet_uav", "Bucha")
    assert (r["c"]["downed"], r["c"]["attacked"], r["c"]["hit_locations"], r["c"]["region"]) == (40, 50, 7, None) and r["c"]["summary"].startswith("overnight attack: 50")
    assert (r["f"]["downed"], r["f"]["hit_locations"], r["f"]["debris_locations"]) == (12, 5, 9) and r["g"]["to_place"] == "Bucha"
    assert r["d"]["weapon"] == "ballistic" and r["e"]["weapon"] is None and r["e"]["summary"] == "report"


def test_names_in_reports(spark):
    """Prefixes, bare names, headers, small places, names set apart, and launch areas of a tally."""
    rows = [("1", "Sumy", 250000, "суми"), ("2", "Bucha", 30000, "буча"), ("3", "Kursk", 400000, "курськ"), ("4", "Hvardiiske", 12000, "гвардійське"), ("5", "Mala", 50, "мала"), ("6", "Kharkiv", 1400000, "харків"), ("7", "Kyiv", 2900000, "київ"), ("8", "Post", 700, "постове"), ("9", "Bila Hora", 5000, "біла гора")]
    places = spark.createDataFrame([(i, n, 50.0, 30.0, p, k) for i, n, p, k in rows], "id string, name string, lat double, lon double, population long, key string")
    posts = [
        ("bare", "1х реактив Буча"), ("plain", "2x Буча"), ("prefix", "БпЛА курсом на н.п. Буча"), ("town", "шахед повз м. Суми"), ("small", "курс на Мала, курс на Бучу"), ("never", "БпЛА на Київ, далі на Суми"),
        ("header", "Харків: 3х шахеди"), ("capital", "Київ: увага"), ("two", "вектор на Біла Гора"), ("late", "На Постове курс"), ("none", None), ("empty", ""),
        ("night", "У ніч противник атакував 135 ударними БпЛА із напрямків: Курськ, ТОТ АР Крим – Гвардійське та «Постове»; Ніде і Суми – рф. збито/подавлено 125"),
        ("launch", "із напрямку: Курськ"),
    ]
    r = {x["id"]: x for x in reports.parse(spark.createDataFrame(posts, "id string, text string"), places).collect()}
    assert [(k, r[k]["at_place"]) for k in ("bare", "plain", "town", "header")] == [("bare", "Bucha"), ("plain", "Bucha"), ("town", "Sumy"), ("header", "Kharkiv")]
    assert [(k, r[k]["to_place"]) for k in ("prefix", "small", "never", "two", "late")] == [("prefix", "Bucha"), ("small", "Bucha"), ("never", "Sumy"), ("two", "Bila Hora"), ("late", "Post")]
    assert (r["capital"]["region"], r["capital"]["at_place"]) == ("UA-30", None) and r["none"]["summary"] == r["empty"]["summary"] == "report"
    assert (r["night"]["attacked"], r["night"]["downed"], r["night"]["launch_areas"]) == (135, 125, ["Kursk", "Hvardiiske"]) and r["launch"]["launch_areas"] == []


def test_threat_axes(spark):
    base = dict(kind="aircraft", state_code="ru", role="strike", uav=False, military=True, dist_km=120.0, front_km=40.0, occupied=False, off_deg=10.0, spd=400.0, squawk="7700", callsign="X", nac_p=10, ground=False, gnss_level="high", net_mission=None, on_station=None, rerouted=True)
    schema = "kind string, state_code string, role string, uav boolean, military boolean, dist_km double, front_km double, occupied boolean, off_deg double, spd double, squawk string, callsign string, nac_p int, ground boolean, gnss_level string, net_mission string, on_station boolean, rerouted boolean"
    rows = [Row(**base), Row(**base | {"state_code": "us"}), Row(**base | {"state_code": None, "role": None, "squawk": None})]
    a, b, c = threat.score(spark.createDataFrame(rows, schema)).collect()
    assert (a["threat"], a["intel"], a["priority"]) == (40 + 15 + 12 + 12 + 10, 25 + 6 + 6, 100)
    assert b["threat"] == 0 and b["intel"] == 37 and b["priority"] == round(37 / 2) and b["reasons"][-1]["points"] == 0
    assert c["threat"] == 34 and c["reasons"][-1]["reason"] == "state not attributed"
    assert threat.board(threat.score(spark.createDataFrame(rows, schema))).first()["top"][0] == "operated by RU"
