"""Parsers on rows written here after the formats they read."""

import datetime as dt
import hashlib
import json

import pytest

from lodestar.sources import feeds, maritime, paged, tables


def lines(spark, *values):
    return spark.createDataFrame([(v if isinstance(v, str) else json.dumps(v),) for v in values], "value string")


def events(spark, *items):
    return spark.read.schema("e " + maritime.EVENT).json(spark.sparkContext.parallelize([json.dumps({"e": i}) for i in items])).select("e.*")


def test_gap_with_numbers_as_text_and_no_end_is_open(spark):
    base = {"id": "g1", "type": "gap", "start": "2024-01-01T00:00:00Z", "end": "", "vessel": {"id": "v1", "name": "N"}, "gap": {"offPosition": {"lat": "45.1", "lon": "36"}, "durationHours": "15.45"}}
    r = maritime.gaps(events(spark, base)).first()
    assert r["open"] and r["end"] is None and r["duration_h"] == 15.45 and r["off_lon"] == 36.0
    with pytest.raises(Exception, match="event without vessel.id"):
        maritime.gaps(events(spark, base | {"vessel": {"name": "x"}})).collect()


def test_first_seen_vessel_and_last_non_null_identity(spark):
    e = events(spark, {"id": "b", "type": "encounter", "vessel": {"id": "v2"}, "encounter": {"vessel": {"id": "v1", "name": "late"}}}, {"id": "a", "type": "gap", "vessel": {"id": "v1", "name": "first", "type": "TANKER"}})
    assert {r["vessel_id"] for r in maritime.vessel_ids(e).collect()} == {"v1", "v2"}
    ids = spark.createDataFrame([("v1", "new", None, "1", None, dt.datetime(2024, 2, 1)), ("v1", None, "RU", None, None, dt.datetime(2024, 3, 1))], "vessel_id string, name string, flag string, mmsi string, imo string, date_to timestamp")
    v = {r["vessel_id"]: r for r in maritime.vessels(e, ids).collect()}
    assert (v["v1"]["name"], v["v1"]["flag"], v["v1"]["mmsi"], v["v1"]["vessel_type"]) == ("new", "RU", "1", "tanker")


def test_sar_rows_of_any_data_set_without_repeats(spark):
    row = {"date": "2024-01-01 05:00", "lat": 45.0, "lon": 36.0, "detections": 2}
    got = maritime.sar(lines(spark, {"entries": [{"set:v1": [row, row]}, {"set:v2": None}]})).collect()
    assert len(got) == 1 and got[0]["detections"] == 2 and len(got[0]["sar_id"]) == 16


def test_sanctions_flags_and_bad_number(spark, tmp_path):
    head = "type,caption,imo,risk,countries,flag,mmsi,id,url,datasets,aliases\n"
    f = tmp_path / "s.csv"
    f.write_text(head + 'VESSEL,"A, B",IMO1234567,mare.shadow;x,ru;cn,ru,273;;274,q1,u,d,\nVESSEL,C,,mare.detained,,,,q2,u,d,\nPERSON,D,bad,,,,,q3,u,d,\n')
    r = {x["os_id"]: x for x in maritime.sanctions(spark, str(f)).collect()}
    assert r["q1"]["imo"] == "1234567" and r["q1"]["mmsis"] == ["273", "274"] and r["q1"]["sanctioned"] and r["q1"]["shadow_fleet"] and not r["q2"]["sanctioned"] and r["q2"]["detained"] and len(r) == 2
    f.write_text(head + "VESSEL,A,IMO12,,,,,q1,u,d,\n")
    with pytest.raises(Exception, match="bad IMO"):
        maritime.sanctions(spark, str(f)).collect()


def test_alert_intervals(spark, tmp_path):
    regions = spark.createDataFrame([("Kyiv", "UA-30")], "region string, iso string")
    f = tmp_path / "a.csv"
    f.write_text("region,started_at,finished_at,naive\nKyiv,2024-01-01 05:00:00+00:00,2024-01-01 07:30:00+00:00,False\nKyiv,2024-01-01 05:00:00+00:00,2024-01-01 05:00:00+00:00,True\n")
    assert [r["minutes"] for r in feeds.alerts_csv(spark, str(f), regions).collect()] == [150.0]
    f.write_text("region,started_at,finished_at,naive\nNowhere,2024-01-01 05:00:00+00:00,2024-01-01 07:30:00+00:00,False\n")
    with pytest.raises(Exception, match="unknown region"):
        feeds.alerts_csv(spark, str(f), regions).collect()
    f.write_text("region,started_at\nKyiv,x\n")
    with pytest.raises(tables.SchemaError):
        feeds.alerts_csv(spark, str(f), regions)


def test_conflict_flags_keep_null(spark, tmp_path):
    regions = spark.createDataFrame([("R", "UA-1")], "region string, iso string")
    f = tmp_path / "v.csv"
    f.write_text("event_id_1pd,date,ADM1_NAME,asciiname,longitude,latitude,GEO_PRECISION,n_reports,t_airstrike_b,t_armor_b\n1,20240105,R,P,30.1,50.2,x,3,1,\n2,20240105,R,P,,50.2,x,3,,0\n")
    a, b = feeds.conflict_csv(spark, str(f), ["t_airstrike_b", "t_armor_b"], regions).orderBy("event_id").collect()
    assert a["air_attack"] and a["t_armor_b"] is None and not b["air_attack"] and b["lon"] is None and a["date"] == dt.date(2024, 1, 5)


def test_weather_arrays_and_count(spark):
    page = [{"latitude": 1.0, "longitude": 2.0, "daily": {"time": ["2024-01-01", "2024-01-02"], "cloud_cover_mean": [1.0, None], "precipitation_sum": [0.0, 2.0], "wind_speed_10m_max": [3.0, 4.0]}}]
    assert [(r["iso"], r["cloud_cover_mean"]) for r in feeds.weather(lines(spark, page), ["X"]).orderBy("date").collect()] == [("X", 1.0), ("X", None)]
    with pytest.raises(Exception, match="locations"):
        feeds.weather(lines(spark, page), ["X", "Y"]).collect()


def test_aircraft_and_interference(spark):
    ac = [{"hex": f"a{i}", "flight": " ", "lat": 45.1, "lon": 36.1, "alt_baro": "ground" if i == 3 else 1000, "seen_pos": 61 if i == 4 else 1, "version": 2, "nac_p": 3 if i == 0 else 10, "dbFlags": i} for i in range(5)]
    air = feeds.aircraft(spark.createDataFrame([(json.dumps({"aircraft": ac}), 1_000_000)], "value string, received_ms long"))
    rows = {r["id"]: r for r in air.collect()}
    assert set(rows) == {"a0", "a1", "a2", "a3"} and rows["a1"]["label"] == "A1" and rows["a1"]["military"] and rows["a3"]["alt"] == 0 and rows["a0"]["alt"] == pytest.approx(304.8) and rows["a0"]["ts"] == 999_000
    cell = feeds.gnss_cells(feeds.gnss_samples(air)).first()
    assert cell["n"] == 3 and cell["share"] == pytest.approx(1 / 3) and cell["level"] == "high"


def test_alert_states_in_local_time(spark):
    regions = spark.createDataFrame([("A", "UA-1")], "region string, iso string")
    r = feeds.alert_states(lines(spark, {"cachedat": "2024-07-01 12:00:00", "states": {"A": {"alertnow": True, "changed": "2024-07-01 11:00:00"}}}), regions).first()
    assert r["active"] and r["changed"] == dt.datetime(2024, 7, 1, 8)


def test_news_rows_group_by_article_and_place(spark, tmp_path):
    def row(i, actor, root="19"):
        v = [""] * 61
        v[0], v[6], v[26], v[28], v[30], v[31], v[34], v[51], v[52], v[56], v[57], v[59], v[60] = str(i), actor, "190", root, "-10", "3", "-1.5", "4", "Place", "45.0001", "36.0001", "20240101120000", "http://u"
        return "\t".join(v)

    (tmp_path / "n.tsv").write_text("\n".join([row(2, "B"), row(1, "A"), row(3, "A"), row(4, "Z", "01")]) + "\n")
    got = feeds.news(spark, str(tmp_path / "n.tsv"), ["19"], (30, 40, 40, 50)).collect()
    assert len(got) == 1 and got[0]["actors"] == ["A", "B"] and got[0]["mentions"] == 3


def test_feed_and_channel(spark):
    xml = "<rss><item><title><![CDATA[A &amp; B]]></title><link>http://l</link><description>d</description><pubDate>Mon, 01 Jan 2024 10:00:00 +0200</pubDate></item></rss>"
    r = feeds.rss(lines(spark, xml), "s").first()
    assert r["title"] == "A & B" and r["ts"] == dt.datetime(2024, 1, 1, 8) and len(r["id"]) == 12
    html = '<div data-post="c/1"><div class="message_text">a<br>b</div><time datetime="2024-01-01T10:00:00+00:00"></time></div><div data-post="c/2"><time datetime="x"></time></div>'
    assert [(p["id"], p["text"]) for p in feeds.channel_posts(lines(spark, html)).collect()] == [("c/1", "a\nb")]


def test_gazetteer_and_inflection(spark, tmp_path):
    def row(i, name, alt, cls, people):
        return "\t".join([str(i), name, name, alt, "50", "30", cls, "PPL", "UA", "", "12", "", "", "", str(people), "", "", "", ""])

    (tmp_path / "g.txt").write_text("\n".join([row(1, "Sumy", "Суми", "P", 250000), row(2, "Small", "Сума", "P", 10), row(3, "River", "Сум", "H", 0)]) + "\n")
    places = feeds.gazetteer(spark, str(tmp_path / "g.txt"), {"UA": 1000})
    q = spark.createDataFrame([("Суми",), ("Київ",)], "query string")
    assert {r["query"]: r["name"] for r in feeds.geocode(q, places).collect()} == {"Суми": "Sumy"}


def test_blocks_digits_orbits_winds(spark):
    b = feeds.address_blocks('{start: 0x43BE00, end: 0x43BEFF, country: "Bermuda", country_code: "bm"}, {start: 0x400000, end: 0x43FFFF, country: "UK", country_code: null}', spark).orderBy("start").collect()
    assert [(r["country"], r["code"]) for r in b] == [("UK", None), ("Bermuda", "bm")] and b[1]["start"] == 0x43BE00
    with pytest.raises(tables.SchemaError):
        feeds.address_blocks("nothing", spark)
    assert feeds.mid_table(lines(spark, {"273": ["RU", "RUS", "x", "Russia"]})).first()["country"] == "Russia"
    assert feeds.orbits(lines(spark, [{"OBJECT_NAME": "SENTINEL-1A", "EPOCH": "2024-01-01T00:00:00", "MEAN_MOTION": 14.5}, {"OBJECT_NAME": "X"}]), "^SENTINEL").count() == 1
    hourly = {"time": ["2024-01-01T00:00"]} | {f"wind_{k}_{p}hPa": [p / 10] for p in feeds.LEVELS for k in ("speed", "direction")}
    units = {f"wind_speed_{p}hPa": "kn" for p in feeds.LEVELS}
    assert feeds.winds(lines(spark, {"hourly": hourly, "hourly_units": units})).count() == 6
    with pytest.raises(Exception, match="knots"):
        feeds.winds(lines(spark, {"hourly": hourly, "hourly_units": units | {"wind_speed_925hPa": "km/h"}})).collect()


def test_ship_messages_merge(spark):
    pos = {"MessageType": "PositionReport", "MetaData": {"MMSI": 5, "ShipName": " A ", "latitude": 1.0, "longitude": 2.0}, "Message": {"PositionReport": {"Sog": 9.0, "Cog": 77.0, "TrueHeading": 511}}}
    static = {"MessageType": "ShipStaticData", "MetaData": {"MMSI": 5, "ShipName": ""}, "Message": {"ShipStaticData": {"ImoNumber": 0, "Type": 70}}}
    alone = {"MessageType": "ShipStaticData", "MetaData": {"MMSI": 6, "ShipName": "B"}, "Message": {"ShipStaticData": {"ImoNumber": 9, "Type": 35}}}
    df = spark.createDataFrame([(json.dumps(x), i) for i, x in enumerate((pos, static, alone))], "value string, received_ms long")
    r = {x["mmsi"]: x for x in feeds.ship_updates(df).collect()}
    assert r[5]["hdg"] == 77.0 and r[5]["type"] == 70 and r[5]["imo"] is None and r[5]["label"] == "A" and not r[6]["positioned"]


def test_tables_pages_and_responses(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), dt.datetime(2024, 1, 1))], "a int, b double, c timestamp")
    assert tables.write_table(df, str(tmp_path / "t")) == 1
    with pytest.raises(tables.EmptyTable):
        tables.write_table(df.limit(0), str(tmp_path / "e"), required=True)
    assert json.loads(tables.responses(df).first()[0]) == {"a": 1, "b": None, "c": "2024-01-01T00:00:00Z"}
    w = tmp_path / "gaps" / "2024-01-01"
    w.mkdir(parents=True)
    (w / "page_0.json").write_text(json.dumps({"entries": [{"id": "1"}, {"id": "2"}]}))
    with pytest.raises(tables.SchemaError):
        tables.read_pages(spark, str(w), "struct<id:string>")
    (w / "_complete.json").write_text("{}")
    assert tables.read_pages(spark, str(w), "struct<id:string>").count() == 2
    spark.dataSource.register(paged.PagedSource)
    got = spark.read.format("lodestar_pages").option("folder", str(tmp_path)).option("windows", "gaps@2024-01-01").load()
    assert got.count() == 2


def test_paging_and_retries():
    got = {0: {"entries": [1, 2], "nextOffset": 2}, 2: {"entries": [3], "nextOffset": 2}}
    assert list(paged.pages(lambda at: got[at])) == [1, 2, 3]
    tries, waits = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise paged.Refused(429, 7.0 if len(tries) == 1 else None)
        return {"ok": True}

    assert paged.with_retries(call, sleep=waits.append) == {"ok": True} and waits == [7.0, 2.0]
    with pytest.raises(paged.Refused):
        paged.with_retries(lambda: (_ for _ in ()).throw(paged.Refused(404)), sleep=waits.append)
    assert [len(b) for b in paged.batches([str(i) for i in range(85)])] == [40, 40, 5]


def test_thermal_anomalies(spark, tmp_path):
    (tmp_path / "a.csv").write_text("latitude,longitude,acq_date,acq_time,frp,confidence,satellite,daynight\n48.5,37.25,2024-01-02,7,1.5,n,N,D\n48.5,37.25,2024-01-02,2359,,h,N,N\n")
    a, b = feeds.thermal(spark, str(tmp_path / "a.csv"), "P").orderBy("ts").collect()
    assert (a["lon"], a["lat"], a["ts"].hour, a["ts"].minute, a["frp_mw"], a["product"]) == (37.25, 48.5, 0, 7, 1.5, "P") and b["frp_mw"] is None and b["ts"].hour == 23
    assert a["id"] == "fire:" + hashlib.sha1(b"P|48.5|37.25|2024-01-02T00:07:00+00:00").hexdigest()[:16] and a["id"] != b["id"]
    (tmp_path / "b.csv").write_text("latitude,longitude\n1,2\n")
    with pytest.raises(Exception, match="acq_date|missing"):
        feeds.thermal(spark, str(tmp_path / "b.csv"), "P")
