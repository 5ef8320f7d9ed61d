"""The track store: thinning, flights, retention, recordings, and the stream against the table."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import tracks
from lodestar.streaming.tracks import Rule

SCHEMA = "id string, ts long, lon double, lat double, alt double, spd double, hdg double, ground boolean"
MINUTE = 60_000


def walk(r, n, name):
    out, t, alt, hdg, ground = [], 1_700_000_000_000, 0.0, 0.0, True
    for _ in range(n):
        t += r.choice([0, 500, 1000, 4000, 5000, 9000, 60_000, 25 * MINUTE]) if r.random() < 0.9 else 3600_000
        alt, hdg = alt + r.choice([0, 10, 160, -50]), (hdg + r.choice([0, 0.5, 3, 200])) % 360
        ground = r.random() < 0.2
        out.append((name, t, 30 + r.random(), 45.0, r.choice([alt, alt, None]), None, r.choice([hdg, hdg, None]), ground))
    return out


def plain(rows, rule=tracks.RULE):
    kept, last = [], {}
    for p in sorted(rows, key=lambda p: tuple((v is not None, v) for v in p)):
        k, q = p[0], last.get(p[0])
        if q is not None:
            q, flight = q
            if p[1] <= q[1]:
                continue
            d = None if p[6] is None or q[6] is None else abs(p[6] - q[6]) % 360
            turned = d is not None and min(d, 360 - d) >= rule.turn
            climbed = p[4] is not None and q[4] is not None and abs(p[4] - q[4]) >= rule.climb_m
            if not (p[1] - q[1] >= rule.step_s * 1000 or turned or climbed or p[7] != q[7]):
                continue
            flight = p[1] if p[1] - q[1] > rule.gap_s * 1000 or q[7] and not p[7] else flight
        else:
            flight = p[1]
        last[k] = p, flight
        kept.append((*p, flight))
    return sorted(kept, key=str)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    return [p for name in ("aircraft:a", "aircraft:b", "vessel:c") for p in walk(r, 250, name)]


def test_thinning_of_shuffled_rows(spark, rows):
    mixed = [*rows, *rows[:20], ("aircraft:a", None, 1.0, 1.0, None, None, None, None), (None, 5, 1.0, 1.0, None, None, None, None), ("x", 5, None, 1.0, None, None, None, None)]
    random.Random(1).shuffle(mixed)
    got = tracks.thin(spark.createDataFrame(mixed, SCHEMA)).collect()
    assert sorted((tuple(x) for x in got), key=str) == plain(rows) and len(got) < len(rows)
    assert tracks.thin(spark.createDataFrame([], SCHEMA)).count() == 0


def test_flights_within_hours_and_landings(spark):
    p = lambda m, alt, ground=False: ("a", m * MINUTE, 30.0, 45.0, alt, None, None, ground)
    rows = [p(0, 0.0, True), p(1, 100.0), p(5, 3000.0), p(9, 10.0, True), p(12, 500.0), p(20, 5000.0), p(45, 800.0), p(50, 700.0)]
    kept = tracks.thin(spark.createDataFrame(rows, SCHEMA))
    got = [(x["start"] // MINUTE, x["end"] // MINUTE, x["points"], x["landed"]) for x in tracks.flights(kept, F.lit(120 * MINUTE)).orderBy("start").collect()]
    assert got == [(0, 0, 1, True), (1, 9, 3, True), (12, 20, 2, False), (45, 50, 2, True)]
    later = tracks.flights(kept, F.lit(55 * MINUTE), hours=50 / 60).orderBy("start").collect()
    assert [(x["start"] // MINUTE, x["landed"]) for x in later] == [(5, True), (12, False), (45, False)]
    held = tracks.retained(kept, F.lit(55 * MINUTE), Rule(hours=0.5)).orderBy("ts").collect()
    assert [(x["ts"] // MINUTE, x["active"]) for x in held] == [(45, True), (50, True)]


def test_recordings_are_searched_before_they_are_read(spark, tmp_path):
    def line(i, kind="aircraft", military=True, t="upsert", **more):
        e = {"id": f"{kind}:{i}", "kind": kind, "ts": 1000 * i, "lon": 30.0, "lat": 45.0, "props": {"military": military, "on_ground": i == 3}} | more
        return json.dumps({"t": t, "e": e}, separators=(",", ":"))

    lines = [line(1), line(2, orig_ts=7), line(3, kind="vessel"), line(4, military=False), line(5, kind="news"), line(6, t="remove"), line(7, lon=None), '{"military":true,"kind":"aircraft" broken']
    (tmp_path / "20240102.jsonl").write_text("\n".join(lines))
    got = tracks.rebuild(spark, str(tmp_path), ["20240101", "20240102"]).orderBy("ts").collect()
    assert [(x["id"], x["ts"], x["ground"], x["alt"]) for x in got] == [("aircraft:2", 7, False, 0.0), ("aircraft:1", 1000, False, 0.0), ("vessel:3", 3000, True, 0.0)]
    assert tracks.rebuild(spark, str(tmp_path), ["20230101"]).count() == 0


def test_stream_of_shuffled_and_restarted_input_equals_the_table(spark, tmp_path, rows):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rule, r = Rule(hours=3), random.Random(8)
    end = max(p[1] for p in rows)
    ordered = sorted(rows, key=lambda p: p[1])
    size = len(ordered) // 4
    try:
        for k in range(4):  # each part is shuffled in itself, and a query of its own, resumed from the checkpoint
            part = ordered[k * size : (k + 1) * size if k < 3 else None]
            r.shuffle(part)
            part += [("flush", end + 10**9, 1.0, 1.0, None, None, None, False)] if k == 3 else []
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            q = tracks.stream(source, rule, "1 minute").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
            q.awaitTermination(180)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).select(*tracks.COLUMNS, "flight").where("id <> 'flush'").collect()), key=str)
    assert got == plain(rows, rule)


def test_turn_just_short_of_the_rule(spark):
    """60 degrees less a rounding's worth is no turn of 60; adding 180 first would round it up."""
    a, b = 15.0, 74.99999999999999
    assert b - a < 60 and abs((b - a + 180) % 360 - 180) == 60
    rule = Rule(step_s=1000, turn=60.0)
    rows = [("x", 0, 1.0, 1.0, 0.0, None, a, False), ("x", 1000, 1.0, 1.0, 0.0, None, b, False), ("x", 2000, 1.0, 1.0, 0.0, None, 75.0, False), ("x", 3000, 1.0, 1.0, 0.0, None, 15.0 + 360, False)]
    assert sorted(r["ts"] for r in tracks.thin(spark.createDataFrame(rows, SCHEMA), rule).collect()) == [0, 2000, 3000]
