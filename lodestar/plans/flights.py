"""Flight states, interference cells and fields around a point, over events as positions of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import geo, timeops
from lodestar.operators import kinematics
from lodestar.plans.joins import C, customers, hav
from lodestar.plans.projections import lat, lat_sql, lon, lon_sql
from lodestar.registry import query
from lodestar.sources import feeds

#: Windows of days, as users move more seldom than aircraft.
CLIMB, TURN, DERIVE = 86_400, 604_800, 21_600


def sql_bearing(a: str, b: str, c: str, d: str) -> str:
    east = f"radians({c} - {a})"
    return f"((degrees(atan2(sin({east}) * cos(radians({d})), cos(radians({b})) * sin(radians({d})) - sin(radians({b})) * cos(radians({d})) * cos({east}))) + 360) % 360)"


@query("g19_flight_state", f"""WITH p AS (SELECT user_id, event_id, epoch_us(ts) AS us, {lon_sql('event_id')} / 100 AS x, {lat_sql('event_id')} / 100 AS y, (event_id % 12000)::DOUBLE AS alt,
  CASE WHEN event_type <> 'view' THEN value END AS gs, CASE WHEN event_type <> 'error' THEN (event_id * 37 % 360)::DOUBLE END AS trk FROM events),
o AS (SELECT *, row_number() OVER w AS n, coalesce({hav('lag(x) OVER w', 'lag(y) OVER w', 'x', 'y', '6371.0')}, 0) AS leg, {sql_bearing('lag(x) OVER w', 'lag(y) OVER w', 'x', 'y')} AS came,
  trk - last_value(trk IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS d FROM p WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
l AS (SELECT *, coalesce(abs(((d + 180) % 360 + 360) % 360 - 180), 0) AS turn FROM o),
k AS (SELECT a.user_id, a.n, arg_min(b.x, b.n) AS x, arg_min(b.y, b.n) AS y, min(b.n) AS first, min(b.us) AS us, sum(b.leg) - arg_min(b.leg, b.n) AS path, coalesce(sum(b.turn) FILTER (b.trk IS NOT NULL) - arg_min(b.turn, b.n) FILTER (b.trk IS NOT NULL), 0) AS turned
  FROM l a JOIN l b ON a.user_id = b.user_id AND b.n <= a.n AND b.us >= a.us - {TURN}000000 GROUP BY ALL),
j AS (SELECT a.user_id, a.n, arg_min(b.x, b.n) AS x, arg_min(b.y, b.n) AS y, arg_min(b.alt, b.n) AS alt, min(b.n) AS first, min(b.us) AS us, coalesce(sum(b.turn) FILTER (b.trk IS NOT NULL) - arg_min(b.turn, b.n) FILTER (b.trk IS NOT NULL), 0) AS turned
  FROM l a JOIN l b ON a.user_id = b.user_id AND b.n <= a.n AND b.us >= a.us - {CLIMB}000000 GROUP BY ALL),
s AS (SELECT l.*, k.path, k.turned AS turned_k, k.first AS first_k, (l.us - k.us) / 1e6::DOUBLE AS span_k, {hav('k.x', 'k.y', 'l.x', 'l.y', '6371.0')} AS away_k, j.turned AS turned_j, j.first AS first_j, j.alt AS alt_j, greatest((l.us - j.us) / 1e6::DOUBLE, 1) AS dt,
  CASE WHEN l.us - j.us >= {DERIVE}000000 THEN {hav('j.x', 'j.y', 'l.x', 'l.y', '6371.0')} / (greatest((l.us - j.us) / 1e6::DOUBLE, 1) / 3600) / 1.852 END AS derived FROM l JOIN k USING (user_id, n) JOIN j USING (user_id, n))
SELECT event_id, round(CASE WHEN n > first_j THEN greatest(-8000, least(8000, (alt - alt_j) / 0.3048 / (dt / 60))) ELSE 0 END, 4) + 0 AS vrate_fpm, round(least(turned_k, 2000), 4) AS turned, round(CASE WHEN path > 1 THEN away_k / path ELSE 1 END, 4) AS straightness,
  round(CASE WHEN gs IS NULL THEN coalesce(derived, CASE WHEN n > first_k THEN path / greatest(span_k / 3600, 1e-6) / 1.852 ELSE 0 END) WHEN turned_j < 45 AND derived > 50 AND abs(gs - derived) > 0.35 * derived THEN derived ELSE gs END, 4) AS gs_kn, round(coalesce(trk, came, 0), 4) AS heading FROM s""")
def flight_state(t):
    p = t.events.select(
        "user_id", "event_id", "ts", (lon("event_id") / 100).alias("lon"), (lat("event_id") / 100).alias("lat"), (F.col("event_id") % 12000).cast("double").alias("alt"),
        F.when(F.col("event_type") != "view", F.col("value")).alias("gs"), F.when(F.col("event_type") != "error", (F.col("event_id") * 37 % 360).cast("double")).alias("trk"))
    s = kinematics.states(p, "user_id", "event_id", CLIMB, TURN, DERIVE)
    return s.select("event_id", *((F.round(c, 4) + 0).alias(c) for c in ("vrate_fpm", "turned", "straightness", "gs_kn", "heading")))


def polls(t):
    """A poll for each event, the aircraft listed under either of the two names."""
    cell = (F.col("user_id") % 20 * 0.5).cast("double")
    one = F.array(F.struct(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("hex"), F.concat(F.col("event_type"), F.lit("  ")).alias("flight"), (cell + 20.1).alias("lon"), (cell + 40.1).alias("lat"), F.when(F.col("event_type") == "signup", "ground").otherwise((F.col("event_id") % 40000).cast("string")).alias("alt_baro"),
        F.col("value").alias("seen_pos"), (F.col("event_id") % 12).alias("nac_p"), (F.col("event_id") % 3).alias("version"), (F.col("user_id") % 2).alias("dbFlags")))
    made = F.when(F.col("event_id") % 3 == 0, F.to_json(F.struct(one.alias("aircraft")))).otherwise(F.to_json(F.struct(one.alias("ac"))))
    return t.events.select(made.alias("value"), F.floor(timeops.micros(F.col("ts")) / 1000).alias("received_ms"))


AIRCRAFT = """(SELECT event_id, 'u' || user_id AS id, CASE event_type WHEN 'signup' THEN 0.0 ELSE (event_id % 40000)::DOUBLE END * 0.3048::DOUBLE AS alt, event_type = 'signup' AS ground, user_id % 2 = 1 AS military, event_type AS label,
  (user_id % 20)::DOUBLE * 0.5 + 20.1 AS lon, (user_id % 20)::DOUBLE * 0.5 + 40.1 AS lat, trunc(epoch_us(ts) // 1000 - value * 1000)::BIGINT AS ts, event_id % 12 AS nac_p, event_id % 3 AS version FROM events WHERE value <= 60)"""


@query("s18_aircraft_polls", f"SELECT id, label, round(lon, 6) AS lon, round(lat, 6) AS lat, round(alt, 4) AS alt, ground, military, ts FROM {AIRCRAFT}")
def aircraft_polls(t):
    return feeds.aircraft(polls(t)).select("id", "label", *(F.round(c, r).alias(c) for c, r in (("lon", 6), ("lat", 6), ("alt", 4))), "ground", "military", "ts")


@query("v05_gnss_cells", f"""WITH s AS (SELECT floor(lat / 0.5)::BIGINT AS r, floor(lon / 0.5)::BIGINT AS c, id, arg_max(nac_p < 8, ts) AS bad, max(ts) AS ts FROM {AIRCRAFT} WHERE NOT ground AND version >= 1 GROUP BY ALL),
g AS (SELECT r, c, count(*) AS n, count(*) FILTER (bad) AS b, avg(bad::INT) AS share, max(ts) AS ts FROM s GROUP BY ALL HAVING count(*) >= 3), v AS (SELECT *, CASE WHEN share > 0.10 THEN 'high' WHEN share > 0.02 THEN 'medium' ELSE 'low' END AS level FROM g)
SELECT 'gnss:' || c || ':' || r AS id, 'GNSS ' || level || ' (' || b || '/' || n || ' aircraft degraded)' AS label, c * 0.5::DOUBLE + 0.25 AS lon, r * 0.5::DOUBLE + 0.25 AS lat, ts, n AS aircraft, b AS degraded, round(share, 3) AS share, level, c * 0.5::DOUBLE AS west, r * 0.5::DOUBLE AS south, c * 0.5::DOUBLE + 0.5 AS east, r * 0.5::DOUBLE + 0.5 AS north, 5 AS corners FROM v""")
def gnss_cells(t):
    e = feeds.gnss_entities(feeds.gnss_cells(feeds.gnss_samples(feeds.aircraft(polls(t)))))
    at = lambda i, j: F.col("polygon")[i][j]
    return e.select("id", "label", "lon", "lat", "ts", "aircraft", "degraded", "share", "level", at(0, 0).alias("west"), at(0, 1).alias("south"), at(2, 0).alias("east"), at(2, 1).alias("north"), F.size("polygon").alias("corners"))


@query("v09_field_geometry", f"SELECT c_custkey, round({hav('30.5', '50.4', 'c_lon', 'c_lat', '6371.0')}, 4) AS km, round({sql_bearing('30.5', '50.4', 'c_lon', 'c_lat')}, 6) AS degrees FROM {C}")
def field_geometry(t):
    """Distance and bearing from one point to every field."""
    return customers(t).select("c_custkey", F.round(geo.haversine(30.5, 50.4, "c_lon", "c_lat", 6371.0), 4).alias("km"), F.round(geo.bearing(30.5, 50.4, "c_lon", "c_lat"), 6).alias("degrees"))
