"""Track and landing queries: users as entities whose events are positions, lines of orders as flights from supplier to nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import timeops
from lodestar.operators import danger, landings
from lodestar.registry import query
from lodestar.streaming import tracks

RULE = tracks.Rule(step_s=43_200, turn=60.0, climb_m=120.0, gap_s=172_800, hours=480, low_m=250.0)
_TRACK = """WITH RECURSIVE p AS (SELECT user_id AS id, epoch_us(ts) // 1000 AS ts, value AS alt, (value * 7) % 360 AS hdg, event_type = 'signup' AS ground, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts, event_id) AS i FROM p),
w AS (SELECT id, i, TRUE AS kept, ts, alt, hdg, ground, ts AS flight FROM o WHERE i = 1
 UNION ALL SELECT o.id, o.i, k, CASE WHEN k THEN o.ts ELSE w.ts END, CASE WHEN k THEN o.alt ELSE w.alt END, CASE WHEN k THEN o.hdg ELSE w.hdg END, CASE WHEN k THEN o.ground ELSE w.ground END,
  CASE WHEN k AND (o.ts - w.ts > 172800000 OR (w.ground AND NOT o.ground)) THEN o.ts ELSE w.flight END
 FROM w JOIN o ON o.id = w.id AND o.i = w.i + 1, LATERAL (SELECT o.ts > w.ts AND (o.ts - w.ts >= 43200000 OR least(abs(o.hdg - w.hdg), 360 - abs(o.hdg - w.hdg)) >= 60 OR abs(o.alt - w.alt) >= 120 OR o.ground <> w.ground) AS k)),
k AS (SELECT * FROM w WHERE kept), n AS (SELECT max(epoch_us(ts) // 1000) AS now FROM events)"""


def positions(t):
    x = t.events.select(F.col("user_id").alias("id"), F.floor(timeops.micros(F.col("ts")) / 1000).alias("ts"), F.col("event_id").cast("double").alias("lon"), F.lit(0.0).alias("lat"), F.col("value").alias("alt"), F.lit(None).cast("double").alias("spd"), (F.col("value") * 7 % 360).alias("hdg"), (F.col("event_type") == "signup").alias("ground"))
    return tracks.thin(x, RULE)


def newest(t):
    """The latest event's time, as a column of one value."""
    return F.lit(t.events.agg(F.floor(F.max(timeops.micros(F.col("ts"))) / 1000)).first()[0])


@query("x07_thinned_tracks", _TRACK + " SELECT id, count(*) AS points, count(DISTINCT flight) AS flights, min(ts)::BIGINT AS first_seen, max(ts)::BIGINT AS last_seen FROM k GROUP BY id")
def thinned_tracks(t):
    return positions(t).groupBy("id").agg(F.count("*").alias("points"), F.countDistinct("flight").alias("flights"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query("x07_flights", _TRACK + """ SELECT id, min(ts)::BIGINT AS start, max(ts)::BIGINT AS "end", count(*) AS points, arg_max(ground, ts) OR (arg_max(alt, ts) <= 250 AND any_value(now) - max(ts) > 172800000) AS landed
FROM k, n WHERE ts >= now - 1728000000 GROUP BY id, flight""")
def flights(t):
    """Flights within the hours retained before the newest event."""
    return tracks.flights(positions(t), newest(t), RULE).select("id", "start", "end", "points", "landed")


_FLIGHTS = """WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey AS hex, p_type AS type, l_returnflag AS family, c_nationkey AS field, epoch(o_orderdate::TIMESTAMP) AS start, epoch(l_shipdate::TIMESTAMP) AS "end"
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
e AS (SELECT hex, "end", min({'type': type, 'family': family, 'field': field}) AS x FROM f GROUP BY 1, 2), g AS (SELECT hex, "end", x.type AS type, x.family AS family, x.field AS field FROM e)"""


def _flights(t):
    placed = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    x = t.lineitem.join(placed, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    return x.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("hex"), F.col("p_type").alias("type"), F.col("l_returnflag").alias("family"), F.col("c_nationkey").alias("field"), seconds("o_orderdate").alias("start"), seconds("l_shipdate").alias("end"))


def _asof(level: str, here: bool, out: str) -> str:
    keys = f"{level}, field" if here else level
    same = f"a.{level} = f.{level}" + (" AND a.field = f.field" if here else "")
    return f""" ASOF LEFT JOIN (SELECT {keys}, "end", sum(count(*)) OVER (PARTITION BY {keys} ORDER BY "end") AS {out} FROM g GROUP BY {keys}, "end") AS {out}_ ON {same.replace('a.', out + '_.')} AND {out}_."end" < f.start"""


_COUNTS = [(f"{n}_{level}", level, n == "at") for level in landings.LEVELS for n in ("n", "at")]


@query("v24_learned_landings", _FLIGHTS + " SELECT f.l_orderkey, f.l_linenumber, " + ", ".join(f"coalesce({out}_.{out}, 0)::BIGINT AS {out}" for out, _, _ in _COUNTS) + " FROM f" + "".join(_asof(level, here, out) for out, level, here in _COUNTS))
def learned_landings(t):
    """Every line as a flight from its supplier to the customer's nation, with what the landings before it had shown."""
    return landings.judged(_flights(t), span=30 * 86_400.0).select("l_orderkey", "l_linenumber", *(out for out, _, _ in _COUNTS))


@query("v11_flight_candidates", _FLIGHTS + """, c AS (SELECT DISTINCT hex, field AS candidate FROM g), s AS (SELECT hex, field, "end", sum(count(*)) OVER (PARTITION BY hex, field ORDER BY "end") AS n FROM g GROUP BY hex, field, "end")
SELECT x.candidate, x.y, count(*) AS rows, sum(x.n)::BIGINT AS n FROM (SELECT c.candidate, (c.candidate = f.field)::INTEGER AS y, coalesce(s.n, 0) AS n FROM f JOIN c ON c.hex = f.hex ASOF LEFT JOIN s ON s.hex = f.hex AND s.field = c.candidate AND s."end" < f.start) x
WHERE x.n > 0 OR x.y = 1 GROUP BY ALL""")
def flight_candidates(t):
    """Rows of a ranker's training frame, summed up by candidate."""
    rows = landings.candidates(_flights(t), span=30 * 86_400.0, keep=["field"])
    return rows.groupBy("candidate", "y").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))


_DANGER = """WITH o AS (SELECT 1704067200::BIGINT AS origin), al AS (SELECT user_id % 25 AS region, epoch_us(ts) // 1000000 - origin AS a, epoch_us(ts) // 1000000 + floor(value * 120)::BIGINT - origin AS b FROM events, o WHERE event_type IN ('view', 'click')),
cl AS (SELECT region, greatest(a, 0) AS a, b, greatest(a, 0) // 21600 AS f, least(b, 120 * 21600 - 1) // 21600 AS l FROM al WHERE b > 0 AND greatest(a, 0) // 21600 < 120),
bl AS (SELECT region, block, sum((least(b, (block + 1) * 21600) - greatest(a, block * 21600)) / 60.0::DOUBLE) AS minutes, count(*) FILTER (block = f) AS starts, max((b >= (block + 1) * 21600)::INTEGER) AS running, max(CASE WHEN block = l THEN b / 3600.0::DOUBLE END) AS ended
 FROM (SELECT *, unnest(range(f, l + 1)) AS block FROM cl) GROUP BY ALL),
g AS (SELECT region, block, coalesce(minutes, 0) AS minutes, coalesce(starts, 0) AS starts, coalesce(running, 0) AS running, ended FROM (SELECT DISTINCT user_id % 25 AS region FROM events) CROSS JOIN (SELECT unnest(range(120)) AS block) LEFT JOIN bl USING (region, block)),
w AS (SELECT region, block, minutes AS m_1, sum(minutes) OVER (v ROWS 3 PRECEDING) AS m_4, sum(minutes) OVER (v ROWS 27 PRECEDING) AS m_28, sum(minutes) OVER (v ROWS 119 PRECEDING) AS m_120, sum(starts) OVER (v ROWS 3 PRECEDING) AS starts_4, running AS active_at_issue,
 CASE WHEN running = 1 THEN 0 ELSE coalesce(greatest(0, least((block + 1) * 6 - last_value(ended IGNORE NULLS) OVER (v ROWS UNBOUNDED PRECEDING), 720)), 720) END AS since_last_h, (lead(minutes) OVER v > 0)::INTEGER AS y_active, (lead(starts) OVER v > 0)::INTEGER AS y_new FROM g WINDOW v AS (PARTITION BY region ORDER BY block)),
nb AS (SELECT x.region, w.block, avg(w.m_1) AS nb_m_1, avg(w.m_4) AS nb_m_4 FROM (SELECT DISTINCT region FROM w) x JOIN w ON w.region <> x.region AND (w.region - x.region) % 25 IN (1, -1, 24, -24) GROUP BY ALL),
na AS (SELECT block, sum(m_1) AS nat_m_1, count(*) FILTER (m_1 > 0) AS nat_regions_1 FROM w GROUP BY block), n4 AS (SELECT *, sum(nat_m_1) OVER (ORDER BY block ROWS 3 PRECEDING) AS nat_m_4, sum(nat_regions_1) OVER (ORDER BY block ROWS 3 PRECEDING) AS nat_regions_4 FROM na),
at_ AS (SELECT user_id % 25 AS region, ts::DATE AS day FROM events WHERE event_type = 'error'), d AS (SELECT *, make_timestamp((origin + (block + 1) * 21600) * 1000000) AS issue FROM w, o),
we AS (SELECT user_id % 25 AS region, ts::DATE AS day, avg(value) AS cloud, max(value) AS precip, min(value) AS wind FROM events WHERE event_type = 'purchase' GROUP BY ALL),
ar AS (SELECT region, issue, (SELECT count(*) FROM at_ WHERE at_.region = d.region AND at_.day BETWEEN issue::DATE - 11 AND issue::DATE - 5) AS r7, (SELECT count(*) FROM at_ WHERE at_.region = d.region AND at_.day BETWEEN issue::DATE - 32 AND issue::DATE - 5) AS r28, (SELECT count(*) FROM at_ WHERE at_.day BETWEEN issue::DATE - 11 AND issue::DATE - 5) AS n7 FROM (SELECT DISTINCT region, issue FROM d) d)
SELECT d.block::BIGINT AS block, d.region, ((d.block + 1) % 4)::INTEGER AS block_of_day, (isodow(d.issue) - 1)::INTEGER AS dow, round(sin(2 * pi() * extract(month FROM d.issue) / 12), 6) AS month_sin, round(cos(2 * pi() * extract(month FROM d.issue) / 12), 6) AS month_cos,
 round((1 - cos(2 * pi() * (((epoch_us(d.issue) / 1000000.0::DOUBLE + 10800 - 947182440) / 86400) % 29.530588853::DOUBLE) / 29.530588853::DOUBLE)) / 2, 6) AS moon, round(m_1, 6) AS m_1, round(m_4, 6) AS m_4, round(m_28, 6) AS m_28, round(m_120, 6) AS m_120, starts_4::BIGINT AS starts_4, active_at_issue,
 round(since_last_h::DOUBLE, 6) AS since_last_h, round(coalesce(nb_m_1, 0), 6) AS nb_m_1, round(coalesce(nb_m_4, 0), 6) AS nb_m_4, round(nat_m_1, 6) AS nat_m_1, round(nat_m_4, 6) AS nat_m_4, nat_regions_1, nat_regions_4::BIGINT AS nat_regions_4, round(cloud, 6) AS cloud, round(precip, 6) AS precip, round(wind, 6) AS wind,
 r7 AS attacks_region_7d, n7 AS attacks_national_7d, r28 AS attacks_region_28d, y_active, y_new
FROM d LEFT JOIN nb ON nb.region = d.region AND nb.block = d.block JOIN n4 ON n4.block = d.block JOIN ar ON ar.region = d.region AND ar.issue = d.issue LEFT JOIN we ON we.region = d.region AND we.day = d.issue::DATE"""


@query("m07_danger_features", _DANGER)
def danger_features(t):
    """All inputs of the forecast: groups of users as regions on a ring, views and clicks as alerts, errors as attacks, purchases as weather."""
    region, seconds = (F.col("user_id") % 25).alias("region"), F.floor(timeops.micros(F.col("ts")) / 1e6)
    alerts = t.events.where(F.col("event_type").isin("view", "click")).select(region, seconds.alias("start"), (seconds + F.floor(F.col("value") * 120)).alias("end"))
    day = F.to_date("ts").alias("day")
    attacks = t.events.where("event_type = 'error'").select(region, day)
    weather = t.events.where("event_type = 'purchase'").groupBy(region, day).agg(F.avg("value").alias("cloud"), F.max("value").alias("precip"), F.min("value").alias("wind"))
    places = t.events.select(region).distinct()
    ring = places.select(F.col("region").alias("a"), F.explode(F.array((F.col("region") + 1) % 25, (F.col("region") + 24) % 25)).alias("b"))
    x = danger.features(places, alerts, attacks, weather, ring, F.lit(1704067200), 120)
    whole = ("block", "region", "block_of_day", "dow", "starts_4", "active_at_issue", "nat_regions_1", "nat_regions_4", "attacks_region_7d", "attacks_national_7d", "attacks_region_28d", "y_active", "y_new")
    return x.select(*(F.col(c) if c in whole else F.round(c, 6).alias(c) for c in x.columns))
