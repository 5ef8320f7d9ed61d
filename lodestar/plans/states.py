"""Batch twins of the stream operators, over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import timeops
from lodestar.operators import rules
from lodestar.registry import query
from lodestar.streaming import state

RULE = {
    "id": "r1", "name": "costly trouble", "enabled": True,
    "nodes": [
        {"id": "s", "type": "source", "params": {"field": "event_type", "kinds": ["error", "purchase"]}},
        {"id": "f", "type": "filter", "params": {"field": "value", "op": ">", "value": 60.0}},
        {"id": "g", "type": "filter", "params": {"field": "user_id", "op": "<", "value": 20}},
        {"id": "o", "type": "or", "params": {}}, {"id": "a", "type": "alert", "params": {"title": "{label}"}},
    ],
    "edges": [["s", "f"], ["s", "g"], ["f", "o"], ["g", "o"], ["o", "a"]],
}


@query("x01_current_state", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def current_state(t):
    return state.current(t.events.select("user_id", "ts", "event_id", "event_type", "value"), "user_id", "ts", "event_id")


@query("x02_ttl", "SELECT event_id FROM (SELECT *, (SELECT max(ts) FROM events) AS now FROM events) WHERE CASE event_type WHEN 'view' THEN epoch_us(now) - epoch_us(ts) <= 600000000 WHEN 'click' THEN epoch_us(now) - epoch_us(ts) <= 3600000000 WHEN 'error' THEN epoch_us(now) - epoch_us(ts) <= 86400000000 ELSE true END")
def ttl(t):
    now = t.events.agg(F.max("ts").alias("now"))
    return state.alive(t.events.join(F.broadcast(now)), "event_type", "ts", F.col("now"), {"view": 600, "click": 3600, "error": 86400}).select("event_id")  # one row


@query("x04_first_relation", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def first_relation(t):
    return t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))


FOLD = """WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE {where}),
f AS (SELECT user_id, n, event_id, true AS kept, us AS last, value AS held FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, e.event_id, {keep}, CASE WHEN {keep} THEN e.us ELSE f.last END, CASE WHEN {keep} THEN e.value ELSE f.held END FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1)
SELECT user_id, event_id FROM f WHERE kept"""


@query("x05_cooldown", FOLD.format(where="event_type = 'error'", keep="(e.us >= f.last + 172800000000)"))
def cooldown(t):
    return state.cooldown(t.events.where("event_type = 'error'"), ["user_id"], "ts", "event_id", 172800).select("user_id", "event_id")


@query("x06_thinning", FOLD.format(where="true", keep="(e.us > f.last AND (e.us - f.last >= 86400000000 OR abs(e.value - f.held) >= 40))"))
def thinning(t):
    return state.thin(t.events, "user_id", "ts", "event_id", "value", 86400, 40).select("user_id", "event_id")


@query("x08_sessions", """WITH m AS (SELECT *, lag(ts) OVER w AS was, lag(event_type = 'signup') OVER w AS up FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum((was IS NULL OR epoch_us(ts) - epoch_us(was) > 21600000000 OR (event_type = 'signup' AND NOT coalesce(up, false)))::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM m)
SELECT user_id, g::BIGINT AS session, count(*) AS n, min(ts) AS first, max(ts) AS last FROM s GROUP BY ALL""")
def sessions(t):
    """A new session after six hours of silence, or where signing up begins."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("_up", F.col("event_type") == "signup")
    e = e.withColumn("_begin", F.col("_up") & ~F.coalesce(F.lag("_up").over(w), F.lit(False)))
    s = timeops.sessions(e, "user_id", "ts", 6 * 3600, "event_id", F.col("_begin"))
    return s.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("x09_coverage", """WITH m AS (SELECT user_id, epoch_us(ts) / 60000000.0::DOUBLE AS m, lag(epoch_us(ts) / 60000000.0::DOUBLE) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT user_id, round(sum(CASE WHEN m - was <= 630 THEN m - was ELSE 0 END), 4) AS watched, round(sum(CASE WHEN m - was > 630 THEN m - was ELSE 0 END), 4) AS unwatched FROM m WHERE was IS NOT NULL GROUP BY 1""")
def coverage(t):
    """Minutes between polls that count as watched, and those of gaps too long."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    g = t.events.select("user_id", (timeops.seconds_between(F.lag("ts").over(w), F.col("ts")) / 60).alias("g")).where("g IS NOT NULL")
    part = lambda c: F.round(F.sum(F.when(c, F.col("g")).otherwise(0.0)), 4)
    return g.groupBy("user_id").agg(part(F.col("g") <= 630).alias("watched"), part(F.col("g") > 630).alias("unwatched"))


@query("x10_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS start, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY 1")
def tumbling(t):
    return t.events.groupBy(F.window("ts", "6 hours")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "n", "total")


@query("x11_sliding_latest", """WITH h AS (SELECT user_id, event_id, ts, value, unnest(range(epoch_us(ts) // 43200000000, epoch_us(ts) // 43200000000 + 4)) AS w FROM events) SELECT w::BIGINT AS w, count(*) AS users, round(avg((v > 60)::INTEGER), 8) AS share FROM (SELECT w, user_id, arg_max(value, (ts, event_id)) AS v FROM h GROUP BY ALL) GROUP BY 1""")
def sliding_latest(t):
    """Share of users whose latest value in each two-day window, moved by half a day, is high."""
    base = F.floor(timeops.micros(F.col("ts")) / 4.32e10)
    h = t.events.select("user_id", "value", F.struct("ts", "event_id").alias("o"), F.explode(F.sequence(base, base + 3)).alias("w"))
    last = h.groupBy("w", "user_id").agg(F.max_by("value", "o").alias("v"))
    return last.groupBy("w").agg(F.count("*").alias("users"), F.round(F.avg((F.col("v") > 60).cast("int")), 8).alias("share"))


@query("x13_confirm", """WITH l AS (SELECT user_id % 10 AS k, ts::DATE AS day, arg_max(event_type, (value, event_id)) AS leader FROM events GROUP BY ALL), r AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY day) AS run FROM (SELECT *, (lag(leader) OVER (PARTITION BY k ORDER BY day) IS DISTINCT FROM leader)::INTEGER AS new FROM l)),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY day) AS n FROM r) WHERE n = 2), b AS (SELECT k, day, leader, lag(leader) OVER (PARTITION BY k ORDER BY day) AS before FROM c) SELECT * FROM b WHERE before IS DISTINCT FROM leader""")
def confirm(t):
    lead = t.events.groupBy((F.col("user_id") % 10).alias("k"), F.col("ts").cast("date").alias("day")).agg(F.max_by("event_type", F.struct("value", "event_id")).alias("leader"))
    return state.confirm(lead, "k", "day", "leader", 2)


@query("x14_change_log", "WITH l AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, ts FROM events) SELECT user_id, event_id, was, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM l WHERE was IS DISTINCT FROM event_type) WHERE n <= 20")
def change_log(t):
    w = Window.partitionBy("user_id")
    x = t.events.withColumn("was", F.lag("event_type").over(w.orderBy("ts", "event_id"))).where(~F.col("was").eqNullSafe(F.col("event_type")))
    return x.withColumn("n", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id")))).where("n <= 20").select("user_id", "event_id", "was", "event_type")


@query("x15_rules", "SELECT event_id, event_type IN ('error', 'purchase') AS pass_s, event_type IN ('error', 'purchase') AND value > 60 AS pass_f, event_type IN ('error', 'purchase') AND (value > 60 OR user_id < 20) AS pass_a FROM events")
def rule_passes(t):
    return rules.evaluate(t.events, RULE).select("event_id", "pass_s", "pass_f", "pass_a")


@query("x15_rule_counters", "SELECT count(*) AS s, count(*) FILTER (value > 60) AS f, count(*) FILTER (user_id < 20) AS g, count(*) FILTER (value > 60 OR user_id < 20) AS o, count(*) FILTER (value > 60 OR user_id < 20) AS a FROM events WHERE event_type IN ('error', 'purchase')")
def rule_counters(t):
    return rules.counters(t.events, RULE)


@query("a27_entity_hits", "SELECT user_id, count(*) FILTER (s) AS s, count(*) FILTER (s AND value > 60) AS f, count(*) FILTER (s AND user_id < 20) AS g, count(*) FILTER (s AND (value > 60 OR user_id < 20)) AS o, count(*) FILTER (s AND (value > 60 OR user_id < 20)) AS a FROM (SELECT *, event_type IN ('error', 'purchase') AS s FROM events) GROUP BY user_id")
def entity_hits(t):
    return rules.counters(t.events, RULE, ("user_id",))


@query("x18_alert_rules", "SELECT event_id, CASE WHEN value > 95 THEN 'extreme' WHEN event_type = 'error' AND value > 80 THEN 'fault' ELSE 'new' END AS rule FROM events WHERE value > 95 OR (event_type = 'error' AND value > 80) OR event_type = 'signup'")
def alert_rules(t):
    rule = F.when(F.col("value") > 95, "extreme").when((F.col("event_type") == "error") & (F.col("value") > 80), "fault").when(F.col("event_type") == "signup", "new")
    return t.events.select("event_id", rule.alias("rule")).where("rule IS NOT NULL")


@query("x20_growing_priors", "SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM events")
def growing_priors(t):
    w = Window.partitionBy("user_id", "event_type").orderBy(timeops.micros(F.col("ts"))).rangeBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.count("*").over(w).alias("prior"))


@query("v04_snapshot_replace", "WITH a AS (SELECT DISTINCT user_id FROM events WHERE ts::DATE = DATE '2024-01-10'), b AS (SELECT DISTINCT user_id FROM events WHERE ts::DATE = DATE '2024-01-11') SELECT user_id, 'upsert' AS op FROM b UNION ALL SELECT user_id, 'remove' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def snapshot_replace(t):
    day = lambda d: t.events.where(F.col("ts").cast("date") == F.lit(d).cast("date")).select("user_id").distinct()
    old, new = day("2024-01-10"), day("2024-01-11")
    return new.withColumn("op", F.lit("upsert")).unionByName(old.join(new, "user_id", "left_anti").withColumn("op", F.lit("remove")))
