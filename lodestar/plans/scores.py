"""Scores, facts, features and endpoint-like queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import timeops
from lodestar.operators import briefs, forecast, scoring
from lodestar.operators.joins import top_n
from lodestar.registry import query

EVIDENCE = """(SELECT o_custkey AS entity, 'late_orders' AS signal, 'order ' || o_orderkey AS reason, 10.0::DOUBLE AS points, o_orderkey::VARCHAR AS evidence_ref FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'O') WHERE n <= 3
UNION ALL SELECT o_custkey, 'large_orders', 'large ' || o_orderkey, 15.0::DOUBLE, o_orderkey::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_totalprice > 300000) WHERE n <= 2
UNION ALL SELECT user_id, 'errors', 'error ' || event_id, 8.0::DOUBLE, event_id::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error') WHERE n <= 4
UNION ALL SELECT c_custkey, 'overdrawn', 'balance below zero', 25.0::DOUBLE, c_custkey::VARCHAR FROM customer WHERE c_acctbal < 0)"""
SCORES = f"""WITH e AS {EVIDENCE}, s AS (SELECT entity, sum(points) AS raw FROM e GROUP BY 1), r AS (SELECT entity, string_agg(reason, '; ' ORDER BY n) AS reasons FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY points DESC, signal, evidence_ref) AS n FROM e) WHERE n <= 3 GROUP BY 1),
v AS (SELECT c_custkey, coalesce(raw, 0.0::DOUBLE) AS raw_points, least(coalesce(raw, 0.0::DOUBLE), 100.0::DOUBLE) AS risk, coalesce(reasons, '') AS reasons FROM customer LEFT JOIN s ON c_custkey = s.entity LEFT JOIN r ON c_custkey = r.entity) SELECT *, row_number() OVER (ORDER BY risk DESC, raw_points DESC, c_custkey) AS rank FROM v"""


def evidence(t):
    o, e = t.orders, t.events
    says = lambda word, c: F.concat(F.lit(word + " "), F.col(c).cast("string"))
    return scoring.breakdown([
        scoring.award(o.where("o_orderstatus = 'O'"), "o_custkey", "late_orders", 10, 30, [F.asc("o_orderdate"), F.asc("o_orderkey")], says("order", "o_orderkey"), F.col("o_orderkey"), source="orders"),
        scoring.award(o.where("o_totalprice > 300000"), "o_custkey", "large_orders", 15, 30, [F.desc("o_totalprice"), F.asc("o_orderkey")], says("large", "o_orderkey"), F.col("o_orderkey"), source="orders"),
        scoring.award(e.where("event_type = 'error'"), "user_id", "errors", 8, 32, [F.asc("ts"), F.asc("event_id")], says("error", "event_id"), F.col("event_id")),
        scoring.award(t.customer.where("c_acctbal < 0"), "c_custkey", "overdrawn", 25, None, [], F.lit("balance below zero"), F.col("c_custkey"), source="customer"),
    ])


@query("m01_capped_score", SCORES)
def capped_score(t):
    return scoring.scores(t.customer.select("c_custkey"), evidence(t), "c_custkey")


@query("m01_breakdown", f"SELECT * FROM {EVIDENCE}")
def breakdown(t):
    return evidence(t).select("entity", "signal", "reason", "points", "evidence_ref")


@query("q04_ranked_filter", SCORES.replace("SELECT *, row_number() OVER (ORDER BY risk", "SELECT c_custkey, risk, reasons, c_custkey IN (SELECT user_id FROM events) AS active FROM (SELECT *, row_number() OVER (ORDER BY risk") + ") WHERE risk >= 50 ORDER BY rank LIMIT 500")
def ranked_filter(t):
    """The ranked list above a least risk, with a membership flag."""
    known = t.events.select(F.col("user_id").alias("c_custkey")).distinct().withColumn("active", F.lit(True))
    s = scoring.scores(t.customer.select("c_custkey"), evidence(t), "c_custkey").where("risk >= 50").orderBy("rank").limit(500)
    return s.join(known, "c_custkey", "left").select("c_custkey", "risk", "reasons", F.coalesce("active", F.lit(False)).alias("active"))


@query("q05_dossier", "SELECT c_custkey, n_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT round(max(o_totalprice), 4) FROM orders WHERE o_custkey = c_custkey) AS top, (SELECT count(*) FROM events WHERE user_id = c_custkey) AS events FROM customer JOIN nation ON c_nationkey = n_nationkey")
def dossier(t):
    o = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("orders"), F.round(F.max("o_totalprice"), 4).alias("top"))
    e = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("events"))
    c = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(o, "c_custkey", "left").join(e, "c_custkey", "left").select("c_custkey", "n_name", F.coalesce("orders", F.lit(0)).alias("orders"), "top", F.coalesce("events", F.lit(0)).alias("events"))


@query("q06_event_features", "SELECT event_id, CASE WHEN event_type = 'view' THEN 'line' ELSE 'point' END AS geometry, event_type FROM events WHERE event_type IN ('view', 'error') AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-08'")
def event_features(t):
    x = t.events.where("event_type IN ('view', 'error') AND ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-07' + INTERVAL 1 DAY")
    return x.select("event_id", F.when(F.col("event_type") == "view", "line").otherwise("point").alias("geometry"), "event_type")


@query("q08_union_roles", "SELECT o_custkey AS id, 'order' AS role, o_totalprice AS v FROM orders WHERE o_custkey = 7 UNION ALL SELECT user_id, 'event', value FROM events WHERE user_id = 7 UNION ALL SELECT c_custkey, 'self', c_acctbal FROM customer WHERE c_custkey = 7")
def union_roles(t):
    a = t.orders.where("o_custkey = 7").select(F.col("o_custkey").alias("id"), F.lit("order").alias("role"), F.col("o_totalprice").alias("v"))
    b = t.events.where("user_id = 7").select(F.col("user_id").alias("id"), F.lit("event").alias("role"), F.col("value").alias("v"))
    return a.unionByName(b).unionByName(t.customer.where("c_custkey = 7").select(F.col("c_custkey").alias("id"), F.lit("self").alias("role"), F.col("c_acctbal").alias("v")))


@query("q22_snapshot_alerts", "SELECT event_id, ts FROM events WHERE value > 90 ORDER BY ts DESC, event_id DESC LIMIT 100")
def snapshot_alerts(t):
    return t.events.where("value > 90").orderBy(F.desc("ts"), F.desc("event_id")).limit(100).select("event_id", "ts")


M02 = "(SELECT event_id, (list_filter([CASE WHEN value > 80 THEN {r: 'near', axis: 'threat', pts: 40} WHEN value > 50 THEN {r: 'mid', axis: 'threat', pts: 20} WHEN value > 20 THEN {r: 'far', axis: 'threat', pts: 5} END, CASE WHEN event_type = 'error' THEN {r: 'armed', axis: 'threat', pts: 30} END, CASE WHEN user_id % 3 = 0 THEN {r: 'tanker', axis: 'intel', pts: 25} END, CASE WHEN user_id % 7 = 0 THEN {r: 'orbit', axis: 'intel', pts: 14} END], lambda x: x IS NOT NULL)) AS rs, user_id % 5 = 0 AS ours FROM events)"


@query("m02_two_axis", f"""SELECT event_id, threat::BIGINT AS threat, intel::BIGINT AS intel, least(100, round_even(threat + 0.5 * intel, 0))::BIGINT AS priority, reasons FROM (SELECT event_id, CASE WHEN ours THEN 0 ELSE coalesce(list_sum(list_transform(list_filter(rs, lambda x: x.axis = 'threat'), lambda x: x.pts)), 0) END AS threat,
coalesce(list_sum(list_transform(list_filter(rs, lambda x: x.axis = 'intel'), lambda x: x.pts)), 0) AS intel, array_to_string(list_concat(list_transform(list_filter(rs, lambda x: NOT ours OR x.axis = 'intel'), lambda x: x.r), CASE WHEN ours THEN ['own side'] ELSE [] END), ',') AS reasons FROM {M02})""")
def two_axis(t):
    """Threat and intelligence points of each event with reasons; the own side has no threat, and one row says so."""
    r = lambda name, axis, pts: F.struct(F.lit(name).alias("r"), F.lit(axis).alias("axis"), F.lit(pts).alias("pts"))
    v, ours = F.col("value"), F.col("user_id") % 5 == 0
    tier = F.when(v > 80, r("near", "threat", 40)).when(v > 50, r("mid", "threat", 20)).when(v > 20, r("far", "threat", 5))
    rs = F.array_compact(F.array(tier, F.when(F.col("event_type") == "error", r("armed", "threat", 30)), F.when(F.col("user_id") % 3 == 0, r("tanker", "intel", 25)), F.when(F.col("user_id") % 7 == 0, r("orbit", "intel", 14))))
    x = t.events.select("event_id", ours.alias("ours"), rs.alias("rs"))
    rs = F.when(F.col("ours"), F.concat(F.filter("rs", lambda y: y["axis"] == "intel"), F.array(r("own side", "threat", 0)))).otherwise(F.col("rs"))
    x = x.select("event_id", rs.alias("rs"))
    total = lambda axis: F.aggregate(F.filter("rs", lambda y: y["axis"] == axis), F.lit(0), lambda a, y: a + y["pts"]).cast("long")
    return x.select("event_id", total("threat").alias("threat"), total("intel").alias("intel"), F.least(F.lit(100), F.bround(total("threat") + 0.5 * total("intel"), 0)).cast("long").alias("priority"), F.array_join(F.transform("rs", lambda y: y["r"]), ",").alias("reasons"))


@query("m03_highlights", "(SELECT 1 AS section, 'orders' AS kind, o_orderkey AS id FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5) UNION ALL (SELECT 2, 'events', event_id FROM events ORDER BY value DESC, event_id LIMIT 5) UNION ALL (SELECT 3, 'parts', p_partkey FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 4)")
def highlights(t):
    one = lambda n, kind, df, c, order: df.orderBy(F.desc(order), c).limit(5 if n < 3 else 4).select(F.lit(n).alias("section"), F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return one(1, "orders", t.orders, "o_orderkey", "o_totalprice").unionByName(one(2, "events", t.events, "event_id", "value")).unionByName(one(3, "parts", t.part, "p_partkey", "p_retailprice"))


@query("m04_weighted_likelihood", "WITH l AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1), c AS (SELECT user_id, k, w / (1 + abs(v - 10 * k)) AS s FROM l, (VALUES (1, 3.0::DOUBLE), (4, 1.0::DOUBLE), (8, 2.0::DOUBLE)) p(k, w)) SELECT user_id, k, round(s / sum(s) OVER (PARTITION BY user_id), 8) AS p FROM c")
def weighted_likelihood(t):
    """Weight of each place over distance, normalised over the places of a row, which stay in the row."""
    last = t.events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))
    opts = F.array(*(F.struct(F.lit(k).alias("k"), (F.lit(w) / (1 + F.abs(F.col("v") - 10 * k))).alias("s")) for k, w in ((1, 3.0), (4, 1.0), (8, 2.0))))
    x = last.withColumn("o", opts).withColumn("z", F.aggregate("o", F.lit(0.0), lambda a, y: a + y["s"]))
    return x.select("user_id", "z", F.explode("o").alias("x")).select("user_id", "x.k", F.round(F.col("x.s") / F.col("z"), 8).alias("p"))


@query("m05_facts", """SELECT row_number() OVER (ORDER BY o)::INTEGER AS n, fact FROM (SELECT 1 AS o, count(*) || ' events' AS fact FROM events UNION ALL SELECT 2, count(DISTINCT user_id) || ' users' FROM events UNION ALL SELECT 3, count(*) FILTER (event_type = 'error') || ' errors' FROM events HAVING count(*) FILTER (event_type = 'error') > 0 UNION ALL SELECT 4, 'most common: ' || (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, min(event_id) LIMIT 1) UNION ALL SELECT 5, count(*) || ' overdrawn' FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0)""")
def facts(t):
    """Numbered facts; a fact whose count is nought is left out."""
    kinds = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    s = t.events.agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.count_if(F.col("event_type") == "error").alias("e"))
    top = kinds.agg(F.min(F.struct((-F.col("n")).alias("n"), "f", "event_type")).alias("x")).select(F.col("x.event_type").alias("k"))
    poor = t.customer.where("c_acctbal < 0").agg(F.count("*").alias("p"))
    say = lambda c, word: F.concat(F.col(c).cast("string"), F.lit(" " + word))
    row = s.crossJoin(top).crossJoin(poor)  # three tables of one row each
    every = F.array_compact(F.array(say("n", "events"), say("u", "users"), F.when(F.col("e") > 0, say("e", "errors")), F.concat(F.lit("most common: "), F.col("k")), F.when(F.col("p") > 0, say("p", "overdrawn"))))
    return row.select(F.posexplode(every).alias("n", "fact")).select((F.col("n") + 1).alias("n"), "fact")


M07 = """WITH c AS (SELECT user_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 21600000000)::BIGINT AS block, count(*) AS n, count(*) FILTER (event_type = 'error') AS active FROM events GROUP BY ALL), g AS (SELECT user_id, block, coalesce(n, 0) AS n, coalesce(active, 0) AS active FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT unnest(range(120)) AS block) b LEFT JOIN c USING (user_id, block))
SELECT user_id, block, n, active, sum(n) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)::BIGINT AS n4, sum(n) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)::BIGINT AS n28, sum(active) OVER (w ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)::BIGINT AS active4, sum(active) OVER (w ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)::BIGINT AS active28,
least(coalesce(block - last_value(CASE WHEN active > 0 THEN block END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 120), 120) AS since, (block % 4)::INTEGER AS block_of_day, ((block // 4) % 7)::INTEGER AS weekday, (lead(active) OVER w > 0)::INTEGER AS y FROM g WINDOW w AS (PARTITION BY user_id ORDER BY block)"""


def features(t):
    return forecast.block_features(t.events, "user_id", "ts", F.col("event_type") == "error", "2024-01-01", 120)


@query("m07_block_features", M07)
def block_features(t):
    return features(t)


FEATURES = ["n", "active", "n4", "n28", "active4", "active28", "since", "block_of_day", "weekday"]


@query("m08_gbt_isotonic")
def gbt_isotonic(t):
    """Calibrated forecasts of the last week, from trees fitted on what came before."""
    x = features(t).where("y IS NOT NULL")
    model = forecast.Danger.fit(x.where("block < 80"), x.where("block >= 80 AND block < 100"), FEATURES, rounds=5, depth=3)
    return model.predict(x.where("block >= 100")).select("user_id", "block", "y", F.round("p", 6).alias("p"))


@query("m09_ablation", "WITH b AS (SELECT event_id, value, user_id % 10 AS u, 1 / (1 + exp(-(0.05::DOUBLE * value - 0.2::DOUBLE * (user_id % 10)))) AS p FROM events WHERE event_type = 'signup'), d AS (SELECT event_id, 'value' AS altered, p - 1 / (1 + exp(-(0.05::DOUBLE * 50 - 0.2::DOUBLE * u))) AS delta FROM b UNION ALL SELECT event_id, 'user', p - 1 / (1 + exp(-(0.05::DOUBLE * value - 0.2::DOUBLE * 5))) FROM b) SELECT event_id, altered, round(delta, 8) AS delta FROM d WHERE abs(delta) >= 0.01")
def ablation(t):
    """What each input adds to a logistic score, against its typical value; all variants in one projection."""
    score = lambda v, u: 1 / (1 + F.exp(-(0.05 * v - 0.2 * u)))
    x = t.events.where("event_type = 'signup'").select("event_id", "value", (F.col("user_id") % 10).alias("u"))
    p = score(F.col("value"), F.col("u"))
    d = F.array(F.struct(F.lit("value").alias("altered"), (p - score(F.lit(50.0), F.col("u"))).alias("delta")), F.struct(F.lit("user").alias("altered"), (p - score(F.col("value"), F.lit(5.0))).alias("delta")))
    return x.select("event_id", F.explode(d).alias("x")).select("event_id", "x.altered", F.round("x.delta", 8).alias("delta")).where("abs(delta) >= 0.01")


@query("m10_segments", """WITH m AS (SELECT *, lag(ts) OVER w AS was, lag(event_type = 'view', 1, true) OVER w AS ground FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum((was IS NULL OR epoch_us(ts) - epoch_us(was) > 72000000000 OR (event_type <> 'view' AND ground))::INTEGER) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM m)
SELECT user_id, g::BIGINT AS session, min(ts) AS start, max(ts) AS "end", count(*) FILTER (event_type <> 'view') AS airborne FROM s GROUP BY user_id, g HAVING count(*) FILTER (event_type <> 'view') >= 3 AND epoch_us(max(ts)) - epoch_us(min(ts)) >= 600000000""")
def segments(t):
    """Flights by gaps and take-offs; short ones and those with few airborne points go."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t.events.withColumn("_g", F.col("event_type") == "view")
    e = e.withColumn("_off", ~F.col("_g") & F.lag("_g", 1, True).over(w))
    s = timeops.sessions(e, "user_id", "ts", 20 * 3600, "event_id", F.col("_off"))
    g = s.groupBy("user_id", "session").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count_if(~F.col("_g")).alias("airborne"))
    return g.where((F.col("airborne") >= 3) & (timeops.seconds_between(F.col("start"), F.col("end")) >= 600))


@query("m13_rank_baselines", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER w, 8) AS by_price, round(1 / (1 + l_quantity) / sum(1 / (1 + l_quantity)) OVER w, 8) AS by_near, round(1.0::DOUBLE / count(*) OVER w, 8) AS uniform FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)")
def rank_baselines(t):
    w = Window.partitionBy("l_orderkey")
    share = lambda c: F.round(c / F.sum(c).over(w), 8)
    return t.lineitem.select("l_orderkey", "l_linenumber", share(F.col("l_extendedprice")).alias("by_price"), share(1 / (1 + F.col("l_quantity"))).alias("by_near"), F.round(F.lit(1.0) / F.count("*").over(w), 8).alias("uniform"))


@query("m15_status", "WITH s AS (SELECT user_id, max(ts) AS seen FROM events WHERE event_type = 'purchase' GROUP BY 1), n AS (SELECT max(ts) AS now FROM events) SELECT c_custkey, CASE WHEN c_custkey % 25 = 0 THEN 'needs key' WHEN seen IS NULL THEN 'missing' WHEN epoch_us(now) - epoch_us(seen) > 172800000000 THEN 'stale' ELSE 'ok' END AS status FROM customer LEFT JOIN s ON c_custkey = user_id CROSS JOIN n")
def status(t):
    seen = t.events.groupBy(F.col("user_id").alias("c_custkey")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("seen"))
    now = t.events.agg(F.max("ts").alias("now"))
    x = t.customer.select("c_custkey").join(seen, "c_custkey", "left").join(F.broadcast(now))  # one row
    late = timeops.seconds_between(F.col("seen"), F.col("now")) > 172800
    return x.select("c_custkey", F.when(F.col("c_custkey") % 25 == 0, "needs key").when(F.col("seen").isNull(), "missing").when(late, "stale").otherwise("ok").alias("status"))


@query("m18_trail", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 40")
def trail(t):
    return top_n(t.events, "user_id", [F.desc("ts"), F.desc("event_id")], 40).select("user_id", "event_id")


@query("v01_position_fallback", "SELECT event_id, CASE WHEN event_type = 'signup' THEN 'centre' WHEN value > 60 THEN 'place' WHEN user_id % 2 = 0 THEN 'region' WHEN value > 10 THEN 'target' END AS placed_by FROM events WHERE event_type = 'signup' OR value > 60 OR user_id % 2 = 0 OR value > 10")
def position_fallback(t):
    by = F.coalesce(F.when(F.col("event_type") == "signup", "centre"), F.when(F.col("value") > 60, "place"), F.when(F.col("user_id") % 2 == 0, "region"), F.when(F.col("value") > 10, "target"))
    return t.events.select("event_id", by.alias("placed_by")).where("placed_by IS NOT NULL")


@query("v10_descriptor_default", "SELECT l_orderkey, l_linenumber, coalesce(d.p, a.p) AS endurance FROM lineitem JOIN part ON l_partkey = p_partkey LEFT JOIN (SELECT p_brand AS b, round(quantile_cont(p_retailprice, 0.95), 4) AS p FROM part GROUP BY 1 HAVING count(*) >= 10) d ON p_brand = b CROSS JOIN (SELECT round(quantile_cont(p_retailprice, 0.95), 4) AS p FROM part) a")
def descriptor_default(t):
    by = t.part.groupBy("p_brand").agg(F.round(F.percentile("p_retailprice", 0.95), 4).alias("d"), F.count("*").alias("n")).where("n >= 10").drop("n")
    everything = t.part.agg(F.round(F.percentile("p_retailprice", 0.95), 4).alias("a"))
    x = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(by, "p_brand", "left").join(F.broadcast(everything))  # one row
    return x.select("l_orderkey", "l_linenumber", F.coalesce("d", "a").alias("endurance"))


_BRIEFS = f"""WITH v AS ({SCORES}), c AS (SELECT c_custkey, risk FROM v WHERE risk >= 40 ORDER BY risk DESC, c_custkey LIMIT 30), b AS {EVIDENCE},
f AS (SELECT c_custkey, 0 AS s, 0.0::DOUBLE AS o, '' AS r, 'Customer ' || c_name || ' of ' || c_mktsegment || '.' AS text FROM customer UNION ALL SELECT c_custkey, 1, 0, '', 'Heuristic risk score ' || risk::BIGINT || ' of 100.' FROM v
UNION ALL SELECT entity, 2, -points, reason, '+' || points::BIGINT || ' points: ' || reason || '.' FROM b UNION ALL SELECT o_custkey, 3, o_orderkey, '', 'Order ' || o_orderkey || ' is open.' FROM orders WHERE o_orderstatus = 'O')
SELECT c_custkey, n, 'F' || n AS fact, text FROM (SELECT c_custkey, (row_number() OVER (PARTITION BY c_custkey ORDER BY s, o, r))::INTEGER AS n, text FROM f SEMI JOIN c USING (c_custkey))"""


@query("m06_brief_facts", _BRIEFS)
def brief_facts(t):
    """Numbered facts of the thirty customers of greatest risk, from forty points on."""
    v = scoring.scores(t.customer.select("c_custkey"), evidence(t), "c_custkey")
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    text = lambda c: F.col(c).cast("string")
    points = F.col("points").cast("long").cast("string")
    return briefs.numbered(briefs.worth(v, key="c_custkey"), [
        briefs.section(t.customer, "c_custkey", [F.lit(0)], said("Customer ", text("c_name"), " of ", text("c_mktsegment"), ".")),
        briefs.section(v, "c_custkey", [F.lit(0)], said("Heuristic risk score ", F.col("risk").cast("long").cast("string"), " of 100.")),
        briefs.section(evidence(t), "entity", [-F.col("points"), F.col("reason")], said("+", points, " points: ", F.col("reason"), ".")),
        briefs.section(t.orders.where("o_orderstatus = 'O'"), "o_custkey", [F.col("o_orderkey")], said("Order ", text("o_orderkey"), " is open.")),
    ], "c_custkey")


@query("u08_danger_points", """WITH e AS (SELECT 'e' || event_id AS id, epoch_us(ts) // 1000 AS ms, * FROM events), n AS (SELECT max(epoch_us(ts) // 1000) - 86400000 * 10 AS now FROM events),
t AS (SELECT * FROM e, n WHERE event_type IN ('error', 'view') AND ms > now - 86400000 AND user_id % 9 <> 0)
SELECT id || ':to' AS id, id AS entity, user_id::DOUBLE AS lon, value AS lat, upper(event_type) || ' heading for town ' || user_id AS title, 'c' || user_id % 3 || ' · reported course' AS sub, ms AS ts, 'heading' AS kind, event_type AS weapon FROM t WHERE value > 50
UNION ALL SELECT id || ':at', id, value, user_id::DOUBLE, upper(event_type) || ' reported near place ' || event_id % 7, 'c' || user_id % 3 || ' · reported position', ms, 'reported', event_type FROM t WHERE value < 70
UNION ALL SELECT id || ':news', id, value, value, 'headline ' || event_id, CASE WHEN user_id % 2 = 0 THEN 'paper' ELSE 'News' END || ' · town ' || user_id, ms, 'news', NULL FROM e, n WHERE event_type = 'purchase' AND value > 20 AND ms > now - 2 * 86400000""")
def danger_points(t):
    """What is reported of the time up to ten days before the newest event and since: errors and views as threats, purchases as headlines."""
    ms = F.floor(timeops.micros(F.col("ts")) / 1000)
    now = F.lit(t.events.agg(F.floor(F.max(timeops.micros(F.col("ts"))) / 1000)).first()[0] - 864_000_000)
    e = t.events.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), ms.alias("ts"), "event_id", "user_id", "event_type", "value")
    user, v = F.col("user_id"), F.col("value")
    place = lambda name, lon, lat: F.struct(name.alias("name"), lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))
    named = lambda word, c: F.concat(F.lit(word), c.cast("string"))
    threats = e.where(F.col("event_type").isin("error", "view")).select(
        "id", "ts", (user % 9 == 0).alias("tally"), F.col("event_type").alias("weapon"), F.upper("event_type").alias("short"), named("c", user % 3).alias("channel"),
        F.when(v > 50, place(named("town ", user), user, v)).alias("to_place"), F.when(v < 70, place(named("place ", F.col("event_id") % 7), v, user)).alias("at_place"))
    news = e.where("event_type = 'purchase'").select("id", "ts", named("headline ", F.col("event_id")).alias("label"), F.when(user % 2 == 0, "paper").alias("outlet"), named("town ", user).alias("place"), v.alias("lon"), v.alias("lat"), (v > 20).alias("strike"))
    return briefs.danger_points(threats, news, now, threat_minutes=1440, news_hours=48)
