"""Window and event-time queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import geo, timeops
from lodestar.operators.joins import top_n
from lodestar.plans.joins import hav
from lodestar.plans.projections import lat, lat_sql, lon, lon_sql
from lodestar.registry import query


def user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


DAYS = "(SELECT u.user_id, d.day, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) c ON c.user_id = u.user_id AND c.day = d.day)"


def daily(t):
    """Events of each user on each day of the month, days without any included."""
    grid = timeops.spine(t.events.select("user_id").distinct(), F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"), F.expr("INTERVAL 1 DAY"), "day")
    n = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return grid.join(n, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


@query("w01_top_n_per_group", "SELECT o_custkey, o_orderkey, n::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def top_n_per_group(t):
    return top_n(t.orders, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "rank")


@query("w02_diff", "SELECT event_id, round(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 8) AS diff FROM events")
def diff(t):
    return t.events.select("event_id", F.round(F.col("value") - F.lag("value").over(user()), 8).alias("diff"))


@query("w03_transition", "SELECT event_id, event_type <> 'view' AND lag(event_type = 'view', 1, true) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS took_off FROM events")
def transition(t):
    view = F.col("event_type") == "view"
    return t.events.withColumn("v", view).select("event_id", (~F.col("v") & F.lag("v", 1, True).over(user())).alias("took_off"))


@query("w04_sessions", "SELECT event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM (SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 14400000000)::INTEGER AS new FROM events)")
def sessions(t):
    return timeops.sessions(t.events, "user_id", "ts", 4 * 3600, "event_id").select("event_id", "session")


@query("w05_change_detection", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n > 1 AND was IS DISTINCT FROM event_type AND ts >= TIMESTAMP '2024-01-10'")
def change_detection(t):
    x = t.events.withColumn("was", F.lag("event_type").over(user())).withColumn("n", F.row_number().over(user()))
    return x.where((F.col("n") > 1) & ~F.col("was").eqNullSafe(F.col("event_type")) & F.expr("ts >= TIMESTAMP_NTZ '2024-01-10'")).select("event_id")


@query("w06_rolling", f"SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)::BIGINT AS n4, sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)::BIGINT AS n28 FROM {DAYS}")
def rolling(t):
    return daily(t).select("user_id", "day", timeops.rolling("n", "user_id", "day", 4).alias("n4"), timeops.rolling("n", "user_id", "day", 28).alias("n28"))


@query("w07_shifted_rolling", f"SELECT user_id, day, sum(n) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN 11 PRECEDING AND 5 PRECEDING)::BIGINT AS n7 FROM {DAYS}")
def shifted_rolling(t):
    return daily(t).select("user_id", "day", timeops.rolling("n", "user_id", "day", 7, 5).alias("n7"))


@query("w08_forward_fill", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS held FROM events")
def forward_fill(t):
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    return t.events.withColumn("v", v).select("event_id", F.last("v", True).over(user().rowsBetween(Window.unboundedPreceding, 0)).alias("held"))


@query("w09_ordinal_rank", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_linenumber) - 1 AS rank FROM lineitem")
def ordinal_rank(t):
    w = Window.partitionBy("l_orderkey").orderBy("l_extendedprice", "l_linenumber")
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.row_number().over(w) - 1).alias("rank"))


@query("w10_share", "SELECT l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 8) AS share FROM lineitem")
def share(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("l_orderkey")), 8).alias("share"))


@query("w11_rank_first", "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) AS rank FROM part")
def rank_first(t):
    return t.part.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"), "p_partkey")).alias("rank"))


@query("w12_last_row", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1")
def last_row(t):
    return t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("user_id", "x.event_id", "x.value")


@query("w13_monotone_ends", """WITH r AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS z FROM events)
SELECT user_id, coalesce(bool_and(value >= p) FILTER (a BETWEEN 2 AND 3), false) AS climbing, coalesce(bool_and(value <= p) FILTER (z <= 2), false) AS descending FROM r GROUP BY 1""")
def monotone_ends(t):
    """Whether the first three values rise and the last three fall."""
    down = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    x = t.events.select("user_id", "value", F.lag("value").over(user()).alias("p"), F.row_number().over(user()).alias("a"), F.row_number().over(down).alias("z"))
    rise, fall = F.when(F.col("a").between(2, 3), F.col("value") >= F.col("p")), F.when(F.col("z") <= 2, F.col("value") <= F.col("p"))
    return x.groupBy("user_id").agg(F.coalesce(F.bool_and(rise), F.lit(False)).alias("climbing"), F.coalesce(F.bool_and(fall), F.lit(False)).alias("descending"))


@query("w14_state_changes", "SELECT event_id, active FROM (SELECT event_id, value > 50 AS active, lag(value > 50) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events) WHERE active IS DISTINCT FROM was")
def state_changes(t):
    x = t.events.withColumn("active", F.col("value") > 50)
    return x.withColumn("was", F.lag("active").over(user())).where(~F.col("active").eqNullSafe(F.col("was"))).select("event_id", "active")


@query("w15_resample", """WITH p AS (SELECT user_id, epoch_us(ts) / 3600000000.0::DOUBLE AS h, value FROM (SELECT user_id, ts, min(value) AS value FROM events GROUP BY ALL)),
s AS (SELECT user_id, unnest(range(ceil(min(h))::BIGINT, floor(max(h))::BIGINT + 1, 6)) AS g FROM p GROUP BY 1)
SELECT user_id, g, round(a.value + CASE WHEN b.h = a.h THEN 0 ELSE (b.value - a.value) * (g - a.h) / (b.h - a.h) END, 6) AS value FROM (SELECT s.user_id, g, (SELECT max({h: p.h, value: p.value}) FROM p WHERE p.user_id = s.user_id AND p.h <= g) AS a, (SELECT min({h: p.h, value: p.value}) FROM p WHERE p.user_id = s.user_id AND p.h >= g) AS b FROM s)""")
def resample(t):
    """Values on a six-hour grid inside each user's span, by linear interpolation between neighbours."""
    p = t.events.groupBy("user_id", "ts").agg(F.min("value").alias("value")).select("user_id", (timeops.micros(F.col("ts")) / 3.6e9).alias("h"), "value")
    span = p.groupBy("user_id").agg(F.ceil(F.min("h")).alias("lo"), F.floor(F.max("h")).alias("hi")).where("lo <= hi")
    grid = span.select("user_id", F.explode(F.sequence("lo", "hi", F.lit(6).cast("long"))).alias("g")).select("user_id", F.col("g").cast("double").alias("h"), "g")
    both = p.withColumn("g", F.lit(None).cast("long")).unionByName(grid.withColumn("value", F.lit(None).cast("double")))
    mark = F.when(F.col("g").isNull(), F.struct("h", "value"))
    w = Window.partitionBy("user_id").orderBy("h")
    x = both.withColumn("a", F.last(mark, True).over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("b", F.first(mark, True).over(w.rangeBetween(0, Window.unboundedFollowing))).where("g IS NOT NULL")
    step = F.when(F.col("b.h") == F.col("a.h"), F.lit(0.0)).otherwise((F.col("b.value") - F.col("a.value")) * (F.col("h") - F.col("a.h")) / (F.col("b.h") - F.col("a.h")))
    return x.select("user_id", "g", F.round(F.col("a.value") + step, 6).alias("value"))


@query("w16_trailing_range", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 900 MINUTE PRECEDING AND CURRENT ROW) AS n, round(max(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 900 MINUTE PRECEDING AND CURRENT ROW), 8) AS top FROM events")
def trailing_range(t):
    w = Window.partitionBy("user_id").orderBy(timeops.micros(F.col("ts"))).rangeBetween(-900 * 60_000_000, 0)
    return t.events.select("event_id", F.count("*").over(w).alias("n"), F.round(F.max("value").over(w), 8).alias("top"))


@query("w17_marks", """WITH m AS (SELECT user_id, unnest(range(min(epoch_us(ts)) // 86400000000 + 1, max(epoch_us(ts)) // 86400000000)) AS mark FROM events GROUP BY 1)
SELECT m.user_id, mark, arg_max(event_id, (ts, event_id)) AS event_id FROM m JOIN events e ON e.user_id = m.user_id AND epoch_us(ts) <= mark * 86400000000 GROUP BY ALL""")
def marks(t):
    """Last event at or before each daily mark within a user's span."""
    e = t.events.select("user_id", timeops.micros(F.col("ts")).alias("us"), "event_id")
    span = e.groupBy("user_id").agg((F.floor(F.min("us") / 8.64e10) + 1).alias("lo"), (F.floor(F.max("us") / 8.64e10) - 1).alias("hi")).where("lo <= hi")
    m = span.select("user_id", F.explode(F.sequence("lo", "hi")).alias("mark")).withColumn("us", (F.col("mark") * 86_400_000_000).cast("long"))
    last = e.groupBy("user_id", "us").agg(F.max("event_id").alias("event_id"))
    return timeops.asof(m, last, "user_id", "us", "us", "event_id").select("user_id", "mark", "event_id")


@query("w18_global_rank", "SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier")
def global_rank(t):
    """Rank over everything: rows are range-split by the leading key, and each range adds the counts before it."""
    from lodestar.operators.scoring import global_rank as rank

    return rank(t.supplier.select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), F.asc("s_suppkey")]).select("s_suppkey", "rank")


@query("w19_first_per_entity", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id FROM events WHERE value > 80 GROUP BY 1")
def first_per_entity(t):
    return t.events.where("value > 80").groupBy("user_id").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("w20_islands", f"SELECT user_id, min(day) AS first, max(day) AS last, count(*) AS length FROM (SELECT user_id, date_diff('day', DATE '2024-01-01', day) AS day, date_diff('day', DATE '2024-01-01', day) - row_number() OVER (PARTITION BY user_id ORDER BY day) AS g FROM {DAYS} WHERE n >= 2) GROUP BY user_id, g")
def islands(t):
    d = daily(t).withColumn("d", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long"))
    return timeops.islands(d, "user_id", "d", F.col("n") >= 2)


@query("w21_merge_intervals", """WITH i AS (SELECT user_id, epoch_us(ts) / 60000000.0::DOUBLE AS a, epoch_us(ts) / 60000000.0::DOUBLE + value * 10 AS b FROM events), m AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM i)
SELECT user_id, round(min(a), 4) AS a, round(max(b), 4) AS b FROM (SELECT *, sum((seen IS NULL OR seen < a)::INTEGER) OVER (PARTITION BY user_id ORDER BY a, b) AS g FROM m) GROUP BY user_id, g""")
def merge_intervals(t):
    a = timeops.micros(F.col("ts")) / 6e7
    m = timeops.merge_intervals(t.events.select("user_id", a.alias("a"), (a + F.col("value") * 10).alias("b")), "user_id", "a", "b")
    return m.select("user_id", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"))


@query("w22_carry_forward", "SELECT event_id, last_value(nullif(trim(CASE WHEN event_id % 3 = 0 THEN event_type ELSE ' ' END), '') IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS callsign FROM events")
def carry_forward(t):
    c = F.nullif(F.trim(F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise(" ")), F.lit(""))
    return t.events.withColumn("c", c).select("event_id", F.last("c", True).over(user().rowsBetween(Window.unboundedPreceding, 0)).alias("callsign"))


@query("w23_jump", f"""SELECT event_id, round(km, 4) AS km FROM (SELECT event_id, {hav('px', 'py', 'x', 'y')} AS km, h FROM (SELECT event_id, {lon_sql('event_id')} AS x, {lat_sql('event_id')} AS y, lag({lon_sql('event_id')}) OVER w AS px, lag({lat_sql('event_id')}) OVER w AS py, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 3600000000.0::DOUBLE AS h FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) WHERE km > 2 AND h > 0 AND km / h / 1.852 > 600""")
def jump(t):
    x = t.events.select("event_id", "user_id", "ts", lon("event_id").alias("x"), lat("event_id").alias("y"))
    x = x.select("event_id", geo.haversine(F.lag("x").over(user()), F.lag("y").over(user()), "x", "y").alias("km"), (timeops.seconds_between(F.lag("ts").over(user()), F.col("ts")) / 3600).alias("h"))
    return x.where("km > 2 AND h > 0 AND km / h / 1.852 > 600").select("event_id", F.round("km", 4).alias("km"))


@query("w24_score_trend", """WITH s AS (SELECT unnest([DATE '2024-01-08', DATE '2024-01-15', DATE '2024-01-22', DATE '2024-01-29', DATE '2024-01-30']) AS step), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, s.step, least(coalesce(sum(least(n, 3) * 10), 0), 100)::BIGINT AS score FROM u CROSS JOIN s LEFT JOIN (SELECT user_id, event_type, step, count(*) AS n FROM events JOIN s ON ts::DATE <= step GROUP BY ALL) c ON c.user_id = u.user_id AND c.step = s.step GROUP BY ALL""")
def score_trend(t):
    """Capped scores as of each week. Events are counted by step first; running sums then give every step at once."""
    from lodestar.operators.scoring import trend

    steps = ["2024-01-08", "2024-01-15", "2024-01-22", "2024-01-29", "2024-01-30"]
    return trend(t.events, "user_id", "event_type", "ts", steps, cap=3, each=10)


@query("d02_floor_blocks", "SELECT event_id, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') AS block FROM events")
def floor_blocks(t):
    return t.events.select("event_id", F.timestamp_seconds(timeops.bucket(F.col("ts"), 21600)).cast("timestamp_ntz").alias("block"))


@query("d07_day_spine", "SELECT unnest(range((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events) + 1, INTERVAL 1 DAY))::DATE AS day")
def day_spine(t):
    ends = t.events.agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    return ends.select(F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias("day"))


@query("a29_turn_total", "SELECT user_id, sum(abs(((d + 180) % 360 + 360) % 360 - 180))::BIGINT AS turned FROM (SELECT user_id, event_id % 360 - lag(event_id % 360) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events) GROUP BY 1")
def turn_total(t):
    d = t.events.select("user_id", geo.wrap(F.col("event_id") % 360 - F.lag(F.col("event_id") % 360).over(user())).alias("d"))
    return d.groupBy("user_id").agg(F.sum(F.abs("d")).cast("long").alias("turned"))


@query("a30_mean_and_radius", f"WITH p AS (SELECT user_id, {lon_sql('event_id')} AS x, {lat_sql('event_id')} AS y FROM events), m AS (SELECT user_id, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1) SELECT p.user_id, round(any_value(mx), 6) AS lon, round(any_value(my), 6) AS lat, round(max({hav('x', 'y', 'mx', 'my')}), 3) AS radius FROM p JOIN m USING (user_id) GROUP BY 1")
def mean_and_radius(t):
    p = t.events.select("user_id", lon("event_id").alias("x"), lat("event_id").alias("y"))
    m = p.groupBy("user_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return p.join(m, "user_id").groupBy("user_id").agg(F.round(F.first("mx"), 6).alias("lon"), F.round(F.first("my"), 6).alias("lat"), F.round(F.max(geo.haversine("x", "y", "mx", "my")), 3).alias("radius"))


@query("a31_straightness", f"""WITH p AS (SELECT user_id, ts, event_id, {lon_sql('event_id')} AS x, {lat_sql('event_id')} AS y FROM events), l AS (SELECT *, {hav('lag(x) OVER w', 'lag(y) OVER w', 'x', 'y')} AS leg FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
e AS (SELECT user_id, sum(leg) AS path, arg_min(x, (ts, event_id)) AS ax, arg_min(y, (ts, event_id)) AS ay, arg_max(x, (ts, event_id)) AS bx, arg_max(y, (ts, event_id)) AS y2 FROM l GROUP BY 1) SELECT user_id, round({hav('ax', 'ay', 'bx', 'y2')} / path, 6) AS straightness FROM e WHERE path > 0""")
def straightness(t):
    p = t.events.select("user_id", "ts", "event_id", lon("event_id").alias("x"), lat("event_id").alias("y"))
    p = p.withColumn("leg", geo.haversine(F.lag("x").over(user()), F.lag("y").over(user()), "x", "y"))
    o = F.struct("ts", "event_id")
    e = p.groupBy("user_id").agg(F.sum("leg").alias("path"), F.min_by(F.struct("x", "y"), o).alias("a"), F.max_by(F.struct("x", "y"), o).alias("b")).where("path > 0")
    return e.select("user_id", F.round(geo.haversine(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")) / F.col("path"), 6).alias("straightness"))
