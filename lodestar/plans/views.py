"""Views that clients ask for, and small rules of single craft, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.operators import anchoring
from lodestar.functions import geo, timeops
from lodestar.operators.joins import top_n
from lodestar.plans.joins import PLACES, hav
from lodestar.plans.projections import lat, lat_sql, lon, lon_sql
from lodestar.registry import query


def user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query("f03_as_of_tables", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01' UNION ALL SELECT 'events', count(*) FROM events WHERE ts <= TIMESTAMP '2024-01-15'")
def as_of_tables(t):
    a = t.orders.where("o_orderdate <= TIMESTAMP_NTZ '1998-01-01'").agg(F.count("*").alias("n")).select(F.lit("orders").alias("name"), "n")
    return a.unionByName(t.events.where("ts <= TIMESTAMP_NTZ '2024-01-15'").agg(F.count("*").alias("n")).select(F.lit("events").alias("name"), "n"))


@query("f06_accuracy_filter", "SELECT event_id FROM events WHERE NOT list_contains(string_split(event_type, 'i'), 'v') AND event_type <> 'error' AND json_extract_string(props, '$.k') IS NOT NULL AND value >= 1")
def accuracy_filter(t):
    own = ~F.array_contains(F.split("event_type", "i"), "v")
    return t.events.where(own & (F.col("event_type") != "error") & F.get_json_object("props", "$.k").isNotNull() & (F.col("value") >= 1)).select("event_id")


@query("f14_orbit_test", f"""WITH p AS (SELECT user_id, event_id % 360 - lag(event_id % 360) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events WHERE event_type <> 'view')
SELECT user_id, count(*) AS points, sum(abs(((d + 180) % 360 + 360) % 360 - 180))::BIGINT AS turned FROM p GROUP BY 1 HAVING count(*) >= 10 AND sum(abs(((d + 180) % 360 + 360) % 360 - 180)) >= 540""")
def orbit_test(t):
    p = t.events.where("event_type <> 'view'").select("user_id", F.abs(geo.wrap(F.col("event_id") % 360 - F.lag(F.col("event_id") % 360).over(user()))).alias("d"))
    return p.groupBy("user_id").agg(F.count("*").alias("points"), F.sum("d").cast("long").alias("turned")).where("points >= 10 AND turned >= 540")


@query("f15_terminal", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1 HAVING arg_max(event_type, (ts, event_id)) = 'view' OR arg_max(value, (ts, event_id)) < 30")
def terminal(t):
    last = t.events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type", "value")).alias("x"))
    return last.where("x.event_type = 'view' OR x.value < 30").select("user_id", "x.event_id")


@query("g09_nearest_border", f"SELECT s_suppkey, round({hav('s_lon', 's_lat', 'least(greatest(s_lon, 22.0), 40.0)', 'least(greatest(s_lat, 44.0), 52.0)')}, 4) AS km FROM (SELECT s_suppkey, {lon_sql('s_suppkey')} AS s_lon, {lat_sql('s_suppkey')} AS s_lat FROM supplier)")
def nearest_border(t):
    """Distance to the nearest point, in degrees, of a box; nought inside."""
    s = t.supplier.select("s_suppkey", lon("s_suppkey").alias("x"), lat("s_suppkey").alias("y"))
    hold = lambda c, a, b: F.least(F.greatest(F.col(c), F.lit(a)), F.lit(b))
    return s.select("s_suppkey", F.round(geo.haversine("x", "y", hold("x", 22.0, 40.0), hold("y", 44.0, 52.0)), 4).alias("km"))


@query("g14_descent_path", "SELECT p_partkey, i, round(least(p_retailprice, 300 * (1 - i / 8.0) / 3), 6) AS alt FROM part, range(9) r(i)")
def descent_path(t):
    """Altitude along a path that comes down one in three."""
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("i")
    return t.part.select("p_partkey", "p_retailprice", i).select("p_partkey", "i", F.round(F.least("p_retailprice", 300 * (1 - F.col("i") / 8.0) / 3), 6).alias("alt"))


@query("g17_passes", f"""WITH g AS (SELECT s_suppkey, m, {hav('36.5::DOUBLE', '45.3::DOUBLE', '((s_suppkey * 7919 + m * 400) % 36000)::DOUBLE / 100 - 180', '80 * sin(radians((s_suppkey * 31 + m * 4) % 360))')} AS km FROM supplier, range(720) r(m)), i AS (SELECT *, m - row_number() OVER (PARTITION BY s_suppkey ORDER BY m) AS k FROM g WHERE km <= 1500)
SELECT s_suppkey, min(m) AS first, max(m) AS last, round(min(km), 4) AS closest FROM i GROUP BY s_suppkey, k""")
def passes(t):
    """Spans of minutes in which a satellite on a made-up track is in reach, with the closest approach."""
    g = t.supplier.select("s_suppkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(719).cast("long"))).alias("m"))
    x = ((F.col("s_suppkey") * 7919 + F.col("m") * 400) % 36000).cast("double") / 100 - 180
    y = 80 * F.sin(F.radians((F.col("s_suppkey") * 31 + F.col("m") * 4) % 360))
    g = g.withColumn("km", geo.haversine(36.5, 45.3, x, y)).where("km <= 1500")
    g = g.withColumn("k", F.col("m") - F.row_number().over(Window.partitionBy("s_suppkey").orderBy("m")))
    return g.groupBy("s_suppkey", "k").agg(F.min("m").alias("first"), F.max("m").alias("last"), F.round(F.min("km"), 4).alias("closest")).drop("k")


@query("m11_ranked_candidates", f"""WITH c AS (SELECT c_custkey, name, {hav('c_lon', 'c_lat', 'p_lon', 'p_lat')} AS km FROM (SELECT c_custkey, {lon_sql('c_custkey')} AS c_lon, {lat_sql('c_custkey')} AS c_lat FROM customer), (VALUES {', '.join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE)" for n, x, y in PLACES)}) p(name, p_lon, p_lat))
SELECT c_custkey, name, round(exp(-km / 3000) / sum(exp(-km / 3000)) OVER (PARTITION BY c_custkey), 8) AS p, row_number() OVER (PARTITION BY c_custkey ORDER BY km, name) AS rank FROM c""")
def ranked_candidates(t):
    """Each snapshot's places with normalised scores and ranks."""
    options = F.array(*(F.struct(geo.haversine("x", "y", a, b).alias("km"), F.lit(n).alias("name")) for n, a, b in PLACES))
    c = t.customer.select("c_custkey", lon("c_custkey").alias("x"), lat("c_custkey").alias("y")).select("c_custkey", F.array_sort(options).alias("o"))
    z = F.aggregate("o", F.lit(0.0), lambda a, s: a + F.exp(-s["km"] / 3000))
    return c.select("c_custkey", z.alias("z"), F.posexplode("o").alias("i", "s")).select("c_custkey", "s.name", F.round(F.exp(-F.col("s.km") / 3000) / F.col("z"), 8).alias("p"), (F.col("i") + 1).alias("rank"))


@query("m14_arrival", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / 18.52 / greatest(1, l_quantity * 8 + l_tax * 100 * cos(radians(l_partkey % 360))), 6) AS hours FROM lineitem")
def arrival(t):
    """Hours to go at the speed over ground that the wind leaves."""
    ground = F.greatest(F.lit(1.0), F.col("l_quantity") * 8 + F.col("l_tax") * 100 * F.cos(F.radians(F.col("l_partkey") % 360)))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(F.col("l_extendedprice") / 18.52 / ground, 6).alias("hours"))


@query("m16_owner", "SELECT l_suppkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN min(l_returnflag) ELSE 'mixed' END AS owner FROM lineitem GROUP BY 1")
def owner(t):
    g = t.lineitem.groupBy("l_suppkey").agg(F.min("l_returnflag").alias("a"), F.max("l_returnflag").alias("b"))
    return g.select("l_suppkey", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("mixed").alias("owner"))


@query("m17_ramp", "SELECT event_id, round(CASE WHEN v <= 0.2 THEN v * 5 * 100 WHEN v <= 0.6 THEN 100 + (v - 0.2) / 0.4 * 80 ELSE 180 + (v - 0.6) / 0.4 * 75 END, 6) AS red FROM (SELECT event_id, value / 100 AS v FROM events)")
def ramp(t):
    v = F.col("value") / 100
    return t.events.select("event_id", F.round(F.when(v <= 0.2, v * 5 * 100).when(v <= 0.6, 100 + (v - 0.2) / 0.4 * 80).otherwise(180 + (v - 0.6) / 0.4 * 75), 6).alias("red"))


@query("v02_region_state", "WITH s AS (SELECT user_id % 25 AS k, arg_max(value > 50, (ts, event_id)) AS active FROM events GROUP BY 1), p AS (SELECT c_nationkey AS k, round(avg((c_acctbal < 0)::INTEGER), 8) AS p FROM customer WHERE c_nationkey <> 3 GROUP BY 1) SELECT n_nationkey, n_name, coalesce(active, false) AS active, p FROM nation LEFT JOIN s ON n_nationkey = s.k LEFT JOIN p ON n_nationkey = p.k")
def region_state(t):
    s = t.events.groupBy((F.col("user_id") % 25).alias("n_nationkey")).agg(F.max_by(F.col("value") > 50, F.struct("ts", "event_id")).alias("active"))
    p = t.customer.where("c_nationkey <> 3").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.round(F.avg((F.col("c_acctbal") < 0).cast("int")), 8).alias("p"))
    return t.nation.join(s, "n_nationkey", "left").join(p, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("active", F.lit(False)).alias("active"), "p")


@query("v06_point_in_cell", f"WITH g AS (SELECT floor({lat_sql('c_custkey')} / 10)::BIGINT AS r, floor({lon_sql('c_custkey')} / 10)::BIGINT AS c, count(*) AS n, avg((c_acctbal < 0)::INTEGER) AS share FROM customer GROUP BY ALL HAVING count(*) >= 3) SELECT s_suppkey, n, round(share, 8) AS share FROM supplier JOIN g ON floor({lat_sql('s_suppkey')} / 10) = r AND floor({lon_sql('s_suppkey')} / 10) = c")
def point_in_cell(t):
    cell = lambda k: (F.floor(lat(k) / 10).alias("r"), F.floor(lon(k) / 10).alias("c"))
    g = t.customer.groupBy(*cell("c_custkey")).agg(F.count("*").alias("n"), F.avg((F.col("c_acctbal") < 0).cast("int")).alias("share")).where("n >= 3")
    return t.supplier.select("s_suppkey", *cell("s_suppkey")).join(g, ["r", "c"]).select("s_suppkey", "n", F.round("share", 8).alias("share"))


@query("v08_heading", f"""WITH r AS (SELECT user_id, ts, event_id, {lon_sql('event_id')} AS x, {lat_sql('event_id')} AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), e AS (SELECT user_id, arg_min(x, n) AS ax, arg_min(y, n) AS ay, arg_max(x, n) AS bx, arg_max(y, n) AS b_y FROM r WHERE n <= 6 GROUP BY 1 HAVING count(*) > 1)
SELECT user_id, round((degrees(atan2(sin(radians(bx - ax)) * cos(radians(b_y)), cos(radians(ay)) * sin(radians(b_y)) - sin(radians(ay)) * cos(radians(b_y)) * cos(radians(bx - ax)))) + 360) % 360, 6) AS hdg FROM e""")
def heading(t):
    """Bearing over the first six positions."""
    r = t.events.select("user_id", lon("event_id").alias("x"), lat("event_id").alias("y"), F.row_number().over(user()).alias("n")).where("n <= 6")
    e = r.groupBy("user_id").agg(F.min_by(F.struct("x", "y"), "n").alias("a"), F.max_by(F.struct("x", "y"), "n").alias("b"), F.count("*").alias("k")).where("k > 1")
    return e.select("user_id", F.round(geo.bearing(F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")), 6).alias("hdg"))


@query("v12_prior_counters", "SELECT name, key, count(*) AS n FROM (SELECT unnest(['type', 'user', 'pair']) AS name, unnest([event_type, user_id::VARCHAR, event_type || '/' || (user_id % 10)]) AS key FROM events) GROUP BY ALL")
def prior_counters(t):
    """Three counters at once, from one pass over the rows."""
    each = F.array(F.struct(F.lit("type").alias("name"), F.col("event_type").alias("key")), F.struct(F.lit("user").alias("name"), F.col("user_id").cast("string").alias("key")), F.struct(F.lit("pair").alias("name"), F.concat_ws("/", "event_type", F.col("user_id") % 10).alias("key")))
    return t.events.select(F.explode(each).alias("e")).groupBy("e.name", "e.key").agg(F.count("*").alias("n"))


@query("v14_formed_dissolved", "WITH d AS (SELECT DISTINCT ts::DATE AS day, user_id FROM events), s AS (SELECT day, string_agg(user_id::VARCHAR, ',' ORDER BY user_id) AS sig FROM d GROUP BY 1) SELECT day, sig, sig IS DISTINCT FROM lag(sig) OVER (ORDER BY day) AS changed FROM s")
def formed_dissolved(t):
    """Signature of each day's members, and whether it differs from the day before."""
    d = t.events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.array_join(F.transform(F.array_sort(F.collect_set("user_id")), lambda x: x.cast("string")), ",").alias("sig"))
    before = d.select(F.date_add("day", 1).alias("day"), F.col("sig").alias("was"))
    return d.join(before, "day", "left").select("day", "sig", (~F.col("sig").eqNullSafe(F.col("was"))).alias("changed"))


@query("v15_vessel_search", "SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%e%' AND p_size BETWEEN 10 AND 20 ORDER BY p_name, p_partkey LIMIT 40")
def vessel_search(t):
    return t.part.where(F.contains(F.lower("p_name"), F.lit("e")) & F.col("p_size").between(10, 20)).orderBy("p_name", "p_partkey").limit(40).select("p_partkey", "p_name")


@query("c01_priority_board", "SELECT user_id, event_id, value FROM events WHERE event_type <> 'view' AND value >= 25 ORDER BY value DESC, event_id LIMIT 50")
def priority_board(t):
    return t.events.where("event_type <> 'view' AND value >= 25").orderBy(F.desc("value"), "event_id").limit(50).select("user_id", "event_id", "value")


@query("c02_merged_feed", "SELECT kind, id FROM (SELECT 'alert' AS kind, event_id AS id, ts FROM events WHERE value > 80 UNION ALL SELECT 'headline', event_id, ts FROM events WHERE event_type = 'signup') ORDER BY ts DESC, id DESC, kind LIMIT 200")
def merged_feed(t):
    one = lambda kind, c: t.events.where(c).select(F.lit(kind).alias("kind"), F.col("event_id").alias("id"), "ts")
    return one("alert", "value > 80").unionByName(one("headline", "event_type = 'signup'")).orderBy(F.desc("ts"), F.desc("id"), "kind").limit(200).select("kind", "id")


@query("c05_weapon_counts", "SELECT event_type, count(*) AS n, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1 ORDER BY n DESC, 1")
def weapon_counts(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest")).orderBy(F.desc("n"), "event_type")


@query("c08_touching", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey = 7 OR l_suppkey = 7")
def touching(t):
    return t.lineitem.where("l_partkey = 7 OR l_suppkey = 7").select("l_orderkey", "l_linenumber")


@query("c09_stream_groups", "SELECT user_id % 5 AS g, string_agg(DISTINCT CASE WHEN value > 95 THEN event_type END, ',' ORDER BY CASE WHEN value > 95 THEN event_type END) AS missing, count(*) FILTER (value > 50) AS ok FROM events GROUP BY 1")
def stream_groups(t):
    return t.events.groupBy((F.col("user_id") % 5).alias("g")).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("value") > 95, F.col("event_type")))), ",").alias("missing"), F.count_if(F.col("value") > 50).alias("ok"))


@query("c12_resolved_links", "SELECT o_orderkey, p_partkey, s_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size < 25 AND s_acctbal > 0")
def resolved_links(t):
    x = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return x.join(t.part.where("p_size < 25"), F.col("l_partkey") == F.col("p_partkey")).join(t.supplier.where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey")).select("o_orderkey", "p_partkey", "s_suppkey")


@query("c15_first_slot", "SELECT user_id, min(ts) AS ts FROM events WHERE value >= 70 GROUP BY 1")
def first_slot(t):
    return t.events.where("value >= 70").groupBy("user_id").agg(F.min("ts").alias("ts"))


@query("c16_top_labels", "SELECT user_id, string_agg(event_type, ',' ORDER BY k) AS top FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)) WHERE k <= 4 GROUP BY 1")
def top_labels(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = top_n(n, "user_id", [F.desc("n"), F.asc("event_type")], 4)
    return best.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "event_type"))), lambda x: x["event_type"]), ",").alias("top"))


@query("q09_recent_evidence", "SELECT user_id, count(*) AS n, min(ts) AS first, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def recent_evidence(t):
    edge = t.events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("edge"))
    x = t.events.join(F.broadcast(edge), F.col("ts") >= F.col("edge"))  # one row
    return x.groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("q13_track_of_one", "WITH m AS (SELECT *, lag(ts) OVER (ORDER BY ts, event_id) AS was FROM events WHERE user_id = 7 AND ts >= TIMESTAMP '2024-01-28') SELECT event_id, sum((was IS NULL OR epoch_us(ts) - epoch_us(was) > 21600000000)::INTEGER) OVER (ORDER BY ts, event_id)::BIGINT AS session FROM m")
def track_of_one(t):
    return timeops.sessions(t.events.where("user_id = 7 AND ts >= TIMESTAMP_NTZ '2024-01-28'"), "user_id", "ts", 6 * 3600, "event_id").select("event_id", "session")


@query("q03_meta", "SELECT (SELECT count(*) FROM orders) AS orders, (SELECT min(ts) FROM events) AS first, (SELECT max(ts) FROM events) AS last")
def meta(t):
    return t.events.agg(F.min("ts").alias("first"), F.max("ts").alias("last")).crossJoin(t.orders.agg(F.count("*").alias("orders"))).select("orders", "first", "last")  # one row each


@query("k07_json_responses", "SELECT event_id, json_object('event_id', event_id, 'v', CASE WHEN value > 90 THEN NULL ELSE user_id END)::VARCHAR AS json FROM events")
def json_responses(t):
    v = F.when(F.col("value") <= 90, F.col("user_id"))
    return t.events.select("event_id", F.to_json(F.struct("event_id", v.alias("v")), {"ignoreNullFields": "false"}).alias("json"))


@query("x03_annotated_state", "WITH s AS (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1), a AS (SELECT o_custkey, count(*) AS orders FROM orders GROUP BY 1) SELECT user_id, value, orders FROM s LEFT JOIN a ON user_id = o_custkey")
def annotated_state(t):
    """Current state beside an annotation kept apart, which an update does not touch."""
    s = t.events.groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    a = t.orders.groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("orders"))
    return s.join(a, "user_id", "left")


@query("x12_report_ttl", "SELECT event_id FROM (SELECT *, (SELECT max(ts) FROM events) AS now, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE event_type = 'signup' OR (n = 1 AND epoch_us(now) - epoch_us(ts) <= 2592000000000)")
def report_ttl(t):
    now = t.events.agg(F.max("ts").alias("now"))
    first = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    x = t.events.withColumn("n", F.row_number().over(first)).join(F.broadcast(now))  # one row
    return x.where((F.col("event_type") == "signup") | ((F.col("n") == 1) & (timeops.seconds_between(F.col("ts"), F.col("now")) <= 2_592_000))).select("event_id")


@query("p13_airframe_letter", "SELECT p_partkey, CASE left(p_type, 1) WHEN 'S' THEN 'helicopter' WHEN 'P' THEN 'tiltrotor' ELSE 'fixed_wing' END AS airframe FROM part")
def airframe_letter(t):
    table = F.create_map(F.lit("S"), F.lit("helicopter"), F.lit("P"), F.lit("tiltrotor"))
    return t.part.select("p_partkey", F.coalesce(F.try_element_at(table, F.substring("p_type", 1, 1)), F.lit("fixed_wing")).alias("airframe"))


@query("p24_probability_clip", "SELECT event_id, least(greatest(value / 80 - 0.1, 0.001), 0.999) AS p FROM events")
def probability_clip(t):
    return t.events.select("event_id", F.least(F.greatest(F.col("value") / 80 - 0.1, F.lit(0.001)), F.lit(0.999)).alias("p"))


@query("p25_iso_format", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z' AS iso, (floor(value / 60)::BIGINT) || ' h ' || (floor(value)::BIGINT % 60) || ' min' AS lasted FROM events")
def iso_format(t):
    m = F.floor("value")
    return t.events.select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"), F.concat(F.floor(F.col("value") / 60).cast("string"), F.lit(" h "), (m % 60).cast("string"), F.lit(" min")).alias("lasted"))


@query("p30_normalised_prior", "SELECT user_id, event_type, round(n::DOUBLE / sum(n) OVER (PARTITION BY user_id), 8) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def normalised_prior(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.select("user_id", "event_type", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("user_id")), 8).alias("share"))


_NAMES = r"""tok AS (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, t FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}][\p{L}\p{M}0-9''’]*(?:-[\p{L}][\p{L}\p{M}0-9''’]*)*') AS t FROM documents)),
src AS (SELECT item_id, list_transform(regexp_extract_all(lower(text), '[\p{L}][\p{L}\p{M}0-9''’]*(?:-[\p{L}][\p{L}\p{M}0-9''’]*)*'), lambda x: x) AS t FROM benchmark),
nm AS (SELECT words, n, min(item_id) AS place FROM (SELECT item_id, n, array_to_string(t[1:n], ' ') AS words FROM src, (VALUES (2), (4)) AS k(n) WHERE len(t) >= n) GROUP BY ALL)"""


@query("t09_first_place", f"""WITH {_NAMES}, hit AS (SELECT doc_id, pos, max(n) AS n, arg_max(place, n) AS place FROM tok JOIN (VALUES (2), (4)) AS k(size) ON pos + size <= len(t) JOIN nm ON nm.n = k.size AND nm.words = lower(array_to_string(t[pos + 1:pos + size], ' ')) GROUP BY doc_id, pos)
SELECT doc_id, min(pos)::INTEGER AS "at", arg_min(n, pos)::INTEGER AS n, arg_min(place, pos) AS place FROM hit GROUP BY doc_id""")
def first_place(t):
    """The first passage of the benchmark that a document names, by its first two words or, if they go on so, four."""
    words = anchoring.tokens(F.lower("text"))
    named = t.benchmark.select("item_id", words.alias("t")).select(F.col("item_id").alias("place"), F.explode(F.array(*(F.when(F.size("t") >= n, F.array_join(F.slice("t", 1, n), " ")) for n in (2, 4)))).alias("name")).where("name IS NOT NULL")
    return anchoring.first_place(t.documents.select("doc_id", "text"), anchoring.names(named), key="doc_id")
