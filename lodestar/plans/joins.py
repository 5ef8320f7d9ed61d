"""Join queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import geo, timeops
from lodestar.operators import joins as J
from lodestar.operators import pairs
from lodestar.plans.projections import lat, lat_sql, lon, lon_sql
from lodestar.registry import query


def hav(a: str, b: str, c: str, d: str, r: str = "6371.0088") -> str:
    """SQL of the distance between two points given as lon, lat, lon, lat."""
    return f"(2 * {r} * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians(({d}) - ({b})) / 2), 2) + cos(radians({b})) * cos(radians({d})) * pow(sin(radians(({c}) - ({a})) / 2), 2)))))"


PLACES = [("kerch", 36.5, 45.3), ("sevastopol", 33.5, 44.6), ("feodosia", 35.4, 45.0), ("north", 10.0, 60.0), ("south", -40.0, -30.0), ("east", 120.0, 10.0), ("west", -100.0, 35.0)]


def suppliers(t):
    return t.supplier.select("s_suppkey", lon("s_suppkey").alias("s_lon"), lat("s_suppkey").alias("s_lat"))


def customers(t):
    return t.customer.select("c_custkey", lon("c_custkey").alias("c_lon"), lat("c_custkey").alias("c_lat"))


S = f"(SELECT s_suppkey, {lon_sql('s_suppkey')} AS s_lon, {lat_sql('s_suppkey')} AS s_lat FROM supplier)"
C = f"(SELECT c_custkey, {lon_sql('c_custkey')} AS c_lon, {lat_sql('c_custkey')} AS c_lat FROM customer)"
P = "(VALUES " + ", ".join(f"('{n}', {x}::DOUBLE, {y}::DOUBLE)" for n, x, y in PLACES) + ") p(name, p_lon, p_lat)"


@query("j01_inner", "SELECT o_orderkey, l_linenumber, l_quantity, o_totalprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'")
def inner(t):
    return t.orders.where("o_orderstatus = 'F'").join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity", "o_totalprice")


@query("j02_two_key", "SELECT a.l_orderkey, a.l_linenumber, b.m FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, max(l_quantity) AS m FROM lineitem GROUP BY ALL) b USING (l_partkey, l_suppkey) WHERE a.l_quantity = b.m")
def two_key(t):
    best = t.lineitem.groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("m"))
    return t.lineitem.join(best, ["l_partkey", "l_suppkey"]).where("l_quantity = m").select("l_orderkey", "l_linenumber", "m")


@query("j03_left_lookup", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def left_lookup(t):
    names = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", "r_name")
    return t.customer.join(J.small(names), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name", "r_name")


@query("j04_priority_key", """WITH idx AS (SELECT s_suppkey, s_name, s_suppkey % 50 AS k1, s_suppkey % 97 AS k2 FROM supplier),
a AS (SELECT k1, arg_max(s_name, s_suppkey) AS v FROM idx WHERE s_suppkey % 3 = 0 GROUP BY k1), b AS (SELECT k2, arg_max(s_name, s_suppkey) AS v FROM idx GROUP BY k2)
SELECT c_custkey, coalesce(a.v, b.v) AS found FROM customer LEFT JOIN a ON c_custkey % 150 = a.k1 LEFT JOIN b ON c_custkey % 211 = b.k2""")
def priority_key(t):
    index = t.supplier.select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_suppkey") % 50).alias("k1"), (F.col("s_suppkey") % 97).alias("k2"))
    left = t.customer.select("c_custkey", (F.col("c_custkey") % 150).alias("m1"), (F.col("c_custkey") % 211).alias("m2"))
    return J.by_priority(left, index, [("m1", "k1"), ("m2", "k2")], "s_name", "s_suppkey", "found").select("c_custkey", "found")


@query("j05_spatial_ellipse", f"""WITH g AS (SELECT a.s_suppkey AS gap, a.s_lon AS g_ax, a.s_lat AS g_ay, a.s_lon + 2 AS g_bx, a.s_lat * 0.98 AS g_by, 12 + a.s_suppkey % 20 AS h FROM {S} a),
e AS (SELECT *, 16.5 * 1.852 * h AS reach, {hav('g_ax', 'g_ay', 'g_bx', 'g_by')} AS d FROM g)
SELECT gap, c_custkey, reach < d AS impossible FROM e JOIN {C} c ON abs(c_lat - (g_ay + g_by) / 2) < 12 AND CASE WHEN reach < d THEN {hav('c_lon', 'c_lat', 'g_bx', 'g_by')} <= 5 ELSE {hav('g_ax', 'g_ay', 'c_lon', 'c_lat')} + {hav('c_lon', 'c_lat', 'g_bx', 'g_by')} <= reach END""")
def spatial_ellipse(t):
    """Points inside the reachability ellipse of a gap. The ellipse lies within a circle of its semi-major axis around its middle."""
    g = suppliers(t).select(F.col("s_suppkey").alias("gap"), F.col("s_lon").alias("g_ax"), F.col("s_lat").alias("g_ay"), (F.col("s_lon") + 2).alias("g_bx"), (F.col("s_lat") * 0.98).alias("g_by"), (12 + F.col("s_suppkey") % 20).alias("h"))
    e = g.withColumn("d", geo.haversine("g_ax", "g_ay", "g_bx", "g_by")).withColumn("e", geo.ellipse("d", F.col("h"), 16.5))
    m = e.withColumn("m", geo.midpoint("g_ax", "g_ay", "g_bx", "g_by")).withColumn("mx", F.col("m.lon")).withColumn("my", F.col("m.lat"))
    # Focus to focus and back is no more than reach, so no point is further from the middle than half of it; impossible gaps end within 5 km of their end.
    m = m.withColumn("_own", F.greatest(F.col("e.max_distance_km"), F.col("d") + 10) / 2 + 1)
    hits = J.within_radius(customers(t), m, 16.5 * 1.852 * 32 / 2 + 250, ("c_lon", "c_lat"), ("mx", "my"), own="_own")
    inside = geo.in_ellipse(geo.haversine("g_ax", "g_ay", "c_lon", "c_lat"), geo.haversine("c_lon", "c_lat", "g_bx", "g_by"), F.col("e.max_distance_km"), F.col("e.impossible"))
    return hits.where(inside & (F.abs(F.col("c_lat") - (F.col("g_ay") + F.col("g_by")) / 2) < 12)).select("gap", "c_custkey", F.col("e.impossible").alias("impossible"))


@query("j06_interval_day", """SELECT o_orderkey, count(*) AS n, max(event_id) AS last FROM (SELECT o_orderkey, DATE '2024-01-01' + ((o_orderdate::DATE - DATE '1992-01-01') % 31)::INTEGER AS a, DATE '2024-01-01' + ((o_orderdate::DATE - DATE '1992-01-01') % 31 + o_orderkey % 4)::INTEGER AS b FROM orders)
JOIN events ON ts::DATE BETWEEN a AND b WHERE event_type = 'error' GROUP BY 1""")
def interval_day(t):
    """Events on a calendar day between an interval's first and last: days are laid out, events counted by day before they meet."""
    first = F.date_add(F.lit("2024-01-01").cast("date"), (F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date")) % 31).cast("int"))
    o = t.orders.select("o_orderkey", first.alias("a"), (F.col("o_orderkey") % 4).cast("int").alias("n"))
    days = o.select("o_orderkey", F.explode(F.sequence("a", F.date_add("a", F.col("n")))).alias("day"))
    e = t.events.where("event_type = 'error'").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("c"), F.max("event_id").alias("last"))
    return days.join(e, "day").groupBy("o_orderkey").agg(F.sum("c").alias("n"), F.max("last").alias("last"))


@query("j07_feasibility", """SELECT l_orderkey, l_linenumber, greatest(t, 24 + d / 30) <= least(t + 1, 72 - d / 40) AS consistent, CASE WHEN greatest(t, 24 + d / 30) <= least(t + 1, 72 - d / 40) THEN round(greatest(t, 24 + d / 30), 6) END AS earliest
FROM (SELECT l_orderkey, l_linenumber, (l_partkey % 96)::DOUBLE AS t, l_quantity * 20 AS d FROM lineitem)""")
def feasibility(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 96).cast("double").alias("t"), (F.col("l_quantity") * 20).alias("d"))
    early, late = F.greatest(F.col("t"), 24 + F.col("d") / 30), F.least(F.col("t") + 1, 72 - F.col("d") / 40)
    return x.select("l_orderkey", "l_linenumber", (early <= late).alias("consistent"), F.when(early <= late, F.round(early, 6)).alias("earliest"))


@query("j08_nearest", f"""SELECT c_custkey, CASE WHEN km <= 4000 THEN name END AS place, round(km, 4) AS place_km FROM (SELECT c_custkey, name, {hav('c_lon', 'c_lat', 'p_lon', 'p_lat')} AS km, row_number() OVER (PARTITION BY c_custkey ORDER BY {hav('c_lon', 'c_lat', 'p_lon', 'p_lat')}, name) AS n FROM {C} c, {P}) WHERE n = 1""")
def nearest(t):
    return J.nearest(customers(t), PLACES, "c_lon", "c_lat", radius_km=4000).select("c_custkey", "place", F.round("place_km", 4).alias("place_km"))


@query("j09_radius", f"SELECT s_suppkey, c_custkey, round({hav('c_lon', 'c_lat', 's_lon', 's_lat')}, 4) AS km FROM {S} s JOIN {C} c ON {hav('c_lon', 'c_lat', 's_lon', 's_lat')} <= 300")
def radius(t):
    return J.within_radius(customers(t), suppliers(t), 300, ("c_lon", "c_lat"), ("s_lon", "s_lat")).select("s_suppkey", "c_custkey", F.round("km", 4).alias("km"))


@query("j10_exists_near", f"SELECT c_custkey FROM {C} c WHERE EXISTS (SELECT 1 FROM {S} s WHERE {hav('c_lon', 'c_lat', 's_lon', 's_lat')} <= 150)")
def exists_near(t):
    return J.within_radius(customers(t), suppliers(t), 150, ("c_lon", "c_lat"), ("s_lon", "s_lat")).select("c_custkey").distinct()


@query("j11_pair_self", f"SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {S} a JOIN {S} b ON a.s_suppkey < b.s_suppkey AND {hav('a.s_lon', 'a.s_lat', 'b.s_lon', 'b.s_lat')} <= 600")
def pair_self(t):
    b = suppliers(t).select(F.col("s_suppkey").alias("b"), F.col("s_lon").alias("b_lon"), F.col("s_lat").alias("b_lat"))
    return J.within_radius(suppliers(t), b, 600, ("s_lon", "s_lat"), ("b_lon", "b_lat")).where("s_suppkey < b").select(F.col("s_suppkey").alias("a"), "b")


@query("j12_aligned_pairs", """WITH m AS (SELECT DISTINCT user_id, epoch_us(ts) // 3600000000 AS slot FROM events WHERE event_type = 'click')
SELECT a.user_id AS a, b.user_id AS b, count(*) AS shared FROM m a JOIN m b ON a.slot = b.slot AND a.user_id < b.user_id GROUP BY ALL HAVING count(*) >= 3""")
def aligned_pairs(t):
    return pairs.sharing(t.events.where("event_type = 'click'").select("user_id", timeops.bucket(F.col("ts"), 3600).alias("slot")), "user_id", "slot", 3)


@query("j13_asof_counts", "SELECT a.event_id, (SELECT count(*) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND b.ts < a.ts) AS prior FROM events a WHERE a.event_type = 'view'")
def asof_counts(t):
    """Strictly earlier purchases of each view's user, by one window instead of a range join."""
    w = Window.partitionBy("user_id").orderBy(timeops.micros(F.col("ts"))).rangeBetween(Window.unboundedPreceding, -1)
    return t.events.withColumn("prior", F.coalesce(F.sum((F.col("event_type") == "purchase").cast("long")).over(w), F.lit(0))).where("event_type = 'view'").select("event_id", "prior")


@query("j14_asof_latest", "SELECT d.day, coalesce((SELECT max(ts::DATE) FROM events WHERE event_type = 'signup' AND user_id = 7 AND ts::DATE <= d.day), (SELECT min(ts::DATE) FROM events WHERE event_type = 'signup' AND user_id = 7)) AS version FROM (SELECT DISTINCT ts::DATE AS day FROM events) d")
def asof_latest(t):
    """Latest version at or before each day, else the first: days and versions laid out together and filled forward."""
    days = t.events.select(F.col("ts").cast("date").alias("day")).distinct()
    v = t.events.where("event_type = 'signup' AND user_id = 7").select(F.col("ts").cast("date").alias("day")).distinct().withColumn("version", F.col("day"))
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    everything = Window.partitionBy(F.lit(1))
    return days.join(v, "day", "left").select("day", F.coalesce(F.last("version", True).over(w), F.min("version").over(everything)).alias("version"))


@query("j15_spine_left", "SELECT u.user_id, d.day, coalesce(n, 0) AS n FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS day) d LEFT JOIN (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL) c ON c.user_id = u.user_id AND c.day = d.day")
def spine_left(t):
    users = t.events.select("user_id").distinct()
    grid = timeops.spine(users, F.lit("2024-01-01").cast("date"), F.lit("2024-01-30").cast("date"), F.expr("INTERVAL 1 DAY"), "day")
    n = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return grid.join(n, ["user_id", "day"], "left").select("user_id", "day", F.coalesce("n", F.lit(0)).alias("n"))


INTERVALS = "(SELECT user_id, epoch_us(ts) / 60000000.0::DOUBLE AS a, epoch_us(ts) / 60000000.0::DOUBLE + value AS b FROM events WHERE event_type = 'error')"


@query("j16_block_overlap", f"SELECT user_id, unnest(range(floor(a / 360)::BIGINT, floor(b / 360)::BIGINT + 1)) AS block, a, b FROM {INTERVALS}".join(["SELECT user_id, block, round(sum(greatest(0, least(b, (block + 1) * 360) - greatest(a, block * 360))), 4) AS minutes FROM (", ") GROUP BY ALL"]))
def block_overlap(t):
    """Minutes of intervals in each six-hour block."""
    a = timeops.micros(F.col("ts")) / 6e7
    x = t.events.where("event_type = 'error'").select("user_id", a.alias("a"), (a + F.col("value")).alias("b"))
    x = x.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / 360), F.floor(F.col("b") / 360))))
    return x.groupBy("user_id", "block").agg(F.round(F.sum(timeops.overlap(F.col("a"), F.col("b"), F.col("block") * 360.0, (F.col("block") + 1) * 360.0)), 4).alias("minutes"))


@query("j17_nearest_time", """SELECT a.event_id, arg_min(b.value, (abs(epoch_us(a.ts) - epoch_us(b.ts)), b.event_id)) AS value FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_type = 'view' WHERE a.event_type = 'signup' GROUP BY a.event_id""")
def nearest_time(t):
    """Value of the same user's view nearest in time: the neighbours before and after, from windows."""
    e = t.events.where("event_type IN ('signup', 'view')").withColumn("us", timeops.micros(F.col("ts")))
    view = F.when(F.col("event_type") == "view", F.struct("us", "event_id", "value"))
    before = F.last(view, True).over(Window.partitionBy("user_id").orderBy("us", F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(view, True).over(Window.partitionBy("user_id").orderBy("us", "event_id").rowsBetween(0, Window.unboundedFollowing))
    found = e.withColumn("b", before).withColumn("c", after).where("event_type = 'signup' AND (b IS NOT NULL OR c IS NOT NULL)")
    near = lambda s: F.when(s.isNotNull(), F.struct(F.abs(F.col("us") - s["us"]).alias("d"), s["event_id"].alias("id"), s["value"].alias("value")))
    return found.select("event_id", F.array_min(F.array_compact(F.array(near(F.col("b")), near(F.col("c")))))["value"].alias("value"))


@query("j18_narrowest_range", """WITH r AS (SELECT s_suppkey, s_suppkey * 40 AS lo, s_suppkey * 40 + (s_suppkey % 13) * 300 AS hi FROM supplier)
SELECT p_partkey * 3 AS v, arg_min(s_suppkey, (hi - lo, s_suppkey)) AS s_suppkey FROM part JOIN r ON p_partkey * 3 BETWEEN lo AND hi GROUP BY p_partkey""")
def narrowest_range(t):
    r = t.supplier.select("s_suppkey", (F.col("s_suppkey") * 40).alias("lo"), (F.col("s_suppkey") * 40 + (F.col("s_suppkey") % 13) * 300).alias("hi"))
    return J.narrowest_range(t.part.select((F.col("p_partkey") * 3).alias("v")), r, "v", "lo", "hi", "s_suppkey").select("v", "s_suppkey")


@query("j19_candidates", f"""WITH x AS (SELECT c_custkey, name, {hav('c_lon', 'c_lat', 'p_lon', 'p_lat')} AS km FROM {C} c, {P}),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY km, name) AS near, row_number() OVER (PARTITION BY c_custkey ORDER BY km DESC, name) AS far FROM x) SELECT c_custkey, name FROM r WHERE km <= 15000 AND (near <= 2 OR far <= 1)""")
def candidates(t):
    """Reachable places in the union of two short lists of each point, from the few places held in the row."""
    options = F.array(*(F.struct(geo.haversine("c_lon", "c_lat", x, y).alias("km"), F.lit(n).alias("name")) for n, x, y in PLACES))
    c = customers(t).withColumn("o", F.array_sort(options))
    far = F.array_sort(F.transform("o", lambda x: F.struct((-x["km"]).alias("k"), x["name"].alias("name"), x["km"].alias("km"))))
    pick = F.array_union(F.transform(F.slice("o", 1, 2), lambda x: F.struct("c_custkey", x["name"].alias("name"), x["km"].alias("km"))), F.transform(F.slice(far, 1, 1), lambda x: F.struct("c_custkey", x["name"].alias("name"), x["km"].alias("km"))))
    return c.select(F.explode(pick).alias("x")).select("x.*").where("km <= 15000").select("c_custkey", "name")


@query("j20_landing_site", f"""WITH x AS (SELECT c_custkey, name, {hav('c_lon', 'c_lat', 'p_lon', 'p_lat')} AS km FROM {C} c, {P}) SELECT c_custkey, arg_min(name, (km - CASE WHEN length(name) = 5 THEN 500 ELSE 0 END, name)) AS site FROM x WHERE km <= 6000 GROUP BY c_custkey""")
def landing_site(t):
    """Nearest place after a bonus for a preferred kind, within reach; points without one drop out."""
    options = F.array(*(F.struct((geo.haversine("c_lon", "c_lat", x, y) - (500 if len(n) == 5 else 0)).alias("d"), F.lit(n).alias("name"), geo.haversine("c_lon", "c_lat", x, y).alias("km")) for n, x, y in PLACES))
    return customers(t).select("c_custkey", F.array_min(F.filter(options, lambda o: o["km"] <= 6000))["name"].alias("site")).where("site IS NOT NULL")


@query("j22_pattern_links", "SELECT DISTINCT a.o_custkey AS a, b.o_custkey AS b FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) a JOIN (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) b USING (l_partkey) WHERE a.o_custkey < b.o_custkey")
def pattern_links(t):
    return pairs.sharing(t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")), "o_custkey", "l_partkey").select("a", "b")


@query("j23_variant_lookup", """WITH v AS (SELECT p_partkey, unnest([w, left(w, length(w) - 1), left(w, length(w) - 2)]) AS form, unnest([0, 1, 2]) AS pos FROM (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS w FROM part)),
n AS (SELECT DISTINCT left(lower(p_type), 4) AS form FROM part) SELECT p_partkey, arg_min(form, pos) AS form FROM v JOIN n USING (form) GROUP BY p_partkey""")
def variant_lookup(t):
    w = F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1))
    forms = F.array(w, F.substring(w, F.lit(1), F.length(w) - 1), F.substring(w, F.lit(1), F.length(w) - 2))
    v = t.part.select("p_partkey", F.posexplode(forms).alias("pos", "form"))
    names = t.part.select(F.substring(F.lower("p_type"), 1, 4).alias("form")).distinct()
    return v.join(names, "form").groupBy("p_partkey").agg(F.min_by("form", "pos").alias("form"))


@query("j24_prefix_search", "SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'b') ORDER BY p_size DESC, p_partkey LIMIT 20")
def prefix_search(t):
    return t.part.where(F.startswith("p_name", F.lit("b"))).orderBy(F.desc("p_size"), "p_partkey").limit(20).select("p_partkey", "p_name")


@query("j25_known_only", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 40)")
def known_only(t):
    return t.lineitem.join(t.part.where("p_size > 40"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("j26_not_requested", "SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 60)")
def not_requested(t):
    return t.events.where("event_type = 'click'").select("user_id").distinct().join(t.events.where("event_type = 'signup' AND value > 60"), "user_id", "left_anti")


@query("j27_relation_rows", f"SELECT 'near:' || s_suppkey || ':' || c_custkey AS id, 'near' AS rel, 's' || s_suppkey AS a, 'c' || c_custkey AS b, round({hav('c_lon', 'c_lat', 's_lon', 's_lat')}, 3) AS km FROM {S} s JOIN {C} c ON {hav('c_lon', 'c_lat', 's_lon', 's_lat')} <= 100")
def relation_rows(t):
    x = J.within_radius(customers(t), suppliers(t), 100, ("c_lon", "c_lat"), ("s_lon", "s_lat"))
    return x.select(F.concat_ws(":", F.lit("near"), "s_suppkey", "c_custkey").alias("id"), F.lit("near").alias("rel"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("a"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("b"), F.round("km", 3).alias("km"))


@query("j28_corroboration", "SELECT user_id, ts::DATE AS day, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS signups FROM events GROUP BY ALL HAVING errors >= 1 AND signups >= 1")
def corroboration(t):
    g = t.events.groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "signup").alias("signups"))
    return g.where("errors >= 1 AND signups >= 1")


@query("j29_explode_lookup", "WITH n AS (SELECT l_suppkey AS net, unnest(list_distinct(list(l_partkey))) AS member FROM lineitem GROUP BY l_suppkey) SELECT p_partkey, max(net) AS net FROM part LEFT JOIN n ON p_partkey = member GROUP BY p_partkey")
def explode_lookup(t):
    nets = t.lineitem.groupBy(F.col("l_suppkey").alias("net")).agg(F.collect_set("l_partkey").alias("m"))
    last = nets.select("net", F.explode("m").alias("p_partkey")).groupBy("p_partkey").agg(F.max("net").alias("net"))
    return t.part.select("p_partkey").join(last, "p_partkey", "left")


@query("c11_both_endpoints", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def both_endpoints(t):
    a = t.lineitem.join(t.part.where("p_size < 20"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    return a.join(t.supplier.where("s_acctbal > 0"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi").select("l_orderkey", "l_linenumber")


@query("beyond_full_outer", "SELECT coalesce(a.k, b.k) AS k, a.n AS orders, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey < 15 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 8 GROUP BY 1) b ON a.k = b.k")
def full_outer(t):
    a = t.customer.where("c_nationkey < 15").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("orders"))
    b = t.supplier.where("s_nationkey > 8").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("suppliers"))
    return a.join(b, "k", "full")
