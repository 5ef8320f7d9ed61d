"""Geometry queries over coordinates derived from keys."""

from __future__ import annotations


from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.functions import rings
from lodestar.operators import joins, orbits, overlay, regions
from lodestar.operators import tracks
from lodestar.plans.joins import C, S, customers, hav, suppliers
from lodestar.registry import query


@query("g01_geodesic")
def geodesic(t):
    return suppliers(t).select("s_suppkey", F.round(geo.geodesic(F.lit(36.5), F.lit(45.3), F.col("s_lon"), F.col("s_lat")), 6).alias("km"))


@query("g02_haversine", f"SELECT s_suppkey, round({hav('36.5::DOUBLE', '45.3::DOUBLE', 's_lon', 's_lat')}, 6) AS km, round({hav('36.5::DOUBLE', '45.3::DOUBLE', 's_lon', 's_lat', '6371.0')}, 6) AS km_mean FROM {S}")
def haversine(t):
    return suppliers(t).select("s_suppkey", F.round(geo.haversine(36.5, 45.3, "s_lon", "s_lat"), 6).alias("km"), F.round(geo.haversine(36.5, 45.3, "s_lon", "s_lat", geo.MEAN_RADIUS), 6).alias("km_mean"))


@query("g03_bearing", f"SELECT s_suppkey, round((degrees(atan2(sin(radians(s_lon - 36.5)) * cos(radians(s_lat)), cos(radians(45.3)) * sin(radians(s_lat)) - sin(radians(45.3)) * cos(radians(s_lat)) * cos(radians(s_lon - 36.5)))) + 360) % 360, 6) AS deg FROM {S}")
def bearing(t):
    return suppliers(t).select("s_suppkey", F.round(geo.bearing(36.5, 45.3, "s_lon", "s_lat"), 6).alias("deg"))


@query("g04_destination", f"SELECT s_suppkey, round((degrees(radians(s_lon) + atan2(sin(radians(h)) * sin(a) * cos(radians(s_lat)), cos(a) - sin(radians(s_lat)) * sin(radians(q)))) + 540) % 360 - 180, 6) AS lon, round(q, 6) AS lat FROM (SELECT *, degrees(asin(sin(radians(s_lat)) * cos(a) + cos(radians(s_lat)) * sin(a) * cos(radians(h)))) AS q FROM (SELECT *, (s_suppkey * 37 % 360)::DOUBLE AS h, 250 / 6371.0088::DOUBLE AS a FROM {S}))")
def destination(t):
    d = suppliers(t).select("s_suppkey", geo.destination("s_lon", "s_lat", (F.col("s_suppkey") * 37 % 360).cast("double"), 250).alias("d"))
    return d.select("s_suppkey", F.round("d.lon", 6).alias("lon"), F.round("d.lat", 6).alias("lat"))


@query("g06_ellipse", f"SELECT s_suppkey, round(a, 6) AS a, round(CASE WHEN a < c THEN 0 ELSE greatest(0.5, sqrt(greatest(0, a * a - c * c))) END, 6) AS b, round(c, 6) AS c, a < c AS impossible FROM (SELECT s_suppkey, 16.5 * 1.852 * (1 + s_suppkey % 400) / 2 AS a, {hav('36.5::DOUBLE', '45.3::DOUBLE', 's_lon', 's_lat')} / 2 AS c FROM {S})")
def ellipse(t):
    x = suppliers(t).select("s_suppkey", geo.ellipse(geo.haversine(36.5, 45.3, "s_lon", "s_lat"), (1 + F.col("s_suppkey") % 400).cast("double"), 16.5).alias("e"))
    return x.select("s_suppkey", F.round("e.semi_major_km", 6).alias("a"), F.round("e.semi_minor_km", 6).alias("b"), F.round("e.focal_half_km", 6).alias("c"), "e.impossible")


@query("g07_point_in_ring", f"SELECT s_suppkey FROM {S} WHERE s_lat > -20 AND s_lat < 60 AND s_lon > -100 AND s_lon < 20 + s_lat")
def point_in_ring(t):
    corners = [(-100.0, -20.0), (0.0, -20.0), (80.0, 60.0), (-100.0, 60.0), (-100.0, -20.0)]
    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in corners))
    return suppliers(t).where(geo.in_ring("s_lon", "s_lat", ring, edge=False)).select("s_suppkey")


@query("g08_to_polyline", f"SELECT s_suppkey, round(111.32 * least(d1, d2), 6) AS km FROM (SELECT s_suppkey, sqrt(pow((0 - s_lon) * k, 2) + pow(greatest(-40.0 - s_lat, least(0, 10.0 - s_lat)) + greatest(0, -40.0 - s_lat) - greatest(-40.0 - s_lat, 0), 2) * 0 + pow(CASE WHEN s_lat < -40 THEN -40 - s_lat WHEN s_lat > 10 THEN s_lat - 10 ELSE 0 END, 2)) AS d1, sqrt(pow(k * CASE WHEN s_lon < 0 THEN -s_lon WHEN s_lon > 60 THEN s_lon - 60 ELSE 0 END, 2) + pow(10 - s_lat, 2)) AS d2 FROM (SELECT *, cos(radians(s_lat)) AS k FROM {S}))")
def to_polyline(t):
    line = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, -40.0), (0.0, 10.0), (60.0, 10.0))))
    return suppliers(t).select("s_suppkey", F.round(geo.to_polyline_km("s_lon", "s_lat", line), 6).alias("km"))


@query("g12_hulls", f"""WITH p AS (SELECT DISTINCT s.s_nationkey, x.s_lon AS x, x.s_lat AS y FROM {S} x JOIN supplier s USING (s_suppkey)), n AS (SELECT s_nationkey, count(*) AS n FROM p GROUP BY 1),
e AS (SELECT a.s_nationkey, count(*) AS k FROM p a JOIN p b ON a.s_nationkey = b.s_nationkey AND (a.x <> b.x OR a.y <> b.y) WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.s_nationkey = a.s_nationkey AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND ((c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0 OR (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) > pow(b.x - a.x, 2) + pow(b.y - a.y, 2))))) GROUP BY 1)
SELECT s_nationkey, (CASE WHEN n < 3 THEN n ELSE k END)::INTEGER AS points FROM n LEFT JOIN e USING (s_nationkey)""")
def hulls(t):
    x = suppliers(t).join(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey")
    return tracks.hulls(x, "s_nationkey", "s_lon", "s_lat").select("s_nationkey", "points")


@query("g13_great_circle", f"""WITH d AS (SELECT s_suppkey, radians(45.3::DOUBLE) AS p, atan2(sin(radians(s_lon - 36.5::DOUBLE)) * cos(radians(s_lat)), cos(radians(45.3::DOUBLE)) * sin(radians(s_lat)) - sin(radians(45.3::DOUBLE)) * cos(radians(s_lat)) * cos(radians(s_lon - 36.5::DOUBLE))) AS b,
2 * asin(sqrt(least(1, pow(sin(radians(s_lat - 45.3::DOUBLE) / 2), 2) + cos(radians(45.3::DOUBLE)) * cos(radians(s_lat)) * pow(sin(radians(s_lon - 36.5::DOUBLE) / 2), 2)))) AS arc FROM {S}),
e AS (SELECT s_suppkey, i, p, b, arc * i / 8 AS a FROM d, (SELECT unnest(range(9)) AS i)), q AS (SELECT *, asin(least(1, greatest(-1, sin(p) * cos(a) + cos(p) * sin(a) * cos(b)))) AS q FROM e)
SELECT s_suppkey, i::INTEGER AS i, round((degrees(atan2(sin(b) * sin(a) * cos(p), cos(a) - sin(p) * sin(q))) + 36.5::DOUBLE + 540) % 360 - 180, 6) AS lon, round(degrees(q), 6) AS lat FROM q""")
def great_circle(t):
    x = suppliers(t).select("s_suppkey", F.posexplode(geo.great_circle(36.5, 45.3, "s_lon", "s_lat", 9)).alias("i", "p"))
    return x.select("s_suppkey", "i", F.round("p.lon", 6).alias("lon"), F.round("p.lat", 6).alias("lat"))


@query("g15_longest_chain")
def longest_chain(t):
    """Longest feasible chains of five days' events of a user, between the first and the last."""
    day = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 4.32e11)
    e = t.events.where("user_id IS NOT NULL").select((F.col("user_id") * 100_000 + day).cast("long").alias("gap_id"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9).alias("t"), (F.col("value") / 50).alias("lon"), ((F.col("event_id") * 37 % 200) / 100.0).alias("lat"))
    ends = e.groupBy("gap_id").agg(F.min("t").alias("a"), F.max("t").alias("b"))
    edge = ends.select("gap_id", F.explode(F.array(F.struct(F.lit(-1).cast("long").alias("id"), (F.col("a") - 1).alias("t")), F.struct(F.lit(-2).cast("long").alias("id"), (F.col("b") + 1).alias("t")))).alias("x")).select("gap_id", "x.id", "x.t", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    return tracks.longest_chains(e.unionByName(edge), 12.0).select("gap_id", "detections", F.round("length_km", 6).alias("length_km"))


@query("c10_nearest_to_view", f"SELECT c_custkey FROM {C} WHERE c_lon BETWEEN -60 AND 60 AND c_lat BETWEEN -40 AND 40 ORDER BY pow(c_lon - 10, 2) + pow(c_lat - 5, 2), c_custkey LIMIT 12")
def nearest_to_view(t):
    c = customers(t).where("c_lon BETWEEN -60 AND 60 AND c_lat BETWEEN -40 AND 40")
    return c.orderBy(F.pow(F.col("c_lon") - 10, 2) + F.pow(F.col("c_lat") - 5, 2), "c_custkey").limit(12).select("c_custkey")


@query("c13_planar", f"SELECT s_suppkey, round(111.32 * sqrt(pow((36.5 - s_lon) * cos(radians(s_lat)), 2) + pow(45.3 - s_lat, 2)), 6) AS km FROM {S}")
def planar(t):
    return suppliers(t).select("s_suppkey", F.round(geo.planar_km("s_lon", "s_lat", 36.5, 45.3), 6).alias("km"))


@query("q02_circles", f"SELECT count(*) AS points, round(max({hav('36.5::DOUBLE', '45.3::DOUBLE', 'lon', 'lat')}), 3) AS far FROM (SELECT degrees(radians(36.5) + atan2(sin(h) * sin(a) * cos(radians(45.3)), cos(a) - sin(radians(45.3)) * sin(q))) AS lon, degrees(q) AS lat FROM (SELECT *, asin(sin(radians(45.3)) * cos(a) + cos(radians(45.3)) * sin(a) * cos(h)) AS q FROM (SELECT radians(i % 64 * {360 / 64}) AS h, 30 / 6371.0088::DOUBLE AS a FROM range(65) r(i))))")
def circles(t):
    ring = t.spark.range(1).select(F.explode(geo.circle(36.5, 45.3, 30.0)).alias("p"))
    return ring.agg(F.count("*").alias("points"), F.round(F.max(geo.haversine(36.5, 45.3, F.col("p.lon"), F.col("p.lat"))), 3).alias("far"))




#: Customers as diamonds: their middle and half their width.
_DIAMOND = """d AS (SELECT c_custkey AS id, (c_custkey * 37 % 1009)::DOUBLE / 8 AS x, (c_custkey * 91 % 757)::DOUBLE / 8 AS y, 0.4 + (c_custkey * 13 % 101)::DOUBLE / 64 AS r FROM customer),
g AS (SELECT *, [{'x': x + r, 'y': y}, {'x': x, 'y': y + r}, {'x': x - r, 'y': y}, {'x': x, 'y': y - r}] AS ring FROM d)"""


def diamonds(t):
    return diamonds_of(t.customer)


def diamonds_of(customer):
    key = F.col("c_custkey")
    d = customer.select(key.alias("id"), ((key * 37 % 1009) / 8.0).alias("x"), ((key * 91 % 757) / 8.0).alias("y"), (0.4 + (key * 13 % 101) / 64.0).alias("r"))
    x, y, r = F.col("x"), F.col("y"), F.col("r")
    return d.select("id", F.array(rings.point(x + r, y), rings.point(x, y + r), rings.point(x - r, y), rings.point(x, y - r)).alias("ring"))


def _far(p: str, a: str, b: str) -> str:
    """Square of the distance from a point to an edge, in SQL."""
    t = f"greatest(0, least(1, (({p}.x - {a}.x) * ({b}.x - {a}.x) + ({p}.y - {a}.y) * ({b}.y - {a}.y)) / (pow({b}.x - {a}.x, 2) + pow({b}.y - {a}.y, 2))))"
    return f"(pow({p}.x - {a}.x - {t} * ({b}.x - {a}.x), 2) + pow({p}.y - {a}.y - {t} * ({b}.y - {a}.y), 2))"


def _left(o: str, p: str, q: str) -> str:
    return f"(({p}.x - {o}.x) * ({q}.y - {o}.y) - ({p}.y - {o}.y) * ({q}.x - {o}.x))"


@query("j21_adjacent_regions", f"""WITH {_DIAMOND}, e AS (SELECT id, ring[i] AS a, ring[i % 4 + 1] AS b FROM g, range(1, 5) AS s(i)),
p AS (SELECT m.id AS a, n.id AS b, abs(m.x + m.r - n.x) + abs(m.y - n.y) < n.r OR abs(n.x + n.r - m.x) + abs(n.y - m.y) < m.r AS held FROM g m JOIN g n ON m.id < n.id AND abs(m.x - n.x) <= m.r + n.r + 0.05 AND abs(m.y - n.y) <= m.r + n.r + 0.05)
SELECT DISTINCT p.a, p.b FROM p JOIN e m ON m.id = p.a JOIN e n ON n.id = p.b WHERE p.held OR ({_left('m.a', 'm.b', 'n.a')} * {_left('m.a', 'm.b', 'n.b')} < 0 AND {_left('n.a', 'n.b', 'm.a')} * {_left('n.a', 'n.b', 'm.b')} < 0)
OR least({_far('m.a', 'n.a', 'n.b')}, {_far('m.b', 'n.a', 'n.b')}, {_far('n.a', 'm.a', 'm.b')}, {_far('n.b', 'm.a', 'm.b')}) <= 0.05 * 0.05""")
def adjacent_regions(t):
    """Which customers' diamonds lie within 0.05 of one another."""
    return regions.adjacent(diamonds(t), 0.05, 0.4)


@query("s29_clipped_regions", f"""WITH RECURSIVE {_DIAMOND}, c AS (SELECT id, 0 AS k, ring FROM g
UNION ALL SELECT id, k + 1, flatten(list_transform(range(1, len(ring) + 1), lambda i: list_concat(
  CASE WHEN s[i] >= 0 THEN [ring[i]] ELSE [] END,
  CASE WHEN s[i] * s[i % len(ring) + 1] < 0 THEN [{{'x': ring[i].x + s[i] / (s[i] - s[i % len(ring) + 1]) * (ring[i % len(ring) + 1].x - ring[i].x), 'y': ring[i].y + s[i] / (s[i] - s[i % len(ring) + 1]) * (ring[i % len(ring) + 1].y - ring[i].y)}}] ELSE [] END)))
FROM (SELECT *, list_transform(ring, lambda p: CASE k WHEN 0 THEN p.x - 20 WHEN 1 THEN 90 - p.x WHEN 2 THEN p.y - 15 ELSE 70 - p.y END) AS s FROM c WHERE k < 4 AND len(ring) > 0))
SELECT id, len(ring)::INTEGER AS corners, round(abs(list_sum(list_transform(range(1, len(ring) + 1), lambda i: (ring[i].x - ring[1].x) * (ring[i % len(ring) + 1].y - ring[1].y) - (ring[i % len(ring) + 1].x - ring[1].x) * (ring[i].y - ring[1].y)))) / 2, 6) AS area FROM c WHERE k = 4 AND len(ring) > 2""")
def clipped_regions(t):
    """What a box has of each customer's diamond."""
    x = joins.spread(t.customer, 40)
    x = diamonds_of(x).select("id", F.inline(F.array(F.struct(rings.clip_box(F.col("ring"), 20, 15, 90, 70).alias("ring"))))).where(F.size("ring") > 2)
    return x.select("id", F.size("ring").alias("corners"), F.round(F.abs(rings.signed_area(F.col("ring"))), 6).alias("area"))


@query("g11_reach_of_sea", None)
def reach_of_sea(t):
    """What a disk around every supplier has of the diamonds, as rings with fewer points."""
    places = t.supplier.select(F.col("s_suppkey").alias("place"), (F.col("s_suppkey") * 59 % 1009 / 8.0).alias("lon"), (F.col("s_suppkey") * 23 % 757 / 16.0).alias("lat"), F.lit(80.0).alias("km"))
    return regions.reach(places, diamonds(t).withColumnRenamed("id", "part"), 0.01).select("place", "part", F.size("ring").alias("corners"), F.round("km2", 3).alias("km2"))


_ROWS = f"""{_DIAMOND}, r AS (SELECT id, row, x - (r - abs((row + 0.5) * 0.25 - y)) AS lo, x + (r - abs((row + 0.5) * 0.25 - y)) AS hi FROM d, LATERAL (SELECT unnest(range(floor((y - r) / 0.25)::BIGINT - 1, ceil((y + r) / 0.25)::BIGINT + 1)) AS row) WHERE r - abs((row + 0.5) * 0.25 - y) > 0),
ev AS (SELECT row, x, sum(n) AS n FROM (SELECT row, lo AS x, 1 AS n FROM r UNION ALL SELECT row, hi, -1 FROM r) GROUP BY ALL), sw AS (SELECT row, x AS lo, lead(x) OVER w AS hi, sum(n) OVER w AS n FROM ev WINDOW w AS (PARTITION BY row ORDER BY x)),
u AS (SELECT row, lo, hi FROM sw WHERE hi IS NOT NULL AND n > 0)"""


@query("g10_union_by_rows", f"""WITH {_ROWS} SELECT row, round(sum(hi - lo), 6) AS held, round(126 - sum(greatest(0, least(hi, 126) - greatest(lo, 0))), 6) AS free FROM u WHERE row BETWEEN 0 AND 359 GROUP BY row""")
def union_by_rows(t):
    """Of each row of a country 126 wide and 90 high, how much customers' diamonds hold, overlaps counted once, and how much is left."""
    area = overlay.union(overlay.spans(diamonds(t), 0.25))
    country = area.select("row").where("row BETWEEN 0 AND 359").distinct().select("row", F.lit(0.0).alias("lo"), F.lit(126.0).alias("hi"))
    free = overlay.minus(country, area).groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("free"))
    held = area.where("row BETWEEN 0 AND 359").groupBy("row").agg(F.sum(F.col("hi") - F.col("lo")).alias("held"))
    return held.join(free, "row", "left").select("row", F.round("held", 6).alias("held"), F.round(F.coalesce("free", F.lit(0.0)), 6).alias("free"))


@query("g10_front_line", None)
def front_line(t):
    """How long each overdrawn customer's diamond faces free land, slivers apart."""
    poor = diamonds(t).join(t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")), "id")
    country = t.spark.range(1).select(F.lit(0).alias("id"), F.array(*(rings.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (126, 0), (126, 95), (0, 95)))).alias("ring"))
    _, _, line = overlay.front(poor, country, 0.5, 0.25, 0.25)
    return line.groupBy("id").agg(F.round(overlay.length(line), 3).alias("length"))


#: Parts as satellites: elements from their key and size.
def satellites(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("norad"), F.lit("2024-03-01 06:00:00").cast("timestamp").alias("epoch"), (14.0 + k % 200 / 100).alias("mean_motion"), (F.col("p_size") / 20_000).alias("eccentricity"), (k * 7 % 120).cast("double").alias("inclination"),
        (k * 13 % 360).cast("double").alias("node"), (k * 17 % 360).cast("double").alias("perigee"), (k * 29 % 360).cast("double").alias("anomaly"), F.lit(2e-5).alias("bstar"),
        F.when(k % 2 == 0, "optical").otherwise("radar").alias("sensor"), (F.lit(300.0) + F.col("p_size") * 10).alias("access_km"))


_NOW = 1709280000.0


@query("v13_ground_tracks", None)
def ground_tracks(t):
    """Where every satellite is, and the places of its coming 45 minutes; tested against published positions and a scalar scan."""
    x = orbits.ground_tracks(satellites(t), F.lit(_NOW))
    return x.select("norad", F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"), F.round("alt_km", 1).alias("alt_km"), F.size("track").alias("points"), "track")


@query("q16_passes", None)
def passes(t):
    """Passes of every satellite over places of the nations in two hours; tested against a dense scan."""
    places = t.nation.select(F.col("n_name").alias("place"), (F.col("n_nationkey") * 53 % 360 - 180).cast("double").alias("lon"), (F.col("n_nationkey") * 31 % 140 - 70).cast("double").alias("lat"))
    return orbits.passes(satellites(t), places, F.lit(_NOW), hours=2, step=60)
