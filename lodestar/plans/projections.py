"""Projections, filters, text, time, array and JSON queries over the driver's tables."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import geo, text, timeops
from lodestar.registry import query

LON, LAT = "((({k}) * 7919) % 36000) / 100.0 - 180", "((({k}) * 10473) % 17000) / 100.0 - 85"


def lon(key: str):
    """Coordinates that the tables lack, from a key by integer arithmetic."""
    return ((F.col(key) * 7919) % 36000).cast("double") / 100.0 - 180


def lat(key: str):
    return ((F.col(key) * 10473) % 17000).cast("double") / 100.0 - 85


def lon_sql(k: str) -> str:
    return f"((({k} * 7919) % 36000)::DOUBLE / 100.0::DOUBLE - 180)"


def lat_sql(k: str) -> str:
    return f"((({k} * 10473) % 17000)::DOUBLE / 100.0::DOUBLE - 85)"


@query("s13_scan_project", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def scan_project(t):
    return t.events.where("event_type = 'purchase'").select("event_id", "user_id", "value")


@query("s10_parallel_arrays", "SELECT o_custkey, unnest(ks) AS o_orderkey, unnest(ps) AS o_totalprice, unnest(range(len(ks)))::INTEGER AS pos FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks, list(o_totalprice ORDER BY o_orderkey) AS ps FROM orders GROUP BY o_custkey)")
def parallel_arrays(t):
    held = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("x"))
    split = held.select("o_custkey", F.col("x.o_orderkey").alias("ks"), F.col("x.o_totalprice").alias("ps"))
    return split.select("o_custkey", F.posexplode(F.arrays_zip("ks", "ps")).alias("pos", "z")).select("o_custkey", F.col("z.ks").alias("o_orderkey"), F.col("z.ps").alias("o_totalprice"), "pos")


@query("p01_strict_cast", "SELECT event_id, CAST(CAST(value AS VARCHAR) AS DOUBLE) AS value FROM events")
def strict_cast(t):
    return t.events.select("event_id", text.required(F.col("value").cast("string"), "event without a value").alias("value"))


@query("p02_fallback_duration", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_shipdate END AS ended, coalesce(CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END, epoch(l_shipdate - o_orderdate) / 3600)::DOUBLE AS hours, l_returnflag = 'R' AS open FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def fallback_duration(t):
    j = t.lineitem.join(t.orders.select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    end = F.when(F.col("l_returnflag") != "R", F.col("l_shipdate"))
    hours = F.coalesce(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")), timeops.seconds_between(F.col("o_orderdate"), F.col("l_shipdate")) / 3600)
    return j.select("l_orderkey", "l_linenumber", end.alias("ended"), hours.alias("hours"), end.isNull().alias("open"))


@query("p04_speed_class", """SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%steel%' THEN 'tanker' WHEN lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%tin%' THEN 'cargo' ELSE 'default' END AS class,
round(CASE WHEN lower(p_type) LIKE '%steel%' THEN 15.0::DOUBLE WHEN lower(p_type) LIKE '%brass%' OR lower(p_type) LIKE '%tin%' THEN 14.0::DOUBLE ELSE 16.0::DOUBLE END * 1.1::DOUBLE, 4) AS vmax FROM part""")
def speed_class(t):
    kind = text.first_class(F.col("p_type"), [("tanker", ("steel",)), ("cargo", ("brass", "tin"))], "default")
    speed = F.when(kind == "tanker", 15.0).when(kind == "cargo", 14.0).otherwise(16.0)
    return t.part.select("p_partkey", kind.alias("class"), F.round(speed * 1.1, 4).alias("vmax"))


@query("p05_hash_id", "SELECT event_id, substr(sha1(user_id || '|' || printf('%.4f', value)), 1, 16) AS id FROM events")
def hash_id(t):
    return t.events.select("event_id", text.hash_id(F.col("user_id").cast("string"), F.format_string("%.4f", "value")).alias("id"))


@query("p06_altitude", "SELECT event_id, CASE WHEN event_type = 'error' THEN 0.0::DOUBLE ELSE round(value * 0.3048::DOUBLE, 6) END AS alt_m FROM events")
def altitude(t):
    raw = F.when(F.col("event_type") == "error", F.lit("ground")).otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", F.when(raw == "ground", 0.0).otherwise(F.round(raw.try_cast("double") * 0.3048, 6)).alias("alt_m"))


@query("p07_label_fallback", "SELECT p_partkey, coalesce(nullif(trim(CASE WHEN p_size > 25 THEN p_name ELSE ' ' END), ''), nullif(CASE WHEN p_size > 10 THEN p_brand ELSE '' END, ''), upper(p_type)) AS label FROM part")
def label_fallback(t):
    name = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(" ")
    brand = F.when(F.col("p_size") > 10, F.col("p_brand")).otherwise("")
    return t.part.select("p_partkey", F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(brand, F.lit("")), F.upper("p_type")).alias("label"))


@query("p08_code_ranges", "SELECT p_partkey, CASE WHEN p_size BETWEEN 20 AND 29 THEN 'wing' WHEN p_size = 30 THEN 'fishing' WHEN p_size BETWEEN 31 AND 32 THEN 'towing' WHEN p_size = 35 THEN 'military' WHEN p_size BETWEEN 40 AND 49 THEN 'fast' ELSE 'other' END AS label FROM part")
def code_ranges(t):
    s = F.col("p_size")
    return t.part.select("p_partkey", F.when(s.between(20, 29), "wing").when(s == 30, "fishing").when(s.between(31, 32), "towing").when(s == 35, "military").when(s.between(40, 49), "fast").otherwise("other").alias("label"))


@query("p10_classify_evidence", """SELECT user_id, n, CASE WHEN buys >= 5 THEN 'buyer' WHEN errors >= 10 THEN 'faulty' ELSE 'viewer' END AS class,
array_to_string(list_filter([CASE WHEN buys >= 5 THEN 'purchases' END, CASE WHEN errors >= 10 THEN 'errors' END, CASE WHEN n >= 60 THEN 'busy' END], lambda x: x IS NOT NULL), ';') AS evidence
FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS buys, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY user_id)""")
def classify_evidence(t):
    g = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("buys"), F.count_if(F.col("event_type") == "error").alias("errors"))
    evidence = F.array_compact(F.array(F.when(F.col("buys") >= 5, "purchases"), F.when(F.col("errors") >= 10, "errors"), F.when(F.col("n") >= 60, "busy")))
    return g.select("user_id", "n", F.when(F.col("buys") >= 5, "buyer").when(F.col("errors") >= 10, "faulty").otherwise("viewer").alias("class"), F.array_join(evidence, ";").alias("evidence"))


@query("p14_family", "SELECT p_partkey, nullif(regexp_extract(upper(replace(p_brand, '#', '')), '^([A-Z]{2,6})[0-9]', 1), '') AS family FROM part")
def family(t):
    return t.part.select("p_partkey", text.family(F.upper(F.replace("p_brand", F.lit("#"), F.lit("")))).alias("family"))


@query("p15_valid_number", "SELECT c_custkey, regexp_matches((c_custkey * 61803 + 123456789)::VARCHAR, '^[2-7][0-9]{8}$') AS valid FROM customer")
def valid_number(t):
    return t.customer.select("c_custkey", text.valid_mmsi((F.col("c_custkey") * 61803 + 123456789).cast("string")).alias("valid"))


@query("p16_grid_cell", f"SELECT s_suppkey, floor({lat_sql('s_suppkey')} / 0.5)::BIGINT AS row, floor({lon_sql('s_suppkey')} / 0.5)::BIGINT AS col FROM supplier")
def grid_cell(t):
    return t.supplier.select("s_suppkey", F.floor(lat("s_suppkey") / 0.5).cast("long").alias("row"), F.floor(lon("s_suppkey") / 0.5).cast("long").alias("col"))


@query("p17_level_bucket", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.1::DOUBLE THEN 'high' WHEN l_discount > 0.02::DOUBLE THEN 'medium' ELSE 'low' END AS level FROM lineitem")
def level_bucket(t):
    d = F.col("l_discount")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.when(d > 0.1, "high").when(d > 0.02, "medium").otherwise("low").alias("level"))


@query("p18_block_calendar", """SELECT event_id, floor(epoch_us(ts) / 21600000000)::BIGINT - floor(epoch_us(TIMESTAMP '2024-01-01') / 21600000000)::BIGINT AS block, (extract(hour FROM ts)::INTEGER // 6)::INTEGER AS block_of_day,
(isodow(ts) - 1)::INTEGER AS dow, round(sin(2 * pi() * extract(month FROM ts) / 12), 8) AS month_sin, round(cos(2 * pi() * extract(month FROM ts) / 12), 8) AS month_cos FROM events""")
def block_calendar(t):
    m = F.month("ts")
    return t.events.select("event_id", timeops.block_index(F.col("ts"), F.lit("2024-01-01").cast("timestamp")).alias("block"), F.floor(F.hour("ts") / 6).cast("int").alias("block_of_day"), F.weekday("ts").alias("dow"),
                           F.round(F.sin(2 * math.pi * m / 12), 8).alias("month_sin"), F.round(F.cos(2 * math.pi * m / 12), 8).alias("month_cos"))


@query("p19_moon", """SELECT o_orderkey, round((1 - cos(2 * pi() * ((d % 29.530588853::DOUBLE + 29.530588853::DOUBLE) % 29.530588853::DOUBLE) / 29.530588853::DOUBLE)) / 2, 6) AS lit
FROM (SELECT o_orderkey, (epoch_us(o_orderdate) - epoch_us(TIMESTAMP '2000-01-06 18:14:00')) / 86400000000.0::DOUBLE AS d FROM orders)""")
def moon(t):
    """Share of the moon that is lit, from its age in synodic months since a known new moon."""
    month = 29.530588853
    days = timeops.seconds_between(F.lit("2000-01-06 18:14:00").cast("timestamp"), F.col("o_orderdate")) / 86400
    return t.orders.select("o_orderkey", F.round((1 - F.cos(2 * math.pi * F.pmod(days, F.lit(month)) / month)) / 2, 6).alias("lit"))


@query("p20_pressure_level", """SELECT p_partkey, arg_min(l, (abs(l - p), l)) AS level FROM (SELECT p_partkey, 1013.25::DOUBLE * pow(1 - 0.0000225577::DOUBLE * (p_size * 250), 5.25588::DOUBLE) AS p, unnest([925, 850, 700, 500, 300, 250]) AS l FROM part) GROUP BY p_partkey""")
def pressure_level(t):
    """The standard pressure level nearest to the pressure at an altitude."""
    p = 1013.25 * F.pow(1 - 0.0000225577 * (F.col("p_size") * 250), 5.25588)
    levels = F.array(*map(F.lit, (925, 850, 700, 500, 300, 250)))
    return t.part.select("p_partkey", F.array_min(F.transform(levels, lambda v: F.struct(F.abs(v - p).alias("d"), v.alias("v"))))["v"].alias("level"))


@query("p21_tailwind", "SELECT l_orderkey, l_linenumber, round(l_quantity * cos(radians(l_partkey % 360 + 180 - l_suppkey % 360)), 6) + 0 AS tail FROM lineitem")
def tailwind(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (F.round(F.col("l_quantity") * F.cos(F.radians(F.col("l_partkey") % 360 + 180 - F.col("l_suppkey") % 360)), 6) + F.lit(0.0)).alias("tail"))


@query("p22_angle_diff", "SELECT l_orderkey, l_linenumber, (((l_partkey % 360 - l_suppkey % 360 + 180) % 360 + 360) % 360 - 180)::DOUBLE AS diff FROM lineitem")
def angle_diff(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", geo.wrap(F.col("l_partkey") % 360 - F.col("l_suppkey") % 360).cast("double").alias("diff"))


@query("p23_probability_bin", "SELECT l_orderkey, l_linenumber, least(greatest(floor(round(l_quantity / 50, 6) * 10), 0), 9)::INTEGER AS bin FROM lineitem")
def probability_bin(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.least(F.greatest(F.floor(F.round(F.col("l_quantity") / 50, 6) * 10), F.lit(0)), F.lit(9)).cast("int").alias("bin"))


@query("p26_dead_reckoning", f"""SELECT s_suppkey, round({lon_sql('s_suppkey')} + v * 0.5144444444444445 * 30 * sin(h) / 111320 / cos(radians({lat_sql('s_suppkey')})), 8) AS lon, round({lat_sql('s_suppkey')} + v * 0.5144444444444445 * 30 * cos(h) / 111320, 8) AS lat
FROM (SELECT s_suppkey, (s_suppkey % 400)::DOUBLE AS v, radians(s_suppkey * 37 % 360) AS h FROM supplier)""")
def dead_reckoning(t):
    """Position thirty seconds ahead on a straight course."""
    s = t.supplier.select("s_suppkey", (F.col("s_suppkey") % 400).cast("double").alias("v"), F.radians(F.col("s_suppkey") * 37 % 360).alias("h"), lon("s_suppkey").alias("x"), lat("s_suppkey").alias("y"))
    km = F.col("v") * 0.5144444444444445 * 30
    return s.select("s_suppkey", F.round(F.col("x") + km * F.sin("h") / 111320 / F.cos(F.radians("y")), 8).alias("lon"), F.round(F.col("y") + km * F.cos("h") / 111320, 8).alias("lat"))


@query("p27_shift_times", "SELECT event_id, ts + INTERVAL 36 HOUR AS ts FROM events")
def shift_times(t):
    return t.events.select("event_id", (F.col("ts") + F.expr("INTERVAL 36 HOURS")).alias("ts"))


@query("f01_bbox", f"SELECT s_suppkey FROM supplier WHERE {lon_sql('s_suppkey')} BETWEEN -30 AND 60 AND {lat_sql('s_suppkey')} BETWEEN 0 AND 70")
def bbox(t):
    return t.supplier.where(lon("s_suppkey").between(-30, 60) & lat("s_suppkey").between(0, 70)).select("s_suppkey")


@query("f02_half_open_range", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-11'")
def half_open_range(t):
    return t.events.where("ts >= TIMESTAMP_NTZ '2024-01-05' AND ts < TIMESTAMP_NTZ '2024-01-10' + INTERVAL 1 DAY").select("event_id")


@query("f04_semi", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("f04_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("f05_bitmask", "SELECT event_id FROM events WHERE (event_id & 5) = 5")
def bitmask(t):
    return t.events.where(F.col("event_id").bitwiseAND(5) == 5).select("event_id")


@query("f07_ops_nullsafe", """SELECT event_id, v IS NOT DISTINCT FROM 50 AS eq, v IS DISTINCT FROM 50 AS ne, coalesce(v > 50, false) AS gt, coalesce(v <= 50, false) AS le, contains(lower(event_type), 'ur') AS has
FROM (SELECT event_id, event_type, CASE WHEN event_id % 3 > 0 THEN floor(value)::BIGINT END AS v FROM events)""")
def ops_nullsafe(t):
    v, half = F.when(F.col("event_id") % 3 > 0, F.floor("value").cast("long")), F.lit(50)
    return t.events.select("event_id", text.ops("==", v, half).alias("eq"), text.ops("!=", v, half).alias("ne"), text.ops(">", v, half).alias("gt"), text.ops("<=", v, half).alias("le"), text.ops("contains", F.col("event_type"), F.lit("UR")).alias("has"))


@query("f08_json_path", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, json_extract_string(props, '$.a.b') AS missing FROM events")
def json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.get_json_object("props", "$.a.b").alias("missing"))


@query("f10_array_overlap", "SELECT p_partkey FROM part WHERE list_has_any(string_split(lower(p_name), ' '), ['red', 'blue', 'green'])")
def array_overlap(t):
    return t.part.where(F.arrays_overlap(F.split(F.lower("p_name"), " "), F.array(F.lit("red"), F.lit("blue"), F.lit("green")))).select("p_partkey")


@query("f12_word_filter", "SELECT doc_id FROM documents WHERE regexp_matches(lower(coalesce(text, '')), '(^|[^a-z])(the|und|que)([^a-z]|$)')")
def word_filter(t):
    return t.documents.where(F.lower(F.coalesce("text", F.lit(""))).rlike("(^|[^a-z])(the|und|que)([^a-z]|$)")).select("doc_id")


@query("f13_freshness", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 45 MINUTE")
def freshness(t):
    newest = t.events.agg((F.max("ts") - F.expr("INTERVAL 45 MINUTES")).alias("edge"))
    return t.events.join(F.broadcast(newest), F.col("ts") >= F.col("edge")).select("event_id")  # one row, by construction


@query("f16_citations_valid", """SELECT conv_id, turn, len(list_filter(list_distinct(x), lambda v: NOT list_contains(['1', '2', '3', '4', '5'], v))) = 0 AND len(list_distinct(x)) >= 2 AS valid
FROM (SELECT conv_id, turn, regexp_extract_all('[F' || (turn + 1) || '] and [F' || (conv_id % 7) || ', F' || (conv_id % 3) || ']', 'F([0-9]+)', 1) AS x FROM conversations)""")
def citations_valid(t):
    said = F.concat(F.lit("[F"), (F.col("turn") + 1).cast("string"), F.lit("] and [F"), (F.col("conv_id") % 7).cast("string"), F.lit(", F"), (F.col("conv_id") % 3).cast("string"), F.lit("]"))
    return t.conversations.select("conv_id", "turn", text.cites_well(said, F.array(*(F.lit(str(i)) for i in range(1, 6)))).alias("valid"))


@query("t01_norm", r"SELECT doc_id, md5(lower(trim(regexp_replace(translate(translate(text, '’ʼ`´‘', ''''''''''''), 'ёЁ', 'еЕ'), '[ \t\n\v\f\r]+', ' ', 'g')))) AS norm_md5 FROM documents WHERE regexp_matches(text, '^[\x01-\x7F]*$')")
def norm(t):
    return t.documents.where(F.col("text").rlike(r"^[\x01-\x7F]*$")).select("doc_id", F.md5(text.norm(F.col("text"))).alias("norm_md5"))


@query("t02_variants", "SELECT p_partkey, array_to_string(list_distinct_ordered, ';') AS forms FROM (SELECT p_partkey, list_filter([p, CASE WHEN ends_with(p, 'ing') AND length(p) > 5 THEN left(p, length(p) - 3) END, CASE WHEN ends_with(p, 'e') AND length(p) > 3 THEN left(p, length(p) - 1) || 'a' END, CASE WHEN ends_with(p, 'ne') AND length(p) > 4 THEN left(p, length(p) - 2) END], lambda x: x IS NOT NULL) AS list_distinct_ordered FROM (SELECT p_partkey, split_part(lower(p_name), ' ', 1) AS p FROM part))")
def variants(t):
    return t.part.select("p_partkey", F.array_join(text.variants(F.split_part(F.lower("p_name"), F.lit(" "), F.lit(1)), (("ing", ""), ("e", "a"), ("ne", ""))), ";").alias("forms"))


@query("t03_ordered_class", "SELECT doc_id, CASE WHEN contains(lower(text), 'error') OR contains(lower(text), 'fail') THEN 'fault' WHEN contains(lower(text), 'copyright') THEN 'licence' WHEN contains(lower(text), 'the ') THEN 'english' ELSE 'none' END AS class FROM documents")
def ordered_class(t):
    return t.documents.select("doc_id", text.first_class(F.col("text"), [("fault", ("error", "fail")), ("licence", ("copyright",)), ("english", ("the ",))], "none").alias("class"))


@query("t04_regex_extract", r"SELECT page_id, regexp_extract(url, '^https?://([^/:]+)', 1) AS host, len(regexp_extract_all(html, '<a [^>]*href=')) AS links, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def regex_extract(t):
    n = lambda p: F.size(F.regexp_extract_all("html", F.lit(p), F.lit(0))).cast("long")
    return t.pages.select("page_id", F.regexp_extract("url", r"^https?://([^/:]+)", 1).alias("host"), n("<a [^>]*href=").alias("links"), n("<p[ >]").alias("paragraphs"))


@query("t07_strip_html", r"""WITH s AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis') AS h FROM pages)
SELECT page_id, trim(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(h, '<br\s*/?>', chr(10), 'gi'), '<[^>]*>', '', 'gs'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS text FROM s""")
def strip_html(t):
    return t.pages.select("page_id", text.strip_html(F.col("html")).alias("text"))


@query("t10_key_suffix", "SELECT page_id, trim(string_split(replace(url, '/', ' /// '), '///')[-1]) AS key FROM pages")
def key_suffix(t):
    return t.pages.select("page_id", text.suffix_key(F.replace("url", F.lit("/"), F.lit(" /// "))).alias("key"))


@query("t12_numbered_facts", "SELECT conv_id, string_agg('F' || n || ': ' || role, ' | ' ORDER BY n) AS facts, count(*) AS n FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS n FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)) GROUP BY conv_id")
def numbered_facts(t):
    w = Window.partitionBy("conv_id").orderBy("turn", "role")
    n = t.conversations.select("conv_id", "turn", "role").distinct().withColumn("n", F.row_number().over(w))
    said = F.array_sort(F.collect_list(F.struct("n", F.concat(F.lit("F"), F.col("n").cast("string"), F.lit(": "), F.col("role")).alias("s"))))
    return n.groupBy("conv_id").agg(F.array_join(F.transform(said, lambda x: x["s"]), " | ").alias("facts"), F.count("*").alias("n"))


@query("t13_citations", r"SELECT conv_id, turn, array_to_string(regexp_extract_all('<think>[F9]</think>[F' || turn || ', F2] ' , 'F([0-9]+)', 1), ',') AS cited, trim(regexp_replace('<think>[F9]</think>[F' || turn || ', F2] ', '<think>.*?</think>', '', 'gs')) AS answer FROM conversations")
def cited(t):
    said = F.concat(F.lit("<think>[F9]</think>[F"), F.col("turn").cast("string"), F.lit(", F2] "))
    return t.conversations.select("conv_id", "turn", F.array_join(text.citations(said), ",").alias("cited"), text.without_thoughts(said).alias("answer"))


@query("t14_number_format", "SELECT o_orderkey, printf('%.1f', o_totalprice) || ' on ' || strftime(o_orderdate, '%Y-%m-%d') AS reason FROM orders WHERE o_totalprice * 10 - floor(o_totalprice * 10) NOT BETWEEN 0.49 AND 0.51")
def number_format(t):
    tenths = F.col("o_totalprice") * 10
    return t.orders.where(~(tenths - F.floor(tenths)).between(0.49, 0.51)).select("o_orderkey", F.concat(F.format_string("%.1f", "o_totalprice"), F.lit(" on "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("reason"))


@query("d04_zone_to_utc", "SELECT event_id, timezone('Europe/Kyiv', ts) AT TIME ZONE 'UTC' AS utc FROM events")
def zone_to_utc(t):
    return t.events.select("event_id", F.to_utc_timestamp(F.col("ts").cast("timestamp"), "Europe/Kyiv").cast("timestamp_ntz").alias("utc"))


@query("d05_compact_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS compact, CAST(strptime(strftime(o_orderdate, '%Y%m%d'), '%Y%m%d') AS TIMESTAMP) AS back FROM orders")
def compact_date(t):
    c = F.date_format("o_orderdate", "yyyyMMdd")
    return t.orders.select("o_orderkey", c.alias("compact"), F.to_timestamp_ntz(c, F.lit("yyyyMMdd")).alias("back"))


@query("d08_clock_from_number", "SELECT l_orderkey, l_linenumber, substr(printf('%04d', h), 1, 2) || ':' || substr(printf('%04d', h), 3, 2) AS clock FROM (SELECT l_orderkey, l_linenumber, ((l_partkey % 24) * 100 + l_suppkey % 60)::INTEGER AS h FROM lineitem)")
def clock_from_number(t):
    h = F.lpad(((F.col("l_partkey") % 24) * 100 + F.col("l_suppkey") % 60).cast("string"), 4, "0")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.concat(F.substring(h, 1, 2), F.lit(":"), F.substring(h, 3, 2)).alias("clock"))


@query("d09_solar", """SELECT event_id, round(jd, 4) AS jd, round(((280.46061837::DOUBLE + 360.98564736629::DOUBLE * (jd - 2451545)) % 360 + 360) % 360, 5) AS gmst FROM (SELECT event_id, epoch_us(ts) / 86400000000.0::DOUBLE + 2440587.5::DOUBLE AS jd FROM events)""")
def solar(t):
    """Julian date and Greenwich sidereal time in degrees."""
    e = t.events.select("event_id", (timeops.micros(F.col("ts")) / 8.64e10 + 2440587.5).alias("jd"))
    return e.select("event_id", F.round("jd", 4).alias("jd"), F.round(F.pmod(280.46061837 + 360.98564736629 * (F.col("jd") - 2451545), F.lit(360.0)), 5).alias("gmst"))


@query("r01_split_filter", "SELECT event_id, array_to_string(list_filter(list_transform(string_split(event_type || '; ;' || user_id || ';', ';'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM events")
def split_filter(t):
    return t.events.select("event_id", F.array_join(text.split_filled(F.concat("event_type", F.lit("; ;"), F.col("user_id").cast("string"), F.lit(";"))), "|").alias("parts"))


@query("r02_map_explode", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k')::BIGINT AS v FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def map_explode(t):
    return t.events.select("event_id", F.explode(F.from_json("props", "map<string,bigint>")).alias("key", "v"))


@query("r03_max_by_field", "SELECT l_orderkey, arg_max(f, (q, -n, f)) AS flag FROM (SELECT l_orderkey, l_returnflag AS f, l_quantity AS q, l_linenumber AS n FROM lineitem) GROUP BY l_orderkey")
def max_by_field(t):
    held = F.collect_list(F.struct(F.col("l_quantity").alias("q"), (-F.col("l_linenumber")).alias("n"), F.col("l_returnflag").alias("f")))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_max(held)["f"].alias("flag"))


@query("r05_collect_sorted", "SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS turns FROM conversations GROUP BY conv_id")
def collect_sorted(t):
    return t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), ",").alias("turns"))


@query("r09_merge", "SELECT event_id, 2::BIGINT AS a, user_id AS b, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def merge(t):
    """Two maps, of which the later wins on a shared key."""
    old = F.create_map(F.lit("a"), F.lit(1).cast("long"), F.lit("b"), F.col("user_id"))
    new = F.map_concat(F.from_json("props", "map<string,bigint>"), F.create_map(F.lit("a"), F.lit(2).cast("long")))
    both = F.map_concat(F.map_from_entries(F.filter(F.map_entries(old), lambda e: ~F.array_contains(F.map_keys(new), e["key"]))), new)
    return t.events.select("event_id", both["a"].alias("a"), both["b"].alias("b"), both["k"].alias("k"))
