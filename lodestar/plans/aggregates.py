"""Aggregation, top-k and set queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import timeops
from lodestar.operators import metrics
from lodestar.operators.joins import top_n
from lodestar.registry import query


@query("a01_sum_clip", "SELECT c_custkey, least(coalesce(sum(x), 0), 100)::BIGINT AS points FROM customer LEFT JOIN (SELECT o_custkey, 10 AS x FROM orders) ON c_custkey = o_custkey GROUP BY c_custkey")
def sum_clip(t):
    g = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum(F.lit(10)).alias("x"))
    return t.customer.select("c_custkey").join(g, "c_custkey", "left").select("c_custkey", F.least(F.coalesce("x", F.lit(0)), F.lit(100)).cast("long").alias("points"))


@query("a02_capped_awards", "SELECT user_id, event_type, sum(10)::BIGINT AS points FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3 GROUP BY ALL")
def capped_awards(t):
    """At most thirty points of a signal: a count suffices, so no row is ranked."""
    return t.events.groupBy("user_id", "event_type").agg((F.least(F.count("*"), F.lit(3)) * 10).cast("long").alias("points"))


@query("a03_group_count_back", "SELECT l_orderkey, l_linenumber, count(*) FILTER (l_returnflag = 'R') OVER (PARTITION BY l_orderkey) AS returned FROM lineitem")
def group_count_back(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.count_if(F.col("l_returnflag") == "R").over(Window.partitionBy("l_orderkey")).alias("returned"))


@query("a04_union_counts", "SELECT nation, kind, count(*) AS n FROM (SELECT c_nationkey AS nation, c_mktsegment AS kind FROM customer UNION ALL SELECT s_nationkey, 'SUPPLIER' FROM supplier) GROUP BY ALL")
def union_counts(t):
    both = t.customer.select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("kind")).unionByName(t.supplier.select(F.col("s_nationkey").alias("nation"), F.lit("SUPPLIER").alias("kind")))
    return both.groupBy("nation", "kind").agg(F.count("*").alias("n"))


@query("a05_distinct", "SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT ts::DATE) AS days FROM events GROUP BY event_type")
def distinct(t):
    return t.events.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct(F.col("ts").cast("date")).alias("days"))


@query("a06_spacing_quartiles", "SELECT user_id, round(quantile_cont(d, 0.25), 4) AS q1, round(quantile_cont(d, 0.5), 4) AS q2, round(quantile_cont(d, 0.75), 4) AS q3 FROM (SELECT user_id, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 3600000000.0::DOUBLE AS d FROM events WHERE event_type = 'purchase') WHERE d IS NOT NULL GROUP BY user_id HAVING count(*) >= 3")
def spacing_quartiles(t):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = t.events.where("event_type = 'purchase'").select("user_id", (timeops.seconds_between(F.lag("ts").over(w), F.col("ts")) / 3600).alias("d")).where("d IS NOT NULL")
    q = d.groupBy("user_id").agg(F.percentile("d", [0.25, 0.5, 0.75]).alias("q"), F.count("*").alias("n")).where("n >= 3")
    return q.select("user_id", *(F.round(F.col("q")[i], 4).alias(f"q{i + 1}") for i in range(3)))


@query("a07_p95_min_n", "SELECT p_brand AS kind, round(quantile_cont(p_retailprice, 0.95), 4) AS p95 FROM part GROUP BY p_brand HAVING count(*) >= 5 UNION ALL SELECT '*', round(quantile_cont(p_retailprice, 0.95), 4) FROM part")
def p95_min_n(t):
    by = t.part.groupBy(F.col("p_brand").alias("kind")).agg(F.percentile("p_retailprice", 0.95).alias("p"), F.count("*").alias("n")).where("n >= 5").drop("n")
    return by.unionByName(t.part.agg(F.percentile("p_retailprice", 0.95).alias("p")).withColumn("kind", F.lit("*"))).select("kind", F.round("p", 4).alias("p95"))


@query("a08_median", "SELECT event_type, round(median(value), 6) AS typical FROM events GROUP BY event_type")
def median(t):
    return t.events.groupBy("event_type").agg(F.round(F.median("value"), 6).alias("typical"))


@query("a09_baseline_rates", "SELECT extract(hour FROM ts)::INTEGER AS hour, event_type = 'error' AS active, round(avg((value > 50)::INTEGER), 8) AS rate FROM events GROUP BY ALL")
def baseline_rates(t):
    return t.events.groupBy(F.hour("ts").alias("hour"), (F.col("event_type") == "error").alias("active")).agg(F.round(F.avg((F.col("value") > 50).cast("int")), 8).alias("rate"))


@query("a10_last_nonnull", "SELECT user_id, arg_max(CASE WHEN event_type <> 'view' THEN value END, (ts, event_id)) AS value, arg_max(CASE WHEN event_id % 4 = 0 THEN event_type END, (ts, event_id)) AS kind FROM events GROUP BY user_id")
def last_nonnull(t):
    """Last value of each column that is not null, which need not come from one row."""
    e = t.events.select("user_id", F.struct("ts", "event_id").alias("o"), F.when(F.col("event_type") != "view", F.col("value")).alias("v"), F.when(F.col("event_id") % 4 == 0, F.col("event_type")).alias("k"))
    return e.groupBy("user_id").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("o"))).alias("value"), F.max_by("k", F.when(F.col("k").isNotNull(), F.col("o"))).alias("kind"))


@query("a11_majority", "SELECT p_brand, role, n FROM (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS total FROM (SELECT p_brand, (p_size > 15)::INTEGER AS role, count(*) AS n FROM part GROUP BY 1, 2)) WHERE n >= 3 AND 2 * n > total")
def majority(t):
    n = t.part.groupBy("p_brand", (F.col("p_size") > 15).cast("int").alias("role")).agg(F.count("*").alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy("p_brand"))).where("n >= 3 AND 2 * n > total").drop("total")


@query("a12_pivot", "SELECT ts::DATE AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1")
def pivot(t):
    p = t.events.where("event_type IN ('click', 'error', 'purchase')").groupBy(F.col("ts").cast("date").alias("day")).pivot("event_type", ["click", "error", "purchase"]).count()
    return p.na.fill(0)


@query("a13_share_latest", "SELECT k, round(avg(bad::INTEGER), 8) AS share, count(*) AS n FROM (SELECT json_extract_string(props, '$.k')::BIGINT % 20 AS k, user_id, arg_max(value > 60, (ts, event_id)) AS bad FROM events GROUP BY ALL) GROUP BY k HAVING count(*) >= 3")
def share_latest(t):
    """Share of members whose latest sample is bad, by cell."""
    e = t.events.select((F.get_json_object("props", "$.k").cast("long") % 20).alias("k"), "user_id", F.struct("ts", "event_id").alias("o"), (F.col("value") > 60).alias("b"))
    last = e.groupBy("k", "user_id").agg(F.max_by("b", "o").alias("bad"))
    return last.groupBy("k").agg(F.round(F.avg(F.col("bad").cast("int")), 8).alias("share"), F.count("*").alias("n")).where("n >= 3")


@query("a14_mixed_record", """SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_kind, min(value) AS low, max(value) AS high, (SELECT string_agg(x, ',' ORDER BY o) FROM (SELECT event_type AS x, min((epoch_us(ts), event_id)) AS o FROM events b WHERE b.user_id = a.user_id GROUP BY event_type)) AS kinds FROM events a GROUP BY user_id""")
def mixed_record(t):
    """First label, extremes and the distinct kinds in the order they first came."""
    kinds = t.events.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("o"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    return kinds.groupBy("user_id").agg(
        F.min_by("event_type", "o").alias("first_kind"), F.min("lo").alias("low"), F.max("hi").alias("high"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("a15_most_common", "SELECT k, n FROM (SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1) ORDER BY n DESC, f LIMIT 10")
def most_common(t):
    g = t.events.groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.min("event_id").alias("f"))
    return g.orderBy(F.desc("n"), "f").limit(10).select("k", "n")


@query("a16_busiest_window", """WITH b AS (SELECT epoch_us(ts) // 600000000 AS bin, sum(CASE event_type WHEN 'purchase' THEN 5 WHEN 'error' THEN 3 ELSE 1 END) AS w FROM events GROUP BY 1),
s AS (SELECT unnest(range((SELECT min(bin) FROM b), (SELECT max(bin) FROM b) + 1)) AS bin), r AS (SELECT bin, sum(coalesce(w, 0)) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS total, count(*) OVER (ORDER BY bin ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS full_ FROM s LEFT JOIN b USING (bin))
SELECT arg_max(bin, (total, -bin)) AS bin, max(total)::BIGINT AS total FROM r WHERE full_ = 6""")
def busiest_window(t):
    """The hour of most weight, in ten-minute steps: bins are folded before the window, each bin spread over the hours it is in."""
    weight = F.when(F.col("event_type") == "purchase", 5).when(F.col("event_type") == "error", 3).otherwise(1)
    b = t.events.groupBy(F.floor(timeops.micros(F.col("ts")) / 6e8).alias("bin")).agg(F.sum(weight).alias("w"))
    ends = b.agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    spread = b.select(F.explode(F.sequence(F.col("bin") - 5, F.col("bin"))).alias("bin"), "w").groupBy("bin").agg(F.sum("w").alias("total"))
    inside = spread.join(F.broadcast(ends), (F.col("bin") >= F.col("lo")) & (F.col("bin") + 5 <= F.col("hi")))  # one row
    best = inside.agg(F.max(F.struct("total", (-F.col("bin")).alias("b"))).alias("x"))
    return best.select((-F.col("x.b")).alias("bin"), F.col("x.total").cast("long").alias("total"))


@query("a17_upper_median", "SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS p50 FROM events GROUP BY event_type")
def upper_median(t):
    """Quantiles with a rank error of n / 10,000 fence the median in; only values between the fences are ranked, by their counts.

    Nulls come last, as infinity; where they hold the middle, the median is null.
    """
    high = float("inf")
    e = t.events.select("event_type", F.coalesce("value", F.lit(high)).alias("v"), F.col("value").isNull().alias("none"))
    fence = e.groupBy("event_type").agg(F.percentile_approx("v", [0.4995, 0.5005], 10_000).alias("f"), F.count("*").alias("n"), F.count_if("none").alias("z"))
    near = e.join(fence, "event_type").where(F.col("v") <= F.col("f")[1])
    inside = F.when(F.col("v") >= F.col("f")[0], F.col("v"))  # null stands for all that lies below
    counts = near.groupBy("event_type", inside.alias("v")).agg(F.count("*").alias("c"), F.max("n").alias("n"), F.max("z").alias("z"))
    upto = F.sum("c").over(Window.partitionBy("event_type").orderBy(F.asc_nulls_first("v")))
    ranked = counts.withColumn("upto", upto).where("v IS NOT NULL AND upto > floor(n / 2)")
    return ranked.groupBy("event_type").agg(F.min(F.struct("v", (F.floor(F.col("n") / 2) >= F.col("n") - F.col("z")).alias("none"))).alias("x")).select("event_type", F.when(~F.col("x.none"), F.col("x.v")).alias("p50"))


@query("a18_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1")
def counts(t):
    return t.orders.groupBy("o_orderstatus").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "o_orderstatus")


SCORED = "(SELECT l.doc_id, d.lang, quality AS y, least(greatest(round((d.n_chars % 1000) / 1000.0::DOUBLE, 3), 0.001), 0.999) AS p FROM labels l JOIN documents d USING (doc_id))"


def scored(t):
    p = F.least(F.greatest(F.round((F.col("n_chars") % 1000) / 1000.0, 3), F.lit(0.001)), F.lit(0.999))
    return t.labels.join(t.documents.select("doc_id", "lang", "n_chars"), "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), p.alias("p"))


AUC = "SELECT {g} (sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)) AS auc FROM (SELECT *, avg(n) OVER (PARTITION BY {p} p) AS r FROM (SELECT *, row_number() OVER ({w} ORDER BY p) AS n FROM " + SCORED + "))"


@query("a19_metrics", f"SELECT round(avg(pow(p - y, 2)), 8) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 8) AS log_loss, (SELECT round(auc, 8) FROM ({AUC.format(g='', p='', w='')})) AS roc_auc FROM {SCORED}")
def classifier_metrics(t):
    s = scored(t)
    both = s.agg(F.round(metrics.brier("p", "y"), 8).alias("brier"), F.round(metrics.log_loss("p", "y"), 8).alias("log_loss"))
    return both.join(F.broadcast(metrics.roc_auc(s, "p", "y").select(F.round("auc", 8).alias("roc_auc"))))  # one row each


@query("a20_reliability", f"SELECT least(floor(p * 10), 9)::INTEGER AS bin, count(*) AS n, round(avg(p), 8) AS mean_p, round(avg(y), 8) AS mean_y FROM {SCORED} GROUP BY 1")
def reliability(t):
    return metrics.reliability(scored(t), "p", "y").select("bin", "n", F.round("mean_p", 8).alias("mean_p"), F.round("mean_y", 8).alias("mean_y"))


@query("a21_skill", f"SELECT round(1 - avg(pow(p - y, 2)) / avg(pow(r - y, 2)), 8) AS skill FROM {SCORED} s JOIN (SELECT lang AS g, avg(y) AS r FROM {SCORED} GROUP BY 1) ON lang = g")
def skill(t):
    s = scored(t)
    base = s.groupBy("lang").agg(F.avg("y").alias("r"))
    return s.join(base, "lang").agg(F.round(1 - metrics.brier("p", "y") / metrics.brier("r", "y"), 8).alias("skill"))


@query("a22_auc_by_group", "SELECT lang, round(auc, 8) AS auc FROM (" + AUC.format(g="lang,", p="lang,", w="PARTITION BY lang") + " GROUP BY lang HAVING count(DISTINCT y) = 2)")
def auc_by_group(t):
    return metrics.roc_auc(scored(t), "p", "y", ["lang"]).select("lang", F.round("auc", 8).alias("auc"))


@query("a23_topk_accuracy", """WITH r AS (SELECT l_orderkey, l_quantity > 40 AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n, count(*) OVER (PARTITION BY l_orderkey) AS size FROM lineitem)
SELECT CASE WHEN size <= 3 THEN 'short' ELSE 'long' END AS bucket, round(avg(t1), 8) AS top1, round(avg(t3), 8) AS top3 FROM (SELECT l_orderkey, size, max((y AND n <= 1)::INTEGER) AS t1, max((y AND n <= 3)::INTEGER) AS t3 FROM r GROUP BY ALL) GROUP BY 1""")
def topk_accuracy(t):
    x = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", (F.col("l_quantity") > 40).alias("y"))
    hits = metrics.top_k_hits(x, "l_orderkey", [F.desc("l_extendedprice"), F.asc("l_linenumber")], "y", (1, 3))
    return hits.groupBy(F.when(F.col("size") <= 3, "short").otherwise("long").alias("bucket")).agg(F.round(F.avg("top1"), 8).alias("top1"), F.round(F.avg("top3"), 8).alias("top3"))


@query("a24_row_counts", "SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def row_counts(t):
    one = lambda n: getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n")
    return one("customer").unionByName(one("orders")).unionByName(one("events"))


@query("a25_rollup", "SELECT l_suppkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(*) FILTER (l_discount > 0.05::DOUBLE) AS discounted, count(*) AS n FROM lineitem GROUP BY l_suppkey")
def evidence_rollup(t):
    return t.lineitem.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count_if(F.col("l_discount") > 0.05).alias("discounted"), F.count("*").alias("n"))


@query("a26_reason_list", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY n) AS top FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3 GROUP BY 1")
def reason_list(t):
    best = top_n(t.orders, "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return best.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("top"))


@query("a28_covered_minutes", "SELECT user_id, round(sum(greatest(0, least(b, 20000) - greatest(a, 5000))), 4) AS covered FROM (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0::DOUBLE AS a, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60000000.0::DOUBLE + value AS b FROM events) GROUP BY 1")
def covered_minutes(t):
    a = timeops.seconds_between(F.lit("2024-01-01").cast("timestamp"), F.col("ts")) / 60
    return t.events.groupBy("user_id").agg(F.round(F.sum(timeops.overlap(a, a + F.col("value"), F.lit(5000.0), F.lit(20000.0))), 4).alias("covered"))


@query("a33_value_counts", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15")
def value_counts(t):
    return t.part.groupBy("p_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_type").limit(15)


@query("l01_multi_key_sort", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey, s_acctbal DESC, s_suppkey")
def multi_key_sort(t):
    return t.supplier.select("s_suppkey", "s_nationkey", "s_acctbal").orderBy("s_nationkey", F.desc("s_acctbal"), "s_suppkey")


@query("l02_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 8")
def head(t):
    return t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(8).select("o_orderkey", "o_totalprice")


@query("l03_best_per_key", "SELECT l_suppkey, l_orderkey, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1 ORDER BY l_extendedprice DESC, l_suppkey LIMIT 25")
def best_per_key(t):
    """Best row of each key by an aggregate, which combines before the exchange, then the first of those."""
    best = t.lineitem.groupBy("l_suppkey").agg(F.min(F.struct((-F.col("l_extendedprice")).alias("p"), "l_orderkey", "l_linenumber")).alias("b"))
    return best.select("l_suppkey", F.col("b.l_orderkey").alias("l_orderkey"), (-F.col("b.p")).alias("l_extendedprice")).orderBy(F.desc("l_extendedprice"), "l_suppkey").limit(25)


@query("l05_topk", "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events) WHERE n <= 3")
def topk(t):
    return top_n(t.events, "user_id", [F.desc("value"), F.asc("event_id")], 3).select("user_id", "event_id", "value")


@query("l06_union_topk", """SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS a, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS b,
row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS c FROM lineitem) WHERE a <= 4 OR b <= 2 OR c <= 3""")
def union_topk(t):
    """Rows in any of several short lists of their key; one exchange serves all lists."""
    w = Window.partitionBy("l_suppkey")
    r = lambda c: F.row_number().over(w.orderBy(c, "l_orderkey", "l_linenumber"))
    x = t.lineitem.select("l_orderkey", "l_linenumber", r(F.desc("l_extendedprice")).alias("a"), r(F.asc("l_quantity")).alias("b"), r(F.desc("l_discount")).alias("c"))
    return x.where("a <= 4 OR b <= 2 OR c <= 3").select("l_orderkey", "l_linenumber")


@query("l07_ring", "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def ring(t):
    return t.events.orderBy(F.desc("ts"), F.desc("event_id")).limit(500).select("event_id")


@query("l09_hash_sample", "SELECT event_id FROM events ORDER BY sha1(event_id || ':7'), event_id LIMIT 100")
def hash_sample(t):
    return t.events.orderBy(F.sha1(F.concat(F.col("event_id").cast("string"), F.lit(":7"))), "event_id").limit(100).select("event_id")


@query("u01_union_all", "SELECT user_id, 'buy' AS kind, ts FROM events WHERE event_type = 'purchase' UNION ALL SELECT user_id, 'join', ts FROM events WHERE event_type = 'signup'")
def union_all(t):
    one = lambda a, b: t.events.where(F.col("event_type") == a).select("user_id", F.lit(b).alias("kind"), "ts")
    return one("purchase", "buy").unionByName(one("signup", "join"))


@query("u03_union_distinct", "SELECT user_id FROM events WHERE event_type = 'purchase' UNION SELECT user_id FROM events WHERE value > 90")
def union_distinct(t):
    return t.events.where("event_type = 'purchase'").select("user_id").union(t.events.where("value > 90").select("user_id")).distinct()


@query("u04_except", "SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 40")
def except_(t):
    return t.lineitem.where("l_quantity > 45").select("l_partkey").subtract(t.lineitem.where("l_returnflag = 'R' AND l_quantity > 40").select("l_partkey"))


@query("u05_jaccard", "WITH d AS (SELECT ts::DATE AS day, list(DISTINCT user_id) AS u FROM events GROUP BY 1) SELECT a.day, round(len(list_intersect(a.u, b.u)) / len(list_distinct(list_concat(a.u, b.u))), 8) AS jaccard FROM d a JOIN d b ON b.day = a.day + 1")
def jaccard(t):
    """Likeness of the users of neighbouring days, counted from pairs of (user, day) without arrays."""
    d = t.events.select(F.col("ts").cast("date").alias("day"), "user_id").distinct()
    n = d.groupBy("day").agg(F.count("*").alias("n"))
    both = d.join(d.select(F.date_sub("day", 1).alias("day"), "user_id"), ["day", "user_id"]).groupBy("day").agg(F.count("*").alias("i"))
    m = n.select(F.date_sub("day", 1).alias("day"), F.col("n").alias("m"))
    return n.join(m, "day").join(both, "day", "left").select("day", F.round(F.coalesce("i", F.lit(0)) / (F.col("n") + F.col("m") - F.coalesce("i", F.lit(0))), 8).alias("jaccard"))


@query("u06_completeness", "SELECT 'missing' AS side, n_nationkey AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey < 20) UNION ALL SELECT 'unknown', k FROM (SELECT DISTINCT s_nationkey + 3 AS k FROM supplier) WHERE k NOT IN (SELECT n_nationkey FROM nation)")
def completeness(t):
    have = t.supplier.where("s_suppkey < 20").select(F.col("s_nationkey").alias("k"))
    named = t.nation.select(F.col("n_nationkey").alias("k"))
    got = t.supplier.select((F.col("s_nationkey") + 3).alias("k")).distinct()
    return named.join(have, "k", "left_anti").select(F.lit("missing").alias("side"), "k").unionByName(got.join(named, "k", "left_anti").select(F.lit("unknown").alias("side"), "k"))


@query("u07_dedupe_pair", "SELECT a, b, min(l_orderkey) AS first FROM (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, l_orderkey FROM lineitem) GROUP BY ALL")
def dedupe_pair(t):
    return t.lineitem.groupBy(F.least("l_partkey", "l_suppkey").alias("a"), F.greatest("l_partkey", "l_suppkey").alias("b")).agg(F.min("l_orderkey").alias("first"))


@query("beyond_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("beyond_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("c03_kpi_counts", "SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (value >= 25) AS notable, count(DISTINCT user_id) FILTER (value > 90) AS users FROM events")
def kpi_counts(t):
    return t.events.agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") >= 25).alias("notable"), F.countDistinct(F.when(F.col("value") > 90, F.col("user_id"))).alias("users"))


@query("c04_null_last_order", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS p FROM supplier ORDER BY coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END, -1) DESC, s_suppkey LIMIT 30")
def null_last_order(t):
    p = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_acctbal"))
    return t.supplier.orderBy(F.desc(F.coalesce(p, F.lit(-1.0))), "s_suppkey").limit(30).select("s_suppkey", p.alias("p"))


@query("c06_grouped_members", "SELECT s_nationkey, count(*) AS n, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS members FROM supplier GROUP BY 1 ORDER BY n DESC, 1")
def grouped_members(t):
    return t.supplier.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")), ",").alias("members")).orderBy(F.desc("n"), "s_nationkey")


@query("c07_text_search", "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'blue') OR contains(lower(p_type), 'blue') OR contains(lower(p_brand), '1') ORDER BY p_partkey LIMIT 8")
def text_search(t):
    hit = F.contains(F.lower("p_name"), F.lit("blue")) | F.contains(F.lower("p_type"), F.lit("blue")) | F.contains(F.lower("p_brand"), F.lit("1"))
    return t.part.where(hit).orderBy("p_partkey").limit(8).select("p_partkey")
