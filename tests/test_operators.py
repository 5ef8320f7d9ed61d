"""Operators on small inputs with known results."""

import datetime as dt
import math

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lodestar.functions import geo, text, timeops
from lodestar.operators import graph, joins, louvain, metrics, rules, scoring, tracks
from lodestar.streaming import state


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_ellipse_of_one_point_is_a_circle(spark):
    e = one(spark, geo.ellipse(0.0, 20.0, 16.5))
    assert e["semi_major_km"] == pytest.approx(16.5 * 20 * 1.852 / 2) and e["semi_minor_km"] == pytest.approx(e["semi_major_km"]) and not e["impossible"]


def test_impossible_gap_strays_around_its_end(spark):
    e = one(spark, geo.ellipse(200.0, 2.0, 16.5))
    assert e["impossible"] and e["semi_minor_km"] == 0 and e["area_km2"] == pytest.approx(math.pi * 25)
    assert one(spark, geo.in_ellipse(500.0, 4.9, 61.1, F.lit(True))) and not one(spark, geo.in_ellipse(1.0, 5.1, 61.1, F.lit(True)))


def test_geodesic_of_a_degree_at_the_equator_and_of_equal_points(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0), (10.0, 50.0, 10.0, 50.0), (0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.geodesic("a", "b", "c", "d")).collect()]
    assert got == pytest.approx([111.319491, 0.0, 110.574389], abs=1e-5)


def test_wrap_and_tailwind_and_levels(spark):
    assert one(spark, geo.wrap(F.lit(190.0))) == -170 and one(spark, geo.wrap(F.lit(-190.0))) == 170 and one(spark, geo.turn(350.0, 10.0)) == 20


def test_radius_join_meets_across_the_date_line_and_at_a_pole(spark):
    a = spark.createDataFrame([(1, 179.9, 10.0), (2, 0.0, 89.9), (3, 50.0, 10.0)], "i int, x double, y double")
    b = spark.createDataFrame([(1, -179.9, 10.0), (2, 180.0, 89.9), (3, 50.0, 15.0)], "j int, u double, v double")
    got = {(r["i"], r["j"]) for r in joins.within_radius(a, b, 100, ("x", "y"), ("u", "v")).collect()}
    assert got == {(1, 1), (2, 2)}


def test_nearest_is_chosen_before_the_radius_rejects(spark):
    df = spark.createDataFrame([(36.5, 45.4), (0.0, 0.0)], "x double, y double")
    got = [r["place"] for r in joins.nearest(df, [("a", 36.5, 45.3), ("b", 36.5, 46.0)], "x", "y", radius_km=50).collect()]
    assert got == ["a", None]


def test_narrowest_block_wins(spark):
    r = spark.createDataFrame([(1, 0, 100000), (2, 500, 600)], "k int, lo long, hi long")
    v = spark.createDataFrame([(550,), (50,), (200000,)], "v long")
    assert {x["v"]: x["k"] for x in joins.narrowest_range(v, r, "v", "lo", "hi", "k").collect()} == {550: 2, 50: 1}


def test_asof_is_strict_or_not(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "k string, t int")
    right = spark.createDataFrame([("a", 10, "x"), ("a", 15, "y")], "k string, t int, v string")
    plain = {(r["k"], r["t"]): r["v"] for r in timeops.asof(left, right, "k", "t", "t", "v").collect()}
    strict = {(r["k"], r["t"]): r["v"] for r in timeops.asof(left, right, "k", "t", "t", "v", strict=True).collect()}
    assert plain == {("a", 10): "x", ("a", 20): "y", ("b", 5): None} and strict[("a", 10)] is None


def test_interval_union(spark):
    df = spark.createDataFrame([(1, 0, 30), (1, 20, 50), (1, 60, 70)], "k int, a int, b int")
    assert sorted((r["a"], r["b"]) for r in timeops.merge_intervals(df, "k", "a", "b").collect()) == [(0, 50), (60, 70)]


def test_session_keeps_two_events_a_gap_apart(spark):
    df = spark.createDataFrame([(1, i, at(m)) for i, m in enumerate((0, 20, 41))], "k int, i int, ts timestamp_ntz")
    assert [r["session"] for r in timeops.sessions(df, "k", "ts", 1200, "i").orderBy("i").collect()] == [1, 1, 2]


def test_cooldown_counts_from_the_last_that_fired(spark):
    assert one(spark, timeops.cooldown(F.array(*map(F.lit, (0, 5, 12, 30, 33))), 10, "int")) == [0, 12, 30]
    df = spark.createDataFrame([("a", i, at(m)) for i, m in enumerate((0, 5, 12, 30, 33))], "k string, i int, ts timestamp_ntz")
    assert [r["i"] for r in state.cooldown(df, ["k"], "ts", "i", 600).orderBy("i").collect()] == [0, 2, 3]


def test_confirmation_needs_its_ticks_in_a_row(spark):
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate("abababccc")], "k string, i int, v string")
    assert [(r["i"], r["v"]) for r in state.confirm(df, "k", "i", "v", 3).collect()] == [(8, "c")]


def test_current_state_and_time_to_live(spark):
    df = spark.createDataFrame([("a", at(2), 1, "x"), ("a", at(1), 2, "old"), ("a", at(2), 3, "later")], "k string, ts timestamp_ntz, n int, v string")
    assert [r["v"] for r in state.current(df, "k", "ts", "n").collect()] == ["later"]
    assert state.alive(df, "v", "ts", F.lit(at(3)), {"x": 30, "old": 120}).count() == 2


def test_scores_cap_signals_and_total(spark):
    rows = spark.createDataFrame([("v", i) for i in range(5)], "e string, i int")
    ev = scoring.breakdown([scoring.award(rows, "e", "gap", 10, 30, [F.asc("i")], F.lit("gap"), F.col("i")), scoring.award(rows, "e", "other", 45, None, [], F.lit("o"), F.col("i"))])
    got = scoring.scores(spark.createDataFrame([("v",), ("w",)], "e string"), ev, "e").orderBy("rank").collect()
    assert ev.where("signal = 'gap'").agg(F.sum("points")).first()[0] == 30
    assert (got[0]["risk"], got[0]["raw_points"], got[1]["risk"], got[1]["rank"]) == (100.0, 255.0, 0.0, 2)


def test_global_rank_is_total_with_ties(spark):
    got = scoring.global_rank(spark.range(1000).select((F.col("id") % 7).alias("a"), "id"), [F.desc("a"), F.asc("id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 1001)) and got[0]["a"] == 6 and got[-1]["id"] == 994


GRAPH = {"nodes": [{"id": "s", "type": "source", "params": {"kinds": ["a"]}}, {"id": "f", "type": "filter", "params": {"field": "v", "op": ">", "value": 1}}, {"id": "t", "type": "alert"}], "edges": [["s", "f"], ["f", "t"]]}


def test_rules_are_checked_and_counted(spark):
    df = spark.createDataFrame([Row(kind="a", v=2), Row(kind="a", v=None), Row(kind="b", v=5)])
    assert rules.counters(df, GRAPH).first().asDict() == {"s": 2, "f": 1, "t": 1}
    for broken in ([["s", "f"], ["f", "t"], ["t", "f"]], [["s", "nowhere"]]):
        with pytest.raises(ValueError):
            rules.validate(GRAPH | {"edges": broken})
    with pytest.raises(ValueError):
        rules.validate({"nodes": GRAPH["nodes"][:2], "edges": []})


def test_expansion_and_time_travel(spark):
    e = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "d", 3)], "a string, b string, day int")
    seed = spark.createDataFrame([("a",)], "node string")
    assert {r["node"]: r["depth"] for r in graph.expand(e, seed, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert graph.expand(graph.as_of(e, 0), seed, 3).count() == 1


def test_ids_stay_with_the_group_that_resembles(spark):
    new = spark.createDataFrame([("x", m) for m in "abcd"] + [("y", "e")], "group string, member string")
    old = spark.createDataFrame([(7, m) for m in "abc"] + [(8, "z")], "id int, member string")
    assert {r["group"]: r["id"] for r in graph.stable_ids(new, old).collect()} == {"x": 7, "y": None}


def test_communities_of_two_cliques(spark):
    e = [(a, b, 1.0) for g in ((1, 2, 3), (11, 12, 13)) for a in g for b in g if a < b] + [(3, 11, 0.1)]
    got = {r["node"]: r["community"] for r in louvain.communities(spark.createDataFrame(e, "a long, b long, weight double")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 11: 11, 12: 11, 13: 11}


def test_chain_drops_one_of_a_conflicting_pair(spark):
    rows = [(1, -1, 0.0, 0.0, 0.0), (1, 5, 2.0, 0.2, 0.0), (1, 6, 2.1, 0.9, 0.0), (1, 7, 6.0, 0.9, 0.0), (1, -2, 9.0, 1.0, 0.0)]
    got = tracks.longest_chains(spark.createDataFrame(rows, "gap_id long, id long, t double, lon double, lat double"), 16.5).first()
    assert got["ids"] == [5, 7] and got["detections"] == 2


def test_auc_of_ties_and_of_one_class(spark):
    df = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 0), ("b", 0.9, 1), ("c", 0.2, 0), ("c", 0.8, 1)], "g string, p double, y int")
    assert {r["g"]: r["auc"] for r in metrics.roc_auc(df, "p", "y", ["g"]).collect()} == {"a": 0.5, "c": 1.0}


def test_text(spark):
    assert one(spark, text.norm(F.lit("  Ё’к  Б "))) == "е'к б"
    assert one(spark, text.strip_html(F.lit("a<br>b <b>c</b> &lt;d&gt;&amp;"))) == "a\nb c <d>&"
    assert [one(spark, text.family(F.lit(x))) for x in ("RCH913  ", "FORTE10", "170040")] == ["RCH", "FORTE", None]
    assert [one(spark, text.valid_mmsi(F.lit(x))) for x in ("273123456", "002730000", None)] == [True, False, False]
    known = F.array(*(F.lit(str(i)) for i in (1, 2, 3)))
    assert [one(spark, text.cites_well(F.lit(x), known)) for x in ("[F1] [F2, F3]", "[F1] [F9]", "none", "[F1] [F1]")] == [True, False, False, False]
    assert one(spark, text.ops("!=", F.lit(None).cast("int"), F.lit(1))) and not one(spark, text.ops(">", F.lit(None).cast("int"), F.lit(1)))


def test_truncated_history_gives_equal_features(spark, data):
    from lodestar.operators.forecast import block_features

    e = spark.read.parquet(f"{data}/events.parquet")
    full = block_features(e, "user_id", "ts", F.col("event_type") == "error", "2024-01-01", 60).where("block < 40").drop("y")
    cut = block_features(e.where("ts < TIMESTAMP_NTZ '2024-01-11'"), "user_id", "ts", F.col("event_type") == "error", "2024-01-01", 60).where("block < 40").drop("y")
    users = cut.select("user_id").distinct()
    assert full.join(users, "user_id", "left_semi").select(*cut.columns).exceptAll(cut).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a" if i % 3 else "b", at(i * 7 % 100), i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, ts timestamp, n int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = state.stream_cooldown(stream, "k", "ts", 900).writeStream.format("memory").queryName("fired").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    got = sorted((r["k"], r["ts"]) for r in spark.table("fired").collect())
    want = sorted((r["k"], r["ts"]) for r in state.cooldown(df, ["k"], "ts", "n", 900).select("k", "ts").collect())
    assert got == want
    q = state.stream_current(stream, "k", "ts", "n").writeStream.format("memory").queryName("now").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("now").collect())) == sorted(map(tuple, state.current(df, "k", "ts", "n").collect()))


def test_communities_cover_whole_tables(spark, data):
    from lodestar import catalogue

    orders, lines = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("orders", "lineitem"))
    x = orders.join(lines, orders.o_orderkey == lines.l_orderkey)
    want = {r[0] for r in x.select("o_custkey").distinct().collect()} | {r[0] + 1_000_000_000 for r in x.select("l_partkey").distinct().collect()}
    got = catalogue.QUERIES["n06_communities"](spark, data)
    assert {r[got.columns[0]] for r in got.collect()} == want


def test_stable_ids_take_every_user(spark, tmp_path):
    from lodestar import catalogue

    at = lambda hour: f"SELECT user_id, TIMESTAMP_NTZ '2024-01-11 {hour}:00:00' AS ts FROM VALUES (1L), (2L), (13L), (14L), (170L) AS v(user_id)"
    spark.sql(at("05") + " UNION ALL " + at("17")).write.parquet(str(tmp_path / "events.parquet"))
    got = catalogue.QUERIES["n07_stable_ids"](spark, str(tmp_path)).collect()
    assert {(r["group"], r["id"]) for r in got} == {(0, 0), (3, 2), (28, 28)}


def test_great_circles_of_every_supplier(spark, data, tmp_path):
    from lodestar import catalogue

    spark.read.parquet(f"{data}/supplier.parquet").withColumn("s_suppkey", F.col("s_suppkey") + 100).write.parquet(str(tmp_path / "supplier.parquet"))
    got = {r["s_suppkey"] for r in catalogue.QUERIES["g13_great_circle"](spark, str(tmp_path)).collect()}
    assert got and got == {r["s_suppkey"] for r in spark.read.parquet(str(tmp_path / "supplier.parquet")).collect()}


def test_upper_median_with_nulls_as_its_sql_has_it(spark, tmp_path):
    import duckdb

    from lodestar import catalogue

    values = [(k, None if i % 10 < share else float(i * 7 % 51)) for k, share in (("a", 3), ("b", 6), ("c", 10), ("d", 0)) for i in range(301)] + [("e", float("-inf"))] * 5 + [("e", 1.0)] * 3
    spark.createDataFrame(values, "event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(catalogue.ORACLE["a17_upper_median"]).fetchall())
    assert sorted(map(tuple, catalogue.QUERIES["a17_upper_median"](spark, str(tmp_path)).collect())) == want and len(want) == 5


def test_radius_of_each_row_and_full_cells(spark, monkeypatch):
    """Own radii, the date line, poles and cells cut into parts, against all pairs."""
    import random

    from lodestar.operators import joins as J

    monkeypatch.setattr(J, "PER_TASK", 20)
    r = random.Random(5)
    many = [(i, r.uniform(-180, 180), r.uniform(-90, 90)) for i in range(300)] + [(i, r.choice([179.9, -179.9, 10.0]), r.choice([89.5, 0.1, -89.9])) for i in range(300, 400)]
    few = [(i, r.uniform(-180, 180), r.choice([-89.0, 0.0, 60.0, 89.9]), r.choice([50.0, 400.0, 900.0])) for i in range(40)] + [(40, 180.0, 0.0, 300.0), (41, 10.0, 0.0, 300.0), (42, None, 0.0, 300.0)]
    a, b = spark.createDataFrame(many, "i int, x double, y double"), spark.createDataFrame(few, "j int, u double, v double, own double")
    every = a.crossJoin(b).withColumn("km", J.geo.haversine("x", "y", "u", "v"))
    for own, want in ((None, every.where("km <= 700")), ("own", every.where("km <= least(own, 700)"))):
        got = J.within_radius(a, b, 700, ("x", "y"), ("u", "v"), own=own)
        assert sorted((x.i, x.j) for x in got.collect()) == sorted((x.i, x.j) for x in want.collect())
