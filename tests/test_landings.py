"""Prefix counts of landings against a plain loop."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import landings

SCHEMA = "hex string, type string, family string, field string, start double, end double"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for _ in range(300):
        start = float(r.randrange(0, 400))
        out.append((r.choice(["hot", "hot", "b", "c"]), r.choice(["x", "y", None]), r.choice(["q", None]), r.choice(["f1", "f2", "f3", None]), start, start + r.choice([0, 1, 10, 50])))
    return out + [out[0], ("d", "x", "q", "f1", None, 5.0), ("d", "x", "q", "f1", 3.0, None), (None, "x", "q", "f1", 1.0, 2.0)]


def learned(rows):
    first = {}
    for h, t, f, field, _, end in rows:
        if None not in (h, field, end):
            key = lambda v: tuple((x is not None, x) for x in v)
            first[h, end] = min(first.get((h, end), (t, f, field)), (t, f, field), key=key)
    return [(h, end, *x) for (h, end), x in first.items()]


@pytest.mark.parametrize("span", [7.0, 1000.0])
def test_each_landing_is_judged_by_those_before_it(spark, rows, span):
    known = learned(rows)
    want = []
    for h, t, f, field, start, end in rows:
        if None in (h, field, start):
            continue
        counts = []
        for i, v in ((0, h), (2, t), (3, f)):
            same = [k for k in known if v is not None and k[i] == v and k[1] < start]
            counts += [len(same), sum(k[4] == field for k in same)]
        want.append((h, t, f, field, start, end, *counts))
    got = landings.judged(spark.createDataFrame(rows, SCHEMA), span).select("hex", "type", "family", "field", "start", "end", "n_hex", "at_hex", "n_type", "at_type", "n_family", "at_family")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_candidates_are_fields_known_by_then_and_the_one_landed_at(spark, rows):
    known = learned(rows)
    want = []
    for h, t, f, field, start, end in rows:
        for c in {k[4] for k in known if k[0] == h} if None not in (h, field, start) else ():
            n = sum(k[0] == h and k[4] == c and k[1] < start for k in known)
            if n or c == field:
                want.append((h, field, start, c, n, int(c == field)))
    got = landings.candidates(spark.createDataFrame(rows, SCHEMA), 30.0).select("hex", "field", "start", "candidate", "n", "y")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_snapshots_leave_out_the_last_step(spark):
    points = spark.createDataFrame([("a", float(t)) for t in (0, 100, 299, 300, 650, 700, 905, 1000)] + [("b", 5.0)], "flight string, ts double")
    got = sorted((x["flight"], x["ts"], x["left"]) for x in landings.snapshots(points, "flight", "ts").collect())
    assert got == [("a", 299.0, 701.0), ("a", 300.0, 700.0), ("a", 700.0, 300.0)]
    assert landings.judged(spark.createDataFrame([], SCHEMA)).where(F.lit(True)).count() == 0


def test_counts_one_to_another_read_the_flights_once_each(spark, rows):
    """Every count used to read all counts before it twice, so that six made sixty-four readings."""
    plan = landings.judged(spark.createDataFrame(rows, SCHEMA), 30.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and plan.count("Relation") <= 1 + 3 * 2 * len(landings.LEVELS)


@pytest.mark.parametrize("hot, few", [(5, 0), (5, 10**9), (10**9, 10**9), (10**9, 0)])
def test_hot_keys_are_cut_and_few_moments_asked_once(spark, rows, monkeypatch, hot, few):
    """Keys cut into spans or whole, moments of all levels joined or flights sent to each level: the same counts; sizes do not show."""
    want = {span: sorted(map(tuple, landings.judged(spark.createDataFrame(rows, SCHEMA), span).collect()), key=str) for span in (7.0,)}
    pairs = sorted(map(tuple, landings.candidates(spark.createDataFrame(rows, SCHEMA), 30.0).collect()), key=str)
    for name, value in (("HOT", hot), ("FEW", few), ("GROUP", 40)):
        monkeypatch.setattr(landings, name, value)
    assert sorted(map(tuple, landings.judged(spark.createDataFrame(rows, SCHEMA), 7.0).collect()), key=str) == want[7.0]
    assert sorted(map(tuple, landings.candidates(spark.createDataFrame(rows, SCHEMA), 30.0).collect()), key=str) == pairs


def test_no_row_of_the_result_is_exchanged(spark, rows):
    """Fields were laid beside flights before the exchange, and each of six counts sent the flights anew."""
    plan = landings.candidates(spark.createDataFrame(rows, SCHEMA), 30.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("FlatMapGroupsInArrow")] and plan.count("_group#") and "candidate" not in plan[plan.index("FlatMapGroupsInArrow") :].split("\n", 1)[1]
    plan = landings.judged(spark.createDataFrame(rows, SCHEMA), 30.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 * len(landings.LEVELS)
    moments = spark.createDataFrame([("h%d" % (i % 3), "x", "q", "f%d" % (i % 2), float(i % 5), float(i % 7)) for i in range(900)], SCHEMA)
    plan = landings.judged(moments, 30.0)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("BroadcastHashJoin") == 3
