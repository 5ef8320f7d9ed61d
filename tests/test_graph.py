"""Communities, expansion and lasting names against plain versions."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestar import api
from lodestar.operators import graph, louvain

CLUB = """1-2 1-3 2-3 1-4 2-4 3-4 1-5 1-6 1-7 5-7 6-7 1-8 2-8 3-8 4-8 1-9 3-9 3-10 1-11 5-11 6-11 1-12 1-13 4-13 1-14 2-14 3-14 4-14 6-17 7-17 1-18 2-18
1-20 2-20 1-22 2-22 24-26 25-26 3-28 24-28 25-28 3-29 24-30 27-30 2-31 9-31 1-32 25-32 26-32 29-32 3-33 9-33 15-33 16-33 19-33 21-33 23-33 24-33 30-33 31-33
32-33 9-34 10-34 14-34 15-34 16-34 19-34 20-34 21-34 23-34 24-34 27-34 28-34 29-34 30-34 31-34 32-34 33-34"""
CLUB = [(*map(int, x.split("-")), 1.0) for x in CLUB.split()]


def matrix(edges):
    near = defaultdict(lambda: defaultdict(float))
    for a, b, w in edges:
        near[a][b] += w
        if a != b:
            near[b][a] += w
    return near


def degrees(near):
    return {a: sum(w * (2 if a == b else 1) for b, w in row.items()) for a, row in near.items()}


def quality(edges, group):
    near = matrix(edges)
    degree = degrees(near)
    twice, totals, inside = sum(degree.values()), Counter(), 0.0
    for a, row in near.items():
        totals[group[a]] += degree[a]
        inside += sum(w * (2 if a == b else 1) for b, w in row.items() if group[a] == group[b])
    return inside / twice - sum((t / twice) ** 2 for t in totals.values())


def contracted(edges, group):
    out = Counter()
    for a, b, w in edges:
        out[tuple(sorted((group[a], group[b])))] += w
    return [(a, b, w) for (a, b), w in out.items()]


def one_by_one(edges):
    """Louvain as usual: node after node, level after level."""
    found, links, before = None, edges, -1.0
    while True:
        near = matrix(links)
        degree = degrees(near)
        group, totals, twice, moved = {a: a for a in near}, dict(degree), sum(degree.values()), True
        while moved:
            moved = False
            for a in sorted(near):
                into = Counter()
                for b, w in near[a].items():
                    if a != b:
                        into[group[b]] += w
                own = group[a]
                totals[own] -= degree[a]
                best = max([own, *into], key=lambda c: (twice * into[c] - degree[a] * totals[c], c == own))
                totals[best] += degree[a]
                moved, group[a] = moved or best != own, best
        q = quality(links, group)
        if q <= before + 1e-9:
            return found
        before, found = q, {a: group[c] for a, c in found.items()} if found else group
        links = contracted(links, group)


def all_at_once(edges, draws, most, look):
    """The rounds of the operator, in dictionaries."""
    found, links, before = None, edges, None
    while True:
        near = matrix(links)
        degree = degrees(near)
        twice = sum(degree.values())
        group = {a: a for a in near}
        best, best_q, best_i, still = dict(group), quality(links, group), 0, 0
        for i in range(1, most + 1):
            totals = Counter()
            for a in near:
                totals[group[a]] += degree[a]
            after = {}
            for a in near:
                into = Counter({group[a]: 0.0})
                for b, w in near[a].items():
                    if a != b:
                        into[group[b]] += w
                can = into if (a, i) in draws else [group[a]]
                after[a] = min(can, key=lambda c: (degree[a] * (totals[c] - (degree[a] if c == group[a] else 0)) - twice * into[c], c != group[a], c))
            still = still + 1 if after == group else 0
            group = after
            if i % look and i < most and still < louvain.SHARE:
                continue
            if (q := quality(links, group)) > best_q:
                best, best_q, best_i = dict(group), q, i
            elif i - best_i > look:
                break
            if still >= louvain.SHARE:
                break
        if before is not None and best_q <= before + louvain.GAIN:
            return found
        least = {}
        for a, c in best.items():
            least[c] = min(a, least.get(c, a))
        best = {a: least[c] for a, c in best.items()}
        before, found = best_q, {a: best[c] for a, c in found.items()} if found else best
        links = contracted(links, best)


EDGES = "a long, b long, weight double"


def test_communities_equal_the_rounds_done_plainly_and_are_as_good_as_one_by_one(spark):
    r = random.Random(5)
    edges = [(min(a, b), max(a, b), w) for a, b, w in CLUB] + [(1, 1, 2.0), (50, 51, 3.0), (r.randrange(60, 66), r.randrange(60, 66), 1.0)]
    given = [(b, a, w) if r.random() < 0.5 else (a, b, w) for a, b, w in edges] + [(None, 1, 1.0), (1, None, 1.0), (1, 2, None), (3, 30, -1.0), (3, 30, 0.0)]
    found = dict(map(tuple, louvain.communities(spark.createDataFrame(given, EDGES)).collect()))
    pairs = spark.createDataFrame([(a, i) for a in {x for e in edges for x in e[:2]} for i in range(1, louvain.ROUNDS + 1)], "a long, i int")
    draws = {(x["a"], x["i"]) for i in range(1, louvain.ROUNDS + 1) for x in pairs.where(F.col("i") == i).where(louvain.drawn(F.col("a"), i)).collect()}
    assert found == all_at_once(edges, draws, louvain.ROUNDS, louvain.LOOK)
    assert quality(edges, found) >= quality(edges, one_by_one(edges)) - 0.01
    df = spark.createDataFrame(edges, EDGES)
    assert louvain.modularity(df, spark.createDataFrame(list(found.items()), "node long, community long")) == pytest.approx(quality(edges, found))


def test_nets_add_lone_nodes_and_an_empty_graph_has_none(spark):
    none = spark.createDataFrame([], EDGES)
    assert louvain.communities(none).count() == 0
    alone = spark.createDataFrame([(9,), (1,), (None,), (9,)], "node long")
    two = spark.createDataFrame([(1, 2, 1.0)], EDGES)
    assert sorted(map(tuple, louvain.nets(two, alone).collect())) == [(1, 1), (2, 1), (9, 9)]


def test_expansion_of_every_seed_at_once(spark):
    r = random.Random(2)
    links = [(r.randrange(30), r.randrange(30)) for _ in range(40)] + [(None, 3)]
    edges = spark.createDataFrame(links, "a int, b int")
    seeds = spark.createDataFrame([(1,), (2,), (99,), (1,), (None,)], "node int")
    near = defaultdict(set)
    for a, b in links:
        if a is not None:
            near[a].add(b)
            near[b].add(a)
    want = set()
    for s in (1, 2, 99):
        depth, front = {s: 0}, [s]
        for d in (1, 2, 3):
            front = [n for m in front for n in near[m] if n not in depth and not depth.update({n: d})]
        want |= {(s, n, d) for n, d in depth.items()}
    got = [tuple(x) for x in graph.expand(edges, seeds, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    plan = graph.expand(edges, seeds, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # every frontier lies written
    c = {x["node"]: (x["depth"], x["seeds"]) for x in api.cluster(edges, seeds, 2).collect()}
    assert c == {n: (min(d for _, m, d in want if m == n), len({s for s, m, d in want if m == n and d <= 2})) for _, n, d in want if d <= 2}


def settled(new, old, least):
    free, out = dict(old), {}
    for g in sorted(new, key=lambda g: (-len(new[g]), g)):
        best = max(free, key=lambda i: (len(new[g] & free[i]) / len(new[g] | free[i]), -i), default=None)
        out[g] = None
        if best is not None and len(new[g] & free[best]) / len(new[g] | free[best]) >= least:
            out[g] = best
            del free[best]
    return out


@pytest.mark.parametrize("least", [0.5, 0.1])
def test_lasting_names_are_those_of_settling_one_by_one(spark, least):
    r = random.Random(9)
    new = {g: {r.randrange(20) for _ in range(r.randint(1, 8))} for g in range(25)}  # groups that overlap ask for the same names
    old = {i: {r.randrange(20) for _ in range(r.randint(1, 8))} for i in range(18)}
    n = spark.createDataFrame([(g, m) for g, ms in new.items() for m in ms], "group long, member long")
    o = spark.createDataFrame([(i, m) for i, ms in old.items() for m in ms], "id long, member long")
    assert dict(map(tuple, graph.stable_ids(n, o, least).collect())) == settled(new, old, least)


def test_changes_between_versions(spark):
    edges = spark.sql("SELECT * FROM VALUES (1, 2, DATE '2024-01-01'), (2, 3, DATE '2024-01-05') AS t(a, b, day)")
    assert [tuple(x) for x in api.changes(edges, F.lit("2024-01-01").cast("date"), F.lit("2024-01-06").cast("date")).collect()] == [(2, 3, "added")]


def test_difference_is_one_exchange_and_the_last_hop_is_not_written(spark, tmp_path):
    from lodestar.scratch import Rounds

    old = spark.createDataFrame([(1, 1), (1, 1), (2, 2), (None, 3)], "a int, b int")
    new = spark.createDataFrame([(2, 2), (4, 4), (None, 3)], "a int, b int")
    x = graph.diff(old, new, ["a", "b"])
    assert sorted(map(str, x.collect())) == sorted(["Row(a=1, b=1, change='removed')", "Row(a=4, b=4, change='added')", "Row(a=None, b=3, change='added')", "Row(a=None, b=3, change='removed')"])
    assert "Join" not in x._jdf.queryExecution().optimizedPlan().toString()
    kept = []

    class Noted(Rounds):
        def keep(self, df, name):
            kept.append(name)
            return super().keep(df, name)

    chain = spark.createDataFrame([(i, i + 1) for i in range(5)] + [(1, 0), (2, 2)], "a int, b int")
    got = graph.expand(chain, spark.createDataFrame([(0,)], "node int"), 3, rounds=Noted(spark))
    assert sorted((r["node"], r["depth"]) for r in got.collect()) == [(0, 0), (1, 1), (2, 2), (3, 3)] and "front3" not in kept


def test_a_round_joins_links_once(spark):
    """Totals and degrees travel with the rows: links meet the communities of their ends and nothing else, and only those of nodes drawn."""
    state = spark.createDataFrame([(i, 1.0, i, False) for i in range(6)], "node long, degree double, community long, moved boolean")
    both = spark.createDataFrame([(i, 5 - i, 1.0, 1.0) for i in range(6)], "a long, b long, weight double, degree double")
    out = louvain._moved(state, both, 6.0, 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") <= 3 and "Join LeftOuter" not in plan
    assert out.columns == ["node", "degree", "community", "moved"]
    still = {r["node"] for r in state.where(~louvain.drawn(F.col("node"), 1)).collect()}
    got = {r["node"]: r for r in out.collect()}
    assert set(got) == set(range(6)) and all(got[i]["community"] == i and not got[i]["moved"] for i in still)


def test_held_links_stay_where_they_are(spark):
    """Links were exchanged by neighbour in every round, and what they found by node and community and again by node."""
    state = spark.createDataFrame([(i, 2.0, i, False) for i in range(6)], "node long, degree double, community long, moved boolean")
    links = [(i, (i + 1) % 6) for i in range(6)]
    both = spark.createDataFrame([(a, b, 1.0, 2.0) for x, y in links for a, b in ((x, y), (y, x))], "a long, b long, weight double, degree double")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = louvain._by(both, "b", tasks).sortWithinPartitions("b").persist()
    held.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = louvain._moved(state, held, 12.0, 1, tasks)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[plan.index("SortMergeJoin [b#") : plan.index("InMemoryTableScan")]
        assert plan.count("Exchange hashpartitioning(node#") == 1 and ", to#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, louvain._moved(state, both, 12.0, 1).collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        held.unpersist()
