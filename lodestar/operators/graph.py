"""Versioned property graph: edges with the day they hold from, expansion, clusters, differences, lasting names of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.scratch import Rounds


def as_of(edges: DataFrame, day) -> DataFrame:
    """Edges of the latest version at or before a day."""
    return edges.where(F.col("day") <= day)


def expand(edges: DataFrame, seeds: DataFrame, hops: int, node: str = "node", rounds: Rounds | None = None) -> DataFrame:
    """(seed, node, depth): nodes within so many hops of each seed, at their least depth. edges: a, b, either way round.

    The frontier of a hop holds only nodes not met before, so work follows the neighbourhood and not the graph. Links and
    every frontier but the last, which is the largest and which no hop reads, are written once: a hop is one join and one
    anti join of what lies there.
    """
    rounds = rounds or Rounds(edges.sparkSession)
    links = rounds.keep(edges.where("a IS NOT NULL AND b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    front = rounds.keep(seeds.where(F.col(node).isNotNull()).select(F.col(node).alias("seed"), F.col(node).alias("node"), F.lit(0).alias("depth")).distinct(), "front0")
    seen = front
    for depth in range(1, hops + 1):
        step = front.join(both, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        front = step.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        if depth < hops:
            front = rounds.keep(front, f"front{depth}")
        seen = seen.unionByName(front)
        if depth < hops and front.isEmpty():
            break
    return seen


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by keys with change 'added' or 'removed'. Both sides meet in one aggregate, which combines before its exchange.

    Rows with a null key equal no other row: they are added and removed.
    """
    sides = lambda: old.select(*keys, F.lit(1).alias("_side")).unionByName(new.select(*keys, F.lit(2).alias("_side")))
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    g = sides().groupBy(*keys).agg(F.bool_or(F.col("_side") == 1).alias("_old"), F.bool_or(F.col("_side") == 2).alias("_new"))
    change = F.array_compact(F.array(F.when(F.col("_new") & (~whole | ~F.col("_old")), "added"), F.when(F.col("_old") & (~whole | ~F.col("_new")), "removed")))
    return g.select(*keys, F.explode(change).alias("change"))


def stable_ids(new: DataFrame, old: DataFrame, least: float = 0.5, rounds: Rounds | None = None) -> DataFrame:
    """(group, id): each new group takes the id of the old group it resembles most by Jaccard, largest group first.

    new(group, member), old(id, member). Groups ask for the id they like best, ids hold on to the largest group that asks
    (of equal ones the first in order), and a group that was turned down asks for the next: all at once, round by round,
    until nobody is turned down. As all ids prefer the same groups, that is the result of settling groups one by one.
    Groups without a partner keep null.
    """
    rounds = rounds or Rounds(new.sparkSession)
    new, old = new.distinct(), old.distinct()
    n = rounds.keep(new.groupBy("group").agg(F.count("*").alias("n")), "sizes")
    o = old.groupBy("id").agg(F.count("*").alias("m"))
    both = new.join(old, "member").groupBy("group", "id").agg(F.count("*").alias("i")).join(n, "group").join(o, "id")
    pairs = both.withColumn("j", F.col("i") / (F.col("n") + F.col("m") - F.col("i"))).where(F.col("j") >= least).select("group", "id", "n", "j")
    pairs, turn = rounds.keep(pairs, "pairs0"), 0
    while True:
        asked = pairs.groupBy("group", "n").agg(F.min_by("id", F.struct(-F.col("j"), "id")).alias("id"))
        asked = rounds.keep(asked, f"asked{turn}")
        held = asked.groupBy("id").agg(F.min_by("group", F.struct(-F.col("n"), "group")).alias("group"))
        refused = rounds.keep(asked.join(held, ["id", "group"], "left_anti").select("group", "id"), f"refused{turn}")
        if refused.isEmpty():
            break
        turn += 1
        pairs = rounds.keep(pairs.join(refused, ["group", "id"], "left_anti"), f"pairs{turn}")
    return n.select("group").join(asked.select("group", "id"), "group", "left")


def mission(roles: Column, rules: list[tuple[str, tuple[str, ...], str]], default: str) -> Column:
    """Label of the first rule a group's set of roles meets; a rule wants 'all' or 'any' of its roles."""
    out = F.lit(default)
    for label, wanted, how in reversed(rules):
        w = F.array(*map(F.lit, wanted))
        hit = F.size(F.array_except(roles, w)) == 0 if how == "all" else F.arrays_overlap(roles, w)
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def dense_ids(df: DataFrame, order: str, out: str = "id") -> DataFrame:
    """Ids from 0 in the order of a key."""
    from lodestar.operators.scoring import global_rank

    return global_rank(df, [F.asc(order)], out).withColumn(out, F.col(out) - 1)


def ranked(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
