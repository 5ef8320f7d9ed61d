"""The prefix trie of conversations, rolled up by depth bands.

A node is a distinct sequence of first turns. It is known by its depth and two 64-bit sums by exclusive or of the
hashes of its (place, role, text), so that a prefix of a conversation is extended by one step and a slice of a long
conversation is summed apart from the others. Conversations are sorted by ranges: the turns of a very long one lie
in many slices, whose counts and sums, one row for each slice, carry on from slice to slice.

Sums over subtrees go by bands of HEIGHT depths. A node is exploded to its ancestors within its own band alone, HEIGHT
at most. What a band's root has gathered is then the value of a node of a trie of the band roots, which is HEIGHT times
less deep and is rolled up by the same rule; the completed totals of band roots come back down as sums for their
ancestors in the band above. So the rounds are the logarithm of the depth to the base HEIGHT.

Defined results: turns without a conversation id belong to none; turns of one number come by role, then text, then as
often as they are repeated; a null turn number is first; null role and text are empty; an empty table has no nodes,
not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, partitions, words_of

HEIGHT = 8
#: Bits of an id that one text of ends holds: at most 4,096 distinct ids.
ENDS = 12
NODE = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def shared_turns(conv: Column) -> Column:
    """Turns that a rebuilt conversation takes from the first of its twenty."""
    return (F.crc32(conv.cast("string").cast("binary")) % 4).cast("int")


def slices(turns: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, slice, at (ascending in a slice), t1 and t2 (hashes of role and text) and words, in order over all slices."""
    filled = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    order = ["conv", "turn", "role", "text"]
    dealt = rows.repartitionByRange(partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    hashed = dealt.select("conv", F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias("at"),
                          *(F.xxhash64(F.lit(s), "role", "text").alias(f"t{s}") for s in (1, 2)), words_of(F.col("text")).alias("words"))
    return scratch.save(hashed, "turns")


def _step(depth: Column, s: int) -> Column:
    """What the turn at a depth adds to sum s of its node."""
    return F.xxhash64(F.lit(s), depth.cast("long"), "t1", "t2")


def paths(turns: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True) -> DataFrame:
    """A row for each depth of each conversation, 0 included: conv, depth, k1, k2, p1, p2 (the parent's sums), words, ends.

    With rebuild, the first turns come from the first conversation of each twenty, as many as `shared_turns` says.
    """
    own = slices(turns, scratch, conv, turn, role, text)
    counts = own.groupBy("conv", "slice").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = scratch.save(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("start") + 1), "counts")
    placed = scratch.save(own.join(counts.drop("n", "start"), ["conv", "slice"]).withColumn("place", F.col("at") + F.col("before")).drop("before"), "placed")

    convs = counts.groupBy("conv").agg(F.sum("n").alias("n")).withColumn("h", shared_turns(F.col("conv")) if rebuild else F.lit(0)).withColumn("base", F.col("conv") - F.col("conv") % 20)
    heads = placed.where("place <= 3").groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "words"))).alias("head"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h")))
    convs = convs.withColumn("taken", F.size("head")).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv", "h", "head", "taken", "length")
    convs = scratch.save(convs, "convs")

    # Sums over the turns taken over, three at most.
    first = convs.select("conv", "length", F.posexplode("head").alias("i", "t")).select("conv", "length", (F.col("i") + 1).cast("long").alias("depth"), "t.t1", "t.t2", "t.words")
    first = first.select("conv", "length", "depth", "words", *(_step(F.col("depth"), s).alias(f"e{s}") for s in (1, 2)))
    grown = Window.partitionBy("conv").orderBy("depth")
    first = scratch.save(first.select("conv", "length", "depth", "words", *(F.bit_xor(f"e{s}").over(grown).alias(f"k{s}") for s in (1, 2)), "e1", "e2"), "first")
    above = first.groupBy("conv").agg(*(F.bit_xor(f"e{s}").alias(f"a{s}") for s in (1, 2)))

    # A conversation's own turns, slice by slice.
    info = scratch.save(counts.select("conv", "slice").join(convs.select("conv", "h", "taken", "length"), "conv"), "info")
    later = placed.join(info, ["conv", "slice"]).where("place > h").withColumn("depth", (F.col("place") - F.col("h") + F.col("taken")).cast("long"))
    later = later.select("conv", "slice", "length", "depth", "words", *(_step(F.col("depth"), s).alias(f"e{s}") for s in (1, 2)))
    within = Window.partitionBy("conv", "slice").orderBy("depth")
    later = scratch.save(later.select("*", *(F.bit_xor(f"e{s}").over(within).alias(f"x{s}") for s in (1, 2))), "later")
    totals = later.groupBy("conv", "slice").agg(*(F.bit_xor(f"e{s}").alias(f"e{s}") for s in (1, 2)))
    carried = totals.select("conv", "slice", *(F.coalesce(F.bit_xor(f"e{s}").over(before), F.lit(0)).alias(f"c{s}") for s in (1, 2))).join(above, "conv", "left")
    carried = scratch.save(carried.select("conv", "slice", *(F.col(f"c{s}").bitwiseXOR(F.coalesce(f"a{s}", F.lit(0))).alias(f"c{s}") for s in (1, 2))), "carried")
    later = later.join(carried, ["conv", "slice"]).select("conv", "length", "depth", "words", *(F.col(f"x{s}").bitwiseXOR(F.col(f"c{s}")).alias(f"k{s}") for s in (1, 2)), "e1", "e2")

    nothing = F.lit(0).cast("long")
    root = convs.select("conv", "length", nothing.alias("depth"), nothing.alias("words"), *(nothing.alias(c) for c in ("k1", "k2", "e1", "e2")))
    every = root.unionByName(first).unionByName(later)
    every = every.select("conv", *NODE, *(F.col(f"k{s}").bitwiseXOR(F.col(f"e{s}")).alias(f"p{s}") for s in (1, 2)), F.col("words").cast("long").alias("words"), (F.col("depth") == F.col("length")).alias("ends"))
    out = scratch.save(every, "paths")
    scratch.drop("turns", "placed", "counts", "first", "later", "carried", "info", "convs")
    return out


def _band_paths(every: DataFrame, step: int) -> DataFrame:
    """conv, band and way, the nodes of a conversation at the depths of a band that `step` divides, HEIGHT at most."""
    at = every.where(F.col("depth") % step == 0)
    return at.groupBy("conv", F.floor(F.col("depth") / (step * HEIGHT)).alias("band")).agg(F.collect_list(F.struct(*NODE)).alias("way"))


def _to_ancestors(values: DataFrame, ways: DataFrame, step: int, band: Column) -> DataFrame:
    """Sums of values(conv, depth, leaves, saved) by the nodes above them, or equal to them, in the band given."""
    met = values.withColumn("band", band).join(ways, ["conv", "band"])
    up = met.select("depth", "leaves", "saved", F.explode("way").alias("to")).where(F.col("to.depth") <= F.col("depth"))
    return up.groupBy(*(F.col(f"to.{c}").alias(c) for c in NODE)).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def roll_up(values: DataFrame, every: DataFrame, scratch: Scratch) -> DataFrame:
    """NODE, leaves and saved, summed over each node's subtree, of values(NODE, conv, leaves, saved).

    conv is a conversation through the node; every is what `paths` gives.
    """
    deepest = values.agg(F.max("depth")).first()[0] or 0
    levels, step, here = [], 1, values
    while True:
        ways = scratch.save(_band_paths(every, step), f"ways{step}")
        part = _to_ancestors(here, ways, step, F.floor(F.col("depth") / (step * HEIGHT)))
        part = scratch.save(here.select(*NODE, "conv").join(part, NODE), f"part{step}")
        levels.append((step, ways, part))
        if deepest < step * HEIGHT:
            break
        step *= HEIGHT
        here = part.where(F.col("depth") % step == 0)
    total = levels[-1][2]
    for step, ways, part in reversed(levels[:-1]):
        # Roots of the bands below, completed, for each of their ancestors one band higher.
        above = _to_ancestors(total.where("depth > 0"), ways, step, F.floor(F.col("depth") / (step * HEIGHT)) - 1)
        both = part.join(above.select(*NODE, F.col("leaves").alias("more"), F.col("saved").alias("also")), NODE, "left")
        total = scratch.save(both.select(*NODE, "conv", (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("also", F.lit(0))).alias("saved")), f"total{step}")
    return total.select(*NODE, "leaves", "saved")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash for each run of a node's texts; only the hash under way is held."""
    node, sha = None, None

    def row(key, digest):
        return pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in key), pa.array([digest])], names=[*NODE, "sha"])

    for b in batches:
        done: list[tuple] = []
        for d, k1, k2, text in zip(*(c.to_pylist() for c in b.columns)):
            if (d, k1, k2) == node:
                sha.update(b"," + text.encode())
                continue
            if node is not None:
                done.append((*node, sha.hexdigest()))
            node, sha = (d, k1, k2), hashlib.sha256(text.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*NODE, "sha"])
    if node is not None:
        yield row(node, sha.hexdigest())


def ends_of(every: DataFrame) -> DataFrame:
    """NODE and sha: the hash of the ids of the conversations that end at a node, in order.

    Ids are joined in texts of a few thousand by their leading digits; a hash runs through the texts of a node one by one.
    """
    texts = every.where("ends").groupBy(*NODE, F.shiftright("conv", ENDS).alias("part")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv")), lambda x: x.cast("string")), ",").alias("text"))
    ordered = texts.repartition(*(F.col(c) for c in NODE)).sortWithinPartitions(*NODE, "part").select(*NODE, "text")
    return ordered.mapInArrow(_digest, "depth long, k1 long, k2 long, sha string")


def trie(turns: DataFrame, scratch: Scratch, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True) -> DataFrame:
    """Every node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    every = paths(turns, scratch, conv, turn, role, text, rebuild)
    nodes = every.groupBy(*NODE).agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
    nodes = scratch.save(nodes, "nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    facts = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    facts = scratch.save(facts, "facts")
    own = facts.select(*NODE, "conv", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = roll_up(own, every, scratch)
    ends = scratch.save(ends_of(every), "ends")
    parent = facts.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv").alias("parent_conv_id"))
    whole = facts.join(sums, NODE).join(ends, NODE, "left").join(parent, ["depth", "p1", "p2"], "left")
    return whole.select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


def op12_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"), Scratch(spark))


#: CRC-32 of a text of digits, bit by bit; paths hold the whole prefix as text, so this suits small tables.
_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h
), steps AS (
  SELECT conv_id, text, row_number() OVER w AS depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS path FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
), every AS (
  SELECT conv_id, depth, path, text FROM steps UNION ALL SELECT conv_id, 0, '', '' FROM convs
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * len(regexp_extract_all(any_value(text), '[^\\x20\\x09-\\x0D]+')) AS own FROM every GROUP BY depth, path
), edges AS (
  SELECT n.depth, n.path, p.path AS above, p.conv_id AS parent FROM nodes n JOIN every e ON e.conv_id = n.conv_id AND e.depth = n.depth - 1 JOIN nodes p ON p.depth = e.depth AND p.path = e.path
), children AS (
  SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM edges GROUP BY 1, 2
), sums AS (
  SELECT e.depth, e.path, sum((c.n_children IS NULL)::BIGINT) AS n_leaves, sum(n.own) AS saved FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
  JOIN every e ON e.conv_id = n.conv_id AND e.depth <= n.depth GROUP BY e.depth, e.path
), ends AS (
  SELECT depth, path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, max(depth) AS depth FROM every GROUP BY conv_id) JOIN every USING (conv_id, depth) GROUP BY depth, path
)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, g.parent::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
  s.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.path = n.path LEFT JOIN edges g ON g.depth = n.depth AND g.path = n.path
LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path LEFT JOIN ends e ON e.depth = n.depth AND e.path = n.path
"""
ORACLE = {"op12_prefix_trie": _SQL}
