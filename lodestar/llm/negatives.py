"""Hard negatives by the threshold algorithm over signed, sorted lists.

Rows are dealt into blocks of bounded size. A block keeps, for each dimension, its rows in order of that dimension's
integer value. An anchor walks all lists of a block side by side, from the top where its own component is positive and
from the bottom where it is negative; each row met is scored at once from all its components. What a row not yet met can
score is at most the sum of the anchor's components times the values where the lists stand, the threshold. The walk ends
when the threshold falls strictly below the k-th score of every window (a window that isn't full counts its lower end),
so that ties are all met and the smaller id wins them.

A unit of work is a block of anchors at a block of rows, and both travel to it by an equi join on their numbers. A first
round finds each anchor's positives, a second the negatives of each of its windows; what units find is merged by rank,
with a limit before the exchange.

Defined results: rows without an id, a label or a vector, or with a null or non-finite component, take no part; vectors of
unlike length are never compared; rows of one id are rows of their own, but none is a positive of another, and each of
them that is an anchor gives its own result; an empty vector scores 0; an empty table gives an empty result; other columns
are ignored. Scores are exact at any size; one that no long can hold is an error.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_batches

#: Positives of an anchor, negatives of a positive, and the least share of a positive's score, in hundredths.
POSITIVES, NEGATIVES, LEAST = 5, 5, 80
#: Every so many ids an anchor; rows of a block; anchors of a block; places first walked in each list.
EVERY, BLOCK, ANCHORS, FIRST = 100, 8192, 512, 16
SCALE = 256


class Block:
    """Rows in order of id, with each dimension's order and sorted values."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, values: np.ndarray, orders: np.ndarray | None = None):
        self.ids, self.labels, self.values = ids, labels, values
        self.orders = np.argsort(values.T, axis=1, kind="stable") if orders is None else orders
        self.sorted = np.take_along_axis(values.T, self.orders, 1)
        self.top = float(np.abs(values).max()) if values.size else 0.0
        self.exact: np.ndarray | None = None

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Inner products as integers; in double precision where no sum can pass 2^53."""
        if self.top * (np.abs(anchor).max() if len(anchor) else 0) * max(1, len(anchor)) < 2.0**53:
            return (self.values[rows] @ anchor).astype(np.int64)
        if self.exact is None:
            self.exact = np.array([[int(x) for x in v] for v in self.values.tolist()], object)
        return self.exact[rows] @ np.array([int(x) for x in anchor.tolist()], object)

    def walk(self, anchor: np.ndarray, first: int = FIRST) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """Rows newly met, their scores and the threshold, which is -inf when no row is left; ever longer steps."""
        n = len(self.ids)
        up, down = np.flatnonzero(anchor > 0), np.flatnonzero(anchor < 0)
        if not len(up) + len(down):
            every = np.arange(n)
            yield every, self.scores(every, anchor), -math.inf
            return
        seen, at, step = np.zeros(n, bool), 0, first
        while at < n:
            to = min(n, at + step)
            met = np.zeros(n, bool)
            met[self.orders[up, n - to : n - at]] = True
            met[self.orders[down, at:to]] = True
            new = np.flatnonzero(met & ~seen)
            seen[new] = True
            # Rounding may only raise the threshold, which walks further than needed.
            bound = float(anchor[up] @ self.sorted[up, n - to] + anchor[down] @ self.sorted[down, to - 1])
            bound += abs(bound) * 1e-12
            yield new, self.scores(new, anchor), -math.inf if to == n else bound
            at, step = to, 2 * step

    def best(self, anchor: np.ndarray, eligible: np.ndarray, windows: list[tuple[float, float]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (low, high) the first k eligible rows by score, then id, with low <= 100 * score <= 100 * high: rows and scores."""
        left = int(eligible.sum())
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for new, got, bound in self.walk(anchor) if left else ():
            fit = eligible[new]
            rows, scores = np.concatenate([rows, new[fit]]), np.concatenate([scores, got[fit]])
            left -= int(fit.sum())
            if not left:
                break
            if all(self._settled(scores, low, high, bound, k) for low, high in windows):
                break
        found = []
        for low, high in windows:
            inside = np.flatnonzero((scores * 100 >= low) & (scores <= high))
            order = sorted(inside.tolist(), key=lambda i: (-scores[i], rows[i])) if scores.dtype == object else inside[np.lexsort((rows[inside], -scores[inside]))]
            found.append((rows[order[:k]], scores[order[:k]]))
        return found

    @staticmethod
    def _settled(scores: np.ndarray, low: float, high: float, bound: float, k: int) -> bool:
        if 100 * bound < low:
            return True
        inside = scores[(scores * 100 >= low) & (scores <= high)]
        return len(inside) >= k and bound < (sorted(inside.tolist(), reverse=True)[k - 1] if inside.dtype == object else np.partition(inside, len(inside) - k)[len(inside) - k])


def _unpacked(rows: pa.ListScalar, width: int) -> tuple:
    """The columns of a packed list of structs as arrays, vectors as a matrix."""
    cells = rows.values
    flat = cells.field("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return cells, cells.field("id").to_numpy(zero_copy_only=False), cells.field("label").to_numpy(zero_copy_only=False), np.floor(flat.reshape(len(cells), width) * SCALE)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's arrays in order of id, with the order of each dimension."""
    for b in batches:
        for width, block, rows in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            _, ids, labels, values = _unpacked(rows, width)
            at = np.argsort(ids, kind="stable")
            made = Block(ids[at], labels[at], values[at])
            parts = (made.ids.astype("<i8"), made.labels.astype("<i8"), made.values.astype("<i4" if made.top < 2**31 else "<f8"), made.orders.astype("<i4"))
            yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)], names=["width", "block", "ids", "labels", "values", "orders"])


def _block_of(width: int, ids: bytes, labels: bytes, values: bytes, orders: bytes) -> Block:
    n = len(ids) // 8
    kind = "<i4" if len(values) == 4 * n * width else "<f8"
    return Block(np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8"), np.frombuffer(values, kind).reshape(n, width).astype(np.float64), np.frombuffer(orders, "<i4").reshape(width, n))


_FOUND = "group int, slot int, goal int, id long, score long"


def _round(index: DataFrame, anchors: DataFrame, blocks: int, groups: int, negatives: bool, k: int, least: int) -> DataFrame:
    """The first k of what units find: group and slot of the anchor, goal (number of the positive), id, score and rank."""
    deal = lambda df: df.repartition(max(1, min(4096, blocks * groups)), "block", "group")
    left = deal(index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))))
    right = deal(anchors.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    met = left.join(right.hint("merge"), ["block", "group"]).select(index["width"], "group", "ids", "labels", "values", "orders", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for width, group, *parts, rows in zip(*(c.to_pylist() for c in b.columns[:6]), b.column(6)):
                block = _block_of(width, *parts)
                cells, ids, labels, values = _unpacked(rows, width)
                slots, goals = cells.field("slot").to_pylist(), cells.field("goals").to_pylist() if negatives else None
                out: list[tuple] = []
                for i, (slot, anchor, label) in enumerate(zip(slots, ids.tolist(), labels.tolist())):
                    if negatives:
                        eligible, windows = block.labels != label, [(least * g["score"], g["score"]) for g in goals[i]]
                    else:
                        eligible, windows = (block.labels == label) & (block.ids != anchor), [(-math.inf, math.inf)]
                    for goal, (at, scores) in enumerate(block.best(values[i], eligible, windows, k)):
                        out += [(group, slot, goal, x, s) for x, s in zip(block.ids[at].tolist(), scores.tolist())]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names=["group", "slot", "goal", "id", "score"])

    order = Window.partitionBy("group", "slot", "goal").orderBy(F.desc("score"), "id")
    return met.mapInArrow(run, _FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, scratch: Scratch, key: str = "vec_id", column: str = "embedding", label: str = "label", every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, block: int = BLOCK, group: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score of every anchor (ids divisible by `every`)."""
    spark = vectors.sparkSession
    text_batches(spark, 8)
    raw = F.transform(F.col(column), lambda x: x.cast("double"))
    fit = F.col(key).isNotNull() & F.col(label).isNotNull() & F.coalesce(~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))
    rows = vectors.where(fit).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), raw.alias("v"), F.size(column).alias("width"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    rows = scratch.save(rows, "rows")
    parts = []
    # A row for each length of vector.
    for width, n, anchors in sorted(map(tuple, rows.groupBy("width").agg(F.count("*"), F.sum((F.col("id") % every == 0).cast("long"))).collect())):
        if anchors:
            own = rows.where(F.col("width") == width)
            parts.append(_mine(own, scratch, str(width), every, math.ceil(n / block), math.ceil(anchors / group), positives, negatives, least))
    if not parts:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return functools.reduce(DataFrame.unionByName, parts)


def _mine(rows: DataFrame, scratch: Scratch, tag: str, every: int, blocks: int, groups: int, positives: int, negatives: int, least: int) -> DataFrame:
    """What `mine` gives, for rows(id, label, v, width, deal) of one length of vector."""
    packed = rows.withColumn("block", F.pmod("deal", F.lit(blocks)).cast("int")).groupBy("width", "block").agg(F.collect_list(F.struct("id", "label", "v")).alias("rows"))
    index = scratch.save(packed.mapInArrow(_index, "width int, block int, ids binary, labels binary, values binary, orders binary"), f"index{tag}", "zstd")
    anchors = rows.where(F.col("id") % every == 0).withColumn("group", F.pmod("deal", F.lit(groups)).cast("int"))
    anchors = scratch.save(anchors.withColumn("slot", F.row_number().over(Window.partitionBy("group").orderBy("id", "deal"))), f"anchors{tag}")
    grouped = lambda df, *more: df.groupBy("group").agg(F.collect_list(F.struct("id", "label", "v", "slot", *more)).alias("rows"))
    best = scratch.save(_round(index, grouped(anchors), blocks, groups, False, positives, least), f"positives{tag}")
    goals = best.groupBy("group", "slot").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("goals"))
    aimed = scratch.save(anchors.join(goals, ["group", "slot"]), f"aimed{tag}")
    hard = scratch.save(_round(index, grouped(aimed, "goals"), blocks, groups, True, negatives, least), f"negatives{tag}")
    each = aimed.select("group", "slot", F.col("id").alias("anchor_id"), F.posexplode("goals").alias("goal", "p"))
    joined = hard.join(each, ["group", "slot", "goal"])
    return joined.select("anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", moved), Scratch(spark))


_SQL = """
WITH kept AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
)
SELECT * FROM ranked WHERE rank <= 5
"""
ORACLE = {"op13_hard_negatives": _SQL}
