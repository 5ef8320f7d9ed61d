"""Packing documents into training windows by multiway Karmarkar-Karp differencing.

A document is its ids and an end id. Whole windows are cut off its front; the rest is one item. Items are dealt
into groups of bounded size. In a group, differencing keeps partial partitions in a heap by imbalance and merges
the two most unbalanced so that large sums meet small ones, which gives near-equal windows; the number of
windows starts at the least that could hold the group and rises whenever a window exceeds the capacity.

Defined results: null text is the empty text (one end id); repeated rows are packed as often as they come;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, text_batches, unsigned_crc
from .tokens import Encoder

CAPACITY, END, GROUP = 4096, 2, 1500
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, directory: str | None = None) -> DataFrame:
    """One row for each piece of each document: whole windows, then what remains."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer, directory)
        for b in batches:
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encoder.encode(b.column(1).to_pylist())):
                ids = np.append(ids, np.uint32(END))
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    rows.append((doc, a, len(part), unsigned_crc(part), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(5)], names=[f.split()[0] for f in PIECE.split(", ")])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, PIECE)


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """Set 0..k-1 of each size by the multiway largest differencing method."""
    n = len(sizes)
    if k <= 1:
        return np.zeros(n, np.int64)
    # A partial partition is k sums in ascending order with a node each; node 0 is the empty set.
    left, right = [-1] * (n + 1), [-1] * (n + 1)
    heap = []
    order = np.argsort(-sizes, kind="stable")
    for rank, i in enumerate(order):
        sums, nodes = np.zeros(k, np.int64), np.zeros(k, np.int64)
        sums[-1], nodes[-1] = sizes[i], i + 1
        heap.append((-int(sizes[i]), rank, sums, nodes))
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        sums, other = sa + sb[::-1], nb[::-1]
        both = np.flatnonzero((na > 0) & (other > 0))
        nodes = np.where(na > 0, na, other)
        if len(both):
            fresh = np.arange(len(left), len(left) + len(both))
            left.extend(na[both].tolist())
            right.extend(other[both].tolist())
            nodes[both] = fresh
        at = np.argsort(sums, kind="stable")
        sums, nodes = sums[at], nodes[at]
        sums = sums - sums[0]
        tick += 1
        heapq.heappush(heap, (-int(sums[-1]), tick, sums, nodes))
    out = np.zeros(n, np.int64)
    for window, node in enumerate(heap[0][3].tolist()):
        stack = [node]
        while stack:
            x = stack.pop()
            if x <= 0:
                continue
            if x <= n:
                out[x - 1] = window
            else:
                stack += (left[x], right[x])
    return out


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Window of each size such that none exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = difference(sizes, k)
        over = int(np.bincount(at, weights=sizes, minlength=k).max()) - capacity
        if over <= 0:
            return at
        k = min(len(sizes), k + max(1, over * k // (4 * capacity)))


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """Give every piece its sequence_id and its gapless offset there."""
    items = scratch.save(items.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    n = items.where(F.col("length") < capacity).count()
    groups = max(1, -(-n // group))
    # A row's number, not its document, decides its group: many equal rows must not meet in one.
    dealt = items.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row", kind="stable").reset_index(drop=True)
        at = windows(rows["length"].to_numpy(np.int64), capacity)
        rows = rows.iloc[np.argsort(at, kind="stable")].reset_index(drop=True)
        at = np.sort(at, kind="stable")
        # Group and window in one number; whole windows take the odd ones.
        rows["sequence_id"] = ((rows["_group"].to_numpy(np.int64) << 20) + at) * 2
        ends = rows.groupby("sequence_id")["length"].cumsum()
        rows["offset"] = ends - rows["length"]
        return rows[[f.split()[0] for f in PIECE.split(", ")] + ["sequence_id", "offset"]]

    packed = dealt.where(F.col("length") < capacity).groupBy("_group").applyInPandas(run, PIECE + ", sequence_id long, offset long")
    whole = items.where(F.col("length") == capacity).withColumn("sequence_id", F.col("_row") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(whole.drop("_row"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(pieces(docs), Scratch(spark))
