"""Keyed state over streams, each with a batch twin of the same result.

The clock is event time throughout, given by a column, so that replays agree; time-to-live and cooldown are
parameters. Streams use transformations that Structured Streaming can checkpoint and restore.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.functions import timeops


def current(updates: DataFrame, key: str, ts: str, arrival: str) -> DataFrame:
    """Newest state of each key: older times lose, of equal times the later arrival wins."""
    rest = [c for c in updates.columns if c not in (key, ts, arrival)]
    return updates.groupBy(key).agg(F.max(F.struct(ts, arrival, *rest)).alias("s")).select(key, "s.*")


def alive(state: DataFrame, kind: str, seen: str, now: Column, ttl_seconds: dict[str, int]) -> DataFrame:
    """Rows seen within their kind's time to live; a kind without one lives on."""
    limit = F.create_map(*(x for k, v in ttl_seconds.items() for x in (F.lit(k), F.lit(v))))[F.col(kind)]
    return state.where(limit.isNull() | (timeops.seconds_between(F.col(seen), now) <= limit))


def fold_by_key(df: DataFrame, key: list[str], ts: str, tie: str, fold: Callable[[tuple | None, np.ndarray, np.ndarray | None], tuple[np.ndarray, tuple | None]], value: str | None = None) -> DataFrame:
    """Rows that a greedy rule keeps, in order of time. fold is given the last row kept (microseconds, value) and a run of a key's
    times and values as arrays, and gives which rows are kept and the last one.

    A key's rows stream through one sorted partition in batches, so memory holds a batch and one kept row, not the key's history.
    """
    cols = list(dict.fromkeys([*key, ts, tie, *([value] if value else [])]))
    ordered = df.select(*cols).repartition(*key).sortWithinPartitions(*key, ts, tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(cols.index(c)).to_pylist() for c in key)))
            times = b.column(cols.index(ts)).cast(pa.int64()).to_numpy(zero_copy_only=False)
            values = b.column(cols.index(value)).to_numpy(zero_copy_only=False).astype(float) if value else None
            kept = np.zeros(len(keys), bool)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if keys[i] != at:
                    at, last = keys[i], None
                kept[i:j], last = fold(last, times[i:j], None if values is None else values[i:j])
            yield b.filter(pa.array(kept))

    return ordered.mapInArrow(run, ordered.schema)


def cooldown(df: DataFrame, key: list[str], ts: str, tie: str, seconds: float) -> DataFrame:
    """Rows that fire: the first of a key, then each that comes at least so long after the last that fired. Times may not be null."""
    gap = int(seconds * 1e6)

    def fold(last: tuple | None, times: np.ndarray, _) -> tuple[np.ndarray, tuple | None]:
        kept = np.zeros(len(times), bool)
        i = 0 if last is None else int(times.searchsorted(last[0] + gap))
        while i < len(times):  # from one that fires straight to the next
            kept[i], last = True, (int(times[i]),)
            i = max(i + 1, int(times.searchsorted(last[0] + gap)))
        return kept, last

    return fold_by_key(df, key, ts, tie, fold)


def thin(df: DataFrame, key: str, ts: str, tie: str, value: str, seconds: float, change: float) -> DataFrame:
    """Rows far enough from the last kept one in time or in value; repeats of its time go. A value that is missing is no change."""
    step = int(seconds * 1e6)

    def fold(last: tuple | None, times: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, tuple | None]:
        kept = np.zeros(len(times), bool)
        for i, (t, v) in enumerate(zip(times.tolist(), values.tolist())):
            if last is None or t > last[0] and (t - last[0] >= step or abs(v - last[1]) >= change):
                kept[i], last = True, (t, v)
        return kept, last

    return fold_by_key(df, [key], ts, tie, fold, value)


def confirm(df: DataFrame, key: str, order: str, leader: str, ticks: int) -> DataFrame:
    """Rows where a new leader has led for so many ticks in a row: key, order, leader, and the confirmed one before.

    Runs of one leader are islands; a run counts from its tick-th row, if its leader differs from the last confirmed.
    """
    w = Window.partitionBy(key).orderBy(order)
    x = df.withColumn("_new", (~F.lag(leader).over(w).eqNullSafe(F.col(leader))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    x = x.withColumn("_n", F.row_number().over(Window.partitionBy(key, "_run").orderBy(order))).where(F.col("_n") == ticks)
    before = F.lag(leader).over(w)
    return x.withColumn("before", before).where(~F.col("before").eqNullSafe(F.col(leader))).select(key, order, leader, "before")


def stream_cooldown(stream: DataFrame, key: str, ts: str, seconds: float, watermark: str = "1 hour") -> DataFrame:
    """Cooldown over a stream: state holds the time each key last fired."""
    schema = f"{key} {dict(stream.dtypes)[key]}, {ts} timestamp"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(x for b in batches for x in b[ts]):
            us = int(t.timestamp() * 1e6)
            if last is None or us >= last + seconds * 1e6:
                last = us
                out.append(t)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max(int(last / 1e3 + seconds * 1e3), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), ts: out})

    return stream.withWatermark(ts, watermark).groupBy(key).applyInPandasWithState(run, schema, "last long", "append", GroupStateTimeout.EventTimeTimeout)


def stream_current(stream: DataFrame, key: str, ts: str, arrival: str) -> DataFrame:
    """Newest state of each key as an updating aggregate."""
    rest = [c for c in stream.columns if c not in (key, ts, arrival)]
    return stream.groupBy(key).agg(F.max(F.struct(ts, arrival, *rest)).alias("s")).select(key, "s.*")


def stream_tumbling(stream: DataFrame, ts: str, size: str, late: str, *aggregates: Column) -> DataFrame:
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size)).agg(*aggregates)


def stream_relations(stream: DataFrame, id_: str, ts: str, late: str) -> DataFrame:
    """First of each id; repeats within the lateness go."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([id_])
