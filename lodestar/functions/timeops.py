"""Operators over event time: sessions, islands, spines, interval unions, as-of joins and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))


def seconds_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / 1e6


def block_index(ts: Column, origin: Column, hours: int = 6) -> Column:
    """Number of the block of so many hours that a time falls in, counted from the origin."""
    return F.floor((micros(ts) - micros(origin)) / (hours * 3.6e9)).cast("long")


def bucket(ts: Column, seconds: int) -> Column:
    """Start of the bucket, as epoch seconds."""
    return (F.floor(micros(ts) / (seconds * 1e6)) * seconds).cast("long")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: float, tie: str | None = None, extra_break: Column | None = None, out: str = "session") -> DataFrame:
    """Number sessions of each key: a new one begins after a gap longer than asked, or where extra_break holds."""
    w = Window.partitionBy(key).orderBy(*([ts, tie] if tie else [ts]))
    gap = seconds_between(F.lag(ts).over(w), F.col(ts))
    new = gap.isNull() | (gap > gap_seconds)
    if extra_break is not None:
        new = new | F.coalesce(extra_break, F.lit(False))
    marked = df.withColumn("_new", new.cast("int"))
    return marked.withColumn(out, F.sum("_new").over(w).cast("long")).drop("_new")


def islands(df: DataFrame, key: str, order: str, condition: Column, step: int = 1) -> DataFrame:
    """Runs of consecutive steps of an integer column on which the condition holds: key, first, last, length."""
    held = df.where(condition).select(key, F.col(order).alias("_o")).distinct()
    w = Window.partitionBy(key).orderBy("_o")
    runs = held.withColumn("_g", F.col("_o") - F.row_number().over(w) * step)
    return runs.groupBy(key, "_g").agg(F.min("_o").alias("first"), F.max("_o").alias("last"), F.count("*").alias("length")).drop("_g")


def merge_intervals(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Union of each key's intervals; those that overlap or touch become one."""
    w = Window.partitionBy(key).orderBy(start, end)
    seen = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (seen.isNull() | (seen < F.col(start))).cast("int"))
    grouped = marked.withColumn("_island", F.sum("_new").over(w))
    return grouped.groupBy(key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Length shared by two intervals of numbers, 0 if they are apart."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def asof(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, value: str, strict: bool = False, out: str | None = None) -> DataFrame:
    """Last non-null value of right at or before (strict: before) each left row, without a range join.

    Both sides are laid out by key and time in one window; the rows of right only pass their value on.
    """
    out = out or value
    rank = F.lit(1 if strict else -1)  # at equal times a strict lookup must not see the right row yet
    cols = left.columns
    a = left.withColumn("_t", F.col(left_ts)).withColumn("_side", F.lit(0)).withColumn("_v", F.lit(None).cast(right.schema[value].dataType))
    b = right.select(F.col(key), F.col(right_ts).alias("_t"), rank.alias("_side"), F.col(value).alias("_v"))
    for c in cols:
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b.select(*a.columns)).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 0").select(*cols, out)


def rolling(column: str, key: str, order: str, size: int, shift: int = 0, how=F.sum) -> Column:
    """Aggregate over the `size` rows that end `shift` rows before the current one."""
    return how(column).over(Window.partitionBy(key).orderBy(order).rowsBetween(-(size - 1) - shift, -shift))


def forward_fill(column: str, key: str, order: str) -> Column:
    return F.last(column, ignorenulls=True).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def spine(keys: DataFrame, first: Column, last: Column, step: Column, out: str) -> DataFrame:
    """Each row of keys at every step from first to last."""
    return keys.withColumn(out, F.explode(F.sequence(first, last, step)))


def greedy_fold(values: Column, keep, kind: str) -> Column:
    """Left fold that keeps an element if keep(last kept, element) holds; the first is always kept."""
    empty = F.array().cast(f"array<{kind}>")
    return F.aggregate(values, empty, lambda acc, x: F.when((F.size(acc) == 0) | keep(F.element_at(acc, -1), x), F.concat(acc, F.array(x))).otherwise(acc))


def cooldown(values: Column, gap, kind: str = "bigint") -> Column:
    """Times that fire when each waits for the last one fired, not for the last one seen."""
    return greedy_fold(values, lambda last, x: x >= last + gap, kind)
