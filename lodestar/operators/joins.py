"""Joins that Spark lacks as such: by radius, by nearest, by narrowest range, by key priority.

A pure range condition plans as a nested loop over all pairs. Each helper here turns it into an equi join on grid
cells or buckets that one side is spread over, and checks the exact condition on what meets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import geo

#: Largest side, in rows, that is sent to every executor whole.
SMALL_ROWS = 50_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df marked for broadcast if a count says it is small enough, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: Units of work (rows made, pairs met) that one task is dealt.
PER_TASK = 4_000_000


def spread(df: DataFrame, work: float = 1.0, *keys: str, rows: int | None = None) -> DataFrame:
    """df dealt to as many tasks as its rows need, each of which makes so much work; by keys if given.

    A file of few bytes is one task and adaptive execution joins small exchanges, however much each of their rows makes.
    """
    n = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(n * work / PER_TASK)), *keys)


def within_radius(left: DataFrame, right: DataFrame, km: float, a: tuple[str, str], b: tuple[str, str], out: str = "km", radius: float = geo.RADIUS, own: str | None = None) -> DataFrame:
    """Pairs at most km apart, with their distance. Column names of the two sides must differ.

    Rows of right are spread over the latitude bands and the longitude cells that their circle touches; own names a column
    with a smaller radius of each row. Cells are half a radius wide. Of full cells the left rows are cut into parts that meet the
    right ones each for itself, and tasks are as many as the pairs need.
    """
    step = max(km / 220.0, 0.05)
    bands = int(math.ceil(180 / step))
    row = lambda lat: F.floor((lat + 90) / step)
    # Cells of a band are as wide in degrees as its edge nearer the pole needs; near a pole one cell spans the band.
    edge = F.least(F.greatest(F.abs(F.col("_row") * step - 90), F.abs((F.col("_row") + 1) * step - 90)), F.lit(90.0))
    cells = F.greatest(F.floor(360.0 / (step / F.greatest(F.cos(F.radians(edge)), F.lit(1e-6)))), F.lit(1)).cast("long")
    l = left.where(F.col(a[0]).isNotNull() & F.col(a[1]).isNotNull()).withColumn("_row", row(F.col(a[1]))).withColumn("_cells", cells)
    l = l.withColumn("_cell", F.floor(F.pmod(F.col(a[0]) + 180, F.lit(360.0)) / 360.0 * F.col("_cells")))
    # A degree is no less than 110 km; the circle's half width in longitude is exact but for a margin, and all round where it holds a pole.
    most = F.lit(float(km)) if own is None else F.least(F.col(own), F.lit(float(km)))
    tall = most / 110.0 + 1e-6
    wide = F.when(F.abs(F.col(b[1])) + tall >= 90, 180.0).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.radians(tall)) / F.cos(F.radians(F.col(b[1])))))) + 1e-6)
    r = right.where(F.col(b[0]).isNotNull() & F.col(b[1]).isNotNull()).withColumn("_wide", wide)
    r = r.withColumn("_row", F.explode(F.sequence(F.greatest(row(F.col(b[1]) - tall), F.lit(0)), F.least(row(F.col(b[1]) + tall), F.lit(bands))))).withColumn("_cells", cells)
    at = lambda lon: F.floor((lon + 180) / 360.0 * F.col("_cells"))
    first = at(F.pmod(F.col(b[0]) + 180, F.lit(360.0)) - 180 - F.col("_wide"))
    last = F.least(at(F.pmod(F.col(b[0]) + 180, F.lit(360.0)) - 180 + F.col("_wide")), first + F.col("_cells") - 1)
    r = r.withColumn("_cell", F.explode(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.col("_cells"))))).drop("_cells", "_wide")
    d = geo.haversine(a[0], a[1], b[0], b[1], radius)
    met = _meet(l.drop("_cells"), r, ["_row", "_cell"])
    return met.withColumn(out, d).where(F.col(out) <= (km if own is None else most)).drop("_row", "_cell")


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """left join right on keys, in tasks of about PER_TASK pairs: the left rows of a key with more are cut into parts."""
    full = left.groupBy(*keys).agg(F.count("*").alias("_nl")).join(right.groupBy(*keys).agg(F.count("*").alias("_nr")), keys)
    full = full.withColumn("_met", F.col("_nl") * F.col("_nr"))
    pairs = full.agg(F.sum("_met")).first()[0] or 0
    hot = small(full.where(F.col("_met") > PER_TASK).select(*keys, F.ceil(F.col("_met") / F.lit(float(PER_TASK))).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    l = left.join(hot, keys, "left").withColumn("_part", F.floor(F.rand(7) * parts).cast("int")).drop("_parts")
    r = right.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    by = [*keys, "_part"]
    return spread(l, 1, *by, rows=pairs).join(spread(r, 1, *by, rows=pairs), by).drop("_part")


def nearest(points: DataFrame, places: list[tuple[str, float, float]], lon: str, lat: str, out: str = "place", radius_km: float | None = None) -> DataFrame:
    """Name and distance of the nearest of a few fixed places, in the row itself, so nothing is exchanged.

    The nearest centre is chosen first; only then may the radius reject it.
    """
    options = F.array(*(F.struct(geo.haversine(lon, lat, x, y).alias("km"), F.lit(name).alias("name")) for name, x, y in places))
    best = F.array_min(options)
    name = best["name"] if radius_km is None else F.when(best["km"] <= radius_km, best["name"])
    return points.withColumn(out, name).withColumn(f"{out}_km", best["km"])


def narrowest_range(values: DataFrame, ranges: DataFrame, value: str, low: str, high: str, key: str, shift: int = 10) -> DataFrame:
    """For each distinct value, the row of the narrowest range that holds it. Wide ranges are spread over buckets of 2^shift."""
    spread = ranges.withColumn("_b", F.explode(F.sequence(F.shiftright(low, shift), F.shiftright(high, shift))))
    hits = values.select(value).distinct().withColumn("_b", F.shiftright(value, shift)).join(spread, "_b").where(F.col(value).between(F.col(low), F.col(high)))
    return hits.groupBy(value).agg(F.min_by(F.struct(*ranges.columns), F.struct(F.col(high) - F.col(low), key)).alias("_r")).select(value, "_r.*")


def by_priority(left: DataFrame, index: DataFrame, keys: list[tuple[str, str]], value: str, order: str, out: str) -> DataFrame:
    """Value found by the first key of the list that matches; of equal keys in the index the last by order wins."""
    found = []
    for i, (mine, theirs) in enumerate(keys):
        last = index.where(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.max_by(value, order).alias(f"_v{i}"))
        left = left.join(last, left[mine] == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        found.append(f"_v{i}")
    return left.withColumn(out, F.coalesce(*found)).drop(*found)


def top_n(df: DataFrame, key: str | list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """First n rows of each key. Spark limits groups before the exchange where the filter stands on the rank."""
    keys = [key] if isinstance(key, str) else key
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)
