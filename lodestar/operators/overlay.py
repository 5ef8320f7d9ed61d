"""Union, difference, intersection and opening of polygons by scan lines, and the line along which two areas face each other.

An area is a set of spans: for each row of a given height, the stretches of its middle line that lie inside. Spans come from
the edges that cross the line, exact in x; in y an area is known to the row's height, so an area's error is at most its
outline's height times that of a row. Every operation is one sweep along each row: ends of spans are summed up in order, and
the stretches where the sums allow it are kept. Rows are worked out apart from one another, however many polygons they cross.

Rings count by even and odd crossings. Rings of one id are one polygon with holes where they overlap. Rows are numbered from
y = 0; rings with a null, infinite or missing point have to be cleaned before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import rings, timeops


def spans(polygons: DataFrame, height: float) -> DataFrame:
    """(id, row, lo, hi) of polygons(id, ring)."""
    e = polygons.where(F.size("ring") > 2).select("id", F.explode(rings.edges(rings.opened(F.col("ring").cast(rings.KIND)))).alias("e"))
    e = e.select("id", *(F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy")).where("ay <> by")
    # A middle line at or above the lower end and below the upper one is crossed.
    first, last = F.ceil(F.least("ay", "by") / height - 0.5).cast("long"), (F.ceil(F.greatest("ay", "by") / height - 0.5) - 1).cast("long")
    x = e.withColumn("_f", first).withColumn("_l", last).where("_f <= _l").withColumn("row", F.explode(F.sequence("_f", "_l")))
    y = (F.col("row") + 0.5) * height
    crossed = x.select("id", "row", (F.col("ax") + (F.col("bx") - F.col("ax")) * (y - F.col("ay")) / (F.col("by") - F.col("ay"))).alias("x"))
    w = Window.partitionBy("id", "row").orderBy("x")
    paired = crossed.withColumn("_n", F.row_number().over(w)).withColumn("hi", F.lead("x").over(w))
    return paired.where("_n % 2 = 1 AND hi > x").select("id", "row", F.col("x").alias("lo"), "hi")


def _swept(one: DataFrame, two: DataFrame | None, keep) -> DataFrame:
    """(row, lo, hi) where keep(n, m) holds for the numbers of spans of either side that lie over a stretch."""
    ends = lambda df, a, b: df.select("row", F.col("lo").alias("x"), F.lit(a).alias("n"), F.lit(b).alias("m")).unionByName(df.select("row", F.col("hi").alias("x"), F.lit(-a).alias("n"), F.lit(-b).alias("m")))
    every = ends(one, 1, 0) if two is None else ends(one, 1, 0).unionByName(ends(two, 0, 1))
    every = every.groupBy("row", "x").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    w = Window.partitionBy("row").orderBy("x")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = every.select("row", F.col("x").alias("lo"), F.lead("x").over(w).alias("hi"), F.sum("n").over(upto).alias("n"), F.sum("m").over(upto).alias("m"))
    kept = x.where(F.col("hi").isNotNull() & keep(F.col("n"), F.col("m"))).select("row", "lo", "hi")
    return timeops.merge_intervals(kept, "row", "lo", "hi")


def union(area: DataFrame) -> DataFrame:
    return _swept(area, None, lambda n, m: n > 0)


def minus(area: DataFrame, other: DataFrame) -> DataFrame:
    return _swept(area, other, lambda n, m: (n > 0) & (m <= 0))


def both(area: DataFrame, other: DataFrame) -> DataFrame:
    return _swept(area, other, lambda n, m: (n > 0) & (m > 0))


def _moved(area: DataFrame, radius: float, height: float, sign: int) -> tuple[DataFrame, int]:
    """Spans sent to all rows within the radius, longer or shorter by what the circle leaves there; and how many rows that is."""
    reach = int(radius / height)
    rows = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    x = area.select("row", "lo", "hi", rows.alias("_d"))
    by = F.sqrt(F.greatest(F.lit(0.0), F.lit(radius**2) - F.pow(F.col("_d") * height, 2))) * sign
    return x.select((F.col("row") + F.col("_d")).alias("row"), (F.col("lo") - by).alias("lo"), (F.col("hi") + by).alias("hi")).where("lo < hi"), 2 * reach + 1


def grown(area: DataFrame, radius: float, height: float) -> DataFrame:
    """Everything within the radius of the area."""
    return union(_moved(area, radius, height, 1)[0])


def shrunk(area: DataFrame, radius: float, height: float) -> DataFrame:
    """What is further than the radius from all outside: a stretch has to be inside in every row that the circle reaches."""
    sent, rows = _moved(union(area), radius, height, -1)
    return _swept(sent, None, lambda n, m: n >= rows)


def opened(area: DataFrame, radius: float, height: float) -> DataFrame:
    """The area without what is too thin for a circle of the radius."""
    return grown(shrunk(area, radius, height), radius, height)


def size(area: DataFrame, height: float) -> Column:
    """Total size, as an aggregate of spans that don't overlap."""
    return F.sum(F.col("hi") - F.col("lo")) * height


def outline(polygons: DataFrame, piece: float, height: float) -> DataFrame:
    """(id, ax, ay, bx, by): edges of the polygons in pieces no longer than asked, but for those inside another polygon."""
    e = polygons.where(F.size("ring") > 2).select("id", F.explode(rings.edges(rings.opened(F.col("ring").cast(rings.KIND)))).alias("e")).select("id", *(F.col(f"e.{p}.{c}").alias(f"{p}{c}") for p in "ab" for c in "xy"))
    x = e.withColumn("_n", F.greatest(F.lit(1), F.ceil(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / piece)).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = lambda c, i: F.col(f"a{c}") + (F.col(f"b{c}") - F.col(f"a{c}")) * i / F.col("_n")
    x = x.select("id", *(at(c, F.col("_i")).alias(f"_a{c}") for c in "xy"), *(at(c, F.col("_i") + 1).alias(f"_b{c}") for c in "xy")).withColumnsRenamed({f"_{p}{c}": f"{p}{c}" for p in "ab" for c in "xy"})
    x = _middled(x, height)
    hidden = x.join(spans(polygons, height).withColumnsRenamed({"id": "_other", "row": "_at"}), (F.col("_row") == F.col("_at")) & (F.col("id") != F.col("_other")) & (F.col("_x") > F.col("lo")) & (F.col("_x") < F.col("hi")), "left_anti")
    return hidden.drop("_x", "_row")


def _middled(pieces: DataFrame, height: float) -> DataFrame:
    return pieces.withColumn("_x", (F.col("ax") + F.col("bx")) / 2).withColumn("_row", F.floor((F.col("ay") + F.col("by")) / 2 / height).cast("long"))


def facing(pieces: DataFrame, area: DataFrame, reach: float, height: float) -> DataFrame:
    """The pieces (of `outline`) that come within reach of an area, by their middles, to the height of a row."""
    near = grown(area, reach, height).withColumnRenamed("row", "_at")
    met = _middled(pieces, height).join(near, (F.col("_row") == F.col("_at")) & (F.col("_x") >= F.col("lo")) & (F.col("_x") <= F.col("hi")), "left_semi")
    return met.drop("_x", "_row")


def front(occupied: DataFrame, country: DataFrame, sliver: float, reach: float, height: float, piece: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occupied and free area inside a country as spans, and the pieces of the occupied outline that face the free one.

    What is free but thinner than a circle of radius sliver doesn't count: outlines of unlike sources leave such slivers.
    """
    land = union(spans(country, height).select("row", "lo", "hi"))
    held = both(land, spans(occupied, height).select("row", "lo", "hi"))
    free = opened(minus(land, held), sliver, height)
    return held, free, facing(outline(occupied, piece or height, height), free, reach, height)


def length(pieces: DataFrame) -> Column:
    return F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
