"""What is known of every region at the end of every block of hours: the twenty-five inputs of the danger forecast, and its targets.

Regions by blocks are one grid. Alerts are spread over the blocks they run through and added up, all trailing sums of a region
come from one exchange by region, the country's from one row a block, and the neighbours' means from a join of the grid with
pairs of neighbours. Attacks are known some days late: their sums end that many days before the block's. Nothing of a
block's future is read but for the targets, which are null in the last one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOURS, LAG_DAYS, LONGEST_H = 6, 5, 24 * 30
MONTH = 29.530588853
FEATURES = ["region", "block_of_day", "dow", "month_sin", "month_cos", "moon", "m_1", "m_4", "m_28", "m_120", "starts_4", "active_at_issue", "since_last_h", "nb_m_1", "nb_m_4", "nat_m_1", "nat_m_4",
            "nat_regions_1", "nat_regions_4", "cloud", "precip", "wind", "attacks_region_7d", "attacks_national_7d", "attacks_region_28d"]


def moon(at: Column) -> Column:
    """Share of the moon that is lit at epoch seconds, from its age since a known new moon."""
    days = (at - F.lit(947182440.0)) / 86400
    return (1 - F.cos(2 * math.pi * F.pmod(days, F.lit(MONTH)) / MONTH)) / 2


def alert_blocks(alerts: DataFrame, origin: Column, blocks: int, hours: int = HOURS) -> DataFrame:
    """Alerts (region, start, end; epoch seconds) by region and block: minutes, starts, running (at the block's end), ended (hours since the origin).

    What ends by the origin or starts after the last block is left out; what runs longer is cut to the blocks.
    """
    size = hours * 3600
    x = alerts.select("region", (F.col("start") - origin).cast("double").alias("a"), (F.col("end") - origin).cast("double").alias("b")).where("b > 0").withColumn("a", F.greatest("a", F.lit(0.0)))
    x = x.withColumn("first", F.floor(F.col("a") / size)).withColumn("last", F.floor(F.least(F.col("b"), F.lit(float(blocks * size - 1))) / size)).where((F.col("first") < blocks) & (F.col("last") >= F.col("first")))
    x = x.withColumn("block", F.explode(F.sequence("first", "last")))
    low, high = F.col("block") * size, (F.col("block") + 1) * size
    minutes = (F.least(F.col("b"), high) - F.greatest(F.col("a"), low)) / 60
    return x.groupBy("region", "block").agg(F.sum(minutes).alias("minutes"), F.count_if(F.col("block") == F.col("first")).alias("starts"), F.max((F.col("b") >= high).cast("int")).alias("running"), F.max(F.when(F.col("block") == F.col("last"), F.col("b") / 3600)).alias("ended"))


def features(regions: DataFrame, alerts: DataFrame, attacks: DataFrame, weather: DataFrame, neighbours: DataFrame, origin: Column, blocks: int, hours: int = HOURS, lag: int = LAG_DAYS) -> DataFrame:
    """A row for each region(region) and block with FEATURES, block, y_active and y_new.

    origin: epoch seconds of a day's start. attacks: region, day (one row each); weather: region, day, cloud, precip, wind;
    neighbours: a, b, each pair both ways. A region without neighbours has 0 of them; without weather, nulls.
    """
    daily = 24 // hours
    size = hours * 3600
    grid = regions.select("region").where("region IS NOT NULL").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    x = grid.join(alert_blocks(alerts, origin, blocks, hours), ["region", "block"], "left").na.fill(0, ["minutes", "starts", "running"])
    w = Window.partitionBy("region").orderBy("block")
    back = lambda c, n: F.sum(c).over(w.rowsBetween(1 - n, 0))
    ended = F.last("ended", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    quiet = F.coalesce(F.greatest(F.lit(0.0), F.least((F.col("block") + 1) * hours - ended, F.lit(float(LONGEST_H)))), F.lit(float(LONGEST_H)))
    x = x.select(
        "region", "block", F.col("minutes").alias("m_1"), *(back("minutes", n).alias(f"m_{n}") for n in (4, 28, 120)), back("starts", 4).alias("starts_4"), F.col("running").alias("active_at_issue"),
        F.when(F.col("running") == 1, 0.0).otherwise(quiet).alias("since_last_h"), (F.lead("minutes").over(w) > 0).cast("int").alias("y_active"), (F.lead("starts").over(w) > 0).cast("int").alias("y_new"))

    around = neighbours.select(F.col("a").alias("of"), F.col("b").alias("region")).where("of <> region").distinct()
    near = x.select("region", "block", "m_1", "m_4").join(around, "region").groupBy(F.col("of").alias("region"), "block").agg(F.avg("m_1").alias("nb_m_1"), F.avg("m_4").alias("nb_m_4"))
    # One row for each block of the whole country.
    whole = x.groupBy("block").agg(F.sum("m_1").alias("nat_m_1"), F.count_if(F.col("m_1") > 0).alias("nat_regions_1"))
    four = Window.orderBy("block").rowsBetween(-3, 0)
    whole = whole.select("*", F.sum("nat_m_1").over(four).alias("nat_m_4"), F.sum("nat_regions_1").over(four).alias("nat_regions_4"))

    issue = origin + (F.col("block") + 1) * size
    day = F.to_date(F.timestamp_seconds(issue))
    x = x.join(near, ["region", "block"], "left").na.fill(0, ["nb_m_1", "nb_m_4"]).join(whole, "block").withColumn("day", day)
    x = x.join(_late_sums(attacks, lag), ["region", "day"], "left").join(_late_national(attacks, lag), "day", "left").na.fill(0, ["attacks_region_7d", "attacks_region_28d", "attacks_national_7d"])
    x = x.join(weather.select("region", "day", "cloud", "precip", "wind"), ["region", "day"], "left")
    month = F.month("day")
    return x.withColumns({
        "block_of_day": ((F.col("block") + 1) % daily).cast("int"), "dow": F.weekday("day"), "month_sin": F.sin(2 * math.pi * month / 12), "month_cos": F.cos(2 * math.pi * month / 12), "moon": moon(issue + size / 2),
    }).select("block", *FEATURES, "y_active", "y_new")


def _spread(counts: DataFrame, keys: list[str], lag: int, days: int, name: str) -> DataFrame:
    """Sums of n over so many days that end `lag` days before each day: every count goes to all days that see it."""
    seen = counts.withColumn("day", F.explode(F.sequence(F.date_add("day", lag), F.date_add("day", lag + days - 1))))
    return seen.groupBy(*keys, "day").agg(F.sum("n").alias(name))


def _late_sums(attacks: DataFrame, lag: int) -> DataFrame:
    counts = attacks.where("region IS NOT NULL AND day IS NOT NULL").groupBy("region", "day").agg(F.count("*").alias("n"))
    seven, month = (_spread(counts, ["region"], lag, d, f"attacks_region_{d}d") for d in (7, 28))
    return month.join(seven, ["region", "day"], "left")


def _late_national(attacks: DataFrame, lag: int) -> DataFrame:
    return _spread(attacks.where("region IS NOT NULL AND day IS NOT NULL").groupBy("day").agg(F.count("*").alias("n")), [], lag, 7, "attacks_national_7d")
