"""Capped additive evidence scores, ranks over everything, and scores as of past days."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.scratch import Rounds

EVIDENCE = ("entity", "signal", "reason", "points", "evidence_ref", "provenance", "source")


def award(rows: DataFrame, entity: str, signal: str, each: float, cap: int | None, order: list[Column], reason: Column, ref: Column, provenance: str = "observed", source: str = "events") -> DataFrame:
    """Evidence rows of a signal: the first cap / each rows of each entity count, every one with reason and reference."""
    if cap is not None:
        w = Window.partitionBy(entity).orderBy(*order)
        rows = rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= -(-cap // each))
    return rows.select(F.col(entity).alias("entity"), F.lit(signal).alias("signal"), reason.alias("reason"), F.lit(float(each)).alias("points"), ref.cast("string").alias("evidence_ref"), F.lit(provenance).alias("provenance"), F.lit(source).alias("source"))


def breakdown(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def scores(entities: DataFrame, evidence: DataFrame, key: str, most: int = 100, reasons: int = 3) -> DataFrame:
    """Each entity's points, capped risk, its strongest reasons and its rank; entities without evidence score 0.

    One aggregate with map-side combine gives sums; the reasons come from a ranked short list of each entity. Evidence is
    written once, as both read it.
    """
    evidence = Rounds(evidence.sparkSession).keep(evidence.select("entity", "signal", "reason", "points", "evidence_ref"), "evidence")
    sums = evidence.groupBy("entity").agg(F.sum("points").alias("raw_points"))
    w = Window.partitionBy("entity").orderBy(F.desc("points"), "signal", "evidence_ref")
    best = evidence.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= reasons)
    top = best.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "reason"))), lambda x: x["reason"]), "; ").alias("reasons"))
    out = entities.join(sums.join(top, "entity"), entities[key] == F.col("entity"), "left").drop("entity")
    out = out.withColumn("raw_points", F.coalesce("raw_points", F.lit(0.0))).withColumn("risk", F.least(F.col("raw_points"), F.lit(float(most)))).withColumn("reasons", F.coalesce("reasons", F.lit("")))
    return global_rank(out, [F.desc("risk"), F.desc("raw_points"), F.asc(key)])


def global_rank(df: DataFrame, order: list[Column], out: str = "rank", parts: int | None = None) -> DataFrame:
    """Row number over all rows without bringing them into one task.

    Rows are split into ranges of the order and numbered inside each; a range's start is the count of the ranges
    before it, a table with one row for each range.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Written, because numbers and sizes must see the same ranges, whose bounds are sampled, even if an executor is lost.
    split = Rounds(df.sparkSession).keep(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    w = Window.partitionBy("_part").orderBy(*order)
    numbered = split.withColumn("_n", F.row_number().over(w))
    sizes = split.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return numbered.join(before, "_part").withColumn(out, (F.col("_n") + F.col("_before")).cast("int")).drop("_part", "_n", "_before")


def trend(events: DataFrame, entity: str, signal: str, ts: str, steps: list[str], cap: int, each: int, most: int = 100) -> DataFrame:
    """Score of each entity as of the end of each step day."""
    days = [F.lit(s).cast("date") for s in sorted(steps)]
    first = F.when(F.col(ts).cast("date") <= days[0], days[0])
    for d in days[1:]:
        first = first.when(F.col(ts).cast("date") <= d, d)
    n = events.withColumn("step", first).groupBy(entity, signal, "step").agg(F.count("*").alias("n")).where("step IS NOT NULL")
    w = Window.partitionBy(entity, signal).orderBy("step")
    grid = events.select(entity, signal).distinct().withColumn("step", F.explode(F.array(*days)))
    run = grid.join(n, [entity, signal, "step"], "left").withColumn("n", F.coalesce(F.sum("n").over(w), F.lit(0)))
    return run.groupBy(entity, "step").agg(F.least(F.sum(F.least(F.col("n"), F.lit(cap)) * each), F.lit(most)).cast("long").alias("score"))
