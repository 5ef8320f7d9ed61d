"""Scores of probabilistic forecasts and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.scratch import Rounds


def brier(p: str, y: str) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def log_loss(p: str, y: str, edge: float = 1e-15) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(edge)), F.lit(1 - edge))
    return F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q)))


def roc_auc(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Rank-sum AUC by group; a group of one class has no row. Scores are counted first, so that what is ranked is
    the distinct scores, not the rows."""
    by = by or []
    n = df.groupBy(*by, p).agg(F.sum((F.col(y) == 1).cast("long")).alias("pos"), F.sum((F.col(y) == 0).cast("long")).alias("neg"))
    # Ranges of scores are summed apart from one another, and each begins with what the ranges before it hold.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = Rounds(df.sparkSession).keep(n.repartitionByRange(parts, *by, p).withColumn("_part", F.spark_partition_id()), "scores")
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = split.groupBy(*by, "_part").agg(F.sum("neg").alias("_neg")).withColumn("_base", F.coalesce(F.sum("_neg").over(before), F.lit(0))).drop("_neg")
    w = Window.partitionBy(*by, "_part").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    inside = split.withColumn("below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    n = inside.join(base, [*by, "_part"]).withColumn("below", F.col("below") + F.col("_base"))
    g = n.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    return g.where("np > 0 AND nn > 0").select(*by, (F.col("u") / (F.col("np") * F.col("nn"))).alias("auc"))


def reliability(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    b = F.least(F.greatest(F.floor(F.col(p) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("mean_y"))


def top_k_hits(df: DataFrame, key: str, order: list[Column], y: str, ks: tuple[int, ...]) -> DataFrame:
    """For each key, whether the true row is among the first k: top<k> as 0 or 1, and the key's size."""
    w = Window.partitionBy(key)
    r = df.select(key, y, F.row_number().over(w.orderBy(*order)).alias("_n"), F.count("*").over(w).alias("size"))
    return r.groupBy(key).agg(F.max("size").alias("size"), *(F.max((F.col(y) & (F.col("_n") <= k)).cast("int")).alias(f"top{k}") for k in ks))
