"""Forecast features, training and explanation on Spark ML."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.functions import timeops
from lodestar.sources.tables import save_card


def time_split(df: DataFrame, ts: str, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """Rows before the cutoff, and the rest."""
    return df.where(F.col(ts) < cutoff), df.where(F.col(ts) >= cutoff)


def block_features(events: DataFrame, key: str, ts: str, active: Column, origin: str, blocks: int) -> DataFrame:
    """Each key at each six-hour block: counts, trailing sums, blocks since the last active one, the calendar and the target.

    Only the past of a block is read; the target is what its next block holds.
    """
    at = timeops.block_index(F.col(ts), F.lit(origin).cast("timestamp"))
    n = events.groupBy(key, at.alias("block")).agg(F.count("*").alias("n"), F.count_if(active).alias("active"))
    grid = timeops.spine(events.select(key).distinct(), F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"), F.lit(1).cast("long"), "block")
    x = grid.join(n, [key, "block"], "left").na.fill(0, ["n", "active"])
    w = Window.partitionBy(key).orderBy("block")
    last = F.last(F.when(F.col("active") > 0, F.col("block")), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hour = (F.col("block") % 4).cast("int")
    return x.select(
        key, "block", "n", "active",
        timeops.rolling("n", key, "block", 4).alias("n4"), timeops.rolling("n", key, "block", 28).alias("n28"),
        timeops.rolling("active", key, "block", 4).alias("active4"), timeops.rolling("active", key, "block", 28).alias("active28"),
        F.least(F.coalesce(F.col("block") - last, F.lit(120)), F.lit(120)).alias("since"),
        hour.alias("block_of_day"), (F.floor(F.col("block") / 4) % 7).cast("int").alias("weekday"),
        (F.lead("active").over(w) > 0).cast("int").alias("y"))


class Danger:
    """Boosted trees, whose scores an isotonic fit calibrates on later rows."""

    def __init__(self, trees: PipelineModel, calibration, features: list[str]):
        self.trees, self.calibration, self.features = trees, calibration, features

    @classmethod
    def fit(cls, train: DataFrame, later: DataFrame, features: list[str], label: str = "y", rounds: int = 20, depth: int = 4, seed: int = 0) -> Danger:
        gbt = GBTClassifier(featuresCol="features", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)
        trees = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"), gbt]).fit(train)
        raw = cls._raw(trees.transform(later)).select("raw", F.col(label).cast("double").alias("label"))
        return cls(trees, IsotonicRegression(featuresCol="raw", labelCol="label").fit(raw), features)

    @staticmethod
    def _raw(df: DataFrame) -> DataFrame:
        return df.withColumn("raw", vector_to_array("probability")[1])

    def predict(self, df: DataFrame, out: str = "p") -> DataFrame:
        made = self._raw(self.trees.transform(df)).drop("features", "rawPrediction", "probability", "prediction")
        return self.calibration.transform(made).withColumnRenamed("prediction", out).drop("raw")

    def save(self, path: str, card: dict) -> None:
        """Model, calibration and card; `latest` names the card last written."""
        self.trees.write().overwrite().save(f"{path}/trees")
        self.calibration.write().overwrite().save(f"{path}/isotonic")
        save_card(SparkSession.getActiveSession(), f"{path}/latest", card | {"features": self.features})


def ablation(model: Danger, df: DataFrame, key: list[str], typical: dict[str, float], top: int = 5, least: float = 0.01) -> DataFrame:
    """How much each feature moves the forecast away from its typical value: all variants are scored in one pass."""
    kinds = dict(df.dtypes)
    one = lambda alter: F.struct(F.lit(alter or "").alias("altered"), *((F.lit(typical[c]).cast("double") if c == alter else F.col(c).cast("double")).alias(c) for c in model.features))
    variants = df.select(*key, F.explode(F.array(one(None), *(one(c) for c in typical if c in kinds))).alias("v")).select(*key, "v.*")
    scored = model.predict(variants).select(*key, "altered", "p")
    base = scored.where("altered = ''").select(*key, F.col("p").alias("base"))
    moved = scored.where("altered <> ''").join(base, key).withColumn("delta", F.col("base") - F.col("p")).where(F.abs("delta") >= least)
    w = Window.partitionBy(*key).orderBy(F.desc(F.abs("delta")), "altered")
    return moved.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(*key, "altered", "delta", "rank")


def permutation_importance(model: Danger, df: DataFrame, label: str, seed: int = 0) -> DataFrame:
    """Rise of the Brier score when a feature's values are dealt anew among rows."""
    base = model.predict(df).agg(F.avg(F.pow(F.col("p") - F.col(label), 2))).first()[0]
    from lodestar.operators.scoring import global_rank

    rows = []
    keyed = global_rank(df.withColumn("_k", F.xxhash64(*model.features, F.lit(seed))), [F.asc("_k")], "_i")
    for c in model.features:
        dealt = global_rank(df.select(F.col(c).alias("_v"), F.xxhash64(F.lit(c), F.lit(seed), *model.features).alias("_k")), [F.asc("_k")], "_i").select("_i", "_v")
        mixed = keyed.join(dealt, "_i").drop(c).withColumnRenamed("_v", c)
        rows.append((c, model.predict(mixed).agg(F.avg(F.pow(F.col("p") - F.col(label), 2))).first()[0] - base))
    return df.sparkSession.createDataFrame(rows, "feature string, rise double")
