"""Session construction shared by tests, the benchmark and stand-alone use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(cores: str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries assume: UTC, AQE and Arrow transfer."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lodestar")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
