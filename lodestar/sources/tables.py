"""Declared schemas, checks that fail fast, and tables on disk."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """An input lacks what its parser needs."""


class EmptyTable(ValueError):
    """A stage that must have rows has none."""


# Columns of the batch tables.
SCHEMAS = {
    "vessels": "vessel_id string, name string, flag string, imo string, mmsi string, vessel_type string",
    "identities": "vessel_id string, name string, flag string, mmsi string, imo string, callsign string, source string, date_from timestamp, date_to timestamp",
    "gaps": "gap_id string, vessel_id string, start timestamp, end timestamp, duration_h double, off_lon double, off_lat double, on_lon double, on_lat double, distance_km double, implied_speed_kn double, open boolean, intentional boolean",
    "encounters": "enc_id string, vessel_id string, other_vessel_id string, other_name string, start timestamp, end timestamp, lon double, lat double, median_distance_km double, median_speed_kn double, duration_h double",
    "loitering": "loit_id string, vessel_id string, start timestamp, end timestamp, lon double, lat double, duration_h double, distance_km double, avg_speed_kn double",
    "port_visits": "visit_id string, vessel_id string, start timestamp, end timestamp, lon double, lat double, port string, port_flag string, confidence string, aoi string, occupied_aoi string",
    "sar": "sar_id string, ts timestamp, lon double, lat double, detections int",
    "sanctions": "os_id string, name string, imo string, flag string, url string, mmsis array<string>, countries array<string>, topics array<string>, datasets array<string>, aliases array<string>, sanctioned boolean, shadow_fleet boolean, detained boolean",
}


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    if missing := [n for n in names if n not in df.columns]:
        raise SchemaError(f"missing columns: {', '.join(missing)}")
    return df


def require_known(df: DataFrame, column: str, known: DataFrame, key: str) -> DataFrame:
    """Raises if any value has no partner in known; the check reads one row at most."""
    strange = df.select(F.col(column).alias(key)).where(F.col(key).isNotNull()).join(known.select(key), key, "left_anti").limit(1).collect()
    if strange:
        raise SchemaError(f"unknown {column}: {strange[0][0]}")
    return df


def write_table(df: DataFrame, path: str, required: bool = False, partition_by: list[str] | None = None) -> int:
    """Write Parquet and return the number of rows, which the write itself counts."""
    from pyspark.sql import Observation

    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    rows = seen.get["rows"]
    if required and not rows:
        raise EmptyTable(path)
    return rows


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_pages(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of the pages of a finished window; a folder without its completion mark is refused."""
    jvm = spark._jvm
    mark = jvm.org.apache.hadoop.fs.Path(f"{folder}/_complete.json")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        raise SchemaError(f"{folder} is not complete")
    pages = spark.read.schema(f"entries array<{schema}>").option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/page_*.json")
    return pages.select(F.explode("entries").alias("e")).select("e.*")


def record_jsonl(df: DataFrame, path: str, ts: str) -> None:
    """Append messages as JSON lines, a folder for each day."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def cut_recording(lines: DataFrame, start_ms: int, end_ms: int, kinds: list[str] | None = None) -> DataFrame:
    """Lines of a recording in [start, end). Cheap text tests come before JSON is read."""
    kept = lines
    if kinds:
        wanted = F.lit(False)
        for k in kinds:
            wanted = wanted | F.contains("value", F.lit(f'"{k}"'))
        kept = kept.where(wanted)
    at = F.get_json_object("value", "$.at").cast("long")
    kept = kept.where((at >= start_ms) & (at < end_ms))
    return kept.where(F.get_json_object("value", "$.e.kind").isin(*kinds)) if kinds else kept


def responses(df: DataFrame) -> DataFrame:
    """One JSON text for each row: NaN is null, times are ISO with a Z."""
    columns = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind in ("double", "float"):
            c = F.when(F.isnan(c), F.lit(None)).otherwise(c)
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
        columns.append(c.alias(name))
    return df.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def save_card(spark: SparkSession, path: str, card: dict) -> None:
    spark.createDataFrame([(json.dumps(card, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def latest_of(df: DataFrame, ts: str, fields: list[str]) -> DataFrame:
    """Fields of the newest row."""
    return df.agg(F.max_by(F.struct(*fields), ts).alias("r")).select("r.*")
