"""One function for each read endpoint: tables in, rows (or one row) out. `sources.tables.responses` makes JSON of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import geo, text, timeops
from lodestar.operators import graph, joins, rules
from lodestar.streaming import state


@dataclass(frozen=True)
class Area:
    name: str
    lon: float
    lat: float
    occupied: bool


def health(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("ok",)], "status string")


def areas(spark: SparkSession, places: list[Area], radius_km: float = 15.0) -> DataFrame:
    """Circles of the areas of interest as rings."""
    df = spark.createDataFrame([(a.name, a.lon, a.lat, a.occupied) for a in places], "name string, lon double, lat double, occupied boolean")
    return df.withColumn("ring", geo.circle("lon", "lat", radius_km))


def meta(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each table."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows")
        out = n if out is None else out.unionByName(n)
    return out


def ranked(scores: DataFrame, evidence: DataFrame, flags: dict[str, DataFrame], min_risk: float = 0, limit: int = 500, key: str = "vessel_id") -> DataFrame:
    """Ranked entities of a least risk with their three strongest reasons and whether they are in each set of flags."""
    kept = scores.where(F.col("risk") >= min_risk).orderBy("rank").limit(min(limit, 5000))
    best = joins.top_n(evidence.join(kept.select(F.col(key).alias("entity")), "entity", "left_semi"), "entity", [F.desc("points"), F.asc("signal"), F.asc("evidence_ref")], 3)
    top = best.groupBy(F.col("entity").alias(key)).agg(F.array_sort(F.collect_list(F.struct("rank", "signal", "points", "reason"))).alias("top"))
    out = kept.join(top, key, "left")
    for name, members in flags.items():
        out = out.join(members.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out.orderBy("rank")


def dossier(key: str, value: str, tables: dict[str, DataFrame]) -> DataFrame:
    """One row with every table's rows of one entity, each an array of structs. The filter reaches every scan."""
    out = None
    for name, df in tables.items():
        rows = df.where(F.col(key) == value).agg(F.collect_list(F.struct(*df.columns)).alias(name))
        out = rows if out is None else out.crossJoin(rows)  # one row each
    return out


def events(tables: dict[str, tuple[DataFrame, str]], kind: str, start: Column | None = None, last_day: Column | None = None, vessel_id: str | None = None) -> DataFrame:
    """Events of a kind with a geometry: a closed gap is a line, all else a point. tables: kind to (table, time column)."""
    df, ts = tables[kind]
    if start is not None:
        df = df.where(F.col(ts) >= start)
    if last_day is not None:
        df = df.where(F.col(ts) < last_day + F.expr("INTERVAL 1 DAY"))
    if vessel_id is not None:
        df = df.where(F.col("vessel_id") == vessel_id)
    if kind == "gap":
        line = F.array(F.array("off_lon", "off_lat"), F.array("on_lon", "on_lat"))
        return df.withColumn("geometry", F.when(F.col("open"), "Point").otherwise("LineString")).withColumn("coordinates", F.when(F.col("open"), F.slice(line, 1, 1)).otherwise(line))
    return df.withColumn("geometry", F.lit("Point")).withColumn("coordinates", F.array(F.array("lon", "lat")))


def gap_envelope(gap_id: str, gaps: DataFrame, envelopes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Features of one gap by role: both ends, the middle of its ellipse and its detections."""
    g = gaps.where(F.col("gap_id") == gap_id)
    end = lambda side: g.select(F.lit(side).alias("role"), F.col(f"{side}_lon").alias("lon"), F.col(f"{side}_lat").alias("lat"), F.lit(None).cast("boolean").alias("consistent"))
    m = g.join(envelopes.select("gap_id", "impossible"), "gap_id").withColumn("m", geo.midpoint("off_lon", "off_lat", "on_lon", "on_lat"))
    middle = m.select(F.lit("envelope").alias("role"), F.col("m.lon").alias("lon"), F.col("m.lat").alias("lat"), (~F.col("impossible")).alias("consistent"))
    found = candidates.where(F.col("gap_id") == gap_id).select(F.lit("candidate").alias("role"), "lon", "lat", "consistent")
    return end("off").unionByName(end("on")).unionByName(middle).unionByName(found)


def occupied_calls(calls: DataFrame, since: Column) -> DataFrame:
    """Evidence of calls by hull: ports, counts by provenance, the rows themselves, newest first."""
    x = calls.where(F.col("ts") >= since)
    rows = F.sort_array(F.collect_list(F.struct("ts", "aoi", "kind", "provenance", "evidence_ref")), asc=False)
    return x.groupBy("vessel_id").agg(F.array_sort(F.collect_set("aoi")).alias("aois"), F.count_if(F.col("provenance") == "observed").alias("observed"), F.count("*").alias("n"), rows.alias("evidence"))


def track(points: DataFrame, entity: str, hours: float, now: Column, key: str = "id") -> DataFrame:
    """Recent points of one entity, numbered by flight; hours are held between a tenth and 48."""
    h = min(48.0, max(0.1, hours))
    return timeops.sessions(points.where((F.col(key) == entity) & (timeops.seconds_between(F.col("ts"), now) <= h * 3600)), key, "ts", 1200)


def airfields(fields: DataFrame, military_only: bool = False) -> DataFrame:
    return fields.where("military") if military_only else fields


def search_places(places: DataFrame, query: str, limit: int = 8) -> DataFrame:
    """Places whose name begins with the query, the largest first."""
    spark = places.sparkSession
    key = spark.range(1).select(text.norm(F.lit(query)).alias("k")).first()["k"]
    hits = places.where(F.startswith("key", F.lit(key)))
    return hits.groupBy("id").agg(F.first("name").alias("name"), F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.max("population").alias("population")).orderBy(F.desc("population"), "name").limit(limit)


def newest(feed: DataFrame, limit: int, ts: str = "ts") -> DataFrame:
    return feed.orderBy(F.desc(ts), F.desc("id")).limit(limit)


def snapshot(updates: DataFrame, ttl: dict[str, int], now: Column, alerts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Current state of what is alive, and the hundred newest alerts."""
    return state.alive(state.current(updates, "id", "ts", "arrival"), "kind", "ts", now, ttl), newest(alerts, 100)


def put_rule(existing: list[dict], rule: dict) -> list[dict]:
    """Rules with one added or replaced; a rule that can't run is refused before anything changes."""
    rules.validate(rule)
    return [r for r in existing if r["id"] != rule["id"]] + [rule]


def delete_rule(existing: list[dict], rule_id: str) -> list[dict]:
    kept = [r for r in existing if r["id"] != rule_id]
    if len(kept) == len(existing):
        raise KeyError(rule_id)
    return kept


def network(edges: DataFrame, vessel: DataFrame, hops: int, day=None) -> DataFrame:
    """Nodes within one to three hops as of a day."""
    return graph.expand(edges if day is None else graph.as_of(edges, day), vessel, max(1, min(3, hops)))


def cluster(edges: DataFrame, listed: DataFrame, hops: int = 2, day=None) -> DataFrame:
    """(node, depth, seeds): nodes within so many hops of any listed one, and how many of those they are near."""
    met = graph.expand(edges if day is None else graph.as_of(edges, day), listed, hops)
    return met.groupBy("node").agg(F.min("depth").alias("depth"), F.countDistinct("seed").alias("seeds"))


def changes(edges: DataFrame, since, until) -> DataFrame:
    """Links (a, b) that the version of one day has and that of another day lacks."""
    return graph.diff(graph.as_of(edges, since), graph.as_of(edges, until), ["a", "b"])


def commit_change(edges: DataFrame, path: str, day: str) -> None:
    """One day's change as a whole: it is written aside and moved into place only once complete."""
    spark = edges.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    aside, final = jvm.org.apache.hadoop.fs.Path(f"{path}/_pending-{day}"), jvm.org.apache.hadoop.fs.Path(f"{path}/day={day}")
    fs = final.getFileSystem(conf)
    if fs.exists(final):
        raise ValueError(f"{day} is committed")
    try:
        edges.drop("day").write.mode("overwrite").parquet(aside.toString())
        if not fs.rename(aside, final):
            raise OSError(f"{day} could not be committed")
    except BaseException:
        fs.delete(aside, True)
        raise
