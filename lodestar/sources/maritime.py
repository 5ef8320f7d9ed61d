"""Batch feeds of maritime events and of listed vessels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.sources.tables import require_columns

VESSEL = "struct<id:string,name:string,ssvid:string,flag:string,type:string>"
EVENT = (
    "struct<id:string,type:string,start:string,end:string,position:struct<lat:string,lon:string>,vessel:" + VESSEL + ","
    "encounter:struct<vessel:" + VESSEL + ",medianDistanceKilometers:string,medianSpeedKnots:string>,"
    "gap:struct<offPosition:struct<lat:string,lon:string>,onPosition:struct<lat:string,lon:string>,durationHours:string,distanceKm:string,impliedSpeedKnots:string,intentionalDisabling:boolean>,"
    "loitering:struct<totalTimeHours:string,totalDistanceKm:string,averageSpeedKnots:string>,"
    "port_visit:struct<startAnchorage:struct<name:string,flag:string,lat:string,lon:string>,intermediateAnchorage:struct<name:string,flag:string,lat:string,lon:string>,confidence:string>>"
)


def _num(c: str) -> Column:
    """A number that may come as text; text that is none raises, a missing one is null."""
    return F.col(c).cast("double")


def _need(c: str) -> Column:
    return F.coalesce(F.col(c), F.raise_error(F.concat(F.lit(f"event without {c}: "), F.coalesce("id", F.lit("?")))).cast("string"))


def _time(c: str) -> Column:
    return F.to_timestamp(F.nullif(F.col(c), F.lit("")))


def _hours() -> Column:
    return (F.unix_micros(_time("end")) - F.unix_micros(_time("start"))) / 3.6e9


def gaps(events: DataFrame) -> DataFrame:
    """Gaps in a vessel's signal. One that has no end, or no position at it, is open."""
    open_ = _time("end").isNull() | F.col("gap.onPosition").isNull()
    return events.where("type = 'gap'").select(
        _need("id").alias("gap_id"), _need("vessel.id").alias("vessel_id"), F.to_timestamp(_need("start")).alias("start"), _time("end").alias("end"),
        F.coalesce(_num("gap.durationHours"), _hours()).alias("duration_h"),
        _num("gap.offPosition.lon").alias("off_lon"), _num("gap.offPosition.lat").alias("off_lat"), _num("gap.onPosition.lon").alias("on_lon"), _num("gap.onPosition.lat").alias("on_lat"),
        _num("gap.distanceKm").alias("distance_km"), _num("gap.impliedSpeedKnots").alias("implied_speed_kn"), open_.alias("open"), F.coalesce("gap.intentionalDisabling", F.lit(False)).alias("intentional"))


def encounters(events: DataFrame) -> DataFrame:
    return events.where("type = 'encounter'").select(
        _need("id").alias("enc_id"), _need("vessel.id").alias("vessel_id"), F.col("encounter.vessel.id").alias("other_vessel_id"), F.col("encounter.vessel.name").alias("other_name"),
        F.to_timestamp(_need("start")).alias("start"), _time("end").alias("end"), _num("position.lon").alias("lon"), _num("position.lat").alias("lat"),
        _num("encounter.medianDistanceKilometers").alias("median_distance_km"), _num("encounter.medianSpeedKnots").alias("median_speed_kn"), _hours().alias("duration_h"))


def loitering(events: DataFrame) -> DataFrame:
    return events.where("type = 'loitering'").select(
        _need("id").alias("loit_id"), _need("vessel.id").alias("vessel_id"), F.to_timestamp(_need("start")).alias("start"), _time("end").alias("end"), _num("position.lon").alias("lon"), _num("position.lat").alias("lat"),
        F.coalesce(_num("loitering.totalTimeHours"), _hours()).alias("duration_h"), _num("loitering.totalDistanceKm").alias("distance_km"), _num("loitering.averageSpeedKnots").alias("avg_speed_kn"))


def port_visits(events: DataFrame) -> DataFrame:
    """Visits at the intermediate anchorage, else at the one they began at."""
    at = F.coalesce("port_visit.intermediateAnchorage", "port_visit.startAnchorage")
    return events.where("type = 'port_visit'").select(
        _need("id").alias("visit_id"), _need("vessel.id").alias("vessel_id"), F.to_timestamp(_need("start")).alias("start"), _time("end").alias("end"),
        F.coalesce(at["lon"].cast("double"), _num("position.lon")).alias("lon"), F.coalesce(at["lat"].cast("double"), _num("position.lat")).alias("lat"),
        at["name"].alias("port"), at["flag"].alias("port_flag"), F.col("port_visit.confidence").alias("confidence"), _hours().alias("duration_h"))


def vessel_ids(events: DataFrame) -> DataFrame:
    """Every vessel an event names, as main or as other."""
    return events.select(F.col("vessel.id").alias("vessel_id")).union(events.select("encounter.vessel.id")).where("vessel_id IS NOT NULL").distinct()


def vessels(events: DataFrame, identities: DataFrame | None = None) -> DataFrame:
    """A row for each vessel: as first seen, by kind of event and main before other; identities fill what is newest and not null."""
    kind = F.array_position(F.array(*map(F.lit, ("gap", "encounter", "loitering", "port_visit"))), F.col("type"))
    side = lambda c, n: events.select(F.col(f"{c}.id").alias("vessel_id"), F.struct(kind.alias("k"), F.lit(n).alias("n"), F.col("id").alias("i")).alias("o"), F.struct(F.col(f"{c}.name").alias("name"), F.col(f"{c}.flag").alias("flag"), F.lower(f"{c}.type").alias("vessel_type"), F.col(f"{c}.ssvid").alias("mmsi")).alias("v"))
    first = side("vessel", 0).unionByName(side("encounter.vessel", 1)).where("vessel_id IS NOT NULL").groupBy("vessel_id").agg(F.min_by("v", "o").alias("v")).select("vessel_id", "v.*")
    if identities is None:
        return first.withColumn("imo", F.lit(None).cast("string"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date_to"))).alias(f"i_{c}")
    known = identities.groupBy("vessel_id").agg(*map(last, ("name", "flag", "mmsi", "imo")))
    both = first.join(known, "vessel_id", "left")
    return both.select("vessel_id", *(F.coalesce(f"i_{c}", c).alias(c) for c in ("name", "flag", "mmsi")), F.col("i_imo").alias("imo"), "vessel_type")


def identities(items: DataFrame) -> DataFrame:
    """One row for each identity a vessel reported. items: selfReportedInfo, an array of structs."""
    x = items.select(F.explode("selfReportedInfo").alias("i"))
    return x.select(F.col("i.id").alias("vessel_id"), F.col("i.shipname").alias("name"), F.col("i.flag").alias("flag"), F.col("i.ssvid").alias("mmsi"), F.col("i.imo").alias("imo"), F.col("i.callsign").alias("callsign"),
                    F.lit("self-reported").alias("source"), F.to_timestamp("i.transmissionDateFrom").alias("date_from"), F.to_timestamp("i.transmissionDateTo").alias("date_to"))


def sar(reports: DataFrame) -> DataFrame:
    """Detections out of reports whose data sets name their rows; repeats of a place and time go. reports: value, JSON text."""
    row = "array<struct<date:string,lat:double,lon:double,detections:int>>"
    x = reports.select(F.from_json("value", f"struct<entries:array<map<string,{row}>>>").alias("j")).select(F.explode("j.entries").alias("m"))
    x = x.select(F.explode("m").alias("dataset", "rows")).select(F.explode("rows").alias("r")).select("r.*").where("date IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    ident = text.hash_id(F.col("date"), F.format_string("%.4f", "lon"), F.format_string("%.4f", "lat"))
    return x.select(ident.alias("sar_id"), F.to_timestamp("date", "yyyy-MM-dd HH:mm").alias("ts"), "lon", "lat", F.coalesce("detections", F.lit(1)).alias("detections")).groupBy("sar_id").agg(F.first("ts").alias("ts"), F.first("lon").alias("lon"), F.first("lat").alias("lat"), F.max("detections").alias("detections"))


LISTED = ("type", "caption", "imo", "risk", "countries", "flag", "mmsi", "id", "url", "datasets", "aliases")


def sanctions(spark: SparkSession, path: str) -> DataFrame:
    """Listed vessels. An IMO number that is none raises."""
    raw = require_columns(spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path), *LISTED).where("type = 'VESSEL'")
    imo = F.regexp_extract("imo", r"^IMO(\d{7})$", 1)
    checked = F.when(F.coalesce("imo", F.lit("")) == "", F.lit(None).cast("string")).when(imo != "", imo).otherwise(F.raise_error(F.concat(F.lit("bad IMO: "), F.col("imo"))).cast("string"))
    many = lambda c: F.coalesce(text.split_filled(F.col(c)), F.array().cast("array<string>"))
    x = raw.select(F.col("id").alias("os_id"), F.col("caption").alias("name"), checked.alias("imo"), "flag", "url", many("mmsi").alias("mmsis"), many("countries").alias("countries"), many("risk").alias("topics"), many("datasets").alias("datasets"), many("aliases").alias("aliases"))
    has = lambda *t: F.arrays_overlap("topics", F.array(*map(F.lit, t)))
    return x.withColumn("sanctioned", has("sanction", "mare.shadow")).withColumn("shadow_fleet", has("mare.shadow")).withColumn("detained", has("mare.detained"))
