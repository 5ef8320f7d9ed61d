"""Dark-vessel analysis: where a vessel can have been, which detections fit, and its risk with reasons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import geo, text, timeops
from lodestar.operators import joins, scoring

# Speeds in knots by class, the buffer on them, radii in km.
SPEEDS = {"tanker": 15.0, "cargo": 14.0, "default": 15.0}
BUFFER, STRAY_KM, NEAR_KM = 1.1, 5.0, 50.0


@dataclass(frozen=True)
class Weights:
    """Points of each signal and caps of repeated ones."""

    sanctioned: int = 30
    gap_each: int = 10
    gap_cap: int = 30
    gap_near_occupied: int = 20
    verified_dark: int = 25
    covert_port_call: int = 20
    impossible_gap: int = 15
    encounter_each: int = 10
    encounter_cap: int = 20
    encounter_sanctioned: int = 15
    occupied_port_visit: int = 20
    identity_change_each: int = 5
    identity_change_cap: int = 15
    psc_detention: int = 5
    total_cap: int = 100


def speed_class(vessel_type: Column) -> Column:
    return text.first_class(F.coalesce(vessel_type, F.lit("")), [("tanker", ("tanker",)), ("cargo", ("cargo", "bulk", "container", "general"))], "default")


def vmax(vessel_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in SPEEDS.items() for x in (k, v * BUFFER)))
    return F.element_at(table, speed_class(vessel_type))


def envelopes(gaps: DataFrame, vessels: DataFrame) -> DataFrame:
    """Reachability of each closed gap by the vessel's class."""
    g = gaps.where("NOT open").join(vessels.select("vessel_id", "vessel_type"), "vessel_id", "left").withColumn("vmax_kn", vmax(F.col("vessel_type")))
    d = geo.haversine("off_lon", "off_lat", "on_lon", "on_lat")
    return g.select("gap_id", "vessel_id", "vmax_kn", speed_class(F.col("vessel_type")).alias("speed_class"), geo.ellipse(d, F.col("duration_h"), F.col("vmax_kn")).alias("e")).select("gap_id", "vessel_id", "vmax_kn", "speed_class", "e.*")


def candidates(gaps: DataFrame, envelopes_: DataFrame, sar: DataFrame, reach_km: float) -> DataFrame:
    """Detections inside a gap's ellipse on one of its days, with the hours in which the vessel could have been there.

    reach_km bounds the semi-major axes of the batch: ellipses lie within it around their middle, which the grid
    join needs. Detections stand for the hour that begins with them; those that do not fit stay, as inconsistent.
    """
    g = gaps.where("NOT open").join(envelopes_.select("gap_id", "vmax_kn", "max_distance_km", "impossible"), "gap_id")
    m = g.withColumn("_m", F.when(F.col("impossible"), F.struct(F.col("on_lon").alias("lon"), F.col("on_lat").alias("lat"))).otherwise(geo.midpoint("off_lon", "off_lat", "on_lon", "on_lat")))
    m = m.withColumn("m_lon", F.col("_m.lon")).withColumn("m_lat", F.col("_m.lat")).drop("_m")
    x = joins.within_radius(sar.select("sar_id", "ts", "lon", "lat", "detections"), m, reach_km, ("lon", "lat"), ("m_lon", "m_lat"), "_km")
    x = x.where(F.to_date("ts").between(F.to_date("start"), F.to_date("end")))
    a, b = geo.haversine("off_lon", "off_lat", "lon", "lat"), geo.haversine("lon", "lat", "on_lon", "on_lat")
    x = x.withColumn("dist_from_off_km", a).withColumn("dist_to_on_km", b).where(geo.in_ellipse("dist_from_off_km", "dist_to_on_km", "max_distance_km", "impossible", STRAY_KM))
    hours = lambda km: km / (F.col("vmax_kn") * geo.KNOT_KMH) * 3.6e9
    early = F.greatest(timeops.micros(F.col("ts")).cast("double"), timeops.micros(F.col("start")) + hours(F.col("dist_from_off_km")))
    late = F.least(timeops.micros(F.col("ts")) + 3.6e9, timeops.micros(F.col("end")) - hours(F.col("dist_to_on_km")))
    good = early <= late
    when = lambda c: F.when(good, F.timestamp_micros(c.cast("long")))
    x = x.withColumn("consistent", good).withColumn("earliest", when(early)).withColumn("latest", when(late))
    return x.select("gap_id", "vessel_id", "sar_id", "ts", "lon", "lat", "detections", "dist_from_off_km", "dist_to_on_km", "consistent", "earliest", "latest", F.count_if(F.col("consistent")).over(Window.partitionBy("gap_id")).alias("gap_consistent_candidates"))


def listed(vessels: DataFrame, sanctions: DataFrame) -> DataFrame:
    """Each vessel with its listing: by IMO number first, else by any of the listing's numbers."""
    entry = F.struct("os_id", "sanctioned", "shadow_fleet", "detained")
    index = sanctions.select(entry.alias("entry"), "os_id", "imo", F.explode_outer("mmsis").alias("s_mmsi"))
    return joins.by_priority(vessels, index, [("imo", "imo"), ("mmsi", "s_mmsi")], "entry", "os_id", "listing")


def evidence(t: dict[str, DataFrame], as_of: Column | None = None, w: Weights = Weights()) -> DataFrame:
    """Evidence rows of every signal. t: vessels, gaps, envelopes, candidates, encounters, port_visits, identities,
    sanctions, and near (gap_id, end 'off' or 'on', aoi, km). Event tables are read as of a time; listings are not."""
    cut = lambda df, ts: df if as_of is None else df.where(F.col(ts) <= as_of)
    gaps, encounters, visits = cut(t["gaps"], "start"), cut(t["encounters"], "start"), cut(t["port_visits"], "start")
    cands = cut(t["candidates"], "ts")
    lists = listed(t["vessels"], t["sanctions"]).where("listing IS NOT NULL")
    bad = lists.where("listing.sanctioned").select("vessel_id")
    none: list[Column] = []
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    best = cands.where("consistent").groupBy("vessel_id").agg(F.min_by(F.struct("gap_id", "sar_id"), F.struct("gap_consistent_candidates", "ts", "sar_id")).alias("b")).select("vessel_id", "b.*")
    near = gaps.join(t["near"], "gap_id").where(F.col("km") <= NEAR_KM)
    first_near = near.groupBy("vessel_id").agg(F.min_by(F.struct("gap_id", "aoi", "km", "end_at"), F.struct("start", F.when(F.col("end_at") == "off", 0).otherwise(1), "gap_id")).alias("b")).select("vessel_id", "b.*")
    order = Window.partitionBy("vessel_id").orderBy("date_from", "name")
    ids = t["identities"].withColumn("_n", F.lag("name").over(order)).withColumn("_f", F.lag("flag").over(order)).withColumn("_i", F.row_number().over(order))
    edge = F.broadcast(t["gaps"].agg(F.min("start").alias("_edge")))  # one row
    moved = cut(ids.where(F.col("_i") > 1).where(~F.col("name").eqNullSafe(F.col("_n")) | ~F.col("flag").eqNullSafe(F.col("_f"))), "date_from").join(edge).where(F.col("date_from") >= F.col("_edge"))
    award = scoring.award
    other = encounters.join(bad.withColumnRenamed("vessel_id", "other_vessel_id"), "other_vessel_id", "left_semi")
    return scoring.breakdown([
        award(bad, "vessel_id", "sanctioned", w.sanctioned, None, none, F.lit("on a sanctions list"), F.col("vessel_id"), "listed", "sanctions"),
        award(lists.where("listing.detained"), "vessel_id", "psc_detention", w.psc_detention, None, none, F.lit("detained in port"), F.col("vessel_id"), "listed", "sanctions"),
        award(gaps, "vessel_id", "gap", w.gap_each, w.gap_cap, [F.asc("start"), F.asc("gap_id")], F.concat(F.lit("signal gap of "), F.format_number("duration_h", 1), F.lit(" h from "), day("start")), F.col("gap_id"), source="gaps"),
        award(first_near, "vessel_id", "gap_near_occupied", w.gap_near_occupied, None, none, F.concat(F.lit("gap "), F.format_number("km", 0), F.lit(" km from "), F.col("aoi")), F.col("gap_id"), "derived", "gaps"),
        award(best, "vessel_id", "verified_dark", w.verified_dark, None, none, F.lit("radar detection fits the gap"), F.col("sar_id"), "derived", "candidates"),
        award(gaps.join(t["envelopes"].where("impossible").select("gap_id"), "gap_id", "left_semi"), "vessel_id", "impossible_gap", w.impossible_gap, w.impossible_gap, [F.asc("start"), F.asc("gap_id")], F.lit("positions no vessel of its class can link"), F.col("gap_id"), "derived", "gaps"),
        award(encounters, "vessel_id", "encounter", w.encounter_each, w.encounter_cap, [F.asc("start"), F.asc("enc_id")], F.concat(F.lit("encounter at sea on "), day("start")), F.col("enc_id"), source="encounters"),
        award(other, "vessel_id", "encounter_sanctioned", w.encounter_sanctioned, w.encounter_sanctioned, [F.asc("start"), F.asc("enc_id")], F.lit("met a listed vessel"), F.col("enc_id"), "derived", "encounters"),
        award(visits.where("occupied_aoi"), "vessel_id", "occupied_port_visit", w.occupied_port_visit, w.occupied_port_visit, [F.asc("start"), F.asc("visit_id")], F.concat(F.lit("called at "), F.col("aoi")), F.col("visit_id"), source="port_visits"),
        award(moved, "vessel_id", "identity_change", w.identity_change_each, w.identity_change_cap, [F.asc("date_from"), F.asc("name")], F.concat(F.lit("identity changed on "), day("date_from")), F.col("name"), source="identities"),
    ])


def risk(t: dict[str, DataFrame], as_of: Column | None = None, w: Weights = Weights()) -> DataFrame:
    return scoring.scores(t["vessels"], evidence(t, as_of, w), "vessel_id", w.total_cap)
