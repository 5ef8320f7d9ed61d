"""Numbered facts of the entities worth a brief, and the points an open source reports as in danger."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worth(scores: DataFrame, least: float = 40, most: int = 30, key: str = "vessel_id") -> DataFrame:
    """The entities of greatest risk that have a brief: at least so much, the first so many (of equal ones by key)."""
    return scores.where(F.col("risk") >= least).orderBy(F.desc("risk"), key).limit(most)


def section(rows: DataFrame, key: str, order: list[Column], text: Column) -> DataFrame:
    """The facts of a kind, one for each row, in an order of their own: _key, text and what orders them."""
    return rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), text.alias("text"), *(c.alias(f"_o{i}") for i, c in enumerate(order)))


def numbered(chosen: DataFrame, sections: list[DataFrame], key: str = "vessel_id") -> DataFrame:
    """(key, n, fact, text): the facts of the chosen entities, section after section, as F1, F2, and so on.

    Facts are picked by a semi join with the few entities chosen before anything is ordered. Facts without text are left out.
    """
    few = F.broadcast(chosen.select(F.col(key).alias("_key")))  # at most as many rows as briefs are asked for
    ranked = []
    for i, rows in enumerate(sections):
        own = [c for c in rows.columns if c.startswith("_o")]
        w = Window.partitionBy("_key").orderBy(*own)
        ranked.append(rows.join(few, "_key", "left_semi").where("text IS NOT NULL").select("_key", F.lit(i).alias("_section"), F.row_number().over(w).alias("_place"), "text"))
    n = F.row_number().over(Window.partitionBy("_key").orderBy("_section", "_place"))
    x = reduce(DataFrame.unionByName, ranked).withColumn("n", n)
    return x.select(F.col("_key").alias(key), "n", F.concat(F.lit("F"), F.col("n").cast("string")).alias("fact"), "text")


def vessel_facts(chosen: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """The facts of vessels from vessels, scores, breakdown, gaps, encounters and candidates (consistent ones alone)."""
    t, unknown = tables, lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    said = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    whole, when = lambda c: F.round(c).cast("long").cast("string"), lambda c: F.date_format(c, "dd MMM HH:mm")
    degrees = lambda y, x: F.concat(F.format_string("%.2f", F.col(y)), F.lit("N "), F.format_string("%.2f", F.col(x)), F.lit("E"))
    key = "vessel_id"
    return numbered(chosen, [
        section(t["vessels"], key, [F.col("name")], said("Vessel ", unknown("name", "unnamed"), " (flag ", unknown("flag", "unknown"), ", IMO ", unknown("imo", "unknown"), ", MMSI ", unknown("mmsi", "unknown"), ", type ", unknown("vessel_type", "unknown"), ").")),
        section(t["scores"], key, [F.col("risk")], said("Heuristic risk score ", whole(F.col("risk")), " of 100.")),
        section(t["breakdown"], key, [-F.col("points"), F.col("reason")], said("+", whole(F.col("points")), " points: ", F.col("reason"), " (", F.col("provenance"), ", source ", F.col("source"), ").")),
        section(t["gaps"], key, [F.col("start")], said("AIS gap starting ", when("start"), " UTC at ", degrees("off_lat", "off_lon"), ", ", F.when(F.col("open"), "still dark").otherwise(said("reappeared after ", whole(F.col("duration_h")), " h")), ".")),
        section(t["encounters"], key, [F.col("start")], said("Encounter with ", F.coalesce("other_name", "other_vessel_id"), " on ", F.date_format("start", "dd MMM"), " at ", degrees("lat", "lon"), ".")),
        section(t["candidates"].where("consistent"), key, [F.col("ts"), F.col("sar_id")], said("Unmatched radar detection ", F.col("sar_id"), " at ", when("ts"), " UTC consistent with the dark track", F.coalesce(F.concat(F.lit(" inside "), F.col("in_aoi")), F.lit("")), ".")),
    ], key)


def danger_points(threats: DataFrame, news: DataFrame, now: Column, threat_minutes: float = 45, news_hours: float = 6) -> DataFrame:
    """(id, entity, lon, lat, title, sub, ts, kind, weapon) of recent reports, each with how it is known. Times in ms.

    A threat (id, ts, tally, weapon, short, channel, to_place and at_place as structs of name, lon, lat) gives the town it
    heads for and the place it is reported at; a headline (id, ts, label, outlet, place, lon, lat, strike) that tells of a
    strike gives its town. A night's tally is no threat.
    """
    fresh = threats.where((F.col("ts") > now - int(threat_minutes * 60_000)) & ~F.coalesce("tally", F.lit(False)))

    def at(place: str, tail: str, says: str, source: str, kind: str) -> DataFrame:
        p = F.col(place)
        return fresh.where(p.isNotNull()).select(
            F.concat("id", F.lit(tail)).alias("id"), F.col("id").alias("entity"), p["lon"].alias("lon"), p["lat"].alias("lat"), F.concat(F.coalesce("short", F.lit("Threat")), F.lit(says), p["name"]).alias("title"),
            F.concat("channel", F.lit(source)).alias("sub"), "ts", F.lit(kind).alias("kind"), "weapon")

    told = news.where((F.col("ts") > now - int(news_hours * 3_600_000)) & F.col("strike")).select(
        F.concat("id", F.lit(":news")).alias("id"), F.col("id").alias("entity"), "lon", "lat", F.col("label").alias("title"), F.concat(F.coalesce("outlet", F.lit("News")), F.lit(" · "), F.col("place")).alias("sub"), "ts",
        F.lit("news").alias("kind"), F.lit(None).cast("string").alias("weapon"))
    return at("to_place", ":to", " heading for ", " · reported course", "heading").unionByName(at("at_place", ":at", " reported near ", " · reported position", "reported")).unionByName(told)
