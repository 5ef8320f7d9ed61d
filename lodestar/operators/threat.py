"""Two-axis ranking of craft: threat by operator, ability and course; interest by mission and oddity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States treated as hostile, roles, points and squawk codes.
HOSTILE = ("ru", "by", "ir", "kp")
STRIKE, ISR = ("fighter", "strike", "bomber"), ("isr", "electronic", "maritime_patrol")
POINTS = {
    "hostile_state": 40, "strike_role": 15, "isr_role": 8, "uav": 8, "near_50": 20, "near_150": 12, "near_300": 6, "front_50": 12, "front_150": 6, "over_occupied": 10,
    "inbound": 10, "emergency": 25, "no_callsign": 5, "own_gnss": 8, "gnss_area": 6, "isr_near": 15, "mission_net": 10, "on_station": 8, "reroute": 6, "warship": 10,
}
EMERGENCY = ("7500", "7600", "7700")


def score(craft: DataFrame, most: int = 100, share: float = 0.5) -> DataFrame:
    """craft with threat, intel, priority and reasons, an array of (axis, points, reason).

    Reads: kind, state_code, role, uav, military, dist_km (to the border), front_km, occupied, off_deg (course off
    the nearest border point), spd, squawk, callsign, nac_p, ground, gnss_level, net_mission, on_station, rerouted.
    A craft of a state that is not hostile keeps no threat reasons but a row of no points that says so.
    """
    c = F.col
    state = F.lower(F.coalesce("state_code", F.lit("")))
    yes = lambda x: F.coalesce(x, F.lit(False))

    def row(axis: str, points: str, when: Column, says: Column | str) -> Column:
        reason = F.lit(says) if isinstance(says, str) else says
        return F.when(yes(when), F.struct(F.lit(axis).alias("axis"), F.lit(POINTS[points]).alias("points"), reason.alias("reason")))

    km = F.concat(F.format_number("dist_km", 0), F.lit(" km from the border"))
    tier = F.coalesce(row("threat", "near_50", c("dist_km") <= 50, km), row("threat", "near_150", c("dist_km") <= 150, km), row("threat", "near_300", c("dist_km") <= 300, km))
    front = F.coalesce(row("threat", "front_50", c("front_km") <= 50, "near the front line"), row("threat", "front_150", c("front_km") <= 150, "within reach of the front line"))
    aircraft = c("kind") == "aircraft"
    found = F.array_compact(F.array(
        row("threat", "hostile_state", state.isin(*HOSTILE), F.concat(F.lit("operated by "), F.upper(state))),
        F.coalesce(row("threat", "strike_role", c("role").isin(*STRIKE), F.concat(c("role"), F.lit(" role"))), row("threat", "isr_role", c("role").isin(*ISR), F.concat(c("role"), F.lit(" role")))),
        row("threat", "uav", c("uav"), "uncrewed aircraft"), row("threat", "warship", (c("kind") == "vessel") & c("military"), "naval or law-enforcement vessel"),
        tier, front, row("intel", "over_occupied", c("occupied"), "over occupied land"),
        row("threat", "inbound", (c("dist_km") > 0) & (c("dist_km") <= 300) & (c("spd") > 100) & (c("off_deg") <= 30), "heading towards the border"),
        row("intel", "emergency", c("squawk").isin(*EMERGENCY), F.concat(F.lit("squawking "), c("squawk"))), row("intel", "no_callsign", aircraft & (F.coalesce("callsign", F.lit("")) == ""), "no callsign"),
        row("intel", "own_gnss", aircraft & (c("nac_p") < 8) & ~F.coalesce("ground", F.lit(False)), "own position degraded"), row("intel", "gnss_area", c("gnss_level").isin("medium", "high"), "in an area of interference"),
        row("intel", "isr_near", c("role").isin(*ISR) & (c("dist_km") <= 300), "reconnaissance near the border"), row("intel", "mission_net", c("net_mission").isNotNull(), "in a mission net"),
        row("intel", "on_station", c("on_station"), "holding an orbit"), row("intel", "reroute", c("rerouted"), "changed its course lately")))
    none = lambda says: F.array(F.struct(F.lit("threat").alias("axis"), F.lit(0).alias("points"), F.lit(says).alias("reason")))
    friendly = (state != "") & ~state.isin(*HOSTILE)
    reasons = F.when(friendly, F.concat(F.filter("_r", lambda r: r["axis"] == "intel"), none("attributed to a state not scored as a threat"))).when(state == "", F.concat(c("_r"), none("state not attributed"))).otherwise(c("_r"))
    x = craft.withColumn("_r", found).withColumn("reasons", reasons).drop("_r")
    total = lambda axis: F.least(F.lit(most), F.aggregate(F.filter("reasons", lambda r: r["axis"] == axis), F.lit(0), lambda a, r: a + r["points"]))
    x = x.withColumn("threat", total("threat")).withColumn("intel", total("intel"))
    return x.withColumn("priority", F.least(F.lit(most), F.bround(c("threat") + share * c("intel"), 0)).cast("int"))


def board(scored: DataFrame, n: int = 3) -> DataFrame:
    """Ranked craft with their strongest reasons."""
    best = F.slice(F.array_sort(F.transform(F.filter("reasons", lambda r: r["points"] > 0), lambda r: F.struct((-r["points"]).alias("p"), r["reason"].alias("reason")))), 1, n)
    return scored.withColumn("top", F.transform(best, lambda r: r["reason"])).orderBy(F.desc("priority"), F.desc("intel"))
