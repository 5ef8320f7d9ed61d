"""State of a flight at each of its positions, from its history up to there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import geo, timeops

RADIUS_KM, KNOT_KM = 6371.0, 1.852


def states(points: DataFrame, key: str = "flight", tie: str = "seq", climb_s: int = 120, turn_s: int = 900, derive_s: int = 30) -> DataFrame:
    """points (key, ts, tie, lon, lat, alt in m, gs in knots, trk in degrees) with vrate_fpm, turned, straightness, gs_kn and heading.

    Windows reach back climb_s and turn_s seconds. Path and turn within one are differences of running sums, so a row looks
    up only where its window begins. Headings that are missing (null or NaN) are passed over when turns are added. The
    reported speed stands unless the climb window is at least derive_s long, turns less than 45 degrees and implies another
    by more than 35 %; a missing one is derived. A missing heading is the bearing from the position before, at the start 0.
    """
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    before = Window.partitionBy(key).orderBy("ts", tie)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    x = points.withColumns({"_us": timeops.micros(F.col("ts")), "_trk": known("trk"), "_gs": known("gs")})
    prior = F.last("_trk", True).over(before.rowsBetween(Window.unboundedPreceding, -1))
    leg = geo.haversine(F.lag("lon").over(before), F.lag("lat").over(before), "lon", "lat", RADIUS_KM)
    x = x.withColumns({"_turn": F.coalesce(geo.turn(F.col("_trk"), prior), F.lit(0.0)), "_leg": F.coalesce(leg, F.lit(0.0)), "_n": F.row_number().over(before)})
    came = geo.bearing(F.lag("lon").over(before), F.lag("lat").over(before), "lon", "lat")
    x = x.withColumns({"_turns": F.sum("_turn").over(upto), "_path": F.sum("_leg").over(upto), "heading": F.coalesce("_trk", came, F.lit(0.0))})

    back = lambda s: Window.partitionBy(key).orderBy("_us").rangeBetween(-s * 1_000_000, 0)
    start = F.struct("_n", "_us", "lon", "lat", "alt", "_path")
    turns = F.struct("_n", "_turns")
    x = x.withColumns({
        "_j": F.min(start).over(back(climb_s)), "_k": F.min(start).over(back(turn_s)),
        "_tj": F.min(F.when(F.col("_trk").isNotNull(), turns)).over(back(climb_s)), "_tk": F.min(F.when(F.col("_trk").isNotNull(), turns)).over(back(turn_s))})
    # A later row of the same time may be the first with a heading; then nothing has turned yet.
    turned = lambda c: F.greatest(F.coalesce(F.col("_turns") - F.col(f"{c}._turns"), F.lit(0.0)), F.lit(0.0))
    span = lambda c: (F.col("_us") - F.col(f"{c}._us")) / 1e6
    away = lambda c: geo.haversine(F.col(f"{c}.lon"), F.col(f"{c}.lat"), "lon", "lat", RADIUS_KM)
    dt = F.greatest(span("_j"), F.lit(1.0))
    climb = F.when(F.col("_n") > F.col("_j._n"), (F.col("alt") - F.col("_j.alt")) / 0.3048 / (dt / 60)).otherwise(0.0)
    path = F.col("_path") - F.col("_k._path")
    derived = F.when(span("_j") >= derive_s, away("_j") / (dt / 3600) / KNOT_KM)
    along = F.when(F.col("_n") > F.col("_k._n"), path / F.greatest(span("_k") / 3600, F.lit(1e-6)) / KNOT_KM).otherwise(0.0)
    wrong = F.coalesce((turned("_tj") < 45) & (derived > 50) & (F.abs(F.col("_gs") - derived) > 0.35 * derived), F.lit(False))
    return x.select(
        *points.columns, F.greatest(F.least(climb, F.lit(8000.0)), F.lit(-8000.0)).alias("vrate_fpm"), F.least(turned("_tk"), F.lit(2000.0)).alias("turned"),
        F.when(path > 1, away("_k") / path).otherwise(1.0).alias("straightness"), F.when(F.col("_gs").isNull(), F.coalesce(derived, along)).when(wrong, derived).otherwise(F.col("_gs")).alias("gs_kn"), "heading")
