"""Landings judged by the landings before them: prefix counts in place of a loop that learns.

What a model had learned when a flight began are counts of the landings that ended before, by aircraft, by type and by family
of callsigns, in all and at each field. Every flight asks for the counts of its own beginning, so all are answered at once.

Flights and landings of a key meet in one task, in order of time. A key with more rows than a task should hold is cut into spans of
time, and what came before a span is a row of its own that begins it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.joins import small
from lodestar.scratch import Rounds

#: What priors are counted by.
LEVELS = ("hex", "type", "family")
#: Rows of a key from which it is cut into spans.
HOT = 1 << 18
#: Moments asked for that are few: at most so many of all flights' (one in FEW), and so many for a broadcast.
FEW, SENT = 8, 400_000
#: Rows of a task's group of aircraft.
GROUP = 1 << 15


def _moment(c: str) -> Column:
    return F.col(c).cast("double")


def _cut(asks: DataFrame, adds: DataFrame, key: str, size: float) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """asks and adds(key, field, _t, _n) with _span, and what begins the spans that hot keys have asks in: key, field, _span, _n (null field: all).

    Of a key that isn't hot _span is 0; asks without a key are spread over some spans. Every field that a hot key ever has begins its spans, with 0 if need be.
    """
    rows = asks.select(key).unionByName(adds.select(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_rows"))
    hot = rows.where(F.col("_rows") > HOT).select(key, F.lit(True).alias("_hot"))
    nowhere = F.pmod(F.xxhash64("_t", "field"), F.lit(1024))
    if hot.isEmpty():
        return asks.withColumn("_span", F.when(F.col(key).isNull(), nowhere).otherwise(F.lit(0).cast("long"))), adds.withColumn("_span", F.lit(0).cast("long")), None
    hot = small(hot)
    span = F.floor(F.col("_t") / size)
    asks = asks.join(hot, key, "left").withColumn("_span", F.when(F.col(key).isNull(), nowhere).when(F.col("_hot"), span).otherwise(F.lit(0).cast("long"))).drop("_hot")
    adds = adds.join(hot, key, "left").withColumn("_span", F.when(F.col("_hot"), span).otherwise(F.lit(0).cast("long")))
    known = adds.where("_hot").groupBy(key, "field", "_span").agg(F.sum("_n").alias("_n"))
    asked = asks.join(hot, key, "left_semi").select(key, "_span").distinct()
    sums = known.unionByName(asked.join(known.select(key, "field").distinct(), key).select(key, "field", "_span", F.lit(0).cast("long").alias("_n")))
    sums = sums.groupBy(key, "field", "_span").agg(F.sum("_n").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(key, "field").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    return asks, adds.drop("_hot"), sums.withColumn("_n", before).join(asked, [key, "_span"], "left_semi").select(key, "field", "_span", "_n")


def _counted(asks: DataFrame, adds: DataFrame, level: str, size: float) -> DataFrame:
    """asks(level, field, _t, ...) with n_ and at_ of the level: how many adds(level, field, _t, _n) of it come before, in all and at the field.

    One exchange serves both counts. A null level meets no row.
    """
    asks, adds, begin = _cut(asks, adds.where(F.col(level).isNotNull()), level, size)
    none = F.lit(0).cast("long")
    # Of equal times those that ask come first: what ends as they begin isn't known yet. A span's beginning has no time and comes before all.
    rows = asks.withColumns({"_order": F.lit(0), "_n": none, "_m": none}).unionByName(adds.withColumns({"_order": F.lit(1), "_m": F.col("_n")}), allowMissingColumns=True)
    if begin is not None:
        rows = rows.unionByName(begin.withColumns({"_order": F.lit(1), "_m": F.col("_n")}), allowMissingColumns=True)
    so_far = lambda *keys: Window.partitionBy(level, "_span", *keys).orderBy(F.asc_nulls_first("_t"), "_order").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(level).isNotNull()
    x = rows.withColumn(f"n_{level}", F.when(known, F.sum("_n").over(so_far())).otherwise(none)).withColumn(f"at_{level}", F.when(known, F.sum("_m").over(so_far("field"))).otherwise(none))
    return x.where("_order = 0").drop("_span", "_order", "_n", "_m")


def observed(flights: DataFrame) -> DataFrame:
    """Landings that are learned: flights that have landed somewhere, once for each aircraft and end."""
    return flights.where("hex IS NOT NULL AND field IS NOT NULL AND end IS NOT NULL").groupBy("hex", "end").agg(F.min(F.struct("type", "family", "field")).alias("x")).select("hex", "end", "x.*")


def judged(flights: DataFrame, span: float = 86_400.0, rounds: Rounds | None = None) -> DataFrame:
    """flights(hex, type, family, field, start, end; times in seconds) that have landed, with what was known at their start.

    n_* counts the landings learned by then of the aircraft, its type and its family of callsigns, at_* those of them at the
    flight's own field. Where flights ask for few different moments of a level, those are answered and joined to them; elsewhere flights go
    to the landings of their level, one level after another, and what one leaves is written before the next.
    """
    rounds = rounds or Rounds(flights.sparkSession)
    flights = rounds.keep(flights, "flights")
    learned = rounds.keep(observed(flights), "learned")
    out = flights.where("hex IS NOT NULL AND field IS NOT NULL AND start IS NOT NULL").withColumn("_t", _moment("start"))
    sizes = out.agg(F.count("*"), *(F.approx_count_distinct(F.struct(level, "field", "_t"), 0.05) for level in LEVELS)).first()
    few = [level for level, n in zip(LEVELS, sizes[1:]) if n * FEW <= sizes[0]]
    asks = out
    adds = lambda level: learned.groupBy(level, "field", _moment("end").alias("_t")).agg(F.count("*").alias("_n"))
    for level in few:
        moments = asks.where(F.col(level).isNotNull()).select(level, "field", "_t").distinct()
        found = rounds.keep(_counted(moments, adds(level), level, span), f"moments_{level}")
        out = out.join(small(found, SENT), [level, "field", "_t"], "left")
        out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in (f"n_{level}", f"at_{level}")})
    rest = [level for level in LEVELS if level not in few]
    for level in rest:
        out = _counted(out, adds(level), level, span)
        if level != rest[-1]:
            out = rounds.keep(out, f"counted_{level}")
    return out.select(*flights.columns, *(f"{n}_{level}" for level in LEVELS for n in ("n", "at")))


def _known(t: pa.Table, keep: list[str]) -> pa.Table:
    """Flights of some aircraft (_kind 0: flight, 1: landing, 2: what begins a span) with _c, the fields known by each one's time and its own if ever known."""
    kind = t["_kind"].to_numpy()
    _, who = np.unique(np.stack([t["_who"].to_numpy(), t["_span"].to_numpy()]), axis=1, return_inverse=True)
    coded = pc.dictionary_encode(t["field"].combine_chunks())
    field = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pair = who.ravel().astype(np.int64) * max(1, len(coded.dictionary)) + field
    time = t["_t"].to_numpy(zero_copy_only=False)
    asks = np.flatnonzero(kind == 0)
    # Pairs of an aircraft and a field, in order of the aircraft; base: landings before the span.
    ever = np.unique(pair[kind > 0])
    base, starts = np.zeros(len(ever), np.int64), np.flatnonzero(kind == 2)
    base[np.searchsorted(ever, pair[starts])] = t["_n"].to_numpy(zero_copy_only=False)[starts].astype(np.int64)
    lands = np.flatnonzero(kind == 1)
    # Times by rank, so that a pair and a time are one whole number.
    ranked = np.unique(time[lands])
    width = len(ranked) + 1
    at = np.sort(np.searchsorted(ever, pair[lands]) * width + np.searchsorted(ranked, time[lands]))
    first = np.searchsorted(at, np.arange(len(ever)) * width)
    fields = max(1, len(coded.dictionary))
    low = np.searchsorted(ever, who.ravel()[asks] * fields)
    n = np.searchsorted(ever, (who.ravel()[asks] + 1) * fields) - low
    out = []
    for k in _slices(n):
        one = np.repeat(np.arange(k.start, k.stop), n[k])
        place = np.arange(len(one)) - np.repeat(n[k].cumsum() - n[k], n[k]) + low[one]
        before = np.searchsorted(at, place * width + np.searchsorted(ranked, time[asks[one]])) - first[place] + base[place]
        good = (before > 0) | (ever[place] == pair[asks[one]])
        one, place, before = one[good], place[good], before[good]
        ends = np.append(0, np.bincount(one - k.start, minlength=k.stop - k.start).cumsum()).astype(np.int32)
        c = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([coded.dictionary.take(pa.array(ever[place] % fields)), pa.array(before)], names=["candidate", "n"]))
        out.append(t.select(keep).take(pa.array(asks[k])).append_column("_c", pa.chunked_array([c])))
    return pa.concat_tables(out)


def _slices(n: np.ndarray, most: int = 4_000_000):
    """Slices of rows that make about so many each; one empty slice of none."""
    ends, at = n.cumsum(), 0
    while True:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))) if len(n) else 0
        yield slice(at, upto)
        at = upto
        if at >= len(n):
            return


def candidates(flights: DataFrame, span: float = 86_400.0, rounds: Rounds | None = None, keep: list[str] | None = None) -> DataFrame:
    """flights with a row for each field where their aircraft is ever learned to land: candidate, n (times before the start) and y (whether it landed there).

    Fields not yet known when the flight began stay, with n = 0, if it landed there; others go. Flights and landings of an aircraft
    meet in one task, and its fields are laid beside a flight there, so that no row of the result is exchanged. keep names the columns
    of flights that the rows shall have, all if none is given.
    """
    rounds = rounds or Rounds(flights.sparkSession)
    keep = flights.columns if keep is None else keep
    flights = rounds.keep(flights, "flights")
    learned = rounds.keep(observed(flights), "learned")
    asks = flights.where("hex IS NOT NULL AND field IS NOT NULL AND start IS NOT NULL").select(*dict.fromkeys([*keep, "hex", "field"]), _moment("start").alias("_t"))
    asks, adds, begin = _cut(asks, learned.select("hex", "field", _moment("end").alias("_t"), F.lit(1).cast("long").alias("_n")), "hex", span)
    rows = asks.withColumn("_kind", F.lit(0)).unionByName(adds.withColumn("_kind", F.lit(1)), allowMissingColumns=True)
    if begin is not None:
        rows = rows.unionByName(begin.withColumn("_kind", F.lit(2)), allowMissingColumns=True)
    spark, total = flights.sparkSession, flights.count() + learned.count()
    groups = max(spark.sparkContext.defaultParallelism, total // GROUP + 1)
    names = rounds.keep(learned.select("hex").distinct().withColumn("_who", F.monotonically_increasing_id()), "names") if dict(flights.dtypes)["hex"] not in ("int", "bigint") else None
    rows = rows.withColumn("_who", F.col("hex").cast("long")) if names is None else rows.join(names, "hex")
    rows = rows.withColumn("_group", F.pmod(F.xxhash64("_who", "_span"), F.lit(groups)).cast("int"))
    kinds = dict(rows.dtypes)
    own = list(dict.fromkeys([*keep, "field"]))
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in own), f"_c array<struct<candidate:{kinds['field']},n:bigint>>"])
    rows = rows.select(*dict.fromkeys([*own, "_who", "_span", "_t", "_n", "_kind", "_group"]))
    found = rows.repartition(max(spark.sparkContext.defaultParallelism, groups // 4), "_group").groupBy("_group").applyInArrow(lambda t: _known(t, own), schema)
    return found.select(*own, F.inline("_c")).withColumn("y", (F.col("candidate") == F.col("field")).cast("int")).select(*keep, "candidate", "n", "y")


def snapshots(points: DataFrame, flight: str, ts: str, step: float = 300.0) -> DataFrame:
    """Of each flight's points the last before each whole step since its start, but for the last step before its end: elapsed and left in seconds."""
    ends = points.groupBy(flight).agg(F.min(ts).alias("_start"), F.max(ts).alias("_end"))
    x = points.join(ends, flight).withColumn("elapsed", F.col(ts) - F.col("_start")).withColumn("left", F.col("_end") - F.col(ts))
    x = x.where(F.col("left") >= step).withColumn("_mark", F.floor(F.col("elapsed") / step))
    rest = [c for c in points.columns if c != flight]
    return x.groupBy(flight, "_mark").agg(F.max(F.struct(ts, *[c for c in rest if c != ts], "elapsed", "left")).alias("s")).select(flight, "s.*")
