"""Tracks of tracked entities: thinned positions, flights, retention; over a stream, over a table, from recordings.

A position is kept if it is later than the last one kept and far enough from it in time, heading or height, or if the
entity has left the ground or come down. A flight begins after a gap, or where the entity leaves the ground. Both are folds
in the order of observation, so every way in sorts first: the stream holds positions until the watermark has passed them
and folds them in order of time, whatever order they came in; the table is folded in sorted partitions, of which one row
of a key is held. Stream and table give the same rows.

Of positions at one time the first counts, by longitude, latitude, height, speed, heading and ground, missing values first.
Rows without an id, time or place are left out. A heading or height that is missing is no change.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

COLUMNS = ["id", "ts", "lon", "lat", "alt", "spd", "hdg", "ground"]
#: What a position is ordered by within its id.
ORDER = COLUMNS[1:]


@dataclass(frozen=True)
class Rule:
    """Least seconds, degrees and metres between kept positions; seconds of a gap between flights; hours that are retained."""

    step_s: float = 5
    turn: float = 2.0
    climb_m: float = 150.0
    gap_s: float = 20 * 60
    hours: float = 48
    low_m: float = 900.0


RULE = Rule()
#: The last position kept of a key: time in ms, height, heading, ground, and the start of its flight.
_Last = tuple[int, float, float, bool, int]


def fold(rule: Rule, last: _Last | None, ts: np.ndarray, alt: np.ndarray, hdg: np.ndarray, ground: np.ndarray) -> tuple[np.ndarray, np.ndarray, _Last | None]:
    """Of one key's sorted positions which are kept, the start of each one's flight, and the last one kept.

    A position a whole step after the one before it is kept whatever that one's fate, so only those nearer are gone through.
    """
    n = len(ts)
    kept, flight = np.zeros(n, bool), np.zeros(n, np.int64)
    step, gap = rule.step_s * 1000, rule.gap_s * 1000
    sure = np.diff(ts, prepend=ts[0] - step - 1 if last is None else last[0]) >= step
    times, heights, headings, down, certain = ts.tolist(), alt.tolist(), hdg.tolist(), ground.tolist(), sure.tolist()
    for i in range(n):
        t, h, c, g = times[i], heights[i], headings[i], down[i]
        if last is not None:
            if t <= last[0]:
                continue
            # Nothing is added first, which would round a turn just short of the rule up to it. NaN compares false.
            turned = abs(c - last[2]) % 360
            if not (certain[i] or t - last[0] >= step or min(turned, 360 - turned) >= rule.turn or abs(h - last[1]) >= rule.climb_m or g != last[3]):
                continue
        start = t if last is None or t - last[0] > gap or last[3] and not g else last[4]
        kept[i], flight[i], last = True, start, (t, h, c, g, start)
    return kept, flight, last


def _points(df: DataFrame) -> DataFrame:
    """Rows that can be placed, in the types of a position."""
    kinds = {"ts": "long", "ground": "boolean"} | dict.fromkeys(("lon", "lat", "alt", "spd", "hdg"), "double")
    x = df.where("id IS NOT NULL AND ts IS NOT NULL AND lon IS NOT NULL AND lat IS NOT NULL")
    return x.select(F.col("id"), *(F.col(c).cast(kinds[c]).alias(c) for c in COLUMNS[1:-1]), F.coalesce("ground", F.lit(False)).alias("ground"))


def thin(points: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Positions (COLUMNS, ts in ms) that are kept, with flight, the time their flight starts."""
    points = _points(points)
    ordered = points.repartition("id").sortWithinPartitions("id", *ORDER)
    schema = ", ".join(f"{c} {kind}" for c, kind in points.dtypes) + ", flight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            cols = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(COLUMNS) if c in ("ts", "alt", "hdg", "ground")}
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            kept, flight = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
            for a, z in zip(cuts, cuts[1:]):
                if ids[a] != at:
                    at, last = ids[a], None
                kept[a:z], flight[a:z], last = fold(rule, last, *(np.asarray(cols[c][a:z], t) for c, t in (("ts", np.int64), ("alt", float), ("hdg", float), ("ground", bool))))
            whole = b.append_column("flight", pa.array(flight))
            yield whole.filter(pa.array(kept))

    return ordered.mapInArrow(run, schema)


def retained(kept: DataFrame, now: Column, rule: Rule = RULE) -> DataFrame:
    """Kept positions of the hours before now, with active (the id's last one is of the last ten minutes) and recent (the row is of the last hour)."""
    since = now - int(rule.hours * 3_600_000)
    x = kept.where((F.col("ts") >= since) & (F.col("ts") <= now))
    latest = F.max("ts").over(Window.partitionBy("id"))
    return x.withColumn("active", latest >= now - 600_000).withColumn("recent", F.col("ts") >= now - 3_600_000)


def flights(kept: DataFrame, now: Column, rule: Rule = RULE, hours: float | None = None) -> DataFrame:
    """A row for each flight within the hours before now: id, start, end, points, first and last position, landed.

    A flight that began earlier starts at its first position within them. It has landed if it is on the ground, or was last
    seen low and not for as long as a gap.
    """
    own = Rule(rule.step_s, rule.turn, rule.climb_m, rule.gap_s, rule.hours if hours is None else min(hours, rule.hours), rule.low_m)
    place = F.struct(*ORDER)
    x = retained(kept, now, own).groupBy("id", "flight").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("points"), F.min_by(place, "ts").alias("first"), F.max_by(place, "ts").alias("last"))
    low = (F.col("last.alt") <= rule.low_m) & (now - F.col("end") > int(rule.gap_s * 1000))
    return x.withColumn("landed", F.col("last.ground") | F.coalesce(low, F.lit(False))).drop("flight")


def messages(lines: DataFrame, kinds: tuple[str, ...] = ("aircraft", "vessel")) -> DataFrame:
    """Positions of military aircraft and vessels from recorded messages. lines: value (JSON).

    Most lines are of other kinds or of civil traffic: text is searched before any JSON is read.
    """
    named = F.lit(False)
    for k in kinds:
        named = named | F.contains("value", F.lit(f'"kind":"{k}"'))
    kind = "struct<t:string,e:struct<id:string,kind:string,label:string,ts:long,orig_ts:long,lon:double,lat:double,alt:double,spd:double,hdg:double,props:struct<military:boolean,on_ground:boolean>>>"
    x = lines.where(F.contains("value", F.lit('"military":true')) & named).select(F.from_json("value", kind).alias("m"))
    x = x.where((F.col("m.t") == "upsert") & F.col("m.e.kind").isin(*kinds) & F.col("m.e.props.military") & F.col("m.e.lon").isNotNull())
    e = F.col("m.e")
    return x.select(e["id"].alias("id"), F.coalesce(e["orig_ts"], e["ts"]).alias("ts"), e["lon"].alias("lon"), e["lat"].alias("lat"), F.coalesce(e["alt"], F.lit(0.0)).alias("alt"), e["spd"].alias("spd"), e["hdg"].alias("hdg"), F.coalesce(e["props"]["on_ground"], F.lit(False)).alias("ground"))


def rebuild(spark: SparkSession, folder: str, days: list[str], rule: Rule = RULE) -> DataFrame:
    """Kept positions from the recordings of some days (yyyymmdd.jsonl in a folder); days without one count for nothing."""
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    paths = [p for d in days if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p := f"{folder}/{d}.jsonl"))]
    lines = spark.read.text(paths) if paths else spark.createDataFrame([], "value string")
    return thin(messages(lines), rule)


_POINT = "ts long, lon double, lat double, alt double, spd double, hdg double, ground boolean"


class _Track(StatefulProcessor):
    """Positions wait in a list for the watermark; a timer folds those it has passed, and a later one forgets a silent key."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _POINT)
        self.last = handle.getValueState("last", "ts long, alt double, hdg double, ground boolean, flight long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for b in rows:
            self.waiting.appendList([tuple(None if pd.isna(v) else v for v in r) for r in b[ORDER].itertuples(index=False, name=None)])
            self.handle.registerTimer(int(b["ts"].min()) + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: tuple((v is not None, v) for v in r))
        ready, later = [r for r in waiting if r[0] < passed], [r for r in waiting if r[0] >= passed]
        last = self.last.get() if self.last.exists() else None
        if last is not None:
            last = (last[0], np.nan if last[1] is None else last[1], np.nan if last[2] is None else last[2], last[3], last[4])
        if ready:
            b = pd.DataFrame(ready, columns=ORDER)
            kept, flight, last = fold(self.rule, last, b["ts"].to_numpy(np.int64), b["alt"].to_numpy(float), b["hdg"].to_numpy(float), b["ground"].to_numpy(bool))
            none = lambda v: None if v != v else v
            self.last.update((last[0], none(last[1]), none(last[2]), last[3], last[4]))
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(later[0][0] + 1)
            else:
                self.waiting.clear()
            out = b[kept].astype({c: "float64" for c in ("lon", "lat", "alt", "spd", "hdg")})
            out.insert(0, "id", [key[0]] * len(out))
            out["flight"] = flight[kept]
            self.handle.registerTimer(last[0] + int(self.rule.hours * 3_600_000) + 1)
            yield out
        elif not later and last is not None and passed > last[0] + self.rule.hours * 3_600_000:
            self.last.clear()

    def close(self) -> None:
        pass


def stream(points: DataFrame, rule: Rule = RULE, late: str = "10 minutes") -> DataFrame:
    """What `thin` gives, over a stream: rows come once the watermark has passed them; what comes later than that is lost.

    A key that is silent for longer than the hours retained is forgotten; as that is longer than a gap, its next flight is new
    either way. Needs a state store with timers (RocksDB).
    """
    if rule.hours * 3600 <= rule.gap_s:
        raise ValueError("a key must be retained for longer than a gap")
    x = _points(points).withColumn("at", F.timestamp_millis("ts")).withWatermark("at", late)
    kind = dict(x.dtypes)["id"]
    return x.groupBy("id").transformWithStateInPandas(statefulProcessor=_Track(rule), outputStructType=f"id {kind}, {_POINT}, flight long", outputMode="append", timeMode="eventTime")
