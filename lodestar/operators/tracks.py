"""Sequence searches inside a bounded group: the longest feasible chain of detections, hulls, resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHAIN = "gap_id long, ids array<long>, length_km double, detections int"
#: Gaps that a task takes as one group, and cells of positions that are searched at once.
GAPS, CELLS = 1000, 1 << 18


def _chains(ids: np.ndarray, t: np.ndarray, lon: np.ndarray, lat: np.ndarray, vmax_kn: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Most detections, least way and the one before, at each place of many gaps of one length (rows) side by side."""
    rows, n = ids.shape
    rlat = np.radians(lat)
    best, cost, back = np.full((rows, n), -1), np.full((rows, n), np.inf), np.full((rows, n), -1)
    start = ids == -1
    one = np.flatnonzero(start.any(1))
    best[one, start[one].argmax(1)], cost[one, start[one].argmax(1)] = 0, 0.0
    for j in range(1, n):
        h = np.sin((rlat[:, j, None] - rlat[:, :j]) / 2) ** 2 + np.cos(rlat[:, :j]) * np.cos(rlat[:, j, None]) * np.sin(np.radians(lon[:, j, None] - lon[:, :j]) / 2) ** 2
        km = 2 * 6371.0088 * np.arcsin(np.sqrt(np.minimum(1, h)))
        fit = (best[:, :j] >= 0) & (ids[:, :j] != -2) & (ids[:, j, None] != -1) & (km <= vmax_kn * 1.852 * np.maximum(t[:, j, None] - t[:, :j], 0) + 1e-9)
        some = np.flatnonzero(fit.any(1))
        if not len(some):
            continue
        fit, km = fit[some], km[some]
        # Most detections, then the shortest way, then the first.
        most = np.where(fit, best[some, :j], -1)
        way = np.where(fit & (most == most.max(1)[:, None]), cost[some, :j] + km, np.inf)
        i = way.argmin(1)
        best[some, j], cost[some, j], back[some, j] = best[some, i] + (ids[some, j] >= 0), way[np.arange(len(some)), i], i
    return best, cost, back


def longest_chains(candidates: DataFrame, vmax_kn: float) -> DataFrame:
    """For each gap the longest chain of detections a vessel could have passed at its speed; ties go to the shortest way.

    candidates: gap_id, id, t (hours), lon, lat, with the gap's ends as ids -1 and -2. A gap holds the detections
    inside its ellipse, a bounded group, and the search over it is quadratic. Gaps of one length are searched side by side, about
    a thousand gaps in a group.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["gap_id", "t", "id"])
        gap, ids, t, lon, lat = (g[c].to_numpy() for c in ("gap_id", "id", "t", "lon", "lat"))
        off = np.flatnonzero(np.append(True, gap[1:] != gap[:-1]))
        size = np.diff(np.append(off, len(gap)))
        out = []
        for n in np.unique(size).tolist():
            every = off[size == n]
            step = max(1, CELLS // n)
            for s in range(0, len(every), step):
                at = every[s : s + step, None] + np.arange(n)
                best, cost, back = _chains(ids[at], t[at], lon[at], lat[at], vmax_kn)
                end = ids[at] == -2
                for r in np.flatnonzero(end.any(1)).tolist():
                    last = int(end[r].argmax())
                    if best[r, last] < 1:
                        continue
                    chain, k = [], last
                    while k >= 0:
                        if ids[at[r, k]] >= 0:
                            chain.append(int(ids[at[r, k]]))
                        k = int(back[r, k])
                    out.append((int(gap[at[r, 0]]), chain[::-1], float(cost[r, last]), len(chain)))
        return pd.DataFrame(out, columns=["gap_id", "ids", "length_km", "detections"])

    known = candidates.where("gap_id IS NOT NULL")
    groups = max(candidates.sparkSession.sparkContext.defaultParallelism, math.ceil(known.agg(F.approx_count_distinct("gap_id")).first()[0] / GAPS))
    dealt = known.withColumn("_group", F.pmod(F.xxhash64("gap_id"), F.lit(groups)))
    return dealt.groupBy("_group").applyInPandas(run, CHAIN)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull by monotone chains, counter-clockwise."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p

    def half(rows):
        out: list = []
        for r in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (r[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (r[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(r)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def hulls(df: DataFrame, key: str, lon: str, lat: str, held: int = 200_000) -> DataFrame:
    """Hull of each key's points as rings of two-element arrays.

    A hull of hulls is the hull: every task keeps only the hulls of what it has read, so what meets for a key is a few
    corners from each task, whatever the number of its points.
    """
    kind = dict(df.dtypes)[key]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        size = 0

        def rows() -> pd.DataFrame:
            parts = [(k, h) for k, p in known.items() if len(h := hull(np.concatenate(p)))]
            return pd.DataFrame({key: [k for k, h in parts for _ in h], "x": [x for _, h in parts for x in h[:, 0]], "y": [y for _, h in parts for y in h[:, 1]]})

        for b in batches:
            for k, g in b.groupby(key, sort=False, dropna=False):
                known.setdefault(None if pd.isna(k) else k, []).append(hull(g[["x", "y"]].to_numpy(float)))
            size += len(b)
            if size > held:
                yield rows()
                known.clear()
                size = 0
        yield rows()

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ring = hull(g[["x", "y"]].to_numpy(float))
        return pd.DataFrame({key: [g[key].iloc[0]], "ring": [ring.tolist()], "points": [len(ring)]})

    points = df.where(f"`{lon}` IS NOT NULL AND `{lat}` IS NOT NULL").select(key, df[lon].cast("double").alias("x"), df[lat].cast("double").alias("y"))
    return points.mapInPandas(partial, f"{key} {kind}, x double, y double").groupBy(key).applyInPandas(run, f"{key} {kind}, ring array<array<double>>, points int")
