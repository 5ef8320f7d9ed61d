"""Spherical and planar geometry as column expressions, and the ellipsoidal distance as an Arrow function."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Mean radii in km; both are in use, so every kernel takes the radius.
RADIUS, MEAN_RADIUS = 6371.0088, 6371.0
KM_PER_DEGREE = 111.32
KNOT_KMH = 1.852


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def haversine(lon1, lat1, lon2, lat2, radius: float = RADIUS) -> Column:
    """Great-circle distance in km."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Initial bearing in degrees from north, 0 to 360."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def destination(lon, lat, degrees, km, radius: float = RADIUS) -> Column:
    """Point reached from a start along a bearing: struct of lon and lat."""
    lon, lat, degrees, km = map(_c, (lon, lat, degrees, km))
    a, t, p = km / radius, F.radians(degrees), F.radians(lat)
    q = F.asin(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(p) * F.cos(a) + F.cos(p) * F.sin(a) * F.cos(t))))
    east = F.atan2(F.sin(t) * F.sin(a) * F.cos(p), F.cos(a) - F.sin(p) * F.sin(q))
    return F.struct((F.pmod(F.degrees(east) + lon + 540, F.lit(360.0)) - 180).alias("lon"), F.degrees(q).alias("lat"))


def midpoint(lon1, lat1, lon2, lat2) -> Column:
    return destination(lon1, lat1, bearing(lon1, lat1, lon2, lat2), haversine(lon1, lat1, lon2, lat2) / 2)


def circle(lon, lat, km, points: int = 64) -> Column:
    """Closed ring of points around a centre."""
    return F.transform(F.sequence(F.lit(0), F.lit(points)), lambda i: destination(lon, lat, F.pmod(i, F.lit(points)) * (360.0 / points), km))


def great_circle(lon1, lat1, lon2, lat2, points: int) -> Column:
    """Evenly spaced points from one end to the other, ends included."""
    b, d = bearing(lon1, lat1, lon2, lat2), haversine(lon1, lat1, lon2, lat2)
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: destination(lon1, lat1, b, d * i / (points - 1)))


def wrap(degrees) -> Column:
    """An angle's difference brought into [-180, 180)."""
    return F.pmod(_c(degrees) + 180, F.lit(360.0)) - 180


def turn(a, b) -> Column:
    """Least angle between two headings."""
    return F.abs(wrap(_c(a) - _c(b)))


def planar_km(lon1, lat1, lon2, lat2) -> Column:
    """Distance on a plane whose longitudes shrink with the cosine of the first latitude."""
    lon1, lat1, lon2, lat2 = map(_c, (lon1, lat1, lon2, lat2))
    return KM_PER_DEGREE * F.sqrt(F.pow((lon2 - lon1) * F.cos(F.radians(lat1)), 2) + F.pow(lat2 - lat1, 2))


def ellipse(distance_km, hours, vmax_kn, least_minor: float = 0.5, stray_km: float = 5.0) -> Column:
    """Where a vessel can have been between two sightings: struct of the ellipse with the sightings as foci.

    `impossible` says that even the straight way is too long; it then stands for a circle of stray_km at the end.
    """
    d, h, v = map(_c, (distance_km, hours, vmax_kn))
    reach = v * KNOT_KMH * h
    a, c = reach / 2, d / 2
    no = a < c
    b = F.when(no, F.lit(0.0)).otherwise(F.greatest(F.lit(least_minor), F.sqrt(F.greatest(F.lit(0.0), a * a - c * c))))
    return F.struct(
        reach.alias("max_distance_km"), a.alias("semi_major_km"), b.alias("semi_minor_km"), c.alias("focal_half_km"),
        F.when(no, F.lit(math.pi * stray_km**2)).otherwise(math.pi * a * b).alias("area_km2"), no.alias("impossible"))


def in_ellipse(to_start_km, to_end_km, max_distance_km, impossible, stray_km: float = 5.0) -> Column:
    return F.when(_c(impossible), _c(to_end_km) <= stray_km).otherwise(_c(to_start_km) + _c(to_end_km) <= _c(max_distance_km))


def in_ring(lon, lat, ring: Column, edge: bool = True) -> Column:
    """Ray casting over a closed ring of (lon, lat) structs. Of points on an edge some are in; without edge none is."""
    lon, lat = _c(lon), _c(lat)
    n = F.size(ring)

    def meets(i: Column) -> Column:
        """1 if the edge crosses the level to the point's right; null if the point lies on it and edges don't count."""
        a, b = F.element_at(ring, i), F.element_at(ring, i + 1)
        # The slope comes first: of an edge whose slope is exact the crossing is, too.
        at = (b["lon"] - a["lon"]) / F.when(a["lat"] != b["lat"], b["lat"] - a["lat"]) * (lat - a["lat"]) + a["lon"]
        crossed = F.when(((a["lat"] > lat) != (b["lat"] > lat)) & (lon < at), 1).otherwise(0)
        if edge:
            return crossed
        level = (a["lat"] == b["lat"]) & (lat == a["lat"]) & lon.between(F.least(a["lon"], b["lon"]), F.greatest(a["lon"], b["lon"]))
        steep = lat.between(F.least(a["lat"], b["lat"]), F.greatest(a["lat"], b["lat"])) & (lon == at)
        return F.when(level | steep, F.lit(None).cast("int")).otherwise(crossed)

    # A null stays null to the end of the sum.
    odd = F.aggregate(F.transform(F.sequence(F.lit(1), n - 1), meets), F.lit(0), lambda s, x: s + x) % 2 == 1
    return odd if edge else F.coalesce(odd, F.lit(False))


def to_polyline_km(lon, lat, line: Column) -> Column:
    """Least planar distance from a point to the segments of a line of (lon, lat) structs."""
    lon, lat = _c(lon), _c(lat)
    k = F.cos(F.radians(lat))

    def one(i: Column) -> Column:
        p, q = F.element_at(line, i), F.element_at(line, i + 1)
        ax, ay, bx, by = (p["lon"] - lon) * k, p["lat"] - lat, (q["lon"] - lon) * k, q["lat"] - lat
        dx, dy = bx - ax, by - ay
        sq = dx * dx + dy * dy
        t = F.when(sq == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(sq == 0, F.lit(1.0)).otherwise(sq))))
        return KM_PER_DEGREE * F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(line) - 1), one))


def _inverse(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Vincenty's inverse on WGS84 in km; points he does not converge for fall back to the sphere."""
    a, f = 6378.137, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (np.arctan((1 - f) * np.tan(np.radians(x))) for x in (lat1, lat2))
    diff = np.radians(lon2 - lon1)
    lam = diff.copy()
    with np.errstate(all="ignore"):
        for _ in range(60):
            s, c = np.sin(lam), np.cos(lam)
            ss = np.hypot(np.cos(u2) * s, np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * c)
            cs = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * c
            sig = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, np.cos(u1) * np.cos(u2) * s / ss)
            c2 = 1 - sa**2
            cm = np.where(c2 == 0, 0, cs - 2 * np.sin(u1) * np.sin(u2) / c2)
            k = f / 16 * c2 * (4 + f * (4 - 3 * c2))
            new = diff + (1 - k) * f * sa * (sig + k * ss * (cm + k * cs * (2 * cm**2 - 1)))
            moved = np.abs(new - lam)
            lam = new
            if not (moved > 1e-12).any():
                break
        u = c2 * (a * a - b * b) / (b * b)
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = small * ss * (cm + small / 4 * (cs * (2 * cm**2 - 1) - small / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        out = b * big * (sig - d)
        h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
        sphere = 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(1, h)))
    return np.where((moved > 1e-9) | ~np.isfinite(out), sphere, out)


@F.pandas_udf(T.DoubleType())
def geodesic(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Distance on the WGS84 ellipsoid in km, in Arrow batches."""
    return pd.Series(_inverse(*(x.to_numpy(float) for x in (lon1, lat1, lon2, lat2))))
