"""Satellites from mean elements: positions, ground tracks and passes over a place.

The published general-perturbation model for near-earth orbits (mean elements in, true-equator position out) is worked out
for whole batches of (satellite, time) pairs, which Spark makes by exploding times; nothing is looped row by row. Positions
become geodetic by the sidereal time and four Newton steps on the ellipsoid. Passes are islands of times within reach.

Defined results: ok is false, and the place null, for elements that are missing or of a period of 225 minutes or more, for
which another model holds, and for satellites that have come down by then.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.operators.joins import spread

# Constants of the model's earth (km, km^3/s^2, zonal harmonics), and of the geodetic ellipsoid.
MODEL_RADIUS, MU, J2, J3, J4 = 6378.135, 398600.8, 0.001082616, -0.00000253881, -0.00000165597
SEMI_MAJOR, FLATTENING = 6378.137, 1 / 298.257223563
#: Heights in km where the drag law's fit ends, and the altitude of its lower and upper bound.
DRAG_LOW, DRAG_HIGH, SIMPLE_BELOW = 78.0, 120.0, 220.0
DEEP_MINUTES = 225.0
XKE = 60 / math.sqrt(MODEL_RADIUS**3 / MU)
ELEMENTS = ["mean_motion", "eccentricity", "inclination", "node", "perigee", "anomaly", "bstar"]


def propagate(n: np.ndarray, e: np.ndarray, incl: np.ndarray, node: np.ndarray, peri: np.ndarray, anomaly: np.ndarray, bstar: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True-equator positions in km [..., 3] after t minutes, and whether they hold. n in turns a day, angles in degrees."""
    with np.errstate(all="ignore"):
        incl, node, peri, anomaly = map(np.radians, (incl, node, peri, anomaly))
        given = n * 2 * math.pi / 1440
        c = np.cos(incl)
        s, c2 = np.sin(incl), c * c
        b2 = 1 - e * e
        b = np.sqrt(b2)
        # The mean motion of the elements is freed of the oblateness it was averaged with.
        a1 = (XKE / given) ** (2 / 3)
        d = 0.75 * J2 * (3 * c2 - 1) / (b * b2)
        d1 = d / a1**2
        a0 = a1 * (1 - d1**2 - d1 * (1 / 3 + 134 * d1**2 / 81))
        mean = given / (1 + d / a0**2)
        a = (XKE / mean) ** (2 / 3)
        p = a * b2
        low = a * (1 - e) - 1  # perigee above the surface, in radii
        height = low * MODEL_RADIUS
        base = np.where(height < 98, 20.0, np.where(height < 156, height - DRAG_LOW, DRAG_LOW))
        q4 = ((DRAG_HIGH - base) / MODEL_RADIUS) ** 4
        sfour = base / MODEL_RADIUS + 1
        simple = height < SIMPLE_BELOW
        tsi = 1 / (a - sfour)
        eta = a * e * tsi
        eta2, ee = eta * eta, e * eta
        psi2 = np.abs(1 - eta2)
        coef = q4 * tsi**4
        coef1 = coef / psi2**3.5
        x3, x1 = 3 * c2 - 1, 1 - c2
        cc2 = coef1 * mean * (a * (1 + 1.5 * eta2 + ee * (4 + eta2)) + 0.375 * J2 * tsi / psi2 * x3 * (8 + 3 * eta2 * (8 + eta2)))
        cc1 = bstar * cc2
        round_ = e <= 1e-4
        cc3 = np.where(round_, 0.0, -2 * coef * tsi * (J3 / J2) * mean * s / e)
        cc4 = 2 * mean * coef1 * a * b2 * (eta * (2 + 0.5 * eta2) + e * (0.5 + 2 * eta2) - J2 * tsi / (a * psi2) * (-3 * x3 * (1 - 2 * ee + eta2 * (1.5 - 0.5 * ee)) + 0.75 * x1 * (2 * eta2 - ee * (1 + eta2)) * np.cos(2 * peri)))
        cc5 = 2 * coef1 * a * b2 * (1 + 2.75 * (eta2 + ee) + ee * eta2)
        # Secular rates.
        k1 = 1.5 * J2 / p**2 * mean
        k2 = 0.5 * k1 * J2 / p**2
        k3 = -0.46875 * J4 / p**4 * mean
        c4 = c2 * c2
        mean_rate = mean + 0.5 * k1 * b * x3 + 0.0625 * k2 * b * (13 - 78 * c2 + 137 * c4)
        peri_rate = -0.5 * k1 * (1 - 5 * c2) + 0.0625 * k2 * (7 - 114 * c2 + 395 * c4) + k3 * (3 - 36 * c2 + 49 * c4)
        turn = -k1 * c
        node_rate = turn + (0.5 * k2 * (4 - 19 * c2) + 2 * k3 * (3 - 7 * c2)) * c
        m, w, o = anomaly + mean_rate * t, peri + peri_rate * t, node + node_rate * t + 3.5 * b2 * turn * cc1 * t * t
        fall, lose, gain = 1 - cc1 * t, bstar * cc4 * t, 1.5 * cc1 * t * t
        # Further drag terms, but for orbits so low that the model leaves them out.
        more = bstar * cc3 * np.cos(peri) * t + np.where(round_, 0.0, -2 / 3 * coef * bstar / ee * ((1 + eta * np.cos(m)) ** 3 - (1 + eta * np.cos(anomaly)) ** 3))
        d2 = 4 * a * tsi * cc1**2
        step = d2 * tsi * cc1 / 3
        d3 = (17 * a + sfour) * step
        d4 = 0.5 * step * a * tsi * (221 * a + 31 * sfour) * cc1
        t3, t4 = d2 + 2 * cc1**2, 0.25 * (3 * d3 + cc1 * (12 * d2 + 10 * cc1**2))
        t5 = 0.2 * (3 * d4 + 12 * cc1 * d3 + 6 * d2**2 + 15 * cc1**2 * (2 * d2 + cc1**2))
        full = ~simple
        m, w = np.where(full, m + more, m), np.where(full, w - more, w)
        fall = np.where(full, fall - d2 * t**2 - d3 * t**3 - d4 * t**4, fall)
        lose = np.where(full, lose + bstar * cc5 * (np.sin(m) - np.sin(anomaly)), lose)
        gain = np.where(full, gain + t3 * t**3 + t**4 * (t4 + t * t5), gain)
        axis = a * fall**2
        e_t = e - lose
        good = (e_t < 1) & (e_t >= -0.001)
        e_t = np.maximum(e_t, 1e-6)
        length = m + mean * gain + w + o
        # Long-period terms, Kepler's equation, short-period terms.
        x = e_t * np.cos(w)
        inv = 1 / (axis * (1 - e_t**2))
        y = e_t * np.sin(w) - inv * 0.5 * (J3 / J2) * s
        flat = np.where(np.abs(c + 1) > 1.5e-12, 1 + c, 1.5e-12)
        u = np.remainder(length - inv * 0.25 * (J3 / J2) * s * (3 + 5 * c) / flat * x - o, 2 * math.pi)
        k = u.copy()
        for _ in range(10):
            k += np.clip((u - y * np.cos(k) + x * np.sin(k) - k) / (1 - x * np.cos(k) - y * np.sin(k)), -0.95, 0.95)
        ec, es, el2 = x * np.cos(k) + y * np.sin(k), x * np.sin(k) - y * np.cos(k), x * x + y * y
        r, beta, pl = axis * (1 - ec), np.sqrt(1 - el2), axis * (1 - el2)
        f = es / (1 + beta)
        su, cu = axis / r * (np.sin(k) - y - x * f), axis / r * (np.cos(k) - x + y * f)
        s2, co2 = 2 * su * cu, 1 - 2 * su * su
        h1 = 0.5 * J2 / pl
        h2 = h1 / pl
        radius = r * (1 - 1.5 * h2 * beta * x3) + 0.5 * h1 * x1 * co2
        angle = np.arctan2(su, cu) - 0.25 * h2 * (7 * c2 - 1) * s2
        o, i = o + 1.5 * h2 * c * s2, incl + 1.5 * h2 * c * s * co2
        place = np.stack([np.cos(o) * np.cos(angle) - np.sin(o) * np.cos(i) * np.sin(angle), np.sin(o) * np.cos(angle) + np.cos(o) * np.cos(i) * np.sin(angle), np.sin(i) * np.sin(angle)], -1)
        ok = good & (radius >= 1) & (pl >= 0) & (2 * math.pi / mean < DEEP_MINUTES) & np.isfinite(radius)
        return place * (radius * MODEL_RADIUS)[..., None], ok


def sidereal(jd: np.ndarray) -> np.ndarray:
    """Greenwich mean sidereal time in radians."""
    t = (jd - 2451545.0) / 36525
    seconds = 67310.54841 + (876600.0 * 3600 + 8640184.812866) * t + 0.093104 * t**2 - 6.2e-6 * t**3
    return np.radians(np.remainder(seconds, 86400) / 240)


def geodetic(place: np.ndarray, jd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longitude and latitude in degrees and height in km of true-equator positions."""
    theta, e2 = sidereal(jd), FLATTENING * (2 - FLATTENING)
    x, y, z = place[..., 0], place[..., 1], place[..., 2]
    lon = np.remainder(np.degrees(np.arctan2(y, x) - theta) + 180, 360) - 180
    flat = np.hypot(x, y)
    lat = np.arctan2(z, flat * (1 - e2))
    for step in range(5):
        normal = SEMI_MAJOR / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        height = flat / np.cos(lat) - normal
        if step < 4:
            lat = np.arctan2(z, flat * (1 - e2 * normal / (normal + height)))
    return lon, np.degrees(lat), height


def elements(orbits: DataFrame) -> DataFrame:
    """Rows of `feeds.orbits` as norad, name, epoch and ELEMENTS; other columns stay."""
    names = dict(zip(("NORAD_CAT_ID", "OBJECT_NAME", "EPOCH", "MEAN_MOTION", "ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE", "ARG_OF_PERICENTER", "MEAN_ANOMALY", "BSTAR"), ("norad", "name", "epoch", *ELEMENTS)))
    return orbits.withColumnsRenamed(names)


def _places(columns: list[np.ndarray], minutes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Longitude, latitude, height and whether they hold."""
    place, ok = propagate(*columns, minutes)
    with np.errstate(all="ignore"):
        return *geodetic(place, at / 86400 + 2440587.5), ok


def _timed(sats: DataFrame, start: Column, more: tuple[str, ...] = ()) -> DataFrame:
    epoch = F.unix_micros(F.col("epoch").cast("timestamp")) / 1e6
    return sats.select("norad", *more, epoch.alias("e0"), start.cast("double").alias("s0"), *(F.col(c).cast("double") for c in ELEMENTS))


def positions(sats: DataFrame, start: Column, seconds: float, step: float, more: tuple[str, ...] = ()) -> DataFrame:
    """Each satellite (norad, epoch, ELEMENTS) at every step from start (epoch seconds) for so long: norad, k (number of the step), at, lon, lat, alt_km, ok, and more of its columns.

    Satellites are dealt to as many tasks as their times need, and times exploded before the model.
    """
    count = max(1, math.ceil(seconds / step))
    x = _timed(spread(sats, count * 4), start, more)
    x = x.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("at", F.col("s0") + F.col("k") * step)
    x = x.select("norad", "k", "at", *more, ((F.col("at") - F.col("e0")) / 60).alias("minutes"), *ELEMENTS)
    first = 3 + len(more)
    held = ", ".join(f"{c} {kind}" for c, kind in x.dtypes[:first])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, minutes, *cols = [b.column(i).to_numpy(zero_copy_only=False).astype(float) for i in (2, *range(first, b.num_columns))]
            lon, lat, alt, ok = _places(cols, minutes, at)
            yield pa.RecordBatch.from_arrays([*b.columns[:first], *(pa.array(v, mask=~ok) for v in (lon, lat, alt)), pa.array(ok)], names=["norad", "k", "at", *more, "lon", "lat", "alt_km", "ok"])

    return x.mapInArrow(run, f"{held}, lon double, lat double, alt_km double, ok boolean")


def ground_tracks(sats: DataFrame, now: Column, minutes: float = 45, step: float = 90) -> DataFrame:
    """norad, lon, lat and alt_km now, and track, the places of the coming minutes; a satellite without a place now has no row.

    All times of a satellite are worked out in its row, so that one row of it is exchanged and not one for each time.
    """
    count = max(1, math.ceil((minutes * 60 + 1) / step))
    x = _timed(spread(sats, count * 4), now)
    kind, rows = dict(x.dtypes)["norad"], 2_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, rows):
                b = whole.slice(i, rows)
                e0, s0, *cols = [c.to_numpy(zero_copy_only=False).astype(float)[:, None] for c in b.columns[1:]]
                at = s0 + np.arange(count) * step
                lon, lat, alt, ok = _places(cols, (at - e0) / 60, at)
                ks, ends = np.broadcast_to(np.arange(count, dtype=np.int32), ok.shape)[ok], np.concatenate([[0], ok.sum(1).cumsum()]).astype(np.int32)
                track = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(ks), pa.array(lon[ok]), pa.array(lat[ok])], names=["k", "lon", "lat"]))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(v[:, 0], mask=~ok[:, 0]) for v in (lon, lat, alt)), track], names=["norad", "lon", "lat", "alt_km", "track"])

    x = x.mapInArrow(run, f"norad {kind}, lon double, lat double, alt_km double, track array<struct<k:int,lon:double,lat:double>>")
    g = x.groupBy("norad").agg(*(F.max(c).alias(c) for c in ("lon", "lat", "alt_km")), F.flatten(F.collect_list("track")).alias("track"))
    track = F.transform(F.sort_array(F.transform("track", lambda p: F.struct(p["k"].alias("k"), F.round(p["lon"], 3).alias("lon"), F.round(p["lat"], 3).alias("lat")))), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    return g.where("lon IS NOT NULL").withColumn("track", track)


def sun_elevation(lon: Column, lat: Column, at: Column) -> Column:
    """Height of the sun in degrees over a place at epoch seconds, to a fraction of a degree."""
    d = at / 86400.0 + (2440587.5 - 2451545.0)
    mean, q = F.radians(F.pmod(357.529 + 0.98560028 * d, F.lit(360.0))), F.pmod(280.459 + 0.98564736 * d, F.lit(360.0))
    long = F.radians(q + 1.915 * F.sin(mean) + 0.020 * F.sin(2 * mean))
    tilt = F.radians(23.439 - 0.00000036 * d)
    decl = F.asin(F.sin(tilt) * F.sin(long))
    hour = F.radians(F.pmod(18.697374558 + 24.06570982441908 * d, F.lit(24.0)) * 15 + lon) - F.atan2(F.cos(tilt) * F.sin(long), F.cos(long))
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(decl) + F.cos(F.radians(lat)) * F.cos(decl) * F.cos(hour)))


def passes(sats: DataFrame, places: DataFrame, start: Column, hours: float = 24, step: float = 20, most_hours: float = 72) -> DataFrame:
    """Windows in which a place (place, lon, lat) is within a satellite's access_km: place, norad, start and end in ms, closest_km, daylight.

    sats has sensor and access_km as well; daylight is told for optical sensors alone. The few places are broadcast.
    """
    reach = positions(sats, start, min(hours, most_hours) * 3600, step, ("sensor", "access_km")).where("ok")
    spots = F.broadcast(places.select("place", F.col("lon").alias("_x"), F.col("lat").alias("_y")))
    # A degree of latitude is no less than 110 km: most pairs fall by that alone.
    near = reach.join(spots, F.abs(F.col("lat") - F.col("_y")) <= F.col("access_km") / 110).withColumn("km", geo.haversine("lon", "lat", "_x", "_y", geo.MEAN_RADIUS)).where("km <= access_km")
    run = F.col("k") - F.row_number().over(Window.partitionBy("place", "norad").orderBy("k"))
    g = near.withColumn("_run", run).groupBy("place", "norad", "_run").agg(F.first("sensor").alias("sensor"), F.first("_x").alias("_x"), F.first("_y").alias("_y"), F.min("at").alias("_a"), F.max("at").alias("_b"), F.min("km").alias("closest_km"))
    middle = F.col("_a") + F.floor((F.col("_b") - F.col("_a")) / step / 2) * step
    ms = lambda c: F.round(c * 1000).cast("long")
    light = F.when(F.col("sensor") == "optical", sun_elevation(F.col("_x"), F.col("_y"), middle) > 0)
    return g.select("place", "norad", "sensor", ms(F.col("_a")).alias("start"), ms(F.col("_b") + step).alias("end"), F.round("closest_km").cast("long").alias("closest_km"), light.alias("daylight"))
