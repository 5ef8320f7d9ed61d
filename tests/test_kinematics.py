"""Flight states against a plain walk over each flight's rows."""

import math
import random
from datetime import datetime, timedelta

import pytest

from lodestar.operators import kinematics

COLUMNS = "flight string, seq long, ts timestamp_ntz, lon double, lat double, alt double, gs double, trk double"


def km(a, b):
    h = math.sin(math.radians(b[4] - a[4]) / 2) ** 2 + math.cos(math.radians(a[4])) * math.cos(math.radians(b[4])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


def missing(v):
    return v is None or math.isnan(v)


def turned(rows):
    seen = [r[7] for r in rows if not missing(r[7])]
    return sum(abs((b - a + 180) % 360 - 180) for a, b in zip(seen, seen[1:]))


def plain(rows, i):
    r = rows[i]
    back = lambda s: [x for x in rows[: i + 1] if x[2] >= r[2] - timedelta(seconds=s)]
    short, long = back(120), back(900)
    span = (r[2] - short[0][2]).total_seconds()
    dt = max(span, 1.0)
    climb = (r[5] - short[0][5]) / 0.3048 / (dt / 60) if len(short) > 1 else 0.0
    path = sum(km(a, b) for a, b in zip(long, long[1:]))
    derived = km(short[0], r) / (dt / 3600) / 1.852 if span >= 30 else None
    if missing(r[6]):
        hours = max((r[2] - long[0][2]).total_seconds() / 3600, 1e-6)
        speed = derived if derived is not None else path / hours / 1.852 if len(long) > 1 else 0.0
    else:
        speed = derived if derived is not None and turned(short) < 45 and derived > 50 and abs(r[6] - derived) > 0.35 * derived else r[6]
    return max(-8000, min(8000, climb)), min(turned(long), 2000.0), km(long[0], r) / path if path > 1 else 1.0, speed


def test_states_equal_a_plain_walk(spark):
    """Straight and turning flights, reported speeds that positions contradict, missing headings and speeds, equal times."""
    r, rows = random.Random(5), []
    for f in range(6):
        t, x, y, h = datetime(2024, 3, 1), 30.0 + f, 50.0, 90.0
        for i in range(120):
            t += timedelta(seconds=r.choice([0, 1, 5, 10, 20, 40, 400 if f == 2 else 10]))
            h = (h + (r.uniform(-30, 30) if f % 2 else r.uniform(-1, 1))) % 360
            x, y = x + 0.02 * math.sin(math.radians(h)), y + 0.02 * math.cos(math.radians(h))
            trk = r.choice([h, h, h, None, float("nan")]) if f < 5 else None
            rows.append((f"f{f}", i, t, x, y, 1000.0 + 50 * i * r.random(), r.choice([400.0, 100.0, 900.0, None, float("nan")]), trk))
    got = {(s["flight"], s["seq"]): s for s in kinematics.states(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert len(got) == len(rows)
    for f in range(6):
        mine = [x for x in rows if x[0] == f"f{f}"]
        for i in range(len(mine)):
            s, want = got[f"f{f}", i], plain(mine, i)
            assert (s["vrate_fpm"], s["turned"], s["straightness"], s["gs_kn"]) == pytest.approx(want, rel=1e-6, abs=1e-6), (f, i)
    assert all(0 <= s["heading"] < 360 for s in got.values()) and got["f5", 0]["heading"] == 0.0


def test_no_flights(spark):
    assert kinematics.states(spark.createDataFrame([], COLUMNS)).collect() == []
