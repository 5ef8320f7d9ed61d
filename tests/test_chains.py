"""Longest chains of many gaps searched side by side."""

import random

from lodestar.operators import tracks


def test_gaps_of_one_group_are_searched_side_by_side(spark, monkeypatch):
    """As a plain search of each gap, whatever shares its group: ties, missing ends, one gap longer than a step."""
    monkeypatch.setattr(tracks, "CELLS", 40)
    r = random.Random(1)
    rows = []
    for gap in range(60):
        n = 50 if gap == 7 else r.randrange(0, 9)
        made = [(gap, 100 * gap + i, float(r.randrange(1, 40)), r.choice([0.0, 0.5, 1.0]), r.choice([0.0, 0.5])) for i in range(n)]
        rows += made + [(gap, -1, 0.0, 0.0, 0.0)] * (gap % 10 != 3) + [(gap, -2, 41.0, 0.0, 0.0)] * (gap % 10 != 4)
    got = {x["gap_id"]: (x["ids"], x["detections"]) for x in tracks.longest_chains(spark.createDataFrame(rows, "gap_id long, id long, t double, lon double, lat double"), 5.0).collect()}
    want = {}
    for gap in range(60):
        g = sorted((x for x in rows if x[0] == gap), key=lambda x: (x[2], x[1]))
        best = {}
        for j, (_, i, t, lon, lat) in enumerate(g):
            if i == -1:
                best[j] = (0, 0.0, [])
                continue
            ways = []
            for k, (most, cost, ids) in best.items():
                km = spherical(g[k], g[j])
                if g[k][1] != -2 and km <= 5.0 * 1.852 * (t - g[k][2]) + 1e-9:
                    ways.append((-most, cost + km, k))
            if ways:
                most, cost, k = min(ways)
                best[j] = (-most + (i >= 0), cost, best[k][2] + [i] * (i >= 0))
        for j, x in enumerate(g):
            if x[1] == -2 and j in best and best[j][0] > 0:
                want[gap] = (best[j][2], best[j][0])
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and len(want) > 30
    assert all(len(got[k][0]) == got[k][1] for k in got)


def spherical(a, b):
    from math import asin, cos, radians, sin, sqrt

    h = sin(radians(b[4] - a[4]) / 2) ** 2 + cos(radians(a[4])) * cos(radians(b[4])) * sin(radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371.0088 * asin(sqrt(min(1, h)))
