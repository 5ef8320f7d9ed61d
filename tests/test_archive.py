"""Split archives: cut at any byte they read the same."""

import gzip
import io
import json
import tarfile

import pytest

from lodestar.sources import archive, feeds


def trace(i, flags=1):
    points = [[0, 45.0, 30.0 + i, 1000, 200, 90, 0, 0, {"flight": f"CALL{i} "}], [60, 45.1, 30.1 + i, "ground", 10, None, 0, 0, None], [120, None, 30.2 + i, 900]]
    return {"icao": f"a{i:05d}", "r": f"R{i}", "t": "C17", "dbFlags": flags, "timestamp": 1_700_000_000.5, "trace": points}


@pytest.fixture(scope="module")
def whole():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.GNU_FORMAT) as tar:
        for i in range(4):
            data = gzip.compress(json.dumps(trace(i, i % 2)).encode(), mtime=0)
            info = tarfile.TarInfo(("x" * 120 + "/" if i == 2 else "./traces/") + f"trace_full_{i}.json")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
        tar.addfile(tarfile.TarInfo("readme"), io.BytesIO())
    return out.getvalue().rstrip(b"\0") + b"\0" * 1024


def cut(folder, data, *at):
    folder.mkdir(exist_ok=True)
    parts = []
    for i, (a, b) in enumerate(zip((0, *at), (*at, len(data)))):
        path = folder / f"day.tar.a{chr(97 + i)}"
        path.write_bytes(data[a:b])
        parts.append((str(path), b - a))
    return parts


def test_every_cut_reads_the_same(tmp_path, whole):
    want = list(archive.contents(parts := cut(tmp_path / "one", whole), list(archive.members(parts))))
    assert len(want) == 5 and json.loads(want[2][1])["icao"] == "a00002" and want[2][0].startswith("x" * 120)
    for at in range(0, len(whole), 13):
        parts = cut(tmp_path / "two", whole, at)
        assert list(archive.contents(parts, list(archive.members(parts)))) == want
    parts = cut(tmp_path / "many", whole, *range(100, len(whole), 700))
    assert list(archive.contents(parts, list(archive.members(parts)))) == want


def test_an_archive_that_breaks_off_raises(tmp_path, whole):
    with pytest.raises((tarfile.ReadError, OSError)):
        list(archive.members(cut(tmp_path / "short", whole[:700])))


def test_traces_of_a_split_archive(spark, tmp_path, whole):
    cut(tmp_path / "parts", whole, 600, 601, 2000)
    got = archive.traces(spark, str(tmp_path / "parts"), begins="day.tar", run=1)
    assert got.rdd.getNumPartitions() == 4
    points = feeds.trace_points(got, (0.0, 0.0, 90.0, 90.0)).orderBy("hex", "ts").collect()
    assert [(p["hex"], p["ground"], p["callsign"]) for p in points if p["lat"] is not None] == [("a00001", False, "CALL1"), ("a00001", True, "CALL1"), ("a00003", False, "CALL3"), ("a00003", True, "CALL3")]
    (tmp_path / "none").mkdir()
    assert archive.traces(spark, str(tmp_path / "none")).count() == 0
