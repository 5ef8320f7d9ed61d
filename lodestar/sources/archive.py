"""Archives of gzipped traces that were split into parts at any byte, as a data source.

The parts in order are one TAR file. Only its headers are read when the work is planned, by seeking from member to member; a
partition is then a run of members, whose bytes it reads across the cuts, one member at a time. No part, and no archive, is
ever held as a whole.
"""

from __future__ import annotations

import bisect
import gzip
import io
import tarfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of members in one partition.
RUN = 64 << 20


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri if uri.startswith("/") else uri.replace("file:/", "file:///", 1))


def parts_of(folder: str, begins: str = "") -> list[tuple[str, int]]:
    """Files of a folder whose names begin so, in order of name, with their sizes."""
    from pyarrow import fs

    system, root = _open(folder)
    found = [f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file and f.base_name.startswith(begins) and not f.base_name.startswith((".", "_"))]
    scheme = folder.split("://")[0] + "://" if "://" in folder else ""
    return [(f"{folder.rstrip('/')}/{f.base_name}" if scheme else f.path, f.size) for f in sorted(found, key=lambda f: f.base_name)]


class Joined(io.RawIOBase):
    """Parts one after the other as one file that can be read and searched; one part is open at a time."""

    def __init__(self, parts: list[tuple[str, int]]):
        self.parts, self.at = [p for p in parts if p[1]], 0
        self.ends = []
        for _, size in self.parts:
            self.ends.append(size + (self.ends[-1] if self.ends else 0))
        self.size, self.open, self.file = self.ends[-1] if self.ends else 0, -1, None

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def tell(self) -> int:
        return self.at

    def readinto(self, buffer) -> int:
        if self.at >= self.size:
            return 0
        i = bisect.bisect_right(self.ends, self.at)
        if i != self.open:
            self.close_part()
            system, path = _open(self.parts[i][0])
            self.file, self.open = system.open_input_file(path), i
        start = self.ends[i] - self.parts[i][1]
        self.file.seek(self.at - start)
        got = self.file.read(min(len(buffer), self.ends[i] - self.at))
        if not got:
            raise OSError(f"{self.parts[i][0]} is shorter than it was")
        buffer[: len(got)] = got
        self.at += len(got)
        return len(got)

    def close_part(self) -> None:
        if self.file is not None:
            self.file.close()
        self.open, self.file = -1, None

    def close(self) -> None:
        self.close_part()
        super().close()


def members(parts: list[tuple[str, int]]) -> Iterator[tuple[str, int, int]]:
    """Name, first byte and size of each regular file of the archive. An archive that breaks off raises."""
    raw = Joined(parts)
    with raw, tarfile.open(fileobj=io.BufferedReader(raw, 4096), mode="r:", errorlevel=2) as tar:
        for m in tar:
            tar.members = []  # headers passed aren't kept
            if m.isreg():
                if m.offset_data + m.size > raw.size:
                    raise tarfile.ReadError(f"the archive breaks off in {m.name}")
                yield m.name, m.offset_data, m.size


def contents(parts: list[tuple[str, int]], run: list[tuple[str, int, int]]) -> Iterator[tuple[str, str]]:
    """Name and text of members; gzipped ones are unpacked."""
    raw = Joined(parts)
    with raw:
        for name, start, size in run:
            raw.seek(start)
            data = bytearray()
            while len(data) < size:
                piece = raw.read(size - len(data))
                if not piece:
                    raise OSError(f"the archive breaks off in {name}")
                data += piece
            yield name, (gzip.decompress(bytes(data)) if data[:2] == b"\x1f\x8b" else bytes(data)).decode("utf-8", "replace")


@dataclass
class Run(InputPartition):
    members: list


class _Reader(DataSourceReader):
    def __init__(self, parts: list[tuple[str, int]], holds: str, run: int):
        self.parts, self.holds, self.run = parts, holds, run

    def partitions(self) -> list[Run]:
        out, held = [[]], 0
        for m in members(self.parts) if self.parts else ():
            if self.holds in m[0]:
                if held + m[2] > self.run and out[-1]:
                    out.append([])
                    held = 0
                out[-1].append(m)
                held += m[2]
        return [Run(x) for x in out]

    def read(self, partition: Run) -> Iterator[tuple[str, str]]:
        return contents(self.parts, partition.members)


class SplitArchive(DataSource):
    """Options: path (folder of the parts), begins (of the parts' names), holds (text in the members' names), run (bytes of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "split_archive"

    def schema(self) -> str:
        return "name string, value string"

    def reader(self, schema) -> _Reader:
        return _Reader(parts_of(self.options["path"], self.options.get("begins", "")), self.options.get("holds", ""), int(self.options.get("run", RUN)))


def traces(spark: SparkSession, folder: str, begins: str = "", holds: str = "trace_full", run: int = RUN) -> DataFrame:
    """Traces of an archive as `feeds.trace_points` takes them: icao, r, t, dbFlags, timestamp, trace. What is no JSON is null throughout and goes."""
    spark.dataSource.register(SplitArchive)
    raw = spark.read.format("split_archive").options(path=folder, begins=begins, holds=holds, run=str(run)).load()
    x = raw.select(F.from_json("value", "struct<icao:string,r:string,t:string,dbFlags:int,timestamp:double,trace:array<array<string>>>").alias("j")).select("j.*").where("icao IS NOT NULL")
    number = lambda p, i: F.try_element_at(p, F.lit(i)).try_cast("double")
    point = lambda p: F.struct(number(p, 1).alias("offset"), number(p, 2).alias("lat"), number(p, 3).alias("lon"), F.try_element_at(p, F.lit(4)).alias("alt"), F.get_json_object(F.try_element_at(p, F.lit(9)), "$.flight").alias("callsign"))
    return x.withColumn("trace", F.transform("trace", point))
