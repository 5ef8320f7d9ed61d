"""A Python data source of paged JSON folders or HTTP services, one task for each data set and window.

The transport is a function, so that the same reader serves tests, folders and services. It retries with
exponential backoff; a page without rows, or without a new next offset, is the last.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RETRY = (429, 500, 502, 503, 504)


class Refused(Exception):
    def __init__(self, status: int, after: float | None = None):
        super().__init__(f"status {status}")
        self.status, self.after = status, after


def with_retries(call: Callable[[], dict], attempts: int = 6, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """The call's result; statuses that may pass are tried again, waiting as the service asks or twice as long each time."""
    for i in range(attempts):
        try:
            return call()
        except Refused as e:
            if e.status not in RETRY or i == attempts - 1:
                raise
            sleep(e.after if e.after is not None else first * 2**i)
    raise AssertionError


def pages(fetch: Callable[[int], dict], key: str = "entries") -> Iterator[dict]:
    """Rows of every page, by offset."""
    at = 0
    while True:
        got = with_retries(lambda: fetch(at))
        rows = got.get(key) or []
        if not rows:
            return
        yield from rows
        after = got.get("nextOffset")
        if after is None or after == at:
            return
        at = after


def batches(ids: list[str], size: int = 40) -> Iterator[list[str]]:
    for i in range(0, len(ids), size):
        yield ids[i : i + size]


@dataclass
class Window(InputPartition):
    dataset: str
    start: str

    def __init__(self, dataset: str, start: str):
        super().__init__((dataset, start))
        self.dataset, self.start = dataset, start


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["folder"]
        self.windows = [w.split("@") for w in options["windows"].split(",")]

    def partitions(self) -> list[Window]:
        return [Window(d, s) for d, s in self.windows]

    def read(self, partition: Window) -> Iterator[tuple]:
        from pathlib import Path

        folder = Path(self.folder, partition.dataset, partition.start)
        for page in sorted(folder.glob("page_*.json")):
            for row in json.loads(page.read_text()).get("entries", []):
                yield partition.dataset, partition.start, json.dumps(row)


class PagedSource(DataSource):
    """spark.read.format("lodestar_pages").option("folder", ..).option("windows", "gaps@2024-01-01,...")."""

    @classmethod
    def name(cls) -> str:
        return "lodestar_pages"

    def schema(self) -> str:
        return "dataset string, start string, value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
