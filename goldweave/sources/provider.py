"""Provider fixtures as a Spark data source: ``spark.read.format("provider")`` and ``readStream``.

A new provider is a folder of JSON files and a schema; nothing else registers.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

MANIFEST = "manifest.json"


@dataclass
class Page(InputPartition):
    """One page of one endpoint: a file of its own, read by a task of its own."""

    endpoint: str
    page: int
    path: str


def pages(folder: str) -> list[Page]:
    """``<endpoint>.json`` is an endpoint of one page; ``<endpoint>/<number>.json`` are its pages."""
    out = []
    for name in sorted(os.listdir(folder)):
        path = os.path.join(folder, name)
        if os.path.isdir(path):
            numbers = sorted(int(n.removesuffix(".json")) for n in os.listdir(path) if n.removesuffix(".json").isdigit())
            out += [Page(name, n, os.path.join(path, f"{n}.json")) for n in numbers]
        elif name.endswith(".json") and name != MANIFEST:
            out.append(Page(name.removesuffix(".json"), 1, path))
    return out


class ProviderSource(DataSource):
    """Options: ``root`` (a folder that all executors see), ``provider``, ``endpoint`` and ``pages`` (names and numbers that are read, comma-joined; all
    without), ``records`` (key of the list), ``pages_per_batch`` of a stream. Other files are never opened."""

    @classmethod
    def name(cls) -> str:
        return "provider"

    def schema(self) -> str:
        return "endpoint string, page int, place long, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ProviderReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ProviderStream(self.options)


class Rows:
    """What batch and stream share: which pages there are, and the rows of one."""

    def __init__(self, options: dict[str, str]):
        self.folder = os.path.join(options["root"], options["provider"])
        self.records = options.get("records", "results")
        self.endpoints = set(options["endpoint"].split(",")) if options.get("endpoint") else None
        self.numbers = {int(n) for n in options["pages"].split(",")} if options.get("pages") else None

    def wanted(self) -> list[Page]:
        return [p for p in pages(self.folder) if (self.endpoints is None or p.endpoint in self.endpoints) and (self.numbers is None or p.page in self.numbers)]

    def read(self, partition: Page | None) -> Iterator[tuple]:
        if partition is None:  # Spark's single task where no page is wanted
            return
        with open(partition.path) as f:
            found = json.load(f)
        rows = found.get(self.records, [found]) if isinstance(found, dict) else found
        for i, row in enumerate(rows):
            yield partition.endpoint, partition.page, i, json.dumps(row, sort_keys=True)


class ProviderReader(Rows, DataSourceReader):
    """One task a page.

    Which files are opened is decided by options, not by ``pushFilters``: Spark 4.1 keeps the
    pages of the last filter for all queries over one DataFrame, so that two differently
    filtered uses of it would both read the pages of one.
    """

    def partitions(self) -> list[Page]:
        return self.wanted()


class ProviderStream(Rows, DataSourceStreamReader):
    """An offset is the last page read of each endpoint; pages are written once, in order of their number."""

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.step = int(options.get("pages_per_batch", "1000"))
        self.reached: dict[str, int] | None = None

    def initialOffset(self) -> dict[str, int]:
        return {}

    def latestOffset(self) -> dict[str, int]:
        """At most ``pages_per_batch`` pages of each endpoint beyond the last offset given."""
        done = dict(self.reached or {})
        fresh: dict[str, list[int]] = {}
        for p in self.wanted():
            if p.page > done.get(p.endpoint, 0):
                fresh.setdefault(p.endpoint, []).append(p.page)
        self.reached = done | {e: n[: self.step][-1] for e, n in fresh.items()}
        return self.reached

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Page]:
        if self.reached is None or any(self.reached.get(e, 0) < n for e, n in end.items()):
            self.reached = dict(end)  # a restart goes on where the log of the query ends
        return [p for p in self.wanted() if start.get(p.endpoint, 0) < p.page <= end.get(p.endpoint, 0)]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ProviderSource)
