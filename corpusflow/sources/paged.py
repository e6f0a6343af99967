"""Rows of a paged web API as a Spark data source, for batches and streams.

    spark.dataSource.register(PagedSource)
    spark.read.format("paged").option("transport", "module:function").schema(...).load(url)

The transport is called with an address and gives a fetch.Reply whose body is one
JSON object: `rows`, a list of objects, and `total`, how many there are now. A
page is asked for with the parameters offset and length.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .fetch import with_retries


class Page(InputPartition):
    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class _Client:
    """Pages of one address; waits and tries again as with_retries does."""

    def __init__(self, options: dict):
        self.url = options["path"]
        module, _, function = options["transport"].partition(":")
        self.get = getattr(importlib.import_module(module), function)
        self.page = int(options.get("page", 100))
        self.task = int(options.get("pages_per_task", 10))
        self.retries = int(options.get("retries", 3))
        self.pause = float(options.get("pause", 1.0))

    def fetch(self, first: int, length: int) -> dict:
        joined = "&" if "?" in self.url else "?"
        reply = with_retries(lambda: self.get(f"{self.url}{joined}offset={first}&length={length}"), self.retries, lambda s: time.sleep(s * self.pause))
        if reply.status != 200:
            raise RuntimeError(f"page {first} of {self.url}: status {reply.status}")
        return json.loads(reply.content())

    def total(self) -> int:
        return int(self.fetch(0, 0)["total"])

    def cut(self, first: int, end: int) -> list[Page]:
        step = self.page * self.task
        return [Page(i, min(end, i + step)) for i in range(first, end, step)]

    def rows(self, part: Page, names: list[str]) -> Iterator[tuple]:
        at = part.first
        while at < part.end:
            found = self.fetch(at, min(self.page, part.end - at))["rows"]
            if not found:
                raise RuntimeError(f"{self.url} ended at {at}, before {part.end}")
            for r in found:
                yield tuple(r.get(n) for n in names)
            at += len(found)


class _Reader(DataSourceReader):
    def __init__(self, client: _Client, schema: StructType):
        self.client, self.names = client, schema.names

    def partitions(self) -> list[Page]:
        return self.client.cut(0, self.client.total()) or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.client.rows(partition, self.names)


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of rows; a batch goes up to what there is at its start."""

    def __init__(self, client: _Client, schema: StructType):
        self.client, self.names = client, schema.names

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": self.client.total()}

    def partitions(self, start: dict, end: dict) -> list[Page]:
        return self.client.cut(start["rows"], end["rows"]) or [Page(0, 0)]

    def read(self, partition: Page) -> Iterator[tuple]:
        return self.client.rows(partition, self.names)

    def commit(self, end: dict) -> None:
        """Nothing is kept here that could go."""


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_Client(self.options), schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(_Client(self.options), schema)
