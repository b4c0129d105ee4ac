"""Services that answer in pages, each with the token of the next: as a table, as a stream, and saved answers as files."""

from __future__ import annotations

import importlib
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

# fixed values: answers of a service that is asked too often, and the seconds to wait then
BUSY, WAIT_S = (429, 403), 60

Page = tuple[list[str], str | None]  # records as JSON, token of the next page (None after the last)


class ServiceError(Exception):
    def __init__(self, status: int):
        super().__init__(f"the service answered {status}")
        self.status = status


def asked(fetch: Callable[[str | None], Page], token: str | None, retries: int, wait: float, sleep: Callable[[float], None] = time.sleep) -> Page:
    """A page; a service that is busy is asked again after a wait, up to `retries` times, other errors go through."""
    for left in range(retries, -1, -1):
        try:
            return fetch(token)
        except ServiceError as e:
            if e.status not in BUSY or not left:
                raise
            sleep(wait)
    raise AssertionError("not reached")


def _function(name: str) -> Callable[[str | None], Page]:
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


class _Options:
    def __init__(self, options):
        self.name, self.retries, self.wait = options["fetch"], int(options.get("retries", 5)), float(options.get("wait", WAIT_S))

    def page(self, token: str | None) -> Page:
        return asked(_function(self.name), token, self.retries, self.wait)


class _Reader(_Options, DataSourceReader):
    """The chain of tokens is followed by one task, as each page names the next."""

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition) -> Iterator[tuple]:
        token, n = None, 0
        while True:
            records, token = self.page(token)
            yield from ((n, r) for r in records)
            n += 1
            if token is None:
                return


class _StreamReader(_Options, SimpleDataSourceStreamReader):
    """An offset is the token to go on with and the number of pages so far; after the last page the stream waits there."""

    def initialOffset(self):
        return {"token": "", "page": 0, "end": False}

    def _next(self, start: dict) -> tuple[list[tuple], dict]:
        if start["end"]:
            return [], start
        records, token = self.page(start["token"] or None)
        return [(start["page"], r) for r in records], {"token": token or "", "page": start["page"] + 1, "end": token is None}

    def read(self, start: dict):
        rows, end = self._next(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        rows = []
        while start["page"] < end["page"]:
            some, start = self._next(start)
            rows += some
        return iter(rows)

    def commit(self, end: dict):
        pass


class PagedService(DataSource):
    """Records (page, value) of a service. Options: fetch, 'module:function' of a function that takes a token (None at first) and
    returns (records, next token); retries and wait for a busy service."""

    @classmethod
    def name(cls):
        return "paged_service"

    def schema(self):
        return "page int, value string"

    def reader(self, schema):
        return _Reader(self.options)

    def simpleStreamReader(self, schema):
        return _StreamReader(self.options)


def saved_pages(spark: SparkSession, path: str, field: str = "files") -> DataFrame:
    """(page, value): the records, as JSON, of saved answers {field: [...], "nextPageToken": ...}, one file a page, on any file
    system. Files that aren't such answers have none."""
    pages = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("page"), F.from_json("value", f"`{field}` array<string>").alias("r"))
    return pages.select("page", F.explode(f"r.{field}").alias("value"))
