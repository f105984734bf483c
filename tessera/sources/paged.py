"""Paged catalogue sources as a Spark data source: offset or cursor paging, caps, retries with backoff.

The transport is a function of a URL and a token, so a source can be tried without a network: ``file:`` URLs name folders of JSON
pages, ``data:`` URLs hold a catalogue. Batch reads split offset-paged catalogues into page ranges that executors fetch side by side; a cursor-paged one
can only be walked in order.
"""

from __future__ import annotations

import json
import os
import random
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader


class Gone(Exception):
    """A page that does not exist: the catalogue ends before it."""


def with_retry(call: Callable[[], bytes], attempts: int = 5, base: float = 1.0, longest: float = 60.0, sleep: Callable[[float], None] = time.sleep, rnd: random.Random | None = None) -> bytes:
    """Call again after errors that may pass (429, 408, 5xx, connection errors), waiting base * 2^n up to ``longest`` plus up to a
    quarter, or as long as the server's Retry-After says."""
    rnd = rnd or random.Random()
    for n in range(attempts):
        try:
            return call()
        except urllib.error.HTTPError as e:
            passing, wait = e.code in (408, 429) or e.code >= 500, e.headers.get("Retry-After") if e.headers else None
            error = e
        except (ConnectionError, TimeoutError, urllib.error.URLError) as e:
            passing, wait, error = True, None, e
        if not passing or n == attempts - 1:
            raise error
        pause = float(wait) if wait and wait.isdigit() else min(longest, base * 2**n) * (1 + 0.25 * rnd.random())
        sleep(pause)
    raise AssertionError("unreachable")


def fetch(url: str, page: str, size: int) -> dict:
    """One page: {"items": [...], "cursor": next or null}. ``data:`` URLs hold the catalogue itself, as a JSON array."""
    if url.startswith("data:"):
        items, at = json.loads(url[5:]), int(page or 0)
        if at >= len(items) > 0:
            raise Gone(page)
        return {"items": items[at : at + size], "cursor": str(at + size) if at + size < len(items) else None}
    if url.startswith("file:"):
        path = os.path.join(url[5:], f"{page or 'first'}.json")
        if not os.path.exists(path):
            raise Gone(path)
        with open(path, "rb") as f:
            return json.load(f)
    sep = "&" if "?" in url else "?"
    full = f"{url}{sep}limit={size}" + (f"&cursor={page}" if page else "")
    return json.loads(with_retry(lambda: urllib.request.urlopen(full, timeout=30).read()))


class _Pages(InputPartition):
    def __init__(self, first: int, step: int):
        self.first, self.step = first, step


class PagedSource(DataSource):
    """Format ``paged``. Options: url; paging = offset | cursor; size (items a page); pages (cap; without it the catalogue is read
    to its end); parallel (partitions of an offset-paged read, which take the pages in turn). Columns: page string, position int, item string (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page string, position int, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Stream(self.options)


def _rows(page: str, body: dict) -> list[tuple]:
    return [(page, i, json.dumps(x, separators=(",", ":"))) for i, x in enumerate(body.get("items") or [])]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.url, self.size = options["url"], int(options.get("size", 100))
        self.cursor, self.pages = options.get("paging", "offset") == "cursor", int(options.get("pages", 1 << 40))
        self.parallel = int(options.get("parallel", 8))

    def partitions(self) -> list[InputPartition]:
        if self.cursor:
            return [_Pages(0, 1)]
        n = max(1, min(self.parallel, self.pages))
        return [_Pages(a, n) for a in range(n)]

    def read(self, part: _Pages) -> Iterator[tuple]:
        token = ""
        for k in range(part.first, self.pages, part.step):
            page = token if self.cursor else str(k * self.size)
            try:
                body = fetch(self.url, page, self.size)
            except Gone:
                return
            yield from _rows(page, body)
            token = body.get("cursor") or ""
            if self.cursor and not token or not self.cursor and len(body.get("items") or []) < self.size:
                return


class _Stream(SimpleDataSourceStreamReader):
    """Reads on from the last offset (a page, and how many of its items are read): one page a call. A last page, short or without
    a cursor, is delivered like any other; it stays the place to read on from, and later gives what was added to it. A missing
    page leaves the offset where it is, to be asked for again."""

    def __init__(self, options):
        self.url, self.size, self.cursor = options["url"], int(options.get("size", 100)), options.get("paging", "offset") == "cursor"

    def initialOffset(self) -> dict:
        return {"page": "" if self.cursor else "0", "read": 0}

    def _step(self, at: dict) -> tuple[list[tuple], dict]:
        try:
            body = fetch(self.url, at["page"], self.size)
        except Gone:
            return [], at
        rows = _rows(at["page"], body)
        if self.cursor:
            after = {"page": body["cursor"], "read": 0} if body.get("cursor") else {"page": at["page"], "read": max(at["read"], len(rows))}
        else:
            whole = len(rows) >= self.size
            after = {"page": str(int(at["page"]) + len(rows)), "read": 0} if whole else {"page": at["page"], "read": max(at["read"], len(rows))}
        return rows[at["read"] :], after

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = self._step(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        at = start
        while at != end:
            rows, after = self._step(at)
            if at["page"] == end["page"]:  # what has come to this page since is for the next read
                yield from rows[: end["read"] - at["read"]]
                return
            yield from rows
            if after == at:
                return
            at = after

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)


def nested(catalogue: DataFrame, item: str = "item") -> DataFrame:
    """Series with events with markets (JSON) -> one row per market ticker: series, event, ticker, title; the first place of a repeated one."""
    schema = "ticker string, category string, events array<struct<ticker:string, title:string, markets:array<struct<ticker:string, title:string>>>>"
    s = catalogue.select(F.from_json(item, schema).alias("s"))
    e = s.select(F.col("s.ticker").alias("series"), F.col("s.category").alias("category"), F.explode("s.events").alias("e"))
    m = e.select("series", "category", F.col("e.ticker").alias("event"), F.explode("e.markets").alias("m"))
    first = F.min(F.struct("series", "event", "category", F.col("m.title").alias("title"))).alias("x")
    return m.filter("m.ticker is not null").groupBy(F.col("m.ticker").alias("ticker")).agg(first).select("ticker", "x.*")
