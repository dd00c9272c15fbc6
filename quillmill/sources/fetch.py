"""Pages fetched by URL, as a Python data source: partitions of URLs, each with retries.

spark.read.format("fetched_pages").option("urls", ...) takes a few URLs; fetch() takes those of a
DataFrame. A URL that fails for good gives a row with its error and no html,
so nothing is lost unseen.
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Seconds a request may take, attempts, and requests under way at once.
TIMEOUT_S, ATTEMPTS, CONCURRENT = 180, 4, 2
AGENT = "Mozilla/5.0 (compatible; quillmill)"
PAGE_DDL = "url string, html string, content_type string, attempts int, error string"


def open_url(url: str) -> tuple[str, str | None]:
    """Body and content type."""
    request = urllib.request.Request(url, headers={"User-Agent": AGENT})
    with urllib.request.urlopen(request, timeout=TIMEOUT_S) as got:
        return got.read().decode(got.headers.get_content_charset() or "utf-8", "replace"), got.headers.get("Content-Type")


def with_retries(call: Callable, attempts: int = ATTEMPTS, wait_s: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[object, int, str | None]:
    """What call() gives, the attempts it took and, if all failed, the last error; waits double from wait_s."""
    error = None
    for n in range(1, attempts + 1):
        try:
            return call(), n, None
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if n < attempts:
                sleep(wait_s * 2 ** (n - 1))
    return None, attempts, error


def fetch_one(url: str, attempts: int = ATTEMPTS, wait_s: float = 1.0, opener: Callable = open_url) -> tuple:
    """A row of PAGE_DDL; runs of white space in the body are one space."""
    got, n, error = with_retries(lambda: opener(url), attempts, wait_s)
    body, kind = got if got else (None, None)
    return url, None if body is None else " ".join(body.split()), kind, n, error


def fetch(urls: DataFrame, concurrent: int = CONCURRENT, attempts: int = ATTEMPTS, wait_s: float = 1.0, opener: Callable = open_url) -> DataFrame:
    """A row of PAGE_DDL for each distinct url; at most `concurrent` requests are under way, one for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
        for batch in batches:
            rows = [fetch_one(u, attempts, wait_s, opener) for u in batch.column(0).to_pylist()]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in PAGE_DDL.split(", ")])

    return urls.select("url").filter("url IS NOT NULL").distinct().repartition(concurrent).mapInArrow(run, PAGE_DDL)


class UrlPartition(InputPartition):
    def __init__(self, urls: list[str]) -> None:
        self.urls = urls


class PageReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.urls = [u for u in options.get("urls", "").split() if u]
        self.attempts, self.wait_s = int(options.get("attempts", ATTEMPTS)), float(options.get("wait_s", 1.0))
        self.concurrent = int(options.get("concurrent", CONCURRENT))

    def partitions(self) -> list[InputPartition]:
        n = max(1, min(self.concurrent, len(self.urls)))
        return [UrlPartition(self.urls[i::n]) for i in range(n)]

    def read(self, partition: UrlPartition) -> Iterator[tuple]:
        for url in partition.urls:
            yield fetch_one(url, self.attempts, self.wait_s)


class FetchedPages(DataSource):
    """Options: urls (separated by white space), attempts, wait_s, concurrent. Register with spark.dataSource.register."""

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return PAGE_DDL

    def reader(self, schema) -> DataSourceReader:
        return PageReader(self.options)
