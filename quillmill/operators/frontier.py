"""What to crawl next: unseen links, the frequency gate, the daily quota, and pages that expire."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import urls
from quillmill.operators.patterns import valid_links

DAILY_QUOTA = 950
FREQUENCY_S = 3600
TTL_S = 3600
SAVE_DELAY_S = 60


def frontier(links: DataFrame, crawled: DataFrame, start_urls: DataFrame) -> DataFrame:
    """crawler_id and url to crawl: links (crawler_id, url) not crawled yet, and start URLs in any case, each once."""
    new = links.select("crawler_id", "url").distinct().join(crawled.select("url"), "url", "left_anti")
    return new.select("crawler_id", "url").unionByName(start_urls.select("crawler_id", "url")).distinct()


def fresh(urls_: DataFrame, crawled: DataFrame) -> DataFrame:
    """Rows (url, start_url) that may be crawled: the start URL, or a URL not crawled before."""
    seen = crawled.select(F.col("url"), F.lit(True).alias("_seen")).distinct()
    return urls_.join(seen, "url", "left").filter(F.col("_seen").isNull() | (F.col("url") == F.col("start_url"))).drop("_seen")


def html_only(pages: DataFrame) -> DataFrame:
    """Pages whose URL tells of HTML, or whose content_type does; a missing type passes."""
    kind = F.coalesce(F.split("content_type", ";")[0], F.lit("text/html"))
    return pages.filter(urls.looks_like_html(F.col("url")) | (kind == "text/html"))


def frequency_gate(visits: DataFrame, frequency: int = FREQUENCY_S) -> DataFrame:
    """The visits (crawler_id long, ts timestamp, and more) that are at least `frequency` seconds after the last one let through.

    Each crawler's visits are read in order, with one number of state, so memory doesn't grow
    with a crawler's log. From a visit let through the next one is found by bisection: the loop
    is over accepted visits, of which a year at an hour apart has 8,760, and not over rows.
    """
    schema = visits.schema
    key, when = visits.columns.index("crawler_id"), visits.columns.index("ts")
    gap = frequency * 1_000_000

    def gate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, due = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(key).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            micros = batch.column(when).cast(pa.timestamp("us", tz="UTC")).cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            keep = np.zeros(batch.num_rows, bool)
            edges = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), batch.num_rows]
            for lo, hi in itertools.pairwise(edges):
                if ids[lo] != who:
                    who, due = ids[lo], int(micros[lo])
                at = lo + int(np.searchsorted(micros[lo:hi], due))
                while at < hi:
                    keep[at], due = True, int(micros[at]) + gap
                    at += int(np.searchsorted(micros[at:hi], due))
            yield batch.filter(pa.array(keep))

    return visits.repartition("crawler_id").sortWithinPartitions("crawler_id", "ts").mapInArrow(gate, schema)


def daily_quota(visits: DataFrame, quota: int = DAILY_QUOTA, order: tuple[str, ...] = ("ts",)) -> DataFrame:
    """The first quota + 1 visits of each day: the limit is tested before a visit is counted."""
    day = Window.partitionBy(F.to_date("ts")).orderBy(*order)
    return visits.withColumn("_n", F.row_number().over(day)).filter(F.col("_n") <= quota + 1).drop("_n")


def expires_at(fetched, ttl: int = TTL_S, delay: int = SAVE_DELAY_S):
    return fetched + F.make_interval(secs=F.lit(ttl + delay))


def live_pages(pages: DataFrame, now, ttl: int = TTL_S) -> DataFrame:
    """Pages (with fetched_at) that haven't expired at `now`."""
    return pages.filter(expires_at(F.col("fetched_at"), ttl) > now)


def crawler_status(active: DataFrame, enabled: DataFrame, paused: DataFrame) -> DataFrame:
    """crawler_id and crawling_status: 1 to start or go on, 2 paused, 0 to stop, of all crawlers that are active or enabled."""
    every = active.select("crawler_id").unionByName(enabled.select("crawler_id")).distinct()
    flags = every.join(enabled.select("crawler_id", F.lit(True).alias("_e")).distinct(), "crawler_id", "left").join(paused.select("crawler_id", F.lit(True).alias("_p")).distinct(), "crawler_id", "left")
    return flags.select("crawler_id", F.when(F.col("_e").isNull(), 0).when(F.col("_p").isNotNull(), 2).otherwise(1).alias("crawling_status"))


def discover(pages: DataFrame, patterns: DataFrame, crawled: DataFrame, start_urls: DataFrame) -> DataFrame:
    """The next frontier of crawled pages (crawler_id, links): their links that are valid for their crawler and not crawled yet."""
    links = pages.select("crawler_id", F.explode_outer("links").alias("url")).filter("url IS NOT NULL").distinct()
    return frontier(valid_links(links, patterns).withColumn("url", urls.without_fragment(F.col("url"))), crawled, start_urls)


def age_pages(pages: DataFrame, crawlers: DataFrame, now) -> DataFrame:
    """pages with crawled_at = now + age where crawlers (category, age, old_age) changed the age of the page's category."""
    changed = crawlers.filter(~F.col("age").eqNullSafe(F.col("old_age"))).groupBy("category").agg(F.max("age").alias("_age"))
    moved = F.when(F.col("_age").isNotNull(), now + F.make_interval(secs=F.col("_age"))).otherwise(F.col("crawled_at"))
    return pages.join(changed, "category", "left").withColumn("crawled_at", moved).select(pages.columns)
