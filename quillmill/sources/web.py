"""Pages, feeds, sitemaps and lexicons as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions import urls

# Content types of feeds.
FEED_TYPES = (
    "application/rss+xml", "application/atom+xml", "application/rss", "application/atom", "application/rdf+xml", "application/rdf", "text/rss+xml",
    "text/atom+xml", "text/rss", "text/atom", "text/rdf+xml", "text/rdf", "text/xml", "application/xml",
)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """url, html with white space collapsed, of stored pages."""
    return spark.read.parquet(path).select("url", T.collapse_space(F.col("html")).alias("html"))


def read_lexicon(spark: SparkSession, path: str) -> dict[str, int]:
    """Terms and scores of a tab-separated word list. A lexicon is a few thousand lines; a file of over a million is refused."""
    rows = spark.read.schema("term string, score int").option("sep", "\t").option("quote", "").csv(path)
    got = rows.limit(1_000_001).collect()
    if len(got) > 1_000_000:
        raise ValueError("a lexicon of over a million terms can't be a literal; join it as a table")
    return {r.term: r.score for r in got if r.term is not None and r.score is not None}


def is_feed(content_type):
    return F.coalesce(F.split(content_type, ";")[0].isin(*FEED_TYPES), F.lit(False))


def feed_link(html):
    """The target of the page's feed link, or null."""
    tag = F.regexp_extract(html, r"""(?i)(<link[^>]*type=["']?application/(?:rss|atom)\+xml[^>]*>)""", 1)
    href = F.regexp_extract(tag, r"""(?i)href=["']?([^"'\s>]+)""", 1)
    return F.when(href != "", href)


def feed_entries(feeds: DataFrame) -> DataFrame:
    """feed, entry_idx, link of feeds (feed, xml): links of RSS items and Atom entries, in order."""
    rss = F.expr("transform(xpath(xml, '//item/link/text()'), x -> trim(x))")
    atom = F.expr("xpath(xml, '//*[local-name()=\"entry\"]/*[local-name()=\"link\"]/@href')")
    return feeds.select("feed", F.posexplode(F.concat(rss, atom)).alias("entry_idx", "link")).filter("link != ''")


def feed_frontier(entries: DataFrame) -> DataFrame:
    """entries with crawl_now: the last entry is crawled at once, the others are queued."""
    last = entries.groupBy("feed").agg(F.max("entry_idx").alias("_last"))
    return entries.join(last, "feed").select("feed", "entry_idx", "link", (F.col("entry_idx") == F.col("_last")).alias("crawl_now"))


def sitemap_urls(maps: DataFrame) -> DataFrame:
    """site and url of sitemaps (site, xml)."""
    return maps.select("site", F.explode(F.expr("xpath(xml, '//*[local-name()=\"url\"]/*[local-name()=\"loc\"]/text()')")).alias("url")).select("site", F.trim("url").alias("url"))


def crawler_type(has_sitemap):
    return F.when(has_sitemap, "sitemap_crawler").otherwise("links_crawler")


def hosts(pages: DataFrame) -> DataFrame:
    return pages.withColumn("site", urls.host(F.col("url")))
