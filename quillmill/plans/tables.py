"""The engine's tables as derived from the test tables: pages, gazetteer, patterns, sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.functions import urls

#: A name is in the gazetteer if so many documents hold it.
NAME_DOCS = 5

#: Tables whose rows cost enough to be worth dealing out.
HEAVY = frozenset({"documents", "pages"})


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table. One of few, small files would keep a single core busy with its texts, so it is dealt out; one of many splits is read as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in HEAVY and df.rdd.getNumPartitions() * 2 <= cores else df


def document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as scraped pages: page_key, site, title (the first line), text (the lines)."""
    lines = F.split("text", "\n")
    return read(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("page_key"), F.col("source").alias("site"), lines[0].alias("title"), lines.alias("text"))


def gazetteer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that NAME_DOCS documents or more hold, by first letter; those of a length divisible by five are disabled."""
    docs = read(spark, sf_dir, "documents")
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(T.CANDIDATE), F.lit(1)), F.lower))
    names = docs.select("doc_id", F.explode_outer(found).alias("_name"))  # outer: no inferred filter that extracts again
    common = names.filter(F.length("_name") >= 2).groupBy("_name").agg(F.count("*").alias("n")).filter(F.col("n") >= NAME_DOCS)
    return common.select(F.col("_name").alias("name"), "_name", F.concat(F.lit("letter_"), F.substring("_name", 1, 1)).alias("category"), F.lit("documents").alias("source"), F.lit(0).cast("long").alias("occur"), (F.length("_name") % 5 == 0).alias("disabled"))


def url_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of the pages' hosts: of each a default, one of its English and French part, and of every other one those of its lists."""
    hosts = page_sites(spark, sf_dir).filter("site IS NOT NULL").groupBy(urls.bare_host(F.col("site")).alias("bare")).agg(F.min("page_id").alias("m"))
    rows = hosts.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).filter("k < 3 OR m % 2 = 0")
    tail = F.when(F.col("k") == 1, "/").when(F.col("k") == 2, "/(en|fr)/").otherwise("/.*page=")
    return rows.select(
        (3 * F.col("m") + F.col("k")).alias("pattern_id"), F.concat(F.when(F.col("k") == 2, "www.").otherwise(""), "bare").alias("website"), (1 + (F.col("m") + F.col("k")) % 2).cast("int").alias("crawler_id"),
        F.concat(F.lit(r"https?://(www\.)?"), F.replace("bare", F.lit("."), F.lit(r"\.")), tail).alias("pattern"), (F.col("k") != 2).alias("is_default"),
    )


def page_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, site."""
    return read(spark, sf_dir, "pages").select("page_id", "url", urls.host(F.col("url")).alias("site"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a crawl log: crawler_id, event_id, ts."""
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("crawler_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"))
