"""Word reports over extracted pages, listings, counters and pages of results."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.storage import materialize


def chosen_words(include: DataFrame, exclude: DataFrame) -> DataFrame:
    """The words (column word) to report: include without exclude, each once."""
    return include.select("word").distinct().join(exclude.select("word"), "word", "left_anti")


def word_report(entities: DataFrame, candidates: DataFrame, words: DataFrame) -> DataFrame:
    """entity, sentiment, count: entity mentions by sentiment type, and pages on which a word is a mere candidate, as "unknown".

    entities (name, type, count) and candidates (name) are rows of pages, flattened; the two
    parts are grouped once, together.
    """
    known = entities.select(F.col("name").alias("word"), F.col("type").alias("sentiment"), "count")
    unknown = candidates.select(F.col("name").alias("word"), F.lit("unknown").alias("sentiment"), F.lit(1).cast("long").alias("count"))
    rows = known.unionByName(unknown).join(words, "word", "left_semi")
    return rows.groupBy(F.col("word").alias("entity"), "sentiment").agg(F.sum("count").alias("count"))


def report_order(report: DataFrame) -> DataFrame:
    """By word, last first, then by sentiment."""
    return report.orderBy(F.desc("entity"), "sentiment")


def report_lines(report: DataFrame) -> DataFrame:
    """line: word|sentiment|count."""
    return report.select(F.concat_ws("|", "entity", "sentiment", F.col("count").cast("string")).alias("line"))


def report_header(site: str, n_include: int, n_exclude: int, scanned: int, matched: int) -> list[str]:
    """The lines above a site's report."""
    return ["Site report for:", site, "", "Total include words:", str(n_include), "", "Total exclude words:", str(n_exclude), "", "Total URLs scanned:", str(scanned), "", "Total URLs matched:", str(matched), "", "Word, Sentiment, count"]


def scan_counts(pages: DataFrame, site: str) -> tuple[int, int]:
    """Pages in all, and those of the site with or without www.: the totals of a report's header."""
    own = urls.bare_host(F.col("site")) == F.lit(site.removeprefix("www."))
    return tuple(pages.agg(F.count("*"), F.count_if(own)).first())


def write_report(report: DataFrame, header: list[str], path: str) -> None:
    """One text file, header first, in order. The report is worked out by all tasks and stored; its lines alone meet in one."""
    spark, report = report.sparkSession, materialize(report, "report")
    head = spark.createDataFrame([(i, "", "", x) for i, x in enumerate(header)], "part int, entity string, sentiment string, line string")
    body = report.select(F.lit(len(header)).alias("part"), "entity", "sentiment", F.concat_ws("|", "entity", "sentiment", F.col("count").cast("string")).alias("line"))
    head.unionByName(body).coalesce(1).sortWithinPartitions("part", F.desc("entity"), "sentiment").select("line").write.mode("overwrite").text(path)


def flatten(pages: DataFrame, array: str, *fields: str) -> DataFrame:
    """Rows of an array of structs; pages with an empty or null array give none. A dotted field is named by its last part."""
    names = [F.col(f"_e.{f}").alias(f.rsplit(".", 1)[-1]) for f in fields]
    return pages.select(*(c for c in pages.columns if c != array), F.explode(array).alias("_e")).select(*(c for c in pages.columns if c != array), *names)


def regroup(report: DataFrame) -> DataFrame:
    """entity and sentiments, the array of struct(sentiment, count) in order."""
    return report.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("sentiment", "count"))).alias("sentiments"))


def domain_counters(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """site, n_pages and n_waiting for each of sites: pages of the host with or without www., and those of them not yet approved.

    pages have site and approved. One pass over the pages, whatever the number of sites.
    """
    counts = pages.groupBy(urls.bare_host(F.col("site")).alias("_bare")).agg(F.count("*").alias("n_pages"), F.count_if(~F.coalesce("approved", F.lit(False))).alias("n_waiting"))
    keyed = sites.withColumn("_bare", urls.bare_host(F.col("site")))
    return keyed.join(counts, "_bare", "left").select("site", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_waiting", F.lit(0)).alias("n_waiting"))


def paginate(df: DataFrame, page: int, per_page: int = 25, max_count: int = 250, order: list[str] | None = None) -> tuple[DataFrame, int]:
    """The rows of a page and the number of pages, which counts max_count rows at most; later pages still have their rows."""
    pages = math.ceil(min(df.limit(max_count).count(), max_count) / per_page)
    return df.orderBy(*(order or df.columns)).offset(per_page * (page - 1)).limit(per_page), pages
