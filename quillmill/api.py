"""The engine's library surface: websites, crawlers, patterns, pages and the gazetteer over a set of tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.functions.sentiment import DEFAULT_LEXICON
from quillmill.operators import checks, entities, frontier, html, mutations, patterns, reports, rollup
from quillmill.sources import web

# Status codes of websites and crawlers.
DISABLED, ENABLED, RUNNING = 0, 1, 2
#: Kinds of crawlers, by name: what gives the URLs of a batch of pages.
CRAWLER_KINDS = {
    "links_crawler": lambda pages: pages.select("url", F.explode("links").alias("link")),
    "sitemap_crawler": lambda pages: web.sitemap_urls(pages.select(F.col("url").alias("site"), F.col("html").alias("xml"))).select(F.col("site").alias("url"), F.col("url").alias("link")),
    "rss_crawler": lambda pages: web.feed_entries(pages.select(F.col("url").alias("feed"), F.col("html").alias("xml"))).select(F.col("feed").alias("url"), "link"),
}
MAX_AGE_S, FREQUENCY_S, MAX_NAME = 31_536_000, 3600, 100
WEBSITE_DDL = "site string, name string, website_url string, publisher_id string, category string, crawler_type string, status int, pages long, date_created timestamp, date_lastupdated timestamp"
CRAWLER_DDL = "crawler_id int, name string, site string, status int, crawling_status int, scraper string, category string, start_url string, age long, frequency long, crawler_type string, crawled_pages long, default_url_pattern int"
PATTERN_DDL = "pattern_id int, website string, crawler_id int, pattern string, harvester_categories array<string>, exclude_words array<string>, ad_script string, is_default boolean"


@dataclass
class Engine:
    """Tables by name, and the operations on them; each change gives a new DataFrame in place of the old."""

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    lexicon: dict[str, int] = field(default_factory=lambda: dict(DEFAULT_LEXICON))

    def __post_init__(self) -> None:
        for name, ddl in (("websites", WEBSITE_DDL), ("crawlers", CRAWLER_DDL), ("patterns", PATTERN_DDL)):
            self.tables.setdefault(name, self.spark.createDataFrame([], ddl))

    # websites

    def create_website(self, name: str, website_url: str, publisher_id: str, category: str, crawler_type: str = "links_crawler", now: datetime | None = None) -> None:
        for value in (name, website_url, publisher_id, category):
            if not value or len(value) >= MAX_NAME:
                raise ValueError(f"a website's name, URL, publisher and category have 1 to {MAX_NAME - 1} characters: {value!r}")
        stamp = now or datetime.now(UTC).replace(tzinfo=None)
        row = self.spark.createDataFrame([(None, name, website_url, publisher_id, category, crawler_type, ENABLED, 0, stamp, stamp)], WEBSITE_DDL)
        self.tables["websites"] = self.tables["websites"].unionByName(row.withColumn("site", urls.host(F.col("website_url"))))

    def websites(self, status: int | None = None) -> DataFrame:
        sites = self.tables["websites"]
        return sites if status is None else sites.filter(F.col("status") == status)

    def website(self, site: str) -> DataFrame:
        return self.tables["websites"].filter(F.col("site").isin(site, site.removeprefix("www."), f"www.{site}"))

    def update_websites(self, changes: DataFrame) -> None:
        self.tables["websites"] = mutations.merge_documents(self.tables["websites"], changes, ["site"])

    def domain_counters(self) -> DataFrame:
        return reports.domain_counters(self.tables["websites"].select("site"), self.tables["extracted_pages"])

    # crawlers and patterns

    def create_crawler(self, crawler_id: int, name: str, site: str, start_url: str, scraper: str = html.DEFAULT_SCRAPER, category: str = "", crawler_type: str = "links_crawler", age: int = MAX_AGE_S, frequency: int = FREQUENCY_S) -> None:
        html.scraper(scraper)
        row = (crawler_id, name, site, ENABLED, DISABLED, scraper, category, start_url, age, frequency, crawler_type, 0, None)
        self.tables["crawlers"] = self.tables["crawlers"].unionByName(self.spark.createDataFrame([row], CRAWLER_DDL))

    def crawlers(self, status: int | None = None) -> DataFrame:
        rows = self.tables["crawlers"]
        return rows if status is None else rows.filter(F.col("status") == status)

    def crawler(self, crawler_id: int) -> DataFrame:
        return self.tables["crawlers"].filter(F.col("crawler_id") == crawler_id)

    def update_crawlers(self, changes: DataFrame, now: datetime | None = None) -> None:
        """Sets the values that changes (crawler_id and more) gives; where the age changes, stored pages of the category get their new time."""
        old = self.tables["crawlers"]
        new = mutations.merge_documents(old, changes, ["crawler_id"])
        if "age" in changes.columns and "scraped_pages" in self.tables and {"category", "crawled_at"} <= set(self.tables["scraped_pages"].columns):
            ages = new.select("crawler_id", "category", "age").join(old.select("crawler_id", F.col("age").alias("old_age")), "crawler_id")
            stamp = F.lit(now or datetime.now(UTC).replace(tzinfo=None)).cast("timestamp")
            self.tables["scraped_pages"] = frontier.age_pages(self.tables["scraped_pages"], ages, stamp)
        self.tables["crawlers"] = new

    def delete_crawler(self, crawler_id: int) -> None:
        """The crawler goes, and its patterns with it."""
        gone = self.spark.createDataFrame([(crawler_id,)], "crawler_id int")
        for name in ("crawlers", "patterns"):
            self.tables[name] = mutations.delete(self.tables[name], gone)

    def add_pattern(self, pattern_id: int, crawler_id: int, website: str, pattern: str, categories: str = "", exclude: str = "", ad_script: str = "", default: bool = False) -> None:
        """Adds a pattern; it is its crawler's default if asked, or if the crawler has none yet."""
        patterns.check_pattern(pattern)
        row = self.spark.createDataFrame([(pattern_id, website, crawler_id, pattern, categories.split(), exclude.split(), ad_script, default)], PATTERN_DDL)
        old = self.tables["patterns"]
        none_yet = old.filter(F.col("crawler_id") == crawler_id).isEmpty()
        if default:
            old = mutations.set_where(old, F.col("crawler_id") == crawler_id, is_default=False)
        if default or none_yet:
            self.tables["crawlers"] = mutations.set_where(self.tables["crawlers"], F.col("crawler_id") == crawler_id, default_url_pattern=pattern_id)
        self.tables["patterns"] = old.unionByName(row.withColumn("is_default", F.lit(default or none_yet)))

    def delete_pattern(self, pattern_id: int) -> None:
        self.tables["patterns"] = mutations.delete(self.tables["patterns"], self.spark.createDataFrame([(pattern_id,)], "pattern_id int"))

    def pattern(self, pattern_id: int) -> DataFrame:
        return self.tables["patterns"].filter(F.col("pattern_id") == pattern_id)

    def update_patterns(self, changes: DataFrame) -> None:
        self.tables["patterns"] = mutations.merge_documents(self.tables["patterns"], changes, ["pattern_id"])

    def site_tree(self) -> DataFrame:
        return patterns.site_tree(self.tables["websites"], self.tables["crawlers"], self.tables["patterns"])

    def pattern_of(self, pages: DataFrame) -> DataFrame:
        return patterns.match_any_crawler(pages, self.tables["patterns"])

    # pages

    def scrape(self, pages: DataFrame, scraper: str | None = None, now: datetime | None = None) -> DataFrame:
        """Scraped pages with page_key (the URL) and site, of those not stored yet."""
        stored = self.tables.get("scraped_pages")
        new = pages if stored is None else pages.join(stored.select("url"), "url", "left_anti")
        return html.scrape(new, scraper, now).withColumn("page_key", F.col("url")).withColumn("site", urls.host(F.col("url")))

    def extract(self, scraped: DataFrame, must_match: bool = False) -> tuple[DataFrame, DataFrame]:
        """Extracted pages with their pattern's categories and words to exclude, and rejected ones with a reason. Pages stored in the present form aren't extracted again."""
        if "extracted_pages" in self.tables:
            scraped = scraped.join(checks.current(self.tables["extracted_pages"])[0].select("url"), "url", "left_anti")
        done, rejects = entities.extract(scraped, self.tables["gazetteer"], self.lexicon)
        tagged = patterns.match_any_crawler(done, self.tables["patterns"], must_match).join(
            self.tables["patterns"].select("pattern_id", F.array_join("harvester_categories", ",").alias("category"), F.array_join("exclude_words", ",").alias("exclude")), "pattern_id", "left"
        )
        return done.join(tagged, "url", "inner" if must_match else "left"), rejects

    def extracted_page(self, url: str) -> DataFrame:
        return self.tables["extracted_pages"].filter(F.col("url") == url)

    def save_extracted(self, done: DataFrame, now: datetime | None = None) -> None:
        """Stores extracted pages by URL, with their version and time; a later one replaces an earlier."""
        stamped = done.withColumn("version", F.lit(checks.VERSION)).withColumn("extracted_at", F.lit(now or datetime.now(UTC).replace(tzinfo=None)).cast("timestamp"))
        old = self.tables.get("extracted_pages")
        self.tables["extracted_pages"] = stamped if old is None else mutations.upsert(old, stamped, ["url"], "extracted_at")

    def extracted_page_with_pattern(self, url: str) -> DataFrame:
        """The extracted page and its pattern's id; no row if no pattern matches."""
        page = self.extracted_page(url).drop("pattern_id")
        return page.join(patterns.match_any_crawler(page, self.tables["patterns"], must_match=True), "url")

    def site_stats(self, site: str) -> DataFrame:
        own = F.col("site") == site
        return rollup.site_stats(self.tables["site_entities"].filter(own), self.tables["site_candidates"].filter(own))

    # gazetteer

    def categories(self) -> DataFrame:
        return self.tables["entity_source"].orderBy("source", "source_category")

    def category(self, source: str, source_category: str) -> DataFrame:
        return self.tables["entity_source"].filter((F.col("source") == source) & (F.col("source_category") == source_category))

    def add_categories(self, rows: DataFrame) -> None:
        self.tables["entity_source"] = mutations.insert_ignore(self.tables["entity_source"], rows, ["source", "source_category"])

    def update_categories(self, changes: DataFrame) -> None:
        self.tables["entity_source"] = mutations.merge_documents(self.tables["entity_source"], changes, ["source", "source_category"])

    def entities(self, where=None, limit: int = 25) -> DataFrame:
        """Entities that aren't disabled, for which `where` holds."""
        rows = self.tables["gazetteer"].filter(~F.coalesce("disabled", F.lit(False)))
        return (rows if where is None else rows.filter(where)).orderBy("category", "name").limit(limit)

    def entities_of(self, category: str, page: int = 1, size: int = 25) -> tuple[DataFrame, int]:
        return reports.paginate(self.tables["gazetteer"].filter(F.col("category") == category), page, size, order=["name"])

    def add_entities(self, rows: DataFrame) -> None:
        self.tables["gazetteer"] = mutations.insert_ignore(self.tables["gazetteer"], rows, ["category", "name"])

    def remove_entity(self, category: str, name: str) -> None:
        self.tables["gazetteer"] = mutations.delete(self.tables["gazetteer"], self.spark.createDataFrame([(category, name)], "category string, name string"))

    def count_lookups(self, mentions: DataFrame) -> None:
        """Adds how often names were looked up to occur."""
        self.tables["gazetteer"] = mutations.increment(self.tables["gazetteer"], entities.occurrences(mentions).withColumnRenamed("occur", "n"), ["_name"], "occur", "n")
