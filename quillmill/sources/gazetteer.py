"""Gazetteer sources: records of public catalogues as rows of names, and the categories they come from.

There is no network here: importers read what a catalogue's API has returned, as JSON lines or
HTML, with Spark's readers, so pages, retries and batches are Spark's tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import text as T
from quillmill.storage import materialize

LABEL_BATCH = 49
FRESH_S = 86_400


def entity_rows(names: DataFrame, category: str, source: str, now=None) -> DataFrame:
    """Gazetteer rows of names (name): name, _name, category, source, occur 0, added_at, disabled false. Null and empty names go."""
    kept = names.filter(F.length("name") > 0)
    return kept.select("name", F.lower("name").alias("_name"), F.lit(category).alias("category"), F.lit(source).alias("source"), F.lit(0).cast("long").alias("occur"), (F.lit(now) if now is not None else F.current_timestamp()).alias("added_at"), F.lit(False).alias("disabled"))


def english_only(names: DataFrame, lang: str | None = None) -> DataFrame:
    """Names in English, by a language column or by their stop words."""
    return names.filter((F.col(lang) if lang else T.language_vote(F.col("name"))) == "en")


def read_json(spark: SparkSession, path: str, ddl: str) -> tuple[DataFrame, DataFrame]:
    """JSON records under a given schema, and rejects (record, reason): the lines that don't fit it."""
    whole = spark.read.schema(f"{ddl}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rejects = spark.read.text(path).select(F.col("value").alias("record"), F.from_json("value", f"{ddl}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("_r"))
    return whole.filter("_bad IS NULL").drop("_bad"), rejects.filter("_r._bad IS NOT NULL").select("record", F.lit("not a record of the schema").alias("reason"))


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """key of all that follow a start (key) along edges (key, next), starts included.

    The way of a "Next" link or a cursor, over stored pages: each round doubles the length of
    the jumps, so a chain of n pages takes log2(n) rounds, and a chain that runs in a circle ends.
    """
    jumps = materialize(edges.select("key", "next").filter("next IS NOT NULL AND key IS NOT NULL").distinct(), "jumps")
    seen, last = materialize(start.select("key").distinct(), "reached"), -1
    while (n := seen.count()) != last:
        last = n
        seen = materialize(seen.unionByName(seen.join(jumps, "key").select(F.col("next").alias("key"))).distinct(), "reached")
        jumps = materialize(jumps.join(jumps.select(F.col("key").alias("next"), F.col("next").alias("_far")), "next").select("key", F.col("_far").alias("next")).distinct(), "jumps")
    return seen


def listing_pages(pages: DataFrame, start: DataFrame, label: str = "Next") -> DataFrame:
    """The pages (url, html) of a listing, from the start URLs (url) on along the links with this text, until there is none."""
    tag = F.regexp_extract("html", rf"""(?is)<a\s[^>]*?href=["']?([^"'\s>]+)["']?[^>]*>\s*{label}\b""", 1)
    edges = pages.select(F.col("url").alias("key"), F.when(tag != "", tag).alias("next"))
    return pages.join(reachable(edges, start.select(F.col("url").alias("key"))).withColumnRenamed("key", "url"), "url", "left_semi")


def cursor_names(answers: DataFrame, first: str = "") -> DataFrame:
    """name of the entities in an API's answers (cursor, next_cursor, result array<struct<name>>), from the first cursor on; nulls go."""
    start = answers.sparkSession.createDataFrame([(first,)], "key string")
    got = reachable(answers.select(F.col("cursor").alias("key"), F.col("next_cursor").alias("next")), start)
    read = answers.join(got.withColumnRenamed("key", "cursor"), "cursor", "left_semi")
    return read.select(F.inline("result")).filter("name IS NOT NULL").select("name")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def names_by_letter(artists: DataFrame, works: DataFrame, english: bool = True, letters: str = LETTERS) -> DataFrame:
    """letter and name, each once, of a catalogue's artists (letter, name) and works (letter, title, relations): what a search for each letter found.

    All letters are one table and one pass, where a client asks for one after the other.
    """
    mine = F.lower("letter").isin(*letters)
    titles = works.filter(mine).select(F.lower("letter").alias("letter"), F.col("title").alias("name"))
    nested = works.filter(mine).select(F.lower("letter").alias("letter"), F.explode("relations").alias("r")).select("letter", F.col("r.name").alias("name"))
    rows = artists.filter(mine).select(F.lower("letter").alias("letter"), "name").unionByName(titles).unionByName(nested).filter(F.length("name") > 0)
    return (english_only(rows) if english else rows).distinct()


def label_batches(ids: DataFrame, size: int = LABEL_BATCH) -> DataFrame:
    """batch and ids (array, in order of prop and item): distinct items by `size`, the last batch included.

    Only ids are numbered; the window runs within a property, and batches don't span them.
    """
    order = Window.partitionBy("prop").orderBy("item")
    numbered = ids.select("prop", "item").distinct().withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))
    return numbered.groupBy("prop", "batch").agg(F.array_sort(F.collect_list("item")).alias("ids"))


def wikidata_names(claims: DataFrame, labels: DataFrame, english: bool = True) -> DataFrame:
    """name of the items (prop, item) that have an English label (item, lang, label); with english, only labels that read as English."""
    got = claims.select("item").distinct().join(labels.filter("lang = 'en'"), "item").select(F.col("label").alias("name"))
    return english_only(got) if english else got


def artist_names(artists: DataFrame, english: bool = True) -> DataFrame:
    got = artists.filter(F.length("name") > 0).select("name")
    return english_only(got) if english else got


def work_names(works: DataFrame, english: bool = True) -> DataFrame:
    """Titles of works and, as rows of their own, the names of the artists they list (relations array<struct<name>>)."""
    titles = works.select(F.col("title").alias("name"))
    artists = works.select(F.explode("relations").alias("r")).select(F.col("r.name").alias("name"))
    return artist_names(titles.unionByName(artists), english)


class _Cells(HTMLParser):
    """Texts of the table cells of one class."""

    def __init__(self, wanted: str) -> None:
        super().__init__()
        self.wanted, self.on, self.out = wanted, False, []

    def handle_starttag(self, tag, attrs) -> None:
        if tag == "td":
            self.on = self.wanted in (dict(attrs).get("class") or "").split()
            if self.on:
                self.out.append("")

    def handle_endtag(self, tag) -> None:
        if tag == "td":
            self.on = False

    def handle_data(self, data) -> None:
        if self.on:
            self.out[-1] += data


def table_names(pages: DataFrame, cell_class: str) -> DataFrame:
    """name: texts of the cells of a class, of listing pages (html); all pages at once instead of one "Next" after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for html in batch.column(0).to_pylist():
                cells = _Cells(cell_class)
                cells.feed(html or "")
                out += [c for c in (" ".join(x.split()) for x in cells.out) if c]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["name"])

    return pages.select("html").mapInArrow(run, "name string")


def stale_sources(sources: DataFrame, now, seconds: int = FRESH_S) -> DataFrame:
    """Sources (last_updated) never updated, or at least `seconds` ago."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_updated")
    return sources.filter(F.col("last_updated").isNull() | (age >= seconds))


def new_categories(domains: DataFrame, known: DataFrame) -> DataFrame:
    """Categories (source_category, source) not among the known ones, each once."""
    keys = ["source_category", "source"]
    return domains.dropDuplicates(keys).join(known.select(*keys), keys, "left_anti")


IMPORTERS: dict[str, Callable[..., DataFrame]] = {"wikidata": wikidata_names, "artists": artist_names, "works": work_names, "table": table_names, "cursor": cursor_names, "letters": lambda *x, **o: names_by_letter(*x, **o).select("name").distinct(), "plain": lambda names: names.select("name").filter(F.length("name") > 0)}


def import_entities(kind: str, category: str, source: str, *inputs: DataFrame, now=None, **options) -> DataFrame:
    """Rows of a registered importer; one interface for all of them."""
    return entity_rows(IMPORTERS[kind](*inputs, **options), category, source, now)
