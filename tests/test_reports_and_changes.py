from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillmill.api import Engine
from quillmill.functions import text as T
from quillmill.operators import mutations as M
from quillmill.operators import reports as W
from quillmill.sources import gazetteer as G
from quillmill.sources import web


def test_report(spark, tmp_path):
    ents = spark.createDataFrame([("A", "positive", 2), ("A", "positive", 1), ("A", "negative", 4), ("B", "neutral", 1)], "name string, type string, count long")
    cands = spark.createDataFrame([("A",), ("C",), ("C",)], "name string")
    word = lambda *w: spark.createDataFrame([(x,) for x in w], "word string")
    report = W.word_report(ents, cands, W.chosen_words(word("A", "B", "C", "A"), word("B")))
    assert [tuple(r) for r in W.report_order(report).collect()] == [("C", "unknown", 2), ("A", "negative", 4), ("A", "positive", 3), ("A", "unknown", 1)]
    path = f"file://{tmp_path}/report"
    W.write_report(report, W.report_header("x", 3, 1, 10, 5), path)
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "Site report for:" and lines[-4:] == ["C|unknown|2", "A|negative|4", "A|positive|3", "A|unknown|1"]


def test_pagination(spark):
    df = spark.range(1000).withColumnRenamed("id", "n")
    rows, pages = W.paginate(df, 11, order=["n"])
    assert pages == 10 and [r.n for r in rows.collect()] == list(range(250, 275))
    assert W.paginate(df.limit(26), 2, order=["n"])[1] == 2


def test_domain_counters(spark):
    pages = spark.createDataFrame([("www.a.com", True), ("a.com", None), ("a.com", False), ("b.com", True)], "site string, approved boolean")
    sites = spark.createDataFrame([("a.com",), ("www.b.com",), ("c.com",)], "site string")
    assert sorted(map(tuple, W.domain_counters(sites, pages).collect())) == [("a.com", 3, 2), ("c.com", 0, 0), ("www.b.com", 1, 0)]


def test_changes(spark):
    old = spark.createDataFrame([("a", 1, 10), ("b", 1, 20)], "k string, v int, x int")
    new = spark.createDataFrame([("a", 2, 11), ("a", 3, 12), ("b", 0, 99), ("c", 1, 30)], "k string, v int, x int")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(M.upsert(old, new, ["k"], "v")) == [("a", 3, 12), ("b", 1, 20), ("c", 1, 30)]
    assert rows(M.insert_ignore(old, new, ["k"])) == [("a", 1, 10), ("b", 1, 20), ("c", 1, 30)]
    assert rows(M.delete(old, spark.createDataFrame([("a",), ("a",)], "k string"))) == [("b", 1, 20)]
    assert rows(M.set_where(old, F.col("k") == "a", x=F.col("x") + 1)) == [("a", 1, 11), ("b", 1, 20)]
    assert rows(M.increment(old, new.groupBy("k").agg(F.sum("x").alias("n")), ["k"], "x", "n")) == [("a", 1, 33), ("b", 1, 119)]
    docs = spark.createDataFrame([("a", 2, "n")], "k string, status int, name string")
    change = spark.createDataFrame([("a", False, None)], "k string, enabled boolean, name string")
    assert rows(M.merge_documents(docs, change, ["k"])) == [("a", 0, "n")]


def test_gazetteer_sources(spark):
    claims = spark.createDataFrame([("P1", f"Q{i:03}") for i in range(100)] + [("P2", "Q1"), ("P2", "Q1")], "prop string, item string")
    sizes = {(r.prop, r.batch): len(r.ids) for r in G.label_batches(claims).collect()}
    assert sizes == {("P1", 0): 49, ("P1", 1): 49, ("P1", 2): 2, ("P2", 0): 1}
    labels = spark.createDataFrame([("Q1", "en", "The house of cards"), ("Q1", "fr", "x"), ("Q2", "en", "La maison de la rue")], "item string, lang string, label string")
    items = spark.createDataFrame([("P", "Q1"), ("P", "Q2")], "prop string, item string")
    assert [r.name for r in G.wikidata_names(items, labels).collect()] == ["The house of cards"]
    assert G.wikidata_names(items, labels, english=False).count() == 2
    works = spark.createDataFrame([("Song", [("Band",), ("",)]), (None, None)], "title string, relations array<struct<name:string>>")
    assert sorted(r.name for r in G.import_entities("works", "music", "cat", works, now=datetime(2024, 1, 1)).collect()) == ["Band", "Song"]
    html = spark.createDataFrame([("<table><tr><td class='name x'>A <b>One</b></td><td>no</td></tr></table>",)], "html string")
    row = G.import_entities("table", "film", "list", html, cell_class="name", now=datetime(2024, 1, 1)).first()
    assert (row.name, row._name, row.category, row.occur, row.disabled) == ("A One", "a one", "film", 0, False)
    sources = spark.createDataFrame([("a", None), ("b", datetime(2024, 1, 1)), ("c", datetime(2024, 1, 2, 12))], "source string, last_updated timestamp")
    assert sorted(r.source for r in G.stale_sources(sources, F.lit(datetime(2024, 1, 3))).collect()) == ["a", "b"]


def test_feeds_and_sitemaps(spark):
    rss = "<rss><channel><item><link> http://a/1 </link></item><item><link>http://a/2</link></item></channel></rss>"
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><link href="http://b/1"/></entry></feed>'
    feeds = spark.createDataFrame([("r", rss), ("a", atom), ("e", "<rss/>")], "feed string, xml string")
    got = {(r.feed, r.link): r.crawl_now for r in web.feed_frontier(web.feed_entries(feeds)).collect()}
    assert got == {("r", "http://a/1"): False, ("r", "http://a/2"): True, ("a", "http://b/1"): True}
    maps = spark.createDataFrame([("s", '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>http://s/1</loc></url></urlset>')], "site string, xml string")
    assert web.sitemap_urls(maps).first().url == "http://s/1"
    page = spark.createDataFrame([('<link rel="alternate" type="application/rss+xml" href="/f.xml">',)], "h string")
    assert page.select(web.feed_link(F.col("h")).alias("l")).first().l == "/f.xml"


def test_text_functions(spark):
    df = spark.createDataFrame([("A , b,,  ",)], "t string")
    row = df.select(T.split_keywords(F.array("t")).alias("k"), T.normal_key(F.lit("OG.Title")).alias("n"), T.word_count(F.lit(" a b  c ")).alias("w"), T.is_object_id(F.lit("0" * 24)).alias("o"), T.first_integer(F.lit("P1104x2")).alias("i"), T.collapse_space(F.lit(" a \n b ")).alias("c"), T.fix_text(F.lit("cafÃ©")).alias("f"), T.fuzzy_date(F.lit("on 3 May 2020 10:00 +0200")).alias("d")).first()
    assert tuple(row) == (["A", "b", ""], "og_title", 3, True, 1104, "a b", "café", datetime(2020, 5, 3, 10))


def test_engine(spark):
    e = Engine(spark)
    e.create_website("Site", "http://www.ex.com/", "p", "news")
    with pytest.raises(ValueError):
        e.create_website("x" * 100, "http://y", "p", "c")
    e.create_crawler(1, "c", "www.ex.com", "http://www.ex.com/")
    e.add_pattern(1, 1, "www.ex.com", "http://www.ex.com/", "cat1 cat2", "bad")
    e.add_pattern(2, 1, "www.ex.com", "http://www.ex.com/fr/")
    assert {r.pattern_id: r.is_default for r in e.tables["patterns"].collect()} == {1: True, 2: False}
    assert e.crawlers().first().default_url_pattern == 1 and e.websites(1).count() == 1
    e.tables["gazetteer"] = G.entity_rows(spark.createDataFrame([("Rome",)], "name string"), "city", "s", datetime(2024, 1, 1))
    pages = spark.createDataFrame([("http://www.ex.com/fr/1", "<title>News</title><article><p>Rome is good and everything is fine.</p></article>")], "url string, html string")
    done, rejects = e.extract(e.scrape(pages, now=datetime(2024, 1, 1)))
    row = done.first()
    assert row.pattern_id == 2 and row.entities[0].name == "Rome" and rejects.count() == 0
    e.delete_crawler(1)
    assert e.tables["patterns"].count() == 0 and e.crawlers().count() == 0
