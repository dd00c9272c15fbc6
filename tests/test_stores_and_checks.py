from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillmill import storage
from quillmill.api import Engine
from quillmill.functions import sentiment as S
from quillmill.functions import text as T
from quillmill.operators import checks
from quillmill.operators import entities as E
from quillmill.operators import rollup as U
from quillmill.sources import fetch
from quillmill.sources import gazetteer as G
from quillmill.sources import web
from quillmill.streaming import jobs

PAGES = "page_key long, site string, title string, text array<string>"


def test_hot_names_fold_in_blocks(spark):
    rows = [("s", "A", i, 1 + i % 3, [0.5, 0.0, -0.25, 0.9, 0.0][i % 5]) for i in range(700)] + [("s", "B", 1, 2, 0.0), ("t", "A", 3, 1, -1.0)]
    df = spark.createDataFrame(rows, "site string, name string, ord long, count long, score double")
    whole, blocks = ({(r.site, r.name): (r["count"], r.sentiment) for r in U.fold_entities(df, hot_rows=n).collect()} for n in (10**6, 50))
    assert whole.keys() == blocks.keys() == {("s", "A"), ("s", "B"), ("t", "A")}
    for k, (n, s) in whole.items():
        assert blocks[k][0] == n and blocks[k][1] == pytest.approx(s, abs=1e-9)


def test_control_characters_are_text(spark):
    df = spark.createDataFrame([(1, "s", None, ["He met \u0003 Anna Lee today. Fine \u0001 it was. \u0002x.", "﷒ Odd One"])], PAGES)
    sents = E.sentence_table(df)
    assert [r.sentence for r in sents.orderBy("sentence_idx").collect()][:2] == ["He met \u0003 Anna Lee today.", "Fine \u0001 it was."]
    found = {r.piece for r in E.piece_table(sents, S.DEFAULT_LEXICON).filter("is_candidate").collect()}
    assert found == {"He", "Anna Lee", "Fine", "Odd One"}


def test_sentences_are_cut_once(spark):
    df = spark.createDataFrame([(1, "s", "Title", ["One is. Two are."])], PAGES)
    plan = E.sentence_table(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3


def test_a_long_lexicon_is_a_parameter(spark, tmp_path):
    terms = {f"term{i}": i % 11 - 5 for i in range(2477)} | {"two words": 3, "half-way": 2}
    (tmp_path / "words.tsv").write_text("".join(f"{k}\t{v}\n" for k, v in terms.items()))
    lexicon = web.read_lexicon(spark, f"file://{tmp_path}/words.tsv")
    assert lexicon == terms
    df = spark.createDataFrame([("term7 term8 TERM9, two words half-way",)], "t string").withColumn("h", S.hits(F.col("t"), lexicon))
    total, count = S.hit_totals(F.col("h"), lexicon)
    assert tuple(df.select(total, count).first()) == (2 + 3 + 4, 3)  # terms of several words aren't met


def test_required_fields_and_versions(spark):
    with pytest.raises(ValueError, match="lacks text"):
        checks.with_required(spark.createDataFrame([(1,)], "url long"), "url", ("url", "text"))
    pages = spark.createDataFrame([("a", 2), ("b", 1), ("c", None)], "url string, version int")
    now, old = checks.current(pages)
    assert [r.url for r in now.collect()] == ["a"] and sorted(r.url for r in old.collect()) == ["b", "c"]
    maps = spark.createDataFrame([("a", [{"text": "x"}]), ("b", [{"name": "x"}]), ("c", [])], "url string, entities array<map<string,string>>")
    assert [r.url for r in checks.current(maps)[1].collect()] == ["a"]


def test_fetch_retries_and_reports_what_fails(spark, tmp_path):
    (tmp_path / "p.html").write_text("<p>a \n\n b</p>")
    good, bad = f"file://{tmp_path}/p.html", f"file://{tmp_path}/none.html"
    rows = {r.url: r for r in fetch.fetch(spark.createDataFrame([(good,), (bad,), (good,), (None,)], "url string"), attempts=2, wait_s=0).collect()}
    assert rows[good].html == "<p>a b</p>" and rows[good].attempts == 1 and rows[good].error is None
    assert rows[bad].html is None and rows[bad].attempts == 2 and "URLError" in rows[bad].error
    spark.dataSource.register(fetch.FetchedPages)
    assert spark.read.format("fetched_pages").option("urls", f"{good} {bad}").option("attempts", 1).load().count() == 2
    waits, calls = [], iter([OSError("x"), OSError("y"), "done"])

    def call():
        x = next(calls)
        if isinstance(x, Exception):
            raise x
        return x

    assert fetch.with_retries(call, 4, 1.0, waits.append) == ("done", 3, None) and waits == [1.0, 2.0]


def test_chains_end_and_circles_too(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), (None, "z"), ("c", None)], "key string, next string")
    assert sorted(r.key for r in G.reachable(edges, spark.createDataFrame([("a",)], "key string")).collect()) == ["a", "b", "c"]


def test_tables_write_touched_buckets_and_clear_old_versions(spark, tmp_path):
    table = jobs.Table(spark, f"file://{tmp_path}/t", spark.createDataFrame([], "url string, crawled_at long"), ["url"], buckets=4)
    each = jobs.upsert_pages(table)
    for n in range(5):
        each(spark.createDataFrame([(f"u{i}", n) for i in range(20 if n == 0 else 1)], "url string, crawled_at long"), n)
    each(spark.createDataFrame([("u0", 4)], "url string, crawled_at long"), 4)  # a batch run again
    got = {r.url: r.crawled_at for r in table.read().collect()}
    assert got == {"u0": 4} | {f"u{i}": 0 for i in range(1, 20)}
    held = table._buckets()
    assert sum(len(v) for v in held.values()) <= 2 + 3 and max(len(v) for v in held.values()) == 2


def test_a_failing_query_is_begun_again(spark):
    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):
            if self.fails:
                raise RuntimeError("x")

    runs = iter([True, True, False])
    waits = []
    assert jobs.keep_running(lambda: Query(next(runs)), 5, 10.0, waits.append) == 2 and waits == [10.0, 10.0]
    with pytest.raises(RuntimeError):
        jobs.keep_running(lambda: Query(True), 1, 0.0, waits.append)


def test_engine_updates_and_lookups(spark):
    e = Engine(spark)
    e.create_crawler(1, "c", "ex.com", "http://ex.com/", category="news")
    e.add_pattern(1, 1, "ex.com", "http://ex.com/")
    e.tables["scraped_pages"] = spark.createDataFrame([("u", "news", datetime(2020, 1, 1)), ("v", "x", datetime(2020, 1, 1))], "url string, category string, crawled_at timestamp")
    e.update_crawlers(spark.createDataFrame([(1, 60)], "crawler_id int, age long"), datetime(2024, 1, 1))
    assert e.crawler(1).first().age == 60 and e.pattern(1).first().pattern == "http://ex.com/"
    assert {r.url: r.crawled_at for r in e.tables["scraped_pages"].collect()} == {"u": datetime(2024, 1, 1, 0, 1), "v": datetime(2020, 1, 1)}
    e.update_patterns(spark.createDataFrame([(1, "http://ex.com/a")], "pattern_id int, pattern string"))
    assert e.pattern(1).first().pattern == "http://ex.com/a" and e.site_tree().count() == 0
    e.save_extracted(spark.createDataFrame([("http://ex.com/a", 1), ("http://other/", 2)], "url string, n int"), datetime(2024, 1, 1))
    e.save_extracted(spark.createDataFrame([("http://ex.com/a", 3)], "url string, n int"), datetime(2024, 1, 2))
    assert e.extracted_page_with_pattern("http://ex.com/a").first().n == 3 and e.extracted_page_with_pattern("http://other/").count() == 0
    e.tables["entity_source"] = spark.createDataFrame([("s", "a", None)], "source string, source_category string, note string")
    e.add_categories(spark.createDataFrame([("s", "a", "no"), ("s", "b", "yes")], "source string, source_category string, note string"))
    e.update_categories(spark.createDataFrame([("s", "a", "now")], "source string, source_category string, note string"))
    assert e.category("s", "a").first().note == "now" and e.categories().count() == 2


def test_no_shared_folder_off_local_mode():
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return None

    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(Session())


def test_marks_are_replaced(spark):
    assert spark.createDataFrame([("a﷐b",)], "t string").select(T.unmarked(F.col("t"))).first()[0] == "a�b"
