from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillmill.functions import urls
from quillmill.operators import frontier as R
from quillmill.operators import patterns as P

PAT = "pattern_id int, website string, crawler_id int, pattern string, is_default boolean"


def url_frame(spark, *rows):
    return spark.createDataFrame([(u,) for u in rows], "url string")


@pytest.fixture
def pats(spark):
    rows = [(1, "ex.com", 1, "http://ex.com/", True), (2, "ex.com", 1, "http://ex.com/fr/", False), (3, "www.ex.com", 1, "http://(www.)?ex.com/fr/a", False), (4, "ex.com", 1, "http://ex.com/d", True)]
    return spark.createDataFrame(rows, PAT)


def test_match(spark, pats):
    pages = url_frame(spark, "http://ex.com/fr/x", "http://ex.com/other", "http://www.ex.com/fr/a", "http://EX.com/fr/a", "http://no.where/", "http://ex.com/d1", "not a url", None)
    got = {r.url: r.pattern_id for r in P.match_any_crawler(pages, pats).collect()}
    assert got["http://ex.com/fr/x"] == 2 and got["http://ex.com/other"] == 1
    assert got["http://www.ex.com/fr/a"] == 3 and got["http://EX.com/fr/a"] == 3
    assert got["http://ex.com/d1"] == 4 and got["http://no.where/"] is None and got["not a url"] is None
    assert P.match_any_crawler(pages, pats, must_match=True).count() == 5


def test_match_joins_on_the_host(spark, pats):
    plan = P.match_any_crawler(url_frame(spark, "http://ex.com/"), pats)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_valid_links(spark, pats):
    links = url_frame(spark, "http://ex.com/x.jpg", "http://ex.com/x.JPG", "http://ex.com/p#top", "http://other.com/", "http://ex.com/y.png#a").withColumn("crawler_id", F.lit(1))
    assert sorted(r.url for r in P.valid_links(links, pats).collect()) == ["http://ex.com/p#top", "http://ex.com/x.JPG", "http://ex.com/y.png#a"]


def test_bad_patterns_are_refused():
    with pytest.raises(Exception):
        P.check_pattern("(")


def test_url_functions(spark):
    df = spark.createDataFrame([("http://U:p@WWW.Ex.com:80/a/b?q#f", "../c"), ("ftp://x", "y"), ("nothing", None)], "url string, href string")
    rows = df.select(urls.host(F.col("url")).alias("h"), urls.bare_host(urls.host(F.col("url"))).alias("b"), urls.other_host(urls.host(F.col("url"))).alias("o"), urls.without_fragment(F.col("url")).alias("w"), urls.join("url", "href").alias("j")).collect()
    assert tuple(rows[0]) == ("www.ex.com", "ex.com", "ex.com", "http://U:p@WWW.Ex.com:80/a/b?q", "http://U:p@WWW.Ex.com:80/c")
    assert rows[1].o == "www.x" and rows[2].h is None and rows[2].j is None


def test_simple_join_agrees_with_urljoin(spark):
    bases = ["http://a.b/c/d?x#y", "http://a.b", "http://a.b/c/"]
    hrefs = ["", "#z", "?q", "/r", "//h/p", "rel", "http://o/", "mailto:x@y"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.select("b", "h", urls.without_fragment(urls.join_simple(F.col("b"), F.col("h"))).alias("s"), urls.without_fragment(urls.join("b", "h")).alias("j")).collect():
        assert r.s == r.j, r


def test_a_long_url_needs_no_stack(spark):
    df = spark.createDataFrame([("http://x/" + "a%20" * 50_000,)], "t string")
    assert df.select(F.length(F.regexp_extract("t", urls.ABSOLUTE_URL, 1)).alias("n")).first().n == 200_009


def test_frequency_gate(spark):
    t0 = datetime(2024, 1, 1)
    rows = [(c, t0 + timedelta(seconds=s)) for c in (1, 2) for s in (0, 10, 3599, 3600, 7199, 7200, 20000)] + [(3, t0)]
    got = R.frequency_gate(spark.createDataFrame(rows, "crawler_id long, ts timestamp")).collect()
    assert sorted((r.crawler_id, int((r.ts - t0).total_seconds())) for r in got) == [(c, s) for c in (1, 2) for s in (0, 3600, 7200, 20000)] + [(3, 0)]


def test_quota_and_freshness(spark):
    t0 = datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, t0 + timedelta(minutes=i)) for i in range(2000)], "id long, ts timestamp")
    assert R.daily_quota(df).count() == 951 + 560
    todo = spark.createDataFrame([("a", "s"), ("s", "s"), ("b", "s")], "url string, start_url string")
    assert sorted(r.url for r in R.fresh(todo, url_frame(spark, "a", "s")).collect()) == ["b", "s"]
    html = spark.createDataFrame([("x.html", "image/png"), ("y", None), ("z", "text/html; charset=x"), ("w", "application/pdf")], "url string, content_type string")
    assert sorted(r.url for r in R.html_only(html).collect()) == ["x.html", "y", "z"]
