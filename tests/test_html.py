from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillmill.operators import html as H

PAGE = """<!DOCTYPE html><html><head><title>The title</title><meta name="keywords" content="Paris, Rome,,x"><meta property="og.Type" content="article">
<meta http-equiv="Content-Type" content="text/html; charset=latin-1"><script>var t="</p>";</script></head>
<body><nav><a href="/one#x">First link</a> <a href="two">zzz</a></nav><!-- not shown -->
<article><p>This is the long first paragraph of the page, with <b>Bold Name</b> in it and words to spare.<p>Second paragraph, long enough to be kept with the first one here.</p>
<time datetime="2020-05-06T10:00:00+02:00">x</time><time datetime="2099-01-01">y</time></article><div>ad</div></body></html>"""


def scrape(spark, html, name="BSoup", url="http://ex.com/dir/page"):
    return H.scrape(spark.createDataFrame([(url, html)], "url string, html string"), name, now=datetime(2024, 1, 1)).first()


def test_page(spark):
    row = scrape(spark, PAGE)
    assert row.title == "The title" and row.parser == "BSoup" and row.reason is None
    assert row.text[0] == "The title" and len(row.text) == 3
    assert row.text[1].startswith("This is the long first paragraph of the page, with Bold Name in it")
    assert row.highlighted_strings == ["Bold Name"]
    assert row.links == ["http://ex.com/one", "http://ex.com/dir/two"]
    assert row.metadata["keywords"] == ["Paris", "Rome", "x"] and row.metadata["og_type"] == ["article"] and row.keywords == ["Paris", "Rome", "x"]
    assert row.charset == "latin-1" and row.date == datetime(2020, 5, 6, 10)


def test_no_text_is_a_reason_and_broken_html_no_crash(spark):
    assert scrape(spark, "<html><body></body></html>").reason == "no text"
    assert scrape(spark, None).reason == "no text" and scrape(spark, "").text == []
    assert scrape(spark, "<p><b>unclosed <i>all of it</p></div></b>").text
    assert scrape(spark, "<div>" * 3000 + "deep text here" + "</div>" * 3000).text == ["deep text here"]


def test_scrapers(spark):
    assert scrape(spark, PAGE, "Readability2").text[0].startswith("This is the long first")
    assert scrape(spark, PAGE, "Newspaper").text[0].startswith("The title. This is")
    assert H.scraper(None)[0] == "Readability"
    with pytest.raises(KeyError):
        H.scraper("nothing")


def test_junk_cut(spark):
    texts = ["a" * 100, "b" * 31, "c" * 30]
    assert H.cut_junk(texts, ["bb", "cc"]) == (texts[:2], ["bb"])
    assert H.cut_junk([], ["x"]) == ([], [])
    df = spark.createDataFrame([(texts, ["bb", "cc", "bb"])], "t array<string>, h array<string>")
    row = df.select(H.kept_texts(F.col("t")).alias("t"), "h").select("t", H.kept_highlights(F.col("h"), F.col("t")).alias("h")).first()
    assert row.t == texts[:2] and row.h == ["bb"]


def test_a_later_run_of_a_meta_key_replaces_an_earlier_one():
    root = H.parse('<meta name=a content=1><meta name=a content=2><meta name=b content=3><meta name=a content=4>')
    assert H.metadata_of(root) == {"a": ["4"], "b": ["3"]}


def test_dates_in_text(spark):
    assert scrape(spark, "<body><p>Written on March 3rd, 2019 and the 5th of April 2021</p></body>").date == datetime(2021, 4, 5)
    assert scrape(spark, "<body><p>on 10/12/1998 or 01/02/2030</p></body>").date == datetime(1998, 10, 12)
    assert scrape(spark, "<body><p>no dates at all</p></body>").date is None


def test_scraping_is_deterministic(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a, b = (sorted(map(str, H.scrape(df, "BSoup", now=datetime(2024, 1, 1)).collect())) for _ in range(2))
    assert a == b


def test_links_of_two_pages_with_one_url_come_once(spark, tmp_path):
    from quillmill.plans import more

    page = '<body><a href="/a">a</a><a href="/%s">b</a></body>'
    spark.createDataFrame([(1, "http://h/", page % "b"), (2, "http://h/", page % "c")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(r.link for r in more.dom_links(spark, str(tmp_path)).collect())
    assert got == ["http://h/a", "http://h/b", "http://h/c"]
