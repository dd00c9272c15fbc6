import pytest

from quillmill.operators import html as H

PAGE = """<html><head><title>A t</title><meta name="keywords" content="x"></head><body><p>Some longer text here</p><a href="/b#c">b</a></body></html>"""


def test_only_the_fields_asked_for_are_worked_out(spark, monkeypatch):
    for name in ("metadata_of", "date_of", "text_pieces", "main_text"):
        monkeypatch.setattr(H, name, lambda *_: (_ for _ in ()).throw(AssertionError(name)))
    page = H.Page("http://h/a", PAGE, "BSoup", H.scrape_soup, None)
    assert page.title == "A t" and page.links == ["http://h/b"] and page.parser == "BSoup"
    with pytest.raises(AssertionError):
        page.metadata  # noqa: B018


def test_through_sql(spark):
    H.register_parse_page(spark)
    spark.createDataFrame([(1, "http://h/a", PAGE), (2, None, None)], "id int, url string, html string").createOrReplaceTempView("some_pages")
    got = spark.sql("SELECT id, t.* FROM some_pages, LATERAL parse_page(html, url, 'title, links, metadata, text') t ORDER BY id").collect()
    assert [got[0].title, got[0].links, got[0].metadata["keywords"], got[0].text] == ["A t", ["http://h/b"], ["x"], ["A t", "Some longer text here"]]
    assert got[1].title is None and got[1].links == [] == got[1].text
    with pytest.raises(Exception, match="no such fields"):
        spark.sql("SELECT t.* FROM some_pages, LATERAL parse_page(html, url, 'titel') t").collect()
    with pytest.raises(Exception, match="constant"):
        spark.sql("SELECT t.* FROM some_pages, LATERAL parse_page(html, url, url) t").collect()


def test_fields_keep_their_order_and_types(spark):
    pages = spark.createDataFrame([("http://h/a", PAGE)], "url string, html string")
    got = H.scrape(pages, "BSoup", fields=("links", "url", "reason"))
    assert got.columns == ["links", "url", "reason"] and tuple(got.first()) == (["http://h/b"], "http://h/a", None)
    assert H.scrape(pages).columns == list(H.FIELDS)
