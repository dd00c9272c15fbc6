"""Pages of one URL, and titles cut inside a reference, held against the queries' SQL."""

import duckdb
import pytest

import __spark_entry__ as entry_point
from quillmill.operators import shared_urls as U

from .test_queries import plain

HEAD = "<!DOCTYPE html><html><head><title>{}</title><script>x = '</p>';</script></head><body>"
# tags of one number don't both have text, so that no order is left open
ONE = HEAD.format("Two of one") + "<article><p>First text of the first page</p><div></div><p><b>first mark</b></p><p></p></article><a href='/x'></a></body></html>"
TWO = HEAD.format("Two of one") + "<article><p></p><p>Second page, <i></i></p><p></p><p></p><p>of another length, ends here</p></article><a href=\"/y\"></a><a href=\"/x\"></a></body></html>"
CUT = HEAD.format("Salt &amp; pepper &amp") + "<article><p>A text with &lt;marks&gt; &amp; <b>bold words</b></p></article><a href=\"/z\"></a></body></html>"
ROWS = [(1, "http://a.example/1", ONE.replace("'/x'", '"/x"')), (2, "http://a.example/1", TWO), (3, "http://a.example/2", CUT)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("shared"))
    spark.createDataFrame(ROWS, "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["article_text", "highlights", "kept_highlights", "newspaper_text", "parsed_pages", "scraped_pages", "visible_text"])
def test_pages_of_one_url_agree_with_the_sql(spark, folder, name):
    got = entry_point.queries()[name](spark, folder)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{folder}/pages.parquet/*.parquet')")
    want = con.sql(entry_point.oracle_sql()[name])
    rows = sorted(tuple(plain(r[c]) for c in want.columns) for r in got.collect())
    assert rows and rows == sorted(tuple(map(plain, r)) for r in want.fetchall())


def test_tags_of_one_number_go_by_page(spark):
    rows = [(2, "u", "<p>later page"), (1, "u", "<p>first page"), (3, None, "<p>none"), (4, None, "<p>none")]
    alone, shared = U.split(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(r.page_id for r in alone.collect()) == [3, 4]
    assert [tuple(r) for r in U.texts(U.groups(U.tags(shared))).collect()] == [("u", 0, "first page later page")]
