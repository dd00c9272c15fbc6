"""Rows of queries against plain Python, beside their SQL, on the smallest tables."""

import html
import re
import unicodedata
from urllib.parse import urldefrag, urljoin

import pyarrow.parquet as pq

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"


def driver_rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


STOP = {
    "en": "the of and to in is that for with on",
    "fr": "le la les de des et est un une que",
    "de": "der die das und ist ein eine mit von zu",
    "es": "el la los de que y en un una por",
}


def test_language_votes(spark):
    def vote(text):
        words = set("".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower()).split())
        return max(STOP, key=lambda k: len(words & set(STOP[k].split())))

    want = sorted((r["doc_id"], vote(r["text"])) for r in driver_rows("documents"))
    got = sorted(tuple(r) for r in entry_point.queries()["language_votes"](spark, SF).select("doc_id", "voted").collect())
    assert got == want and len({v for _, v in want}) > 1


def test_dom_links(spark):
    want = []
    for r in driver_rows("pages"):
        shown = re.sub(r"(?is)<!--.*?-->|<(script|style)\b.*?</\1>", "", r["html"])
        found = re.findall(r"""(?is)<a\s[^>]*?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", shown)
        targets = [html.unescape(x.strip("\"'")) for x in found]
        want += sorted({(r["url"], urldefrag(urljoin(r["url"], t))[0]) for t in targets if t})
    got = sorted(tuple(r) for r in entry_point.queries()["dom_links"](spark, SF).select("url", "link").collect())
    assert got == sorted(want) and want
