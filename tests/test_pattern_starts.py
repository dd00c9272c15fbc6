"""What patterns say of their beginnings, and that no match is lost by it."""

import random
import re

import pytest

from quillmill.operators import patterns as P


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"https?://(www\.)?a\.de/", ["http://a.de/", "http://www.a.de/", "https://a.de/", "https://www.a.de/"]),
        (r"^http://A\.DE/(en|fr)/x", ["http://a.de/en/x", "http://a.de/fr/x"]),
        (r"http://abc/.*page=", ["http://abc/"]),
        (r"http://abc/[xy]z", ["http://abc/xz", "http://abc/yz"]),
        (r"http://abc/[a-z]z", ["http://abc/"]),
        (r"http://abc/(?=q)(?:de)+f", ["http://abc/de"]),
        (r"http://abc/(de)*f", ["http://abc/"]),
        (r"http://abc/d{2}e", ["http://abc/d"]),
        (r"http://abcd(/x)?", ["http://abcd"]),
        (r".*\.html", None),
        (r"http://", None),
        (r"http://abc/|.*x", None),
        (r"(http://abc/", None),
        (r"\Qhttp://abc\E", None),
        (r"http://abc/" + "(a|b)" * 8, None),
        ("", None),
        (None, None),
    ],
)
def test_starts(pattern, want):
    got = P.literal_starts(pattern)
    if pattern and "(a|b)" in pattern:  # cut where they would become too many
        assert got and len(got) <= P.MOST_STARTS and all(x.startswith("http://abc/") for x in got)
    else:
        assert got == want


def test_every_match_begins_with_a_start():
    rnd = random.Random(1)
    atoms = ["a", "b", "x?", "(c|d)", "(e|fg)?", "[hi]", "[j-l]", "m+", "n*", "(o|)", r"\d", ".", "(?:pq){1,2}", "(?!z)", "s{2}"]
    texts = ["a", "b", "c", "d", "e", "fg", "h", "i", "k", "m", "n", "o", "pq", "x", "ss", "7"]
    seen = 0
    for _ in range(3000):
        pattern = "http://ab/" + "".join(rnd.choice(atoms) for _ in range(rnd.randrange(1, 6)))
        starts = P.literal_starts(pattern)
        assert starts and len(starts) <= P.MOST_STARTS
        for _ in range(20):
            url = "HTTP://ab/" + "".join(rnd.choice(texts) for _ in range(rnd.randrange(0, 7)))
            if re.match(f"(?i)^(?:{pattern})", url):
                seen += 1
                assert any(url.lower().startswith(s) for s in starts), (pattern, url)
    assert seen > 500


def links_and_patterns(spark, n):
    hosts = [f"site{i:05}.example.org" for i in range(n)]
    patterns = [(i, 1, rf"https?://(www\.)?{re.escape(h)}/" + ("news/" if i % 2 else ""), i % 3 == 0) for i, h in enumerate(hosts)] + [(n, 1, r".*/special/", False), (n + 1, 2, r".*", False)]
    links = [(f"http://{'www.' if i % 2 else ''}{h}/{'NEWS' if i % 4 < 2 else 'shop'}/{i}#top", 1) for i, h in enumerate(hosts[:500])] + [("http://other/special/1", 1), ("http://other/", 1), ("x", 1), (None, 1), ("http://other/", 2), ("http://other/a.jpg", 2)]
    return spark.createDataFrame(links + links[:3], "url string, crawler_id int"), spark.createDataFrame(patterns, "pattern_id int, crawler_id int, pattern string, is_default boolean"), links, patterns


def test_patterns_are_tried_in_proportion_to_hits(spark):
    links, patterns, rows, _ = links_and_patterns(spark, 10_000)
    tried = P.candidates(links.filter("crawler_id = 1").distinct(), patterns)
    assert tried.filter(f"pattern_id < 10000").count() <= 500  # of 5 million pairs
    assert sorted((r.crawler_id, r.n) for r in P.unkeyed(patterns).collect()) == [(1, 1), (2, 1)]


def test_results_are_those_of_all_pairs(spark):
    links, patterns, rows, pats = links_and_patterns(spark, 600)

    def hits(url, crawler):
        return [(d, -i if d else i) for i, c, p, d in pats if c == crawler and url and re.match(f"(?i)^(?:{p})", url)]

    want = sorted(r for r in rows + rows[:3] if r[0] and not r[0].endswith((".jpg", ".png")) and hits(r[0].split("#")[0], r[1]))
    assert sorted(map(tuple, P.valid_links(links, patterns).collect())) == want
    best = sorted((u, c, abs(min(h)[1])) for u, c in set(rows) if (h := hits(u, c)))
    assert sorted(map(tuple, P.match_crawler(links, patterns).collect())) == best
