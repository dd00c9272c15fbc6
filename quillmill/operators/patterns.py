"""URL patterns: which belongs to a URL, and which links are worth following.

Patterns are regular expressions that must match from the start, in any case. They are only
ever tried on URLs of their own host or crawler, and of a crawler's many patterns only on those that
begin as the pattern says they must: the texts with which a match can begin are read off the
expression's parse tree, and cut to one of LENGTHS they are a key of an equi-join, as in a trie whose
levels are those lengths. The expression is its residual condition, so the work follows the hits and not
the product of URLs and patterns. Patterns that say too little of their beginning are joined by
crawler alone; `unkeyed` counts them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as sre
from re import _parser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmill.functions import urls


def check_pattern(pattern: str) -> str:
    """The pattern, if it compiles; patterns are checked when they are made, so queries don't fail on them."""
    re.compile(pattern)
    return pattern


def matches(url: Column, pattern: Column) -> Column:
    return F.rlike(url, F.concat(F.lit("(?i)^(?:"), pattern, F.lit(")")))


def match_any_crawler(pages: DataFrame, patterns: DataFrame, must_match: bool = False) -> DataFrame:
    """url and pattern_id (null if none, or no row with must_match), for pages (url) and patterns (pattern_id, website, pattern, is_default).

    Patterns of the host with and without www. are tried, www first, then by pattern_id: the
    first that isn't a default wins, and without one the last default.
    """
    seen = pages.select("url").distinct().withColumn("_bare", urls.bare_host(urls.host(F.col("url"))))
    own = patterns.select("pattern_id", "website", "pattern", "is_default", urls.bare_host(F.col("website")).alias("_bare"))
    hits = seen.join(own, "_bare").filter(matches(F.col("url"), F.col("pattern")))
    place = F.struct(F.when(F.col("website").startswith("www."), 0).otherwise(1), "pattern_id")
    best = hits.groupBy("url").agg(F.min_by("pattern_id", F.when(~F.col("is_default"), place)).alias("_first"), F.max_by("pattern_id", F.when(F.col("is_default"), place)).alias("_default"))
    out = best.select("url", F.coalesce("_first", "_default").alias("pattern_id"))
    return out if must_match else pages.select("url").distinct().join(out, "url", "left")


#: Lengths to which beginnings are cut; a pattern with a shorter one isn't keyed.
LENGTHS = (9, 12, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128)
#: Beginnings that one pattern may have.
MOST_STARTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CASE = str.maketrans(_UPPER, _LOWER)


class _Starts:
    """Texts with which a match of a parsed expression begins: those that may go on, and those after which anything may come."""

    def __init__(self, going: set[str]) -> None:
        self.going, self.ended = going, set()

    def end(self) -> None:
        self.ended |= self.going
        self.going = set()

    def follow(self, items) -> None:
        for op, arg in items:
            if not self.going:
                return
            before = set(self.going)
            self.step(op, arg)
            if len(self.going) + len(self.ended) > MOST_STARTS:
                self.going, self.ended = set(), self.ended & self.kept | before
                return
            self.kept = set(self.ended)

    kept: set[str] = frozenset()

    def branch(self, options) -> None:
        """Each option in place of what comes next."""
        going = set()
        for items in options:
            own = _Starts(set(self.going))
            own.follow(items)
            going |= own.going
            self.ended |= own.ended
        self.going = going

    def step(self, op, arg) -> None:
        if op is sre.LITERAL:
            self.going = {x + chr(arg).translate(_CASE) for x in self.going}
        elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
            self.branch([[x] for x in arg])
        elif op is sre.BRANCH:
            self.branch(arg[1])
        elif op is sre.SUBPATTERN and not arg[1] and not arg[2]:
            self.follow(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
            self.branch([arg[2]] if arg[0] else [arg[2], []])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0]:
            self.follow(arg[2])
            self.end()
        elif op not in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):  # these take no text
            self.end()


def literal_starts(pattern: str | None) -> list[str] | None:
    """The different texts, A-Z lower-cased, with one of which every match of the pattern begins in any case; none if it can't be told or one is shorter than the least of LENGTHS."""
    try:
        parsed = _parser.parse(pattern)
    except (re.error, TypeError, OverflowError, RecursionError):  # other dialects' expressions are tried as they are
        return None
    starts = _Starts({""})
    starts.follow(parsed)
    found = {x for x in starts.going | starts.ended if not any(x != y and x.startswith(y) for y in starts.going | starts.ended)}
    return sorted(found) if found and min(map(len, found)) >= LENGTHS[0] else None


def with_starts(patterns: DataFrame) -> DataFrame:
    """patterns with _starts; each different pattern is parsed, once a batch, by the tasks that hold them."""

    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map({x: literal_starts(x) for x in batch.unique()}, na_action=None)

    return patterns.withColumn("_starts", F.pandas_udf(parse, "array<string>")(F.col("pattern")))


def unkeyed(patterns: DataFrame) -> DataFrame:
    """crawler_id and n, the patterns that every URL of the crawler is tried on."""
    return with_starts(patterns).filter("_starts IS NULL").groupBy("crawler_id").agg(F.count("*").alias("n"))


def candidates(links: DataFrame, patterns: DataFrame, url: str = "url") -> DataFrame:
    """links (crawler_id, url and more) with the columns of those patterns of their crawler that they may match; a pair may come twice."""
    parsed = with_starts(patterns)
    cut = F.lit(LENGTHS[0])
    for n in LENGTHS[1:]:
        cut = F.when(F.length("_start") >= n, n).otherwise(cut)
    keyed = parsed.filter("_starts IS NOT NULL").select("*", F.explode("_starts").alias("_start")).withColumn("_key", F.left("_start", cut)).drop("_starts")
    low = F.translate(url, _UPPER, _LOWER)
    keys = F.array_compact(F.array(*(F.when(F.length(low) >= n, F.left(low, F.lit(n))) for n in LENGTHS)))
    met = links.withColumn("_low", low).withColumn("_key", F.explode(keys)).join(keyed, ["crawler_id", "_key"]).filter(F.startswith("_low", "_start")).drop("_low", "_key", "_start")
    return met.unionByName(links.join(parsed.filter("_starts IS NULL").drop("_starts"), "crawler_id"))


def match_crawler(pages: DataFrame, patterns: DataFrame) -> DataFrame:
    """url, crawler_id, pattern_id: as above among the crawler's own patterns, by pattern_id; the fragment stays on."""
    own = patterns.select("crawler_id", "pattern_id", "pattern", "is_default")
    hits = candidates(pages.select("url", "crawler_id").distinct(), own).filter(matches(F.col("url"), F.col("pattern")))
    best = hits.groupBy("url", "crawler_id").agg(F.min(F.struct("is_default", F.when(F.col("is_default"), -F.col("pattern_id")).otherwise(F.col("pattern_id")).alias("p"))).alias("m"))
    return best.select("url", "crawler_id", F.when(F.col("m.is_default"), -F.col("m.p")).otherwise(F.col("m.p")).alias("pattern_id"))


def with_default_flag(patterns: DataFrame, crawlers: DataFrame) -> DataFrame:
    """patterns with is_default: whether the crawler names this pattern, or none."""
    named = crawlers.select("crawler_id", F.col("default_url_pattern").alias("_d"))
    return patterns.drop("is_default").join(named, "crawler_id", "left").withColumn("is_default", (F.col("_d") == F.col("pattern_id")) | F.col("_d").isNull()).drop("_d")


def valid_links(links: DataFrame, patterns: DataFrame) -> DataFrame:
    """The links (url, crawler_id) that aren't images and that, without fragment, a pattern of their crawler matches."""
    kept = links.filter(~urls.is_image(F.col("url"))).withColumn("_u", urls.without_fragment(F.col("url")))
    met = candidates(kept.select("crawler_id", "_u").distinct(), patterns.select("crawler_id", "pattern"), "_u")
    hits = met.filter(matches(F.col("_u"), F.col("pattern"))).select("crawler_id", "_u").distinct()
    return kept.join(hits, ["crawler_id", "_u"], "left_semi").select(links.columns)


def site_tree(websites: DataFrame, crawlers: DataFrame, patterns: DataFrame) -> DataFrame:
    """site and crawlers, each with its patterns."""
    per_crawler = patterns.groupBy("crawler_id").agg(F.sort_array(F.collect_list(F.struct("pattern_id", "pattern"))).alias("patterns"))
    per_site = crawlers.join(per_crawler, "crawler_id", "left").groupBy("site").agg(F.sort_array(F.collect_list(F.struct("crawler_id", "patterns"))).alias("crawlers"))
    return websites.select("site").join(per_site, "site", "left")
