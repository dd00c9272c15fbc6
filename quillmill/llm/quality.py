"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition under which a document fails. On a bounded sample the cascade
measures how long a rule takes and what share it rejects, and orders the rules by rejection
per cost. They stand in one CASE in that order, so
a document meets a costly rule only if no cheaper, stricter one has turned it away. The order
affects the time that a verdict takes and never the verdict.
"""

from __future__ import annotations

import contextlib
import math
import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_SEPARATORS, materialize

#: Rows on which rules are measured, and files at most that they are drawn from.
SAMPLE_ROWS, SAMPLE_FILES = 2000, 16
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
NOT_SEPARATORS, NOT_SYMBOLS = r"[^\x20\x09-\x0D]+", r"[^#*$%&|<>]+"


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, WORD_SEPARATORS), lambda w: w != "")


def separator_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_SEPARATORS, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, NOT_SYMBOLS, "")).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def repeated_words(words: Column) -> Column:
    """Words inside a window of three words that the text has twice or more, the first one included.

    Windows are sorted by their hash, equal neighbours are repeats, and the positions they
    cover are counted once each: a window adds three words, less what it shares with the one before.
    """
    n = F.size(words)

    def windows(h: Column) -> Column:
        """The windows' hashes, of the hashes of their words, with their places."""
        return F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)).alias("h"), i.alias("i")))

    ordered = F.sort_array(F.element_at(F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), windows), 1))

    def covered(s: Column) -> Column:
        at = lambda i: F.get(s, i)["h"]
        hits = F.filter(s, lambda x, i: (F.coalesce(at(i - 1) == x["h"], F.lit(False))) | (F.coalesce(at(i + 1) == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(hits, lambda x: x["i"]))
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).alias("n"), i.alias("last"))
        return F.aggregate(places, start, step, lambda a: a["n"])

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(F.element_at(F.transform(F.array(ordered), covered), 1))


@dataclass(frozen=True)
class Rule:
    """fails: when it holds the document goes."""

    name: str
    fails: Column


def features(docs: DataFrame) -> DataFrame:
    """Adds _text (never null), _words, n_words, word_chars, n_symbols, n_dup_lines and n_lines, in place of any there."""
    text = F.col("_text")
    return (
        docs.withColumn("_text", F.coalesce("text", F.lit("")))
        .withColumn("_words", word_list(text))
        .withColumn("n_words", F.size("_words").cast("long"))
    )


def rules() -> list[Rule]:
    """The rules, over the columns _text and _words.

    few_words and repetition are the base rules. The others turn away text where over three
    words in ten carry symbols or stand beside bars, texts set in capitals, texts whose words
    are not of a language's length, and texts most of whose lines repeat.
    """
    text, words = F.col("_text"), F.col("_words")
    n = F.size(words)
    letters = F.length(F.regexp_replace(text, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(text, r"\P{Lu}+", ""))
    chars = F.length(text) - separator_count(text)
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return [
        Rule("few_words", n < 50),
        Rule("symbols", symbol_count(text) * 10 > n * 3),
        Rule("capitals", capitals * 2 > letters),
        Rule("word_length", (chars < n * 2) | (chars > n * 20)),
        Rule("repeated_lines", duplicate_lines(text) * 2 > lines),
        Rule("repetition", repeated_words(words) * 100 > n * 50),
    ]


def sampled(docs: DataFrame, rows: int = SAMPLE_ROWS, files: int = SAMPLE_FILES) -> DataFrame:
    """text of a random sample of about `rows` rows; of a table in more files than `files`, from so many, evenly spread, and no others are read."""
    text = docs.select("text")
    names = sorted({f.rsplit("/", 1)[-1] for f in docs.inputFiles()})
    if len(names) > files:
        few = F.col("_metadata.file_name").isin(names[:: math.ceil(len(names) / files)])
        with contextlib.suppress(AnalysisException):  # not a plain table any more: then all of it is sampled
            text = docs.filter(few).select("text")
    return text.sample(min(1.0, rows / max(1, text.count())), 17)


def seconds(sample: DataFrame, fails: Column) -> tuple[float, float]:
    """How long a condition takes over the sample, the shorter of two runs, and the share for which it holds."""
    took = []
    for _ in range(2):
        began = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(fails, F.lit(False)).cast("double"))).first()[0]
        took.append(time.perf_counter() - began)
    return min(took), share or 0.0


def ordered_rules(sample: DataFrame, every: list[Rule]) -> list[Rule]:
    """The rules by share rejected per measured cost over sample, a small stored table of the columns they are over.

    A cost is the time beyond that of a rule that does nothing; what can't be told from that
    counts as a millisecond. Ties, and an empty table, keep the given order.
    """
    nothing, _ = seconds(sample, F.lit(False))
    gain = []
    for r in every:
        took, share = seconds(sample, r.fails)
        gain.append(share / max(took - nothing, 0.001))
    return [every[i] for i in sorted(range(len(every)), key=lambda i: -gain[i])]


def verdict(ordered: list[Rule]) -> Column:
    """The name of the first rule that fails, or null: later rules aren't evaluated."""
    out = F.when(ordered[0].fails, F.lit(ordered[0].name))
    for r in ordered[1:]:
        out = out.when(r.fails, F.lit(r.name))
    return out


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that no rule rejects, with their own columns alone, whatever their names.

    A null or empty text has no words and is rejected; repeated rows meet the same verdict. A
    very long text is judged whole, in the memory of one task. An empty table gives no rows.
    """
    ordered = ordered_rules(materialize(features(sampled(docs)), "rule-sample"), rules())
    # a Filter would be pushed below the word list and work it out anew for each use; a generator isn't
    kept = F.when(verdict(ordered).isNull(), F.array("_doc"))
    return features(docs.select(F.struct("*").alias("_doc"), "text")).select(F.inline(kept))


def counts(docs: DataFrame) -> DataFrame:
    """features() with word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text, words = F.col("_text"), F.col("_words")
    counted = (
        features(docs)
        .withColumn("word_chars", F.length(text).cast("long") - separator_count(text))
        .withColumn("n_symbols", symbol_count(text))
        .withColumn("n_dup_lines", duplicate_lines(text))
        .withColumn("n_repeat_words", repeated_words(words))
    )
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return counted.withColumn("base_failed", (n < 50) | (repeated * 100 > n * 50))


def rules_of_counts() -> list[Rule]:
    """The rules where counts() are there: what those settle isn't worked out again."""
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    known = {"few_words": n < 50, "symbols": F.col("n_symbols") * 10 > n * 3, "repetition": repeated * 100 > n * 50, "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 20)}
    return [Rule(r.name, known.get(r.name, r.fails)) for r in rules()]


def judge(docs: DataFrame) -> DataFrame:
    """Counts and verdict for every row, kept or not.

    doc_id, n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words
    (longs), base_failed (under 50 words, or over half of them repeated), kept, and failed_rule
    (the first of the cascade to fail, else null; which one that is follows the measured order,
    kept doesn't). A null text has no words. Repeated rows come out as often as they came in; a
    very long text is counted whole, in the memory of one task; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    cascade = ordered_rules(materialize(counts(sampled(docs)), "rule-sample"), rules_of_counts())
    return counts(docs.select("doc_id", "text")).withColumn("failed_rule", verdict(cascade)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule"
    )
