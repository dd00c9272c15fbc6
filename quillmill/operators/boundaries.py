"""Sentence boundaries learned from the texts themselves, without labels, as counts over all of them.

After Kiss and Strunk, "Unsupervised Multilingual Sentence Boundary Detection" (2006). A stop belongs to an
abbreviation if its word is hardly ever met without one; the log-likelihood of that, weighed by the
word's length, its inner stops and its uses without a stop, decides. A stop after an abbreviation, an
initial or a number ends a sentence only if the next word is one that is else written small and never
large inside a sentence, and not if the two words go together more often than chance has it.

Words are runs of other than blanks, without quotes, brackets and marks around them. The counts are
small tables, one row a word or pair, combined before they are shuffled; Catalyst joins them back.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmill.storage import materialize

#: Fixed values of the paper: the least score of an abbreviation, of a collocation, and how sure a stop is after an abbreviation.
ABBREVIATION, COLLOCATION, SURE = 0.3, 7.88, 0.99
WORD = r"[^ \t\n\r\f]+"
#: What may stand before and after a word.
BEFORE, AFTER = "\"'([", "\"')],;:"


def _marked(word: Column, marks: str) -> Column:
    """Whether a word ends in one of the marks."""
    return reduce(or_, (word.endswith(m) for m in marks))


def _words(text: Column, ending: bool) -> Column:
    """The words of a text without what stands around them, as an array of structs: pos, word, next (the word after it) and last (the one before)."""
    bare = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.rtrim(F.ltrim(w, F.lit(BEFORE)), F.lit(AFTER)))

    def rows(ws: Column) -> Column:
        row = lambda w, i: F.struct(i.cast("int").alias("pos"), w.alias("word"), F.get(ws, i + 1).alias("next"), F.get(ws, i - 1).alias("last"))
        if not ending:
            return F.transform(ws, row)
        return F.filter(F.transform(ws, lambda w, i: F.when(_marked(w, ".?!") & (i + 1 < F.size(ws)), row(w, i))), lambda r: r.isNotNull())

    # as the one element of an array the words are worked out once
    return F.transform(F.array(bare), rows)[0]


def tokens(texts: DataFrame, ending: bool = False) -> DataFrame:
    """doc_id, pos, word, type (lower-cased, without its stop), stop, mark (ends in ? or !), next (the word after it) and inside (whether no sentence could end before it).

    ending: only words that end in a stop or mark and have a word after them.
    """
    rows = _words(F.col("text"), ending)
    # an outer generator has no inferred filter, which would cut every text again
    out = texts.select("doc_id", F.explode_outer(rows).alias("r")).filter("r IS NOT NULL")
    word, last = F.col("r.word"), F.col("r.last")
    inside = last.isNotNull() & ~_marked(last, ".?!")
    return out.select("doc_id", "r.pos", word.alias("word"), type_of(word).alias("type"), word.endswith(".").alias("stop"), _marked(word, "?!").alias("mark"), "r.next", F.coalesce(inside, F.lit(False)).alias("inside"))


def type_of(word: Column) -> Column:
    return F.lower(F.when(word.endswith("."), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word))


def _begins(word: Column, kind: str, first: str, last: str) -> Column:
    """Whether a word begins with a letter of this kind; of ASCII letters, those from first to last, that needs no expression."""
    ascii_ = word < "\x80"
    return F.when(ascii_, (word >= first) & (word < chr(ord(last) + 1))).otherwise(word.rlike(rf"^\p{{{kind}}}"))


def type_counts(found: DataFrame) -> DataFrame:
    """type, n, n_stop, small and large_inside of each type."""
    return found.groupBy("type").agg(F.count("*").alias("n"), F.count_if("stop").alias("n_stop"), F.count_if(_begins(F.col("word"), "Ll", "a", "z")).alias("small"), F.count_if(F.col("inside") & _begins(F.col("word"), "Lu", "A", "Z")).alias("large_inside"))


def abbreviations(types: DataFrame) -> DataFrame:
    """type, n, n_stop and score of the types with a letter that are abbreviations."""
    total, stops = types.agg(F.sum("n"), F.sum("n_stop")).first()
    share = min(stops / total, 1 - 1e-9) if stops else 1e-9
    n, with_stop = F.col("n"), F.col("n_stop")
    chance = with_stop * F.log(F.lit(share)) + (n - with_stop) * F.log(F.lit(1 - share))
    sure = with_stop * F.log(F.lit(SURE)) + (n - with_stop) * F.log(F.lit(1 - SURE))
    inner = F.length("type") - F.length(F.replace("type", F.lit("."), F.lit("")))
    letters = F.length("type") - inner
    score = 2 * (sure - chance) * F.exp(-letters) * (inner + 1) * F.pow(letters.cast("double"), with_stop - n)
    return types.filter(F.col("type").rlike(r"\p{L}") & (F.col("n_stop") > 0)).select("type", "n", "n_stop", score.alias("score")).filter(F.col("score") >= ABBREVIATION)


def _weight(k: Column, n: Column, p: Column) -> Column:
    return F.when(k > 0, k * F.log(p)).otherwise(0.0) + F.when(n > k, (n - k) * F.log(1 - p)).otherwise(0.0)


def collocations(found: DataFrame, types: DataFrame, short: DataFrame) -> DataFrame:
    """type and after of the pairs of a short form (type) with its stop and the type after it that go together more often than by chance."""
    total = F.lit(types.agg(F.sum("n")).first()[0])
    pairs = found.filter("stop AND next IS NOT NULL").join(short, "type", "left_semi").groupBy("type", type_of(F.col("next")).alias("after")).agg(F.count("*").alias("k")).filter("k > 1")
    both = pairs.join(types.select("type", "n_stop"), "type").join(types.select(F.col("type").alias("after"), F.col("n").alias("m")), "after")
    k, c, m = F.col("k"), F.col("n_stop"), F.col("m")
    least = lambda p: F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    one, two, p = least(k / c), least((m - k) / F.greatest(total - c, F.lit(1))), least(m / total)
    ratio = 2 * (_weight(k, c, one) + _weight(m - k, total - c, two) - _weight(k, c, p) - _weight(m - k, total - c, p))
    return both.filter((ratio >= COLLOCATION) & (k / c > m / total)).select("type", "after")


def breaks(texts: DataFrame) -> DataFrame:
    """doc_id, pos and ends of each word of texts (doc_id, text) that ends in a stop or mark and has a word after it: whether a sentence ends there."""
    texts = texts.select("doc_id", "text").filter("text IS NOT NULL")
    types = materialize(type_counts(tokens(texts)), "types")  # of all words, which are counted as they come
    found = materialize(tokens(texts, ending=True), "tokens")
    if types.isEmpty():
        return found.select("doc_id", "pos", F.lit(True).alias("ends"))
    forms = types.filter(F.col("type").rlike(r"^(\p{L}|[0-9]+)$")).select("type").unionByName(abbreviations(types).select("type")).distinct()
    short = materialize(forms, "short-forms")
    together = materialize(collocations(found, types, short), "collocations")
    stops = found.filter("(stop OR mark) AND next IS NOT NULL").withColumn("after", type_of(F.col("next")))
    known = stops.join(short.withColumn("short", F.lit(True)), "type", "left").join(together.withColumn("together", F.lit(True)), ["type", "after"], "left")
    known = known.join(types.select(F.col("type").alias("after"), "small", "large_inside"), "after", "left")
    opens = F.col("next").rlike(r"^\p{Lu}") & (F.coalesce("small", F.lit(0)) > 0) & (F.coalesce("large_inside", F.lit(0)) == 0)
    ends = F.col("mark") | F.col("short").isNull() | (opens & F.col("together").isNull())
    return known.select("doc_id", "pos", ends.alias("ends"))


def sentences(texts: DataFrame) -> DataFrame:
    """doc_id and sentences (array, of the words as they are written, joined by single spaces) of each row of texts (doc_id, text).

    A null text, or one of blanks alone, has no sentence. doc_id must tell rows apart.
    """
    ends = breaks(texts).filter("ends").groupBy("doc_id").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    joined = texts.select("doc_id", "text").join(ends, "doc_id", "left").select("doc_id", "at", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    none = F.array().cast("array<int>")
    at = F.coalesce("at", none)
    starts = F.concat(F.array(F.lit(0)), F.transform(at, lambda p: p + 1))
    stops = F.concat(F.transform(at, lambda p: p + 1), F.array(F.size("words")))
    cut = F.zip_with(starts, stops, lambda a, b: F.array_join(F.slice("words", a + 1, b - a), " "))
    return joined.select("doc_id", F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, cut).otherwise(F.array().cast("array<string>")).alias("sentences"))
