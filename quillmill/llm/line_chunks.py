"""Deduplication of content-defined chunks of lines, in DataFrame functions only.

A line's hash goes into a rolling hash over the last WINDOW lines; where its low bits are zero
a chunk ends. Boundaries depend on nothing but nearby lines, so text inserted or removed
elsewhere doesn't shift them. A chunk of two lines or more that occurs more than once keeps its
first occurrence, by doc_id and place, and goes everywhere else.

Digests find candidates and bytes decide: chunks are grouped by digest and text, and a digest
under which two different texts meet removes nothing. Grouping combines copies before the
shuffle, so a chunk that a third of all documents share is one row per task.

Chunks alone miss most short passages: one whose lines are cut together with differing
neighbours has no chunk of its own. With `whole`, as the query and the pipeline ask for, every
two lines in a row are compared too, beside the chunks. A repeated run of two lines or more is
then covered from its first line to its last, wherever it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Lines in the rolling hash, and the mean number of lines in a chunk (a power of two).
WINDOW, MEAN_LINES = 2, 4
MIN_LINES = 2
#: Where rows without a doc_id rank: after all others.
LAST = (1 << 63) - 1


def _rotate(h: Column, by: int) -> Column:
    return F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h


def rolling(hashes: Column, i: Column) -> Column:
    """The cyclic polynomial over the hashes of lines i - WINDOW + 1 to i."""
    out = F.get(hashes, i)
    for k in range(1, WINDOW):
        out = out.bitwiseXOR(F.coalesce(_rotate(F.get(hashes, i - k), k), F.lit(0).cast("long")))
    return out


def chunk_bounds(lines: Column, hashes: Column) -> Column:
    """struct(start, stop) of the chunks of MIN_LINES lines or more; the lines after the last boundary are a chunk too."""
    n = F.size(lines)
    ends = F.filter(F.sequence(F.lit(1), n), lambda e: (e == n) | (rolling(hashes, e - 1).bitwiseAND(F.lit(MEAN_LINES - 1)) == 0))
    starts = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, F.lit(0))))
    chunks = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("stop")))
    return F.filter(chunks, lambda c: c["stop"] - c["start"] >= MIN_LINES)


def _hashed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, _th, _lines and _hashes of the texts of more than one line."""
    lines = docs.filter(F.contains("text", F.lit("\n"))).select("doc_id", F.xxhash64("text").alias("_th"), F.split("text", "\n").alias("_lines"))
    return lines.withColumn("_hashes", F.transform("_lines", lambda x: F.xxhash64(x)))


def _place(start: Column) -> Column:
    place = F.coalesce("doc_id", F.lit(LAST)).cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(12,0)") + start
    return place.cast("decimal(32,0)").alias("_place")


def chunks(docs: DataFrame) -> DataFrame:
    """doc_id, _th, _place (rank of doc_id and start, in one number), start, stop, chunk, digest and n_bytes of each chunk."""
    cut = _hashed_lines(docs).select("doc_id", "_th", "_lines", F.explode(chunk_bounds(F.col("_lines"), F.col("_hashes"))).alias("_c"))
    rows = cut.select("doc_id", "_th", _place(F.col("_c.start")), "_c.start", "_c.stop", F.array_join(F.slice("_lines", F.col("_c.start") + 1, F.col("_c.stop") - F.col("_c.start")), "\n").alias("chunk"))
    return rows.withColumn("digest", F.xxhash64("chunk")).withColumn("n_bytes", F.octet_length("chunk"))


def repeated_chunks(every: DataFrame) -> DataFrame:
    """digest, n_bytes and _first (the place to keep) of the chunks that occur more than once, equal in all bytes."""
    texts = every.groupBy("digest", "n_bytes", "chunk").agg(F.count("*").alias("n"), F.min("_place").alias("_first"))
    digests = texts.groupBy("digest", "n_bytes").agg(F.count("*").alias("texts"), F.sum("n").alias("n"), F.min("_first").alias("_first"))
    return digests.filter((F.col("n") > 1) & (F.col("texts") == 1)).select("digest", "n_bytes", "_first")


def later_chunks(docs: DataFrame) -> DataFrame:
    """doc_id, _th, start and stop of the chunks that occur earlier."""
    every = chunks(docs)
    repeated = materialize(repeated_chunks(every), "repeated-chunks")
    later = every.select("doc_id", "_th", "_place", "start", "stop", "digest", "n_bytes").join(repeated, ["digest", "n_bytes"]).filter("_place != _first")
    return later.select("doc_id", "_th", "start", "stop")


def removals(docs: DataFrame) -> DataFrame:
    """doc_id, _th and _gone, the ordered array of struct(start, stop), of the documents that lose chunks."""
    return later_chunks(docs).groupBy("doc_id", "_th").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("_gone"))


def ambiguous(lines: DataFrame) -> DataFrame:
    """h of the lines (h, line) under which two different lines meet."""
    return lines.groupBy("h", "line").agg(F.lit(1).alias("one")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")


def _ranges(starts: Column) -> Column:
    """The ordered struct(start, stop) of the lines that the pairs of lines at starts (ordered) cover; pairs that touch are one range."""
    first = F.filter(starts, lambda x, k: (k == 0) | (x - F.get(starts, k - 1) > MIN_LINES))
    last = F.filter(starts, lambda x, k: (k == F.size(starts) - 1) | (F.get(starts, k + 1) - x > MIN_LINES))
    return F.zip_with(first, last, lambda a, b: F.struct(a.alias("start"), (b + MIN_LINES).alias("stop")))


def run_removals(docs: DataFrame) -> DataFrame:
    """removals() with every run of two lines or more beside the chunks, whose pairs of lines all occur earlier.

    Pairs are compared by their lines' hashes; lines are compared in bytes, once for each
    distinct line, and a pair with a hash that two lines share removes nothing. A pair that
    overlaps its own first occurrence (three equal lines) isn't a second one.
    """
    hashed = _hashed_lines(docs)
    pairs = F.transform(F.sequence(F.lit(0), F.size("_hashes") - 2), lambda i: F.struct(i.alias("start"), F.get("_hashes", i).alias("h"), F.get("_hashes", i + 1).alias("h2")))
    every = hashed.select("doc_id", "_th", F.explode(pairs).alias("_p")).select("doc_id", "_th", "_p.*", _place(F.col("_p.start")))
    lines = hashed.select(F.explode(F.arrays_zip(F.col("_hashes").alias("h"), F.col("_lines").alias("line"))).alias("_l")).select("_l.h", "_l.line")
    unsure = materialize(ambiguous(lines), "ambiguous")
    twice = every.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min("_place").alias("_first")).filter("n > 1").drop("n")
    sure = twice.join(unsure, "h", "left_anti").join(unsure.withColumnRenamed("h", "h2"), "h2", "left_anti")
    repeated = materialize(sure, "repeated")
    later = every.join(repeated, ["h", "h2"]).filter("_place != _first AND NOT (h = h2 AND _place = _first + 1)")
    cut = later_chunks(docs).select("doc_id", "_th", F.explode(F.sequence(F.col("start"), F.col("stop") - MIN_LINES)).alias("start"))
    both = cut.unionByName(later.select("doc_id", "_th", "start"))
    return both.groupBy("doc_id", "_th").agg(_ranges(F.sort_array(F.collect_set("start"))).alias("_gone"))


def kept_text(text: Column, gone: Column) -> Column:
    """The lines of text outside the ordered, disjoint ranges of gone."""
    lines, m = F.split(text, "\n"), F.size(gone)
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["stop"]))
    stops = F.concat(F.transform(gone, lambda g: g["start"]), F.array(F.size(lines)))
    between = F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, b - a))
    return F.when(m > 0, F.array_join(F.flatten(between), "\n")).otherwise(text)


def dedup_lines(docs: DataFrame, whole: bool = False) -> DataFrame:
    """All rows and columns of docs with the repeated chunks taken out of text, and _gone, the line ranges taken (empty if none).

    A document may end up with an empty text; none is dropped. A null or empty text, and one
    of a single line, has no chunks. Rows alike in doc_id and text count as one document and
    are treated alike; rows without a doc_id rank last, and where only such rows share a chunk
    at the same place all keep it. Other columns pass through, whatever their names.
    """
    gone = (run_removals if whole else removals)(docs.select("doc_id", "text"))
    left = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"))
    joined = left.join(gone.hint("shuffle_hash"), left["_id"].eqNullSafe(gone["doc_id"]) & (left["_h"] == gone["_th"]), "left")
    ranges = F.coalesce(gone["_gone"], F.array().cast("array<struct<start:int,stop:int>>"))
    return joined.select(left["_doc"], kept_text(left["_doc"]["text"], ranges).alias("_kept"), ranges.alias("_gone"))


def clean_documents(docs: DataFrame, whole: bool = False) -> DataFrame:
    """docs with their own columns, text without repeated chunks, and n_chars, if there is one, of that text."""
    columns = [F.col("_kept").alias(c) if c == "text" else F.col("_new_chars").alias(c) if c == "n_chars" else F.col("_doc")[c].alias(c) for c in docs.columns]
    rows = dedup_lines(docs, whole)
    chars = F.when(F.size("_gone") > 0, F.length("_kept").cast("long")).otherwise(F.col("_doc")["n_chars"] if "n_chars" in docs.columns else F.lit(None))
    return rows.withColumn("_new_chars", chars).select(*columns)


def line_dedup(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id, text (what is kept), n_chunks (with whole, runs) and n_lines removed, and removed, their line ranges as start:stop in the original, comma-joined."""
    width = F.aggregate("_gone", F.lit(0).cast("long"), lambda a, g: a + (g["stop"] - g["start"]))
    spans = F.array_join(F.transform("_gone", lambda g: F.concat_ws(":", g["start"].cast("string"), g["stop"].cast("string"))), ",")
    return dedup_lines(docs, whole).select(F.col("_doc.doc_id").alias("doc_id"), F.col("_kept").alias("text"), F.size("_gone").cast("long").alias("n_chunks"), width.alias("n_lines"), spans.alias("removed"))
