"""Deduplication by hashing normalised units of text: lines (paragraphs), and runs of sentences in them.

Every unit's digest is grouped over all documents; the occurrence of the earliest-ranked
document (least doc_id, then first in it) stays and all others go. A line goes by itself. A
sentence goes only in a run of repeated sentences that is as long as a passage: passages aren't
always set on lines of their own, but a single sentence is too short to be one. Only digests
and ids are shuffled for the grouping; each document's text moves once, to its own removals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Words that a line must have to go by itself, and a run of sentences to go, unless told otherwise: every line with a word, and passages.
LINE_WORDS, RUN_WORDS = 1, 25
LAST = (1 << 63) - 1
_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def units(text: str, line_words: int = LINE_WORDS) -> Iterator[tuple[int, int, str, int]]:
    """start, stop, normal form (lower case, single spaces) and, of a sentence, number of words (0 for a line) of each unit.

    Lines of line_words words or more come with their line break. One of several sentences gives
    them too, after itself, each up to where the next one starts.
    """
    at = 0
    for line in _LINE.findall(text):
        words = line.lower().split()
        if len(words) >= max(1, line_words):
            yield at, at + len(line), " ".join(words), 0
            cuts = [m.end() for m in _SENTENCE_END.finditer(line)]
            if cuts and cuts[-1] == len(line):
                cuts.pop()
            if cuts:
                for a, b in zip([0, *cuts], [*cuts, len(line)], strict=True):
                    words = line[a:b].lower().split()
                    yield at + a, at + b, " ".join(words), len(words)
        at += len(line)


def digest(form: str) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(form)
    return d >> 64, d & 0xFFFFFFFFFFFFFFFF


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """docs with ord (doc_id, or the last rank) and row, a hash of the text: what a row's removals are keyed by, so that no id, and no lack of one, gathers many rows."""
    return docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("ord"), F.xxhash64("text").alias("row"), "text", *more)


def unit_table(docs: DataFrame, line_words: int = LINE_WORDS) -> DataFrame:
    """ord, row, h1 and h2 of each different unit of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests = [], []
            for text in batch.column(2):
                got = {digest(form) for _, _, form, _ in units(text.as_py() or "", line_words)}
                sizes.append(len(got))
                digests += got
            h = np.array(digests, np.uint64).reshape(-1, 2).view(np.int64)
            repeat = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(repeat), batch.column(1).take(repeat), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["ord", "row", "h1", "h2"])

    return _keyed(docs).mapInArrow(run, "ord long, row long, h1 long, h2 long")


def removals(docs: DataFrame, line_words: int = LINE_WORDS) -> DataFrame:
    """ord, row and gone, the first halves of the digests of the row's units that an earlier document has."""
    every = unit_table(docs, line_words)
    shared = every.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("ord").alias("first")).filter("n > 1").select("h1", "h2", "first")
    shared = materialize(shared, "units")
    return every.join(shared, ["h1", "h2"]).filter("ord != first").groupBy("ord", "row").agg(F.collect_set("h1").alias("gone"))


def cut(text: str, gone: set[int], line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """The spans to remove, merged and in order: of lines and long runs of sentences that are in gone, or that the text itself has had before."""
    spans: list[tuple[int, int]] = []
    seen: dict[int, int] = {}
    run: list[int] = []  # start, stop and words of the sentences that go on from one another
    for a, b, form, words in units(text, line_words):
        h = digest(form)[0]
        repeated = h in gone or seen.setdefault(h, a) != a
        if repeated and words == 0:
            spans.append((a, b))
        elif repeated:
            run = [run[0], b, run[2] + words] if run and run[1] == a else [a, b, words]
            if run[2] >= run_words:
                spans.append((run[0], b))
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged


def dedup_units(docs: DataFrame, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> DataFrame:
    """doc_id, text (what is kept), n_removed (spans), removed and kept (spans of the original text, in code points, as start:stop).

    A line of fewer words than line_words stays, as do its sentences; by default every line with a word
    may go, headings and closings too. Sentences go in repeated runs of run_words words or more together.
    The text is the kept spans, joined. Every row comes back, with an empty text if all of it
    was seen before, and with a null text if that was null. Rows that share a doc_id rank alike
    and keep what only they share; so do rows without one, which rank last. Of a unit that one
    text holds twice the first place stays. A very long text is worked on whole, in one task.
    No documents give no rows; other columns are ignored, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        show = lambda spans: ",".join(f"{a}:{b}" for a, b in spans)
        for batch in batches:
            out = []
            for doc, text, gone in zip(*batch.columns, strict=True):
                body = text.as_py()
                spans = cut(body or "", {h & 0xFFFFFFFFFFFFFFFF for h in gone.as_py() or ()}, line_words, run_words)
                edges = [0, *(x for s in spans for x in s), len(body or "")]
                kept = [(a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
                out.append((doc.as_py(), body if body is None else "".join(body[a:b] for a, b in kept), len(spans), show(spans), show(kept)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            cols = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "text", "n_removed", "removed", "kept"])

    joined = _keyed(docs, "doc_id").join(removals(docs, line_words).hint("shuffle_hash"), ["ord", "row"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(run, "doc_id long, text string, n_removed long, removed string, kept string")
