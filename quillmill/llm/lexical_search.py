"""Ranked lexical search: a join of documents and items over shared terms, seeded with thresholds.

Every item asks for its k best documents. A posting, a term in a document, has an impact: what it
adds to a score. The search

1. stores, for each term, its k highest impacts and whose they are. The k-th alone is a lower bound
   of the k-th score of each item that holds the term;
2. scores those documents in full: the k-th best of them for an item is a better bound;
3. orders an item's terms by their highest impact and adds these up from the least: the terms whose
   sum stays below the bound can't lift a document into the k best by themselves, so documents are
   joined by the other terms alone;
4. drops a joined pair whose score over those terms, with the sum of the rest, stays below the bound;
5. scores the others over all terms and ranks them. Scores equal to a bound stay in throughout.

Steps 2 and 3 to 5 are the same join, over the documents of step 1 and over all. Documents are cut
into terms once for a block of items, and only terms of items are kept of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .simhash import _LOWER

#: Items of a block, which goes to all tasks: so many rows and bytes of text at most, or one item.
ITEM_ROWS, ITEM_BYTES = 4096, 8 << 20
#: Pairs of a document and an item, and postings times their items, that are worked on together.
CELLS, EXPANDED = 1 << 20, 1 << 21
#: Rows of the best so far that a task holds before it cuts them back.
HELD = 1 << 17
_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text: str | None) -> list[str]:
    """Runs of ASCII letters and digits and of all other characters beyond ASCII; A-Z become a-z."""
    if not text:
        return []
    return _TERM.findall(text.lower() if text.isascii() else text.translate(_LOWER))


def blocks(items: DataFrame, rows: int, size: int) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The different items (item_id, text) in blocks by hash, each as item_id and its different terms; items without a term are left out.

    There are twice as many blocks as the bounds ask for, so that one seldom exceeds them.
    """
    n, total = items.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = 1 if n <= rows and total <= size else 2 * max(math.ceil(n / rows), math.ceil(total / size))
    placed = items.withColumn("_part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))).dropDuplicates(["item_id", "text"])
    for part in range(parts):
        own = placed.filter(F.col("_part") == part).select("item_id", "text").collect()
        if found := [(r.item_id, ts) for r in own if (ts := sorted(set(terms_of(r.text))))]:
            yield found


def posting_table(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """row, doc_id, n (terms with repeats), terms (numbers of those in the vocabulary) and tfs of each row with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for x in batch.column(1):
                tokens = terms_of(x.as_py())
                counts = Counter(map(number, tokens))
                counts.pop(None, None)
                sizes.append(len(tokens))
                terms.append(list(counts.keys()))
                tfs.append(list(counts.values()))
            keep = pa.array([n > 0 for n in sizes], pa.bool_())
            lists = [pa.array(c, pa.list_(pa.int32())) for c in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "tfs"]).filter(keep)

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")
    return materialize(found.withColumn("row", F.monotonically_increasing_id()), "postings")


@dataclass
class Postings:
    """Postings of a batch: place of the document in it, term and impact."""

    at: np.ndarray
    term: np.ndarray
    impact: np.ndarray

    @classmethod
    def of(cls, batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int) -> Postings:
        """Impacts in whole numbers: w * (10^9 tf div (1000 tf + 20 m)), with m = 50 + 50 n N div L."""
        lists = batch.column("terms")
        at = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
        term = lists.flatten().to_numpy(zero_copy_only=False)
        tf = batch.column("tfs").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        m = 50 + (50 * batch.column("n").to_numpy(zero_copy_only=False) * n_docs) // n_terms
        return cls(at, term, weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[at])))


def best_postings(table: DataFrame, k: int, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """term, impact and row of the k highest impacts over 0 of each term; each task sends no more than its own."""

    def cut(kept: list[np.ndarray]) -> list[np.ndarray]:
        order = np.lexsort((kept[2], -kept[1], kept[0]))
        kept = [c[order] for c in kept]
        starts = np.flatnonzero(np.diff(kept[0], prepend=-1))
        rank = np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order)))
        return [c[rank < k] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        for batch in batches:
            p = Postings.of(batch, weights, n_docs, n_terms)
            rows, some = batch.column("row").to_numpy(zero_copy_only=False), p.impact > 0
            kept = cut([np.concatenate(c) for c in zip(kept, [p.term[some].astype(np.int64), p.impact[some], rows[p.at[some]]], strict=True)])
        yield pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), *map(pa.array, kept[1:])], names=["term", "impact", "row"])

    own = table.select("row", "n", "terms", "tfs").mapInArrow(run, "term int, impact long, row long")
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("impact"), "row")))
    return materialize(ranked.filter(F.col("_rank") <= k).drop("_rank"), "best-postings")


@dataclass
class Plan:
    """What the join needs of a block: items of each term, thresholds, and which terms join."""

    items: list[list[int]]
    weights: np.ndarray
    most: np.ndarray
    n_docs: int
    n_terms: int
    k: int
    bound: np.ndarray
    rest: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        """Terms of an item that join it are those from where the sum of the highest impacts, from the least on, reaches its bound."""
        self.rest = np.zeros(len(self.items), np.int64)
        joining = []
        for i, terms in enumerate(self.items):
            own = np.array(terms)[np.argsort(self.most[terms], kind="stable")]
            sums = np.cumsum(self.most[own])
            cut = int(np.searchsorted(sums, self.bound[i], "left"))
            self.rest[i] = sums[cut - 1] if cut else 0
            joining.append(own[cut:].tolist())
        self.joining, self.every = self._by_term(joining), self._by_term(self.items)

    def _by_term(self, items: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Where each term's items start in the list of items by term, and that list."""
        term = np.array([t for ts in items for t in ts], np.int64)
        item = np.array([i for i, ts in enumerate(items) for _ in ts], np.int64)
        order = np.argsort(term, kind="stable")
        return np.searchsorted(term[order], np.arange(len(self.weights) + 1)), item[order]

    def scores(self, p: Postings, n: int, by_term: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Sums of impacts for each of the n documents (rows) and items (columns)."""
        out = np.zeros(n * len(self.items), np.int64)
        starts, item = by_term
        found = starts[p.term + 1] - starts[p.term]
        ends = np.cumsum(found)
        lo = 0
        while lo < len(found):  # postings whose items are at most EXPANDED, or one posting
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + EXPANDED, "right")))
            f = found[lo:hi]
            of = np.arange(f.sum()) + np.repeat(starts[p.term[lo:hi]] - (np.cumsum(f) - f), f)
            np.add.at(out, np.repeat(p.at[lo:hi], f) * len(self.items) + item[of], np.repeat(p.impact[lo:hi], f))
            lo = hi
        return out.reshape(n, -1)

    def matches(self, batch: pa.RecordBatch, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in the batch, items and exact scores of the pairs that reach the item's bound."""
        out = []
        step = max(1, CELLS // len(self.items))
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            p = Postings.of(part, self.weights, self.n_docs, self.n_terms)
            partial = self.scores(p, part.num_rows, self.joining)
            at, item = np.nonzero((partial > 0) & (partial + self.rest >= bound))
            if len(at):
                docs, place = np.unique(at, return_inverse=True)
                here = np.isin(p.at, docs)
                full = self.scores(Postings(np.searchsorted(docs, p.at[here]), p.term[here], p.impact[here]), len(docs), self.every)
                score = full[place, item]
                ok = score >= bound[item]
                out.append((start + at[ok], item[ok], score[ok]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def joined(table: DataFrame, plan: Plan) -> DataFrame:
    """item, rank, doc_id and score of the k best documents of the table for each item, among those that reach its bound.

    A task sends at most k rows for each item, and once it holds k of an item's, their least score is its bound there.
    """
    shared = table.sparkSession.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        bound, kept = plan.bound.copy(), [np.empty(0, np.int64)] * 5

        def cut(kept: list[np.ndarray]) -> list[np.ndarray]:
            item, less, null, doc, row = kept
            kept = [c[np.lexsort((row, doc, null, less, item))] for c in kept]
            starts = np.flatnonzero(np.diff(kept[0], prepend=-1))
            rank = np.arange(len(kept[0])) - np.repeat(starts, np.diff(starts, append=len(kept[0])))
            full = rank == plan.k - 1
            bound[kept[0][full]] = np.maximum(bound[kept[0][full]], -kept[1][full])
            return [c[rank < plan.k] for c in kept]

        for batch in batches:
            at, item, score = plan.matches(batch, bound)
            doc = batch.column("doc_id")
            new = [item, -score, doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64)[at], doc.fill_null(0).to_numpy(zero_copy_only=False)[at], batch.column("row").to_numpy(zero_copy_only=False)[at]]
            kept = [np.concatenate(c) for c in zip(kept, new, strict=True)]
            if len(kept[0]) > HELD:
                kept = cut(kept)
        item, less, null, doc, row = cut(kept)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64(), mask=null > 0), pa.array(row), pa.array(-less)], names=["item", "doc_id", "row", "score"])

    found = table.select("row", "doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, row long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= plan.k).select("item", "rank", "doc_id", "score")


def search_block(docs: DataFrame, items: list[tuple[int | None, list[str]]], k: int) -> DataFrame | None:
    """item_id, rank, doc_id and score for the items of one block; none if no document has a term."""
    spark = docs.sparkSession
    vocabulary = {t: n for n, t in enumerate(sorted({t for _, ts in items for t in ts}))}
    table = posting_table(docs, vocabulary)
    n_docs, n_terms = table.select(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not n_docs:
        return None
    held = table.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    weights = np.zeros(len(vocabulary), np.int64)
    for t, df in zip(held.column("term").to_pylist(), held.column("count").to_pylist(), strict=True):
        weights[t] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))
    best = best_postings(table, k, weights, n_docs, n_terms)
    by_term = best.groupBy("term").agg(F.max("impact").alias("most"), F.min("impact").alias("least"), F.count("*").alias("n")).toArrow().to_pydict()
    most, kth = np.zeros(len(vocabulary), np.int64), np.zeros(len(vocabulary), np.int64)
    most[by_term["term"]] = by_term["most"]
    kth[by_term["term"]] = [least if n == k else 0 for least, n in zip(by_term["least"], by_term["n"], strict=True)]
    numbers = [[vocabulary[t] for t in ts] for _, ts in items]

    def plan(bound: np.ndarray) -> Plan:
        return Plan(numbers, weights, most, n_docs, n_terms, k, np.maximum(bound, 1))

    bound = np.array([kth[ts].max() for ts in numbers])
    seeds = table.join(best.select("row").distinct(), "row", "left_semi")
    for r in joined(seeds, plan(bound)).filter(F.col("rank") == k).select("item", "score").collect():
        bound[r.item] = max(bound[r.item], r.score)
    found = materialize(joined(table, plan(bound)), "ranked")
    for done in (table, best):
        discard(done)
    named = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(items)], "item int, item_id long")
    return found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, rows: int = ITEM_ROWS, size: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k documents with the highest scores above 0 for each item (item_id, text), equal scores by doc_id.

    Each row of docs is a document, so repeated rows are ranked one after another; a null doc_id comes
    last among equals. A null text, or one without a term, is no document and matches nothing. Equal
    rows of items are one item, and an id with several texts has a ranking for each; an item without a
    term, or none of whose terms is in a document, has no row. Very long texts are cut into terms whole.
    Items beyond a block's bounds are searched a block at a time, each with a pass over docs. Empty
    tables give no rows; other columns are ignored, whatever their names.
    """
    found = [b for own in blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), rows, size) if (b := search_block(docs, own, k)) is not None]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
