"""Benchmark decontamination: MinHash containment search partitioned by size, verified exactly.

An item is a short text that may lie inside a long document, where plain MinHash sees next to
no similarity. So items are partitioned by the size of their shingle set, in powers of two,
and for each size the document's shingles are cut into blocks of that size: a block that holds
an item's shingles is hardly larger than the item, and similar to it. An item is a candidate
for a document if they agree in one of HASHES minima in some block. Each candidate is then
verified: the share of the item's shingles that occur anywhere in the document, compared as
words and not as hashes, must reach the threshold.

A minimum of the item is in a document that holds 0.8 of its shingles with chance 0.8, and is
then least in its block of at most twice as many shingles with chance 1/3 or more, so a pair
at the threshold is missed with a chance of (1 - 0.8 / 3) ** 48, under one in a million.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

WIDTH, THRESHOLD, HASHES = 5, 0.8, 48
#: Items of at most so many rows and bytes of text go out to all tasks; more are joined.
ITEM_ROWS, ITEM_BYTES = 4096, 8 << 20
#: Shingles that are worked on together, and words whose hashes are kept.
CHUNK, CACHE = 200_000, 1_000_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def normal(token: str) -> str:
    """Lower case without what is neither letter nor digit at either end."""
    return _EDGE.sub("", token.lower())


def normal_words(text: str | None) -> list[str]:
    return [w for w in map(normal, (text or "").split()) if w]


class WordHashes(dict):
    """Hash of a token's normal form, 0 if nothing is left of it."""

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        form = normal(token)
        self[token] = h = (xxhash.xxh64_intdigest(form, 1) or 1) if form else 0
        return h

    def of(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        h = np.fromiter(map(self.__getitem__, tokens), np.uint64, len(tokens))
        return h[h != 0]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    if len(words) < width:
        return np.empty(0, np.uint64)
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        h = words[:n].copy()
        for j in range(1, width):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def multipliers(hashes: int) -> np.ndarray:
    """Odd factors; each makes another order of the hashed shingles."""
    return np.array([xxhash.xxh64_intdigest(str(k), 7) | 1 for k in range(hashes)], np.uint64)


@dataclass
class Item:
    item_id: int | None
    width: int
    shingles: frozenset


def shingles_of(words: list[str], width: int) -> frozenset:
    return frozenset(" ".join(words[i : i + width]) for i in range(len(words) - width + 1))


def items_of(rows: list[tuple]) -> list[Item]:
    """An item of fewer words than WIDTH is one shingle of them all; one without a word has none and matches nothing."""
    out = []
    for item_id, text in rows:
        if words := normal_words(text):
            width = min(WIDTH, len(words))
            out.append(Item(item_id, width, shingles_of(words, width)))
    return out


class Index:
    """The items' minima: by shingle width, size class and hash function, value to items."""

    def __init__(self, items: list[Item], hashes: int = HASHES) -> None:
        self.items, self.factors = items, multipliers(hashes)
        words = WordHashes()
        self.classes: dict[int, dict[int, list[dict[int, list[int]]]]] = {}
        for at, item in enumerate(items):
            own = np.concatenate([shingle_hashes(words.of(s), item.width) for s in item.shingles])
            size = 1 << (len(own) - 1).bit_length()
            tables = self.classes.setdefault(item.width, {}).setdefault(size, [defaultdict(list) for _ in self.factors])
            with np.errstate(over="ignore"):
                for k, a in enumerate(self.factors):
                    tables[k][int((own * a).min())].append(at)
        # whether any minimum of a size starts with these 16 bits, for each hash function
        self.starts = {w: {s: [self._bits(t) for t in ts] for s, ts in by.items()} for w, by in self.classes.items()}

    @staticmethod
    def _bits(table: dict[int, list[int]]) -> np.ndarray:
        bits = np.zeros(1 << 16, bool)
        bits[[v >> 48 for v in table]] = True
        return bits

    def candidates(self, docs: list[np.ndarray], width: int) -> set[tuple[int, int]]:
        """Pairs of document and item that agree in a minimum. docs: the shingle hashes of each document."""
        by_size = self.classes[width]
        lengths = np.array([len(d) for d in docs])
        if not lengths.sum():
            return set()
        flat = np.concatenate(docs)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        sizes = sorted(by_size)
        # where the blocks of each size start, and which document each is of
        plans, before = [], None
        for size in sizes:
            count = -(-lengths // size)
            owner = np.repeat(np.arange(len(docs)), count)
            local = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            if before is None:
                starts = first[owner] + local * size
            else:  # blocks of the next size are made of whole blocks of this one
                starts = before[1][owner] + local * (size // before[0])
            plans.append((size, owner, starts))
            before = (size, np.cumsum(count) - count)
        found = set()
        with np.errstate(over="ignore"):
            for k, a in enumerate(self.factors):
                least = flat * a
                for size, owner, starts in plans:
                    least = np.minimum.reduceat(least, starts)
                    for b in np.flatnonzero(self.starts[width][size][k][least >> np.uint64(48)]):
                        for item in by_size[size][k].get(int(least[b]), ()):
                            found.add((int(owner[b]), item))
        return found

    def matches(self, texts: list[str | None], words: WordHashes, threshold: float) -> Iterator[tuple[int, Item, int]]:
        """Document, item and number of the item's shingles in it, of the verified pairs."""
        hashed = [words.of(t) for t in texts]
        found = set()
        for width in self.classes:
            shingled = [shingle_hashes(h, width) for h in hashed]
            at = 0
            while at < len(texts):
                stop, total = at, 0
                while stop < len(texts) and (stop == at or total + len(shingled[stop]) <= CHUNK):
                    total += len(shingled[stop])
                    stop += 1
                found |= {(at + d, i) for d, i in self.candidates(shingled[at:stop], width)}
                at = stop
        by_doc = defaultdict(list)
        for d, i in found:
            by_doc[d].append(i)
        for d in sorted(by_doc):
            plain = normal_words(texts[d])
            sets = {w: shingles_of(plain, w) for w in {self.items[i].width for i in by_doc[d]}}
            for i in sorted(by_doc[d]):
                item = self.items[i]
                n = len(item.shingles & sets[item.width])
                if n >= threshold * len(item.shingles):
                    yield d, item, n


def keys_of(width: int, size: int, k: int, least: np.ndarray) -> np.ndarray:
    """One number for a minimum with the width, size and hash function that it is of."""
    with np.errstate(over="ignore"):
        h = (least ^ np.uint64(((width * 64 + size.bit_length()) * 64 + k) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(31))


class Marks:
    """A set of keys as two bits each in a table of 2 ** bits: nothing in it is missed, some others pass."""

    def __init__(self, bits: int, words: np.ndarray) -> None:
        self.bits, self.words = bits, words

    @staticmethod
    def slots(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return keys >> np.uint64(64 - bits), keys & np.uint64((1 << bits) - 1)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for s in self.slots(keys, self.bits):
            out &= (self.words[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1
        return out


def block_minima(shingles: np.ndarray, sizes: list[int], factors: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Size, hash function and the minima of a document's blocks of that size."""
    with np.errstate(over="ignore"):
        for k, a in enumerate(factors):
            least, last = shingles * a, 1
            for size in sizes:
                least = np.minimum.reduceat(least, np.arange(0, len(least), size // last))
                last = size
                yield size, k, least


def joined_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float, hashes: int = HASHES, most_bits: int = 30) -> DataFrame:
    """leaks() for a benchmark of any size: items and documents meet in joins.

    The items' minima go out as a bit table of at most 2 ** most_bits bits. One pass over the
    documents keeps those with a minimum that may be an item's, each once, with these minima;
    they are joined with the items' minima, and each candidate pair with both its texts.
    """
    spark = docs.sparkSession
    factors = multipliers(hashes)
    items = benchmark.groupBy("item_id", "text").agg(F.count("*").alias("times")).withColumn("item", F.monotonically_increasing_id())
    items = materialize(items, "items")

    def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = words.of(text.as_py())
                if len(own):
                    width = min(WIDTH, len(own))
                    own = np.unique(shingle_hashes(own, width))
                    size = 1 << (len(own) - 1).bit_length()
                    with np.errstate(over="ignore"):
                        out += [(item, width, size, int(keys_of(width, size, k, (own * a).min(keepdims=True)).view(np.int64)[0])) for k, a in enumerate(factors)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int64()], strict=True)], names=["item", "width", "size", "key"])

    known = materialize(items.select("item", "text").mapInArrow(minima, "item long, width int, size long, key long"), "item-minima")
    n = known.count()
    bits = min(most_bits, max(16, (16 * n).bit_length()))
    high, low = F.shiftrightunsigned("key", 64 - bits), F.col("key").bitwiseAND((1 << bits) - 1)
    slot = known.select(F.explode(F.array(high, low)).alias("slot"))
    words = slot.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sizes: dict[int, list[int]] = {}
    for r in known.select("width", "size").distinct().orderBy("width", "size").collect():  # at most WIDTH times the powers of two
        sizes.setdefault(r.width, []).append(r.size)
    shared = spark.sparkContext.broadcast(Marks(bits, table))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_words, marks = WordHashes(), shared.value
        for batch in batches:
            found = []
            for text in batch.column(1):
                hashed, keys = own_words.of(text.as_py()), [np.empty(0, np.uint64)]
                for width, of_width in sizes.items():
                    if len(shingles := shingle_hashes(hashed, width)):
                        for size, k, least in block_minima(shingles, of_width, factors):
                            got = keys_of(width, size, k, least)
                            keys.append(got[marks.of(got)])
                found.append(np.unique(np.concatenate(keys)).view(np.int64))
            keep = pa.array([len(f) > 0 for f in found])
            lists = pa.array(found, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "text", "keys"]).filter(keep)

    hits = docs.select("doc_id", "text").mapInArrow(search, "doc_id long, text string, keys array<long>").withColumn("doc", F.monotonically_increasing_id())
    hits = materialize(hits, "document-minima")
    pairs = hits.select("doc", F.explode("keys").alias("key")).join(known.select("item", "key"), "key").select("doc", "item").distinct()
    sides = pairs.join(hits.select("doc", "doc_id", F.col("text").alias("x")), "doc").join(items.withColumnRenamed("text", "y"), "item")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, x, item_id, y, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                item = items_of([(item_id, y)])[0]
                n = len(item.shingles & shingles_of(normal_words(x), item.width))
                if n >= threshold * len(item.shingles):
                    out += [(doc_id, item_id, len(item.shingles), n, n / len(item.shingles))] * times
            if out:
                yield _leak_batch(out)

    return sides.select("doc_id", "x", "item_id", "y", "times").mapInArrow(verify, LEAK_DDL)


LEAK_DDL = "doc_id long, item_id long, n_shingles long, n_matched long, containment double"


def _leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "n_shingles", "n_matched", "containment"])


def small_index(benchmark: DataFrame, rows: int = ITEM_ROWS, size: int = ITEM_BYTES) -> Broadcast | None:
    """An index over the items for all tasks, if they are at most so many rows and bytes of text; none comes to the driver otherwise."""
    n, total = benchmark.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n > rows or total > size:
        return None
    return benchmark.sparkSession.sparkContext.broadcast(Index(items_of([tuple(r) for r in benchmark.select("item_id", "text").collect()])))


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rows: int = ITEM_ROWS, size: int = ITEM_BYTES) -> DataFrame:
    """doc_id, item_id, n_shingles (of the item), n_matched and containment, for each pair of at least the threshold.

    Documents are read once, whatever the number of items: up to `rows` items and `size` bytes
    go to all tasks, more are joined. Words are lower-cased, stripped of marks at their ends and
    dropped if nothing is left. A null or empty text, on either side, matches nothing. Repeated
    rows of either table give repeated pairs. A very long text is searched whole, in one task.
    Empty tables give no rows; other columns are ignored, whatever their names.
    """
    docs, benchmark = docs.select("doc_id", "text"), benchmark.select("item_id", "text")
    index = small_index(benchmark, rows, size)
    if index is None:
        return joined_leaks(docs, benchmark, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            ids = batch.column(0)
            found = [(ids[d].as_py(), i.item_id, len(i.shingles), n, n / len(i.shingles)) for d, i, n in index.value.matches(batch.column(1).to_pylist(), words, threshold)]
            if found:
                yield _leak_batch(found)

    return docs.mapInArrow(run, LEAK_DDL)


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, rows: int = ITEM_ROWS, size: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that contain no item.

    Each row is judged by its own whole text, with or without a doc_id; a null or empty text, and
    a repeated row, stays or goes by that alone. A very long text is searched whole, in one task.
    Columns may have any names. Empty tables change nothing.
    """
    benchmark = benchmark.select("item_id", "text")
    index = small_index(benchmark, rows, size)
    if index is None:
        # rows get a number of their own, fixed by writing them, so that those without an id can be told apart
        named = materialize(docs.withColumn("_quillmill_row", F.monotonically_increasing_id()), "numbered")
        found = joined_leaks(named.select(F.col("_quillmill_row").alias("doc_id"), "text"), benchmark, threshold)
        return named.join(found.select(F.col("doc_id").alias("_quillmill_row")).distinct(), "_quillmill_row", "left_anti").select(docs.columns)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for d, _, _ in index.value.matches(batch.column(at).to_pylist(), words, threshold):
                keep[d] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
