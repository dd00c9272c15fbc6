"""Names of a dictionary in running text: of one word or several, in any case, leftmost and longest first.

Text and names are runs of letters and digits in lower case. A dictionary under NAME_BYTES goes to all
tasks as an automaton over words, which finds names in one pass over a sentence, whatever the number of names. A larger one stays where it is: a name is a row, keyed by that of
its words which the text has least often, so that a sentence meets a name only over that word.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quillmill.storage import materialize

WORD, BETWEEN = r"[\p{L}\p{N}]+", r"[^\p{L}\p{N}]+"
#: Bytes of all names together up to which they go to all tasks.
NAME_BYTES = 16 << 20


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


class Automaton:
    """Names as a tree of words: where a word leads from each beginning of a name, and the name that a beginning is, if any.

    A word that begins no name costs one look-up. Names are taken from the left, the longest at a
    place, so after a name the search goes on behind it, and no place is read further than the longest name.
    """

    def __init__(self, names: list[list[str]]) -> None:
        self.next: list[dict[str, int]] = [{}]  # flat, as a nested tree of a name of very many words can't be pickled
        self.name: list[tuple[int, str] | None] = [None]
        for words_ in names:
            at = 0
            for w in words_:
                if w not in self.next[at]:
                    self.next[at][w] = len(self.next)
                    self.next.append({})
                    self.name.append(None)
                at = self.next[at][w]
            self.name[at] = (len(words_), " ".join(words_))

    def found(self, tokens: list[str]) -> Iterator[tuple[int, tuple[int, str]]]:
        """Place, number of words and text of each name."""
        start, leads, name, end = self.next[0], self.next, self.name, len(tokens)
        free = 0
        for i, w in enumerate(tokens):
            if w in start and i >= free:
                best, at, k = None, start[w], i + 1
                while True:
                    best = name[at] or best
                    if k == end or (at := leads[at].get(tokens[k])) is None:
                        break
                    k += 1
                if best:
                    yield i, best
                    free = i + best[0]

    def matches(self, tokens: list[str]) -> list[tuple[int, int]]:
        """Place and number of words of each name, from the left, the longest at a place, none over another."""
        return [(at, n) for at, (n, _) in self.found(tokens)]


def _share(names: DataFrame) -> Broadcast:
    return names.sparkSession.sparkContext.broadcast(Automaton([r[0] for r in names.collect()]))  # of a size that was checked


def _automaton_matches(rows: DataFrame, names: DataFrame) -> DataFrame:
    shared = _share(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            at, starts, found = [], [], []
            for k, tokens in enumerate(batch.column("_words").to_pylist()):
                for start, (_, name) in automaton.found(tokens or []):
                    at.append(k)
                    starts.append(start)
                    found.append(name)
            yield pa.RecordBatch.from_arrays([batch.column("_row").take(pa.array(at, pa.int64())), pa.array(starts, pa.int32()), pa.array(found, pa.string())], names=["_row", "start", "name"])

    return rows.select("_row", "_words").mapInArrow(run, "_row long, start int, name string")


def _joined_matches(rows: DataFrame, names: DataFrame) -> DataFrame:
    placed = rows.select("_row", F.posexplode("_words").alias("pos", "word"))
    parts = names.select("_name", F.posexplode("_name").alias("offset", "word"))
    often = placed.groupBy("word").agg(F.count("*").alias("n")).join(parts.select("word").distinct(), "word")
    keyed = parts.join(often, "word").groupBy("_name").agg(F.count_distinct("word").alias("held"), F.min_by(F.struct("word", "offset"), F.struct("n", "word", "offset")).alias("k"))
    keyed = keyed.filter(F.col("held") == F.size(F.array_distinct("_name"))).select("_name", "k.word", "k.offset")  # a word that no text has: no match
    met = placed.join(keyed, "word").select("_row", (F.col("pos") - F.col("offset")).alias("start"), "_name").filter("start >= 0")
    hits = met.join(rows.select("_row", "_words"), "_row").filter(F.slice("_words", F.col("start") + 1, F.size("_name")) == F.col("_name"))
    order = F.sort_array(F.collect_list(F.struct("start", (-F.size("_name")).alias("less"), "_name")))
    none = F.array().cast("array<struct<start:int,less:int,_name:array<string>>>")
    free = lambda kept: F.coalesce(F.element_at(kept, -1)["start"] - F.element_at(kept, -1)["less"], F.lit(0))
    kept = F.aggregate(order, none, lambda a, m: F.when((F.size(a) == 0) | (m["start"] >= free(F.when(F.size(a) > 0, a))), F.concat(a, F.array(m))).otherwise(a))
    return hits.groupBy("_row").agg(kept.alias("m")).select("_row", F.explode("m").alias("m")).select("_row", "m.start", F.array_join("m._name", " ").alias("name"))


def _known(names: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """The names as arrays of words, stored, and whether all of them are small enough for every task."""
    known = materialize(names.select(words(F.col("name")).alias("_name")).filter(F.size("_name") > 0).distinct(), "names")
    total = known.agg(F.coalesce(F.sum(F.octet_length(F.array_join("_name", " ")) + 1), F.lit(0))).first()[0]
    return known, total <= most


def matches(sentences: DataFrame, names: DataFrame, text: str = "sentence", most: int = NAME_BYTES) -> DataFrame:
    """sentences with start (in words, from 0) and name (its words, lower-cased, joined by spaces) of each name of names (name) in them.

    Names with the same words are one; a name without a word is none. A null or empty sentence has no
    names. Sentences without a name give no row.
    """
    known, small = _known(names, most)
    rows = materialize(sentences.withColumns({"_words": words(F.col(text)), "_row": F.monotonically_increasing_id()}), "sentences")
    found = (_automaton_matches if small else _joined_matches)(rows, known)
    return rows.drop("_words").join(found, "_row").drop("_row")


def counts(sentences: DataFrame, names: DataFrame, key: str, text: str = "sentence", most: int = NAME_BYTES) -> DataFrame:
    """key, name and n: how often matches() finds each name in the sentences of a key (a column of sentences).

    With names for every task a sentence goes there as its words with blanks between, and nothing of it comes
    back but a batch's counts; no sentence is stored or joined.
    """
    known, small = _known(names, most)
    if not small:
        return matches(sentences.select(key, text), names, text, most).groupBy(key, "name").agg(F.count("*").alias("n"))
    shared = _share(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            n: Counter = Counter()
            for k, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n.update((k, name) for _, (_, name) in automaton.found((line or "").split()))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in n], batch.schema.field(0).type), pa.array([x for _, x in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=[key, "name", "n"])

    rows = sentences.select(key, F.regexp_replace(F.lower(text), BETWEEN, " ").alias("_words"))
    schema = StructType([rows.schema[key], StructField("name", StringType()), StructField("n", LongType())])
    return rows.mapInArrow(run, schema).groupBy(key, "name").agg(F.sum("n").alias("n"))
