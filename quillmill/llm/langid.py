"""Language identification by prediction by partial matching (PPM).

For each language a tree of byte contexts holds how often each byte followed the four, three,
two, one and none before it. A byte's code length is that of method C with exclusion: a context
that has seen the byte codes it by its count; one that hasn't codes an escape, by the number
of different bytes it has seen, and hands over to the next shorter one, which leaves out what
the longer has ruled out; below the shortest all remaining bytes are alike.

Statistics are frozen after learning. What a context has seen its suffix has seen too, so what
is left out of a suffix depends on the one context above it: the cost of an escape and of the
count that follows it are numbers of a node, worked out once, and an exact length is a sum of a
few of them. Nodes are kept sparsely, in hash tables over runs of bytes, for all byte values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: The longest context, in bytes.
ORDER = 4
#: Learning takes at most so many documents of each language, those with the least hash of doc_id, whole.
DOCS_PER_LANGUAGE = 400
UNDETERMINED = "und"
#: Bytes that are worked on together.
PIECE = 1 << 18
#: A character of one of Unicode's letter categories; numbers such as a half or a raised two are none.
_LETTER = regex.compile(r"\p{L}")
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def text_bytes(text: str) -> np.ndarray:
    """UTF-8 with A to Z in lower case, after spaces as the first byte's context."""
    return np.frombuffer(b" " * ORDER + text.encode("utf-8", "surrogatepass").translate(_FOLD), np.uint8)


def grams(b: np.ndarray) -> np.ndarray:
    """Each byte with the ORDER before it, as one number."""
    x = b.astype(np.int64)
    n = len(x) - ORDER
    out = x[:n].copy()
    for k in range(1, ORDER + 1):
        out = (out << 8) | x[k : k + n]
    return out


def suffix(codes: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of runs of bytes."""
    return codes & ((1 << (8 * n)) - 1)


class Places:
    """Where each of some different numbers stands in a sorted list; those not in it stand after its end."""

    def __init__(self, codes: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(codes)).bit_length())
        slot = self._slot(codes)
        self.order = np.argsort(slot, kind="stable").astype(np.int32)
        self.codes = np.append(codes[self.order], -1)
        self.start = np.searchsorted(slot[self.order], np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.longest = int(np.diff(self.start).max(initial=0))
        self.order = np.append(self.order, np.int32(len(codes)))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def of(self, codes: np.ndarray) -> np.ndarray:
        slot = self._slot(codes)
        at = self.start[slot]
        hit = self.codes[at] == codes  # an empty slot points at a run of another, which differs
        out = np.where(hit, self.order[at], len(self.codes) - 1)
        left = np.flatnonzero(~hit)
        for k in range(1, self.longest):
            left = left[at[left] + k < self.start[slot[left] + 1]]
            if not len(left):
                break
            here = self.codes[at[left] + k] == codes[left]
            out[left[here]] = self.order[at[left[here]] + k]
            left = left[~here]
        return out


def _log2(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log2(x)


@dataclass
class PPM:
    """languages in order, and for runs of n bytes that any of them has seen, by n: their places, and by language
    count (its logarithm, of the last byte after the others), and as a context: total and escape, of its own, and
    below and escape_below, of the next shorter context without what this one has seen. A last row stands for all other runs.
    """

    languages: list[str]
    places: list[Places | None] = field(default_factory=list)
    count: list[np.ndarray] = field(default_factory=list)
    total: list[np.ndarray] = field(default_factory=list)
    escape: list[np.ndarray] = field(default_factory=list)
    below: list[np.ndarray] = field(default_factory=list)
    escape_below: list[np.ndarray] = field(default_factory=list)
    rest: np.ndarray | None = None
    known: np.ndarray | None = None

    @classmethod
    def learn(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> PPM:
        """counts: for each language the runs of ORDER + 1 bytes, and how often each occurs."""
        m = cls(sorted(counts))
        if not m.languages:
            return m
        seen: list[np.ndarray] = [np.zeros((1, len(m.languages)))]  # by n: how often, by run and language
        codes_of: list[np.ndarray] = [np.zeros(1, np.int64)]
        for n in range(1, ORDER + 2):
            runs = [suffix(codes, n) for codes, _ in counts.values()]
            contexts = [suffix(codes >> 8, n) for codes, _ in counts.values()] if n <= ORDER else []
            codes_of.append(np.unique(np.concatenate([*runs, *contexts])))
            table = np.zeros((len(codes_of[n]), len(m.languages)))
            for k, lang in enumerate(m.languages):
                codes, times = counts[lang]
                np.add.at(table[:, k], np.searchsorted(codes_of[n], suffix(codes, n)), times)
            seen.append(table)
        totals, kinds = [], []
        for n in range(ORDER + 1):  # contexts of n bytes
            at = np.searchsorted(codes_of[n], codes_of[n + 1] >> 8)
            t, k = np.zeros_like(seen[n]), np.zeros_like(seen[n])
            np.add.at(t, at, seen[n + 1])
            np.add.at(k, at, seen[n + 1] > 0)
            totals.append(t)
            kinds.append(k)
        other = np.zeros((1, len(m.languages)))
        own_total = [_log2(np.where(t > 0, t + k, 1.0)) for t, k in zip(totals, kinds, strict=True)]
        own_escape = [np.where(t > 0, w - _log2(np.maximum(k, 1.0)), 0.0) for t, k, w in zip(totals, kinds, own_total, strict=True)]
        for n in range(ORDER + 2):
            m.places.append(Places(codes_of[n]) if n else None)
            m.count.append(np.append(_log2(seen[n]), other - np.inf, axis=0).astype(np.float32))
            if n > ORDER:
                break
            m.total.append(np.append(own_total[n], other, axis=0).astype(np.float32))
            m.escape.append(np.append(own_escape[n], other, axis=0).astype(np.float32))
            if n == 0:
                m.below.append(other.astype(np.float32))
                m.escape_below.append(other.astype(np.float32))
                continue
            up = np.searchsorted(codes_of[n - 1], suffix(codes_of[n], n - 1))
            # what the shorter context has of the bytes that this one has seen
            at = np.searchsorted(codes_of[n], codes_of[n + 1] >> 8)
            shorter = seen[n][np.searchsorted(codes_of[n], suffix(codes_of[n + 1], n))]
            out = np.zeros_like(totals[n])
            np.add.at(out, at, np.where(seen[n + 1] > 0, shorter, 0.0))
            t, k = totals[n - 1][up] - out, kinds[n - 1][up] - kinds[n]
            whole = _log2(np.where(t > 0, t + k, 1.0))
            m.below.append(np.append(whole, other, axis=0).astype(np.float32))
            m.escape_below.append(np.append(np.where(t > 0, whole - _log2(np.maximum(k, 1.0)), 0.0), other, axis=0).astype(np.float32))
        m.rest = _log2(np.maximum(256 - kinds[0][0], 1))
        every = codes_of[ORDER + 1]
        m.known = np.concatenate([m._lengths(every[lo : lo + PIECE]) for lo in range(0, len(every), PIECE)]).astype(np.float32)
        return m

    def _lengths(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run of ORDER + 1 bytes, by language."""
        out = np.zeros((len(codes), len(self.languages)))
        done = np.zeros(out.shape, bool)
        above = None
        for n in range(ORDER, -1, -1):
            run = self.places[n + 1].of(suffix(codes, n + 1))
            context = self.places[n].of(suffix(codes >> 8, n)) if n else np.zeros(len(codes), np.int64)
            total, escape = self.total[n][context], self.escape[n][context]
            if above is not None:
                there = (above < len(self.below[n + 1]) - 1)[:, None]
                total = np.where(there, self.below[n + 1][above], total)
                escape = np.where(there, self.escape_below[n + 1][above], escape)
            times = self.count[n + 1][run]
            hit = ~done & np.isfinite(times)
            out += np.where(done, 0.0, np.where(hit, total - np.where(hit, times, 0.0), escape))
            done |= hit
            above = context
        return np.where(done, out, out + self.rest)

    def lengths(self, text: str) -> np.ndarray:
        """Bits of the text under each language."""
        b = text_bytes(text)
        out = np.zeros(len(self.languages))
        for at in range(0, len(b) - ORDER, PIECE):
            codes = grams(b[at : at + PIECE + ORDER])
            place = self.places[ORDER + 1].of(codes)
            new = place == len(self.known)
            if new.any():
                out += self._lengths(codes[new]).sum(axis=0)
                place = place[~new]
            out += self.known[place].sum(axis=0, dtype=np.float64)
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language of the shortest code, the first of equals, and its share of probability among all."""
        if not text or not self.languages or not _LETTER.search(text):
            return UNDETERMINED, 0.0
        bits = self.lengths(text)
        best = int(bits.argmin())
        return self.languages[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum())


def held_out(doc_id) -> F.Column:
    """Whether crc32 of doc_id as text leaves 1 when divided by 3; a null doc_id is not held out, and not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, per_language: int = DOCS_PER_LANGUAGE) -> PPM:
    """A model of docs' text and lang, from documents not held out.

    Of each language the per_language ids with the least hash are chosen among its different
    ids; of several rows that share an id and language the least text counts, so that no more
    than per_language texts are learned however often an id is repeated. Their runs of bytes are
    counted where they are, and the counts come to the driver as Arrow: of at most per_language
    texts a language.
    """
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id"))
    # of a language's ids only the share with the least hashes that holds twice the wanted number is ranked
    ids = usable.select("lang", "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    sizes = materialize(ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("_n")), "languages")
    low = ids.join(sizes, "lang").filter(F.col("_h") / float(1 << 64) + 0.5 <= F.lit(2.0 * per_language) / F.col("_n")).select("lang", "doc_id", "_h").distinct()
    order = Window.partitionBy("lang").orderBy("_h", "doc_id")
    chosen = materialize(low.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= per_language).select("lang", "doc_id"), "learned")
    sample = docs.select("lang", "doc_id", "text").join(chosen, ["lang", "doc_id"], "left_semi").groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes, times = np.unique(grams(text_bytes(text.as_py() or "")), return_counts=True)
                for lo in range(0, len(codes), PIECE):
                    part = codes[lo : lo + PIECE]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array(part), pa.array(times[lo : lo + PIECE])], names=["lang", "code", "n"])

    got = sample.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = got.column("lang").combine_chunks().dictionary_encode() if len(got) else None
    if langs is None:
        # languages of which no chosen text has a byte are known, though nothing is known of them
        return PPM.learn({})
    langs = langs.combine_chunks() if isinstance(langs, pa.ChunkedArray) else langs
    which, codes, times = langs.indices.to_numpy(), got.column("code").to_numpy(), got.column("n").to_numpy()
    return PPM.learn({lang: (codes[which == k], times[which == k]) for k, lang in enumerate(langs.dictionary.to_pylist())})


def identify(docs: DataFrame, model: PPM | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score (0 to 1) of every row, by its whole text alone.

    A null text, and one without a letter, is "und" with score 0, as is any text if nothing
    could be learned. Very long texts are gone over in pieces. Of equally short codes the first
    language by name wins. Repeated rows are predicted alike, an empty table gives no rows, and
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model or learn(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in batches:
            got = [ppm.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
