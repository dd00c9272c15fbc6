"""N-gram Jaccard join: texts whose sets of word shingles are alike, by a grouped prefix join.

The shingles of a set are put in one order for all texts, the rarest first. Two sets of m and n
shingles with a Jaccard similarity of s or more share one of the first m - ceil(s m) + 1 of the
one and n - ceil(s n) + 1 of the other. So texts meet over the shingles of these prefixes:

1. equal texts are one text, by a 128-bit digest;
2. texts with the same prefix and size are one group, and groups meet, not texts;
3. a pair of groups is dropped if the sizes are too far apart, or if after the shingle that both
   have too few are left in one of them;
4. what is left is expanded and verified on the members' shingles, as words and not as hashes.

A shingle's rank is how often its place in a table of PLACES counters was hit in all documents, then
its hash: any order is exact, and the table, of fixed size, goes to all tasks.

Only components are asked for, so not all pairs of a group of copies are made. First, up to SMALL groups
that share a shingle give all pairs, and more give each with the first of them and NEAR neighbours.
Then, of a shingle whose texts are still in different components, the pairs across components follow:
all of them up to LARGE groups. Beyond that, and where groups have several members, they are searched in
pairs of blocks over tasks (`near_copies.crowded_links`). So no link between components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import connected_components
from .near_copies import crowded_links

WIDTH, PERCENT = 5, 80
#: Counters of shingles, as a power of two.
PLACES = 18
#: Groups that share a shingle and all meet at once, those of a block of more, the neighbours each of these meets, and groups whose pairs across components are made.
SMALL, BLOCK, NEAR, LARGE = 4, 256, 2, 256
#: Bytes of a text that are hashed together, unless a word is longer.
CHUNK = 1 << 20
#: Different words of two texts up to which five word numbers make one 64-bit number.
BASE = 6208
_ODD = 0x9E3779B97F4A7C15
_IS_SEPARATOR = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


class WordHashes:
    """Hashes of all words of a text at once: a word's is the difference of two prefix sums of bytes times powers, shifted to the word's start."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.up):
            inverse = pow(_ODD, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_ODD, inverse))

    def words(self, text: bytes) -> np.ndarray:
        """text is lower-cased; words end at separators, so it is cut at one of them."""
        out, at = [], 0
        while at < len(text):
            cut = len(text)
            if cut - at > CHUNK and (more := np.flatnonzero(_IS_SEPARATOR[np.frombuffer(text, np.uint8, offset=at + CHUNK)])).size:
                cut = at + CHUNK + int(more[0])
            part = np.frombuffer(text, np.uint8, cut - at, at)
            self._grow(len(part))
            inside = np.concatenate([[False], ~_IS_SEPARATOR[part], [False]])
            edges = np.flatnonzero(inside[1:] != inside[:-1])
            with np.errstate(over="ignore"):
                sums = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.up[: len(part)])])
                h = (sums[edges[1::2]] - sums[edges[0::2]]) * self.down[edges[0::2]]
                out.append((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9))
            at = cut
        return np.concatenate(out) if out else np.empty(0, np.uint64)

    def shingles(self, text: bytes | None) -> np.ndarray:
        """A hash for each run of WIDTH words, of all words if they are fewer."""
        h = self.words((text or b"").lower())
        width = min(WIDTH, len(h))
        if not width:
            return h
        n = len(h) - width + 1
        with np.errstate(over="ignore"):
            out = h[:n].copy()
            for j in range(1, width):
                out = out * np.uint64(_ODD) + h[j : j + n]
            out ^= out >> np.uint64(31)
            out *= np.uint64(0xD6E8FEB86659FD93)
            return out ^ (out >> np.uint64(32))


def different(hashes: np.ndarray) -> np.ndarray:
    """The different values, in order."""
    s = np.sort(hashes)
    return s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) else s


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text, A-Z lower-cased: bytes are cut at, and lower-cased in, ASCII alone."""
    return text.lower().split() if text else []


class Shingles:
    """Different shingles of one text and of others, as words: words are numbered, and a shingle is the number made of its words'."""

    def __init__(self, text: bytes | None) -> None:
        self.numbers: dict[bytes, int] = {}
        self.n_words, self.own = self._numbered(text)
        self.keys = self._packed(self.own) if len(self.numbers) <= BASE else None

    def _numbered(self, text: bytes | None) -> tuple[int, np.ndarray]:
        tokens = tokens_of(text)
        number = self.numbers.setdefault
        return len(tokens), np.fromiter((number(t, len(self.numbers)) for t in tokens), np.int64, len(tokens))

    @staticmethod
    def _packed(numbers: np.ndarray) -> np.ndarray:
        """For fewer than WIDTH words their numbers, filled up with one that no word has."""
        if len(numbers) < WIDTH:
            numbers = np.concatenate([numbers, np.full(WIDTH - len(numbers), BASE - 1)]) if len(numbers) else numbers
        n = max(0, len(numbers) - WIDTH + 1)
        out = np.zeros(n, np.int64)
        for j in range(WIDTH if n else 0):
            out = out * BASE + numbers[j : j + n]
        return different(out)

    def count(self) -> int:
        return len(self.keys) if self.keys is not None else len({tuple(self.own[i : i + WIDTH]) for i in range(max(1, self.n_words - WIDTH + 1))})

    def similar(self, text: bytes | None) -> bool:
        """Whether 100 times the shingles in both are at least PERCENT times those in either."""
        n, other = self._numbered(text)
        if not n or not self.n_words or min(n, self.n_words) < WIDTH:
            return bool(n) and n == self.n_words and np.array_equal(other, self.own)
        if self.keys is not None and len(self.numbers) < BASE:
            mine, yours = self.keys, self._packed(other)
        else:  # ranks of pairs, of pairs of those, and of these with the fifth word: numbers stay below 2 ** 31
            both, cut = np.concatenate([self.own, other]), len(self.own)

            def ranked(x: np.ndarray, y: np.ndarray) -> np.ndarray:
                return np.unique((x << 31) | y, return_inverse=True)[1]

            two = ranked(both[:-1], both[1:])
            four = ranked(two[:-2], two[2:])
            five = ranked(four[:-1], both[4:])
            mine, yours = different(five[: cut - WIDTH + 1]), different(five[cut:])
        shared = len(np.intersect1d(mine, yours, assume_unique=True))
        return 100 * shared >= PERCENT * (len(mine) + len(yours) - shared)


def first_pass(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, n (different shingles) and digest; and a row for each counter that a task hit: place and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = WordHashes(), np.zeros(1 << PLACES, np.int64)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32()]
        names = ["doc_id", "n", "digest", "place"]
        for batch in batches:
            sizes, digests = [], []
            for x in batch.column(1).cast(pa.binary()):
                text = x.as_py()
                every = hashes.shingles(text)
                own = different(every)
                # hashes that repeat are counted as words
                sizes.append(len(own) if len(own) == len(every) else Shingles(text).count())
                digests.append(digest_of(text))
                np.add.at(counts, (own >> np.uint64(64 - PLACES)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, kinds[1]), pa.array(digests, kinds[2]), pa.nulls(batch.num_rows, kinds[3])], names=names)
        hit = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(hit), kinds[0]), pa.array(counts[hit]), pa.nulls(len(hit), kinds[2]), pa.array(hit, kinds[3])], names=names)

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, place int")


def digest_of(text: bytes | None) -> bytes:
    return hashlib.blake2b((text or b"").lower(), digest_size=16).digest()


def shingle_counts(passed: DataFrame) -> np.ndarray:
    """How many shingles of all texts, each once a text, fall to each counter."""
    total = passed.filter("place IS NOT NULL").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << PLACES, np.int64)
    out[total.column("place").to_numpy()] = total.column("n").to_numpy()
    return out


def prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """doc_id, digest, m (size), prefix (hashes, in order) and kind (digest of size and prefix) of each text with a shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    names = ["doc_id", "digest", "m", "prefix", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, ranks = WordHashes(), shared.value
        for batch in batches:
            out: list[tuple] = []
            for doc_id, x in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                text = x.as_py()
                own = different(hashes.shingles(text))
                if m := len(own):
                    head = m - (PERCENT * m + 99) // 100 + 1
                    rank = ranks[(own >> np.uint64(64 - PLACES)).astype(np.int64)]
                    prefix = own[np.argsort(rank, kind="stable")[:head]].view(np.int64)
                    kind = hashlib.blake2b(prefix.tobytes() + m.to_bytes(8, "little"), digest_size=16).digest()
                    out.append((doc_id.as_py(), digest_of(text), m, prefix, kind))
            if out:
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return docs.mapInArrow(run, "doc_id long, digest binary, m long, prefix array<long>, kind binary")


def may_reach(m: str, i: str, n: str, j: str) -> Column:
    """Whether sets of sizes m and n that first share the i-th of one and the j-th of the other, from 0, may be similar."""
    share, both = F.least(F.col(m) - F.col(i), F.col(n) - F.col(j)), F.col(m) + F.col(n)
    sizes = 100 * F.least(m, n) >= PERCENT * F.greatest(m, n)
    return sizes & ((100 + PERCENT) * share >= PERCENT * both)


def met_groups(groups: DataFrame) -> DataFrame:
    """token, group, m, pos, groups and texts, for each shingle of prefixes that several texts share. groups has kind, group, m, prefix and members."""
    index = groups.select(F.posexplode("prefix").alias("pos", "token"), "group", "m", "members")
    shared = index.groupBy("token").agg(F.count("*").alias("groups"), F.sum("members").alias("texts")).filter("texts > 1")
    return index.drop("members").join(shared, "token")


def group_pairs(met: DataFrame) -> DataFrame:
    """a, b (a < b) of the pairs of groups to verify first."""
    first = met.groupBy("token").agg(F.min(F.struct("group", "m", "pos")).alias("first"))
    many = F.col("groups") > SMALL
    rows = met.filter("groups > 1").join(first, "token").withColumn("block", F.pmod(F.xxhash64("group"), F.ceil(F.when(many, F.col("groups") / BLOCK).otherwise(1))))
    before = Window.partitionBy("token", "block").orderBy("m", "group").rowsBetween(1 - SMALL, -1)
    listed = rows.withColumn("others", F.collect_list(F.struct("group", "m", "pos")).over(before))
    near = F.when(many, F.slice("others", F.greatest(F.size("others") - NEAR + 1, F.lit(1)), NEAR)).otherwise(F.col("others"))
    pairs = listed.select("group", "m", "pos", F.explode(F.concat(near, F.array("first"))).alias("o")).filter("o.group != group")
    fit = pairs.filter(may_reach("m", "pos", "o.m", "o.pos"))
    return fit.select(F.least("group", "o.group").alias("a"), F.greatest("group", "o.group").alias("b")).distinct()


def member_pairs(texts: DataFrame, several: DataFrame) -> DataFrame:
    """a, b of each member of a group of several with the group's first and the member before it in a block. several has kind, group and members."""
    inside = Window.partitionBy("kind", "block").orderBy("id")
    placed = texts.select("kind", "id").join(several, "kind").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / BLOCK))).withColumn("last", F.lag("id").over(inside))
    pairs = placed.select(F.col("id").alias("b"), F.explode(F.array("group", "last")).alias("a")).filter("a != b")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def in_several(met: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of met, with root, whose shingle is met by groups of different components."""
    placed = met.join(roots.withColumnRenamed("node", "group"), "group", "left").withColumn("root", F.coalesce("root", "group"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("token")
    return placed.join(mixed, "token")


def pairs_across(mixed: DataFrame) -> DataFrame:
    """a, b of all pairs of groups in different components that share a shingle of at most LARGE groups and may be similar.

    mixed is what in_several gives for all shingles, so it has all that such a pair shares in prefixes.
    What both can share is that, counted, with all of the shorter rest; shingles of more groups count as shared.
    """
    crowd = mixed.groupBy("group").agg(F.count_if(F.col("groups") > LARGE).alias("crowd"))
    rows = mixed.filter(F.col("groups") <= LARGE).join(crowd, "group")
    sides = [rows.select("token", *(F.col(c).alias(f"{c}{k}") for c in ("group", "m", "pos", "root", "crowd"))) for k in (1, 2)]
    met = sides[0].join(sides[1], "token").filter((F.col("group1") < F.col("group2")) & (F.col("root1") != F.col("root2")))
    found = met.groupBy(F.col("group1").alias("a"), F.col("group2").alias("b"), "m1", "m2").agg(F.count("*").alias("n"), F.bool_or(may_reach("m1", "pos1", "m2", "pos2")).alias("near"), F.min(F.least("crowd1", "crowd2")).alias("crowd"))
    rest = F.floor((PERCENT * F.least("m1", "m2") + 99) / 100) - 1
    enough = (100 + PERCENT) * (F.col("n") + F.col("crowd") + rest) >= PERCENT * (F.col("m1") + F.col("m2"))
    return found.filter(F.col("near") & enough).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs a, b with similar texts. docs has id and text; an id may have several texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, Shingles] | None = None
        for batch in batches:
            a, b = (batch.column(c).to_pylist() for c in (0, 1))
            x, y = (batch.column(c).cast(pa.binary()) for c in (2, 3))
            out = []
            for k in range(batch.num_rows):
                text = x[k].as_py()
                if last is None or text != last[0] or len(last[1].numbers) > BASE:
                    last = text, Shingles(text)
                if last[1].similar(y[k].as_py()):
                    out.append((a[k], b[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    left, right = docs.withColumnsRenamed({"id": "a", "text": "x"}), docs.withColumnsRenamed({"id": "b", "text": "y"})
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return materialize(joined.mapInArrow(run, "a long, b long").distinct(), "verified")


def links(docs: DataFrame, counts: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """digest and first, the least doc_id of each different text with a shingle, and a, b, links that connect all texts that are similar."""
    texts = prefixes(docs, counts).groupBy("digest").agg(F.min(F.struct("doc_id", "m", "kind", "prefix")).alias("s"))
    whole = materialize(texts.select("digest", F.col("s.doc_id").alias("id"), "s.m", "s.kind", "s.prefix"), "distinct")
    texts = materialize(whole.drop("prefix"), "texts")
    several = materialize(texts.groupBy("kind").agg(F.min("id").alias("group"), F.count("*").alias("members")).filter("members > 1"), "several")
    # nearly every text is a group of its own: the others are few, and prefixes needn't move to be grouped
    others = materialize(texts.join(several, "kind").filter("id != group").select("kind", "id").distinct(), "others")
    groups = whole.join(others, ["kind", "id"], "left_anti").join(several.select("kind", "members"), "kind", "left")
    met = materialize(met_groups(groups.select(F.col("id").alias("group"), "m", "prefix", F.coalesce("members", F.lit(1)).alias("members"))), "met")
    for done in (whole, others):
        discard(done)
    members = texts.groupBy("kind").agg(F.min("id").alias("group")).join(met.select("group").distinct(), "group").join(texts.select("kind", "id", F.col("m").alias("n")), "kind").drop("kind")
    members = materialize(members.distinct(), "members")
    # the texts that share a shingle of their prefixes with another move once, and are read again where pairs are verified
    named = materialize(docs.select(F.col("doc_id").alias("id"), "text").join(members.select("id").distinct(), "id", "left_semi").distinct(), "named")
    pairs = materialize(group_pairs(met).unionByName(member_pairs(texts.select("kind", "id").distinct(), several)).distinct(), "pairs")
    near = verified(pairs, named)
    rest = materialize(in_several(met.filter("groups > 1"), connected_components(near)), "mixed")
    across = materialize(pairs_across(rest).join(pairs, ["a", "b"], "left_anti"), "across")
    if not across.isEmpty():
        near = near.unionByName(verified(across, named))
    # of what is left, groups stand for all their members
    hidden = met.join(met.join(several.select("group"), "group").select("token").distinct(), "token")
    crowds = rest.filter(F.col("groups") > LARGE).select(F.col("token").alias("bucket"), "group").unionByName(hidden.select(F.col("token").alias("bucket"), "group"))
    crowded = materialize(crowds.distinct().join(members, "group").select("bucket", "id", "n").distinct(), "crowded")
    if not crowded.isEmpty():
        near = near.unionByName(materialize(crowded_links(named, crowded, near), "joined"))
    for done in (met, several, members, named, pairs, rest, across):
        discard(done)
    return texts.select("digest", F.col("id").alias("first")), near.distinct()


def same_ids(firsts: DataFrame) -> DataFrame:
    """a, b, links between the first ids of the texts that one doc_id has. firsts has doc_id and first."""
    least = firsts.groupBy("doc_id").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a < b").select("doc_id", "a")
    return firsts.join(least, "doc_id").select("a", F.col("first").alias("b")).filter("a != b").distinct()


def components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles (different shingles of the text) and component_id, the least doc_id that links reach, for every row of docs.

    Two texts link if 100 times the shingles they share is at least PERCENT times those of both. A text
    of fewer than WIDTH words is one shingle; a null or empty text, or one without a word, has none and
    links with nothing. Rows that share a doc_id are one document. A row without a doc_id links with
    nothing and has a null component. Repeated rows come out as often as they came in. A very long text
    is cut and compared whole, in one task. An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    passed = materialize(first_pass(docs), "first-pass")
    rows = passed.filter("place IS NULL").select("doc_id", F.col("n").alias("n_shingles"), "digest")
    linking = rows.filter("doc_id IS NOT NULL AND n_shingles > 0")
    firsts, near = links(docs.filter("doc_id IS NOT NULL"), shingle_counts(passed))
    placed = materialize(linking.join(firsts, "digest").drop("digest"), "placed")
    roots = connected_components(near.unionByName(same_ids(placed.select("doc_id", "first"))))
    out = placed.join(roots.withColumnRenamed("node", "first"), "first", "left").select("doc_id", "n_shingles", F.coalesce("root", "first").alias("component_id"))
    return out.unionByName(rows.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
