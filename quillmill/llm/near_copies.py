"""Near copies by five-word shingles: SimHash links and MinHash bands find candidate pairs, the texts decide.

Two texts are near copies if the sets of their shingles have a Jaccard similarity of at least
SIMILARITY. The links of `simhash`, over fingerprints of the same shingles, give the closest of
them; at 0.8 fingerprints differ in about 10 of 64 bits and in 17 or more now and then, too
many to route by, so MinHash bands give the others. A band of ROWS minima agrees with chance
0.8 ** ROWS at the threshold, so a pair there shares none of the BANDS with a chance of
(1 - 0.8 ** 5) ** 28, under two in 100,000. Every candidate is then checked on its shingles, as
words and not as hashes, so nothing is linked that is less similar.

A bucket of up to SMALL texts gives all its pairs. In a larger one each text is paired with the
bucket's least id and its neighbours by size within a block, so that a group of any size gives
pairs in proportion. What these pairs leave out matters only where a large bucket still holds
several groups: there all texts outside its largest group are compared with all others, a pair
of blocks a task, and links that connect different groups are added. No task holds a whole bucket.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .decontamination import multipliers
from .simhash import _LOWER, fingerprint_links, fingerprint_of, shingle_hashes, words

WIDTH, SIMILARITY = 5, 0.8
BANDS, ROWS = 28, 5
#: Texts of a bucket whose pairs are all candidates, texts of a block of a larger one, and neighbours paired there.
SMALL, BLOCK, NEAR = 32, 256, 2
#: Shingles that are worked on together, and those of a block of a large bucket, unless one text has more.
CHUNK, BLOCK_SHINGLES = 20_000, 500_000
#: Parts that the rows of a large bucket are dealt into for joins by bucket.
PARTS = 32
_FACTORS = multipliers(BANDS * ROWS)


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each band of the minima of the shingles' hashes."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), CHUNK):
            least = np.minimum(least, (_FACTORS[:, None] * shingles[None, at : at + CHUNK]).min(axis=1))
        keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for row in least.reshape(BANDS, ROWS).T:
            keys = (keys ^ row) * np.uint64(0xBF58476D1CE4E5B9)
            keys ^= keys >> np.uint64(32)
    return keys


def shingles_of(text: str | None) -> frozenset[str]:
    """Runs of WIDTH words of the A-Z-lowered text; all words if they are fewer, none without a word."""
    tokens = words((text or "").translate(_LOWER))
    if not tokens:
        return frozenset()
    return frozenset(" ".join(tokens[i : i + WIDTH]) for i in range(max(1, len(tokens) - WIDTH + 1)))


def similar(a: frozenset, b: frozenset) -> bool:
    """Whether the Jaccard similarity is at least SIMILARITY; texts without a word are like each other and nothing else."""
    both = len(a & b)
    return both >= SIMILARITY * (len(a) + len(b) - both)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest of the text, n (its shingles), fp (its fingerprint) and keys of its bands, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, fps, keys = [], [], [], []
            for x in batch.column(1):
                text = x.as_py() or ""
                every = shingle_hashes(text, WIDTH)
                own = np.unique(every)
                fps.append(fingerprint_of(every))
                # texts without a word are one text
                digests.append(hashlib.blake2b(text.encode() if len(own) else b"", digest_size=16).digest())
                sizes.append(len(own))
                keys.append(band_keys(own).view(np.int64) if len(own) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "digest", "n", "fp", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, digest binary, n long, fp long, keys array<long>")


def candidates(texts: DataFrame, members: DataFrame) -> DataFrame:
    """a, b (ids, a < b) of the pairs to check. texts has id, n, fp and keys; members has bucket, id and n."""
    shared = members.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("least")).filter("size > 1")
    rows = members.join(shared, "bucket").withColumn("block", F.pmod(F.xxhash64("id"), F.ceil(F.when(F.col("size") > SMALL, F.col("size") / BLOCK).otherwise(1))))
    before = Window.partitionBy("bucket", "block").orderBy("n", "id").rowsBetween(1 - SMALL, -1)
    listed = rows.withColumn("others", F.collect_list(F.struct("id", "n")).over(before))
    near = F.when(F.col("size") > SMALL, F.slice("others", F.greatest(F.size("others") - NEAR + 1, F.lit(1)), NEAR)).otherwise(F.col("others"))
    pairs = listed.select("id", "n", F.explode(F.concat(near, F.array("least"))).alias("o")).filter("o.id != id")
    banded = pairs.select("id", "n", F.col("o.id").alias("id2"), F.col("o.n").alias("n2"))
    alike = banded.unionByName(fingerprint_pairs(texts)).filter(F.least("n", "n2") >= F.lit(SIMILARITY) * F.greatest("n", "n2"))
    return alike.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()


def fingerprint_pairs(texts: DataFrame, radius: int = 4) -> DataFrame:
    """id, n, id2, n2 of texts that share a fingerprint with its least id, or whose fingerprints simhash links."""
    stands = materialize(texts.groupBy("fp").agg(F.min(F.struct("id", "n")).alias("s")), "fingerprints")
    near = fingerprint_links(stands.select("fp"), radius).distinct()
    one, two = stands.select(F.col("fp").alias("a"), "s.id", "s.n"), stands.select(F.col("fp").alias("b"), F.col("s.id").alias("id2"), F.col("s.n").alias("n2"))
    linked = near.join(one, "a").join(two, "b").select("id", "n", "id2", "n2")
    same = texts.join(stands, "fp").filter("id != s.id").select("id", "n", F.col("s.id").alias("id2"), F.col("s.n").alias("n2"))
    return linked.unionByName(same)


def checked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs a, b whose texts are similar. texts has id and text; an id may have several."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, frozenset] = (None, frozenset())
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            out = []
            for i, j, s, t in zip(a, b, x, y, strict=True):
                if s != held[0]:
                    held = s, shingles_of(s)
                if similar(held[1], shingles_of(t)):
                    out.append((i, j))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["a", "b"])

    left, right = texts.withColumnsRenamed({"id": "a", "text": "x"}), texts.withColumnsRenamed({"id": "b", "text": "y"})
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long").distinct()


def by_bucket(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows (bucket, id and others) with the columns of large, which has one row for each large bucket: copied for each part, so that a bucket's rows don't meet in one task."""
    parts = large.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return rows.withColumn("_part", F.pmod(F.xxhash64("id"), F.lit(PARTS))).join(parts, ["bucket", "_part"]).drop("_part")


def hashed_sets(docs: DataFrame) -> DataFrame:
    """id and hashes, the different hashes of the text's shingles as bytes, for every row (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(x.as_py() or "", WIDTH)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return docs.mapInArrow(run, "id long, hashes binary")


def joining_pairs(ids: list[int], roots: list[int], own: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of ids with similar sets that join different groups (roots), each join once; of two blocks (own), pairs across them alone."""
    sizes, blocks = np.array([len(s) for s in sets]), np.array(own)
    group = np.unique(roots, return_inverse=True)[1]
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    across = blocks.min() != blocks.max()
    out = []
    for q in range(1, len(ids)):
        fits = (group != group[q]) & (np.minimum(sizes, sizes[q]) >= SIMILARITY * np.maximum(sizes, sizes[q]))
        fits[q:] = False
        if across:
            fits &= blocks != blocks[q]
        if not fits.any():
            continue
        lo = np.searchsorted(flat, sets[q], "left")
        found = np.searchsorted(flat, sets[q], "right") - lo
        at = np.repeat(lo - (np.cumsum(found) - found), found) + np.arange(found.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        hits = np.flatnonzero(fits & (both >= SIMILARITY * (sizes + sizes[q] - both)))
        met, where = np.unique(group[hits], return_index=True)
        out += [(ids[q], ids[hits[k]]) for k in where]
        group[np.isin(group, met)] = group[q]
    return out


def crowded_links(docs: DataFrame, crowded: DataFrame, near: DataFrame) -> DataFrame:
    """a, b, links between groups that near leaves apart in some large bucket. docs has id and text, crowded bucket, id and n.

    The texts of a bucket outside its largest group are compared with each other and with that
    group. Both sides are cut into blocks by hash, as many as their texts and shingles ask for,
    and a pair of blocks is one search, so a crowded bucket is spread over tasks; a search gives
    fewer pairs than it has texts.
    """
    roots = connected_components(near)
    placed = crowded.join(roots, crowded.id == roots.node, "left").select("bucket", "id", "n", F.coalesce("root", "id").alias("root"))
    groups = placed.groupBy("bucket", "root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
    most = F.max(F.struct("texts", "shingles", "root"))
    buckets = groups.groupBy("bucket").agg(F.sum("texts").alias("texts"), F.sum("shingles").alias("shingles"), most.alias("top")).filter("top.texts < texts")

    def blocks(texts: str, shingles: str) -> F.Column:
        return F.ceil(F.greatest(F.expr(texts) / BLOCK, F.expr(shingles) / BLOCK_SHINGLES)).cast("int")

    cut = buckets.select("bucket", "top.root", blocks("texts - top.texts", "shingles - top.shingles").alias("rest"), blocks("top.texts", "top.shingles").alias("main"))
    mixed = materialize(by_bucket(placed, cut.withColumnRenamed("root", "top")), "mixed")
    held = materialize(docs.join(mixed.select("id").distinct(), "id", "left_semi").distinct(), "mixed-texts")
    small, spread = F.col("root") != F.col("top"), F.xxhash64("id", "bucket")
    routed = mixed.withColumn("own", F.when(small, F.pmod(spread, "rest")).otherwise(F.col("rest") + F.pmod(spread, "main")).cast("int"))
    routed = routed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(small, F.col("rest") + F.col("main")).otherwise(F.col("rest")) - 1)))
    keyed = routed.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "id", "root", "own")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (bucket, i, j); a run of equal keys is one search."""

        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        for _, run in itertools.groupby(rows(), lambda r: r[:3]):
            ids, of, own, sets = zip(*(r[3:] for r in run), strict=True)
            pairs = joining_pairs(list(ids), list(of), list(own), [np.frombuffer(x, np.uint64) for x in sets])
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([f(p) for p in pairs], pa.int64()) for f in (min, max)], names=["a", "b"])

    whole = keyed.join(hashed_sets(held), "id").select("bucket", "i", "j", "id", "root", "own", "hashes")
    pairs = whole.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id").mapInArrow(search, "a long, b long")
    return checked(materialize(pairs.distinct(), "joining"), held)


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """first, the least doc_id of each distinct text, and a, b, links between those whose texts are similar, that connect all that are and share a bucket."""
    rows = materialize(signatures(docs), "signatures")
    least = rows.groupBy("digest").agg(F.min(F.struct("doc_id", "n", "fp", "keys")).alias("s"))
    texts = materialize(least.select("s.doc_id", "s.n", "s.fp", "s.keys").withColumnRenamed("doc_id", "id"), "distinct")
    members = materialize(texts.select(F.explode("keys").alias("bucket"), "id", "n").distinct(), "bands")
    pairs = materialize(candidates(texts, members), "candidates")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    named = docs.select(F.col("doc_id").alias("id"), "text")
    held = materialize(named.join(wanted, "id", "left_semi").distinct(), "candidate-texts")
    near = materialize(checked(pairs, held), "near")
    large = members.groupBy("bucket").count().filter(F.col("count") > SMALL).select("bucket")
    crowded = materialize(by_bucket(members, large), "crowded")
    if not crowded.isEmpty():
        near = near.unionByName(materialize(crowded_links(named, crowded, near), "joined")).distinct()
    return texts.select(F.col("id").alias("first")).distinct(), near


def keep_one_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group of near copies: those with its least doc_id.

    Groups are connected over links, so a member may be less similar to the one that stays than
    SIMILARITY, but is linked to it by members that aren't. Rows that share a doc_id are one
    document and stay or go together. Rows without a doc_id are kept, since they can't be named,
    and link nothing. Texts without a word are copies of each other. A very long text is hashed
    and compared whole, in one task. An empty table gives no rows; columns may have any names.
    """
    firsts, near = links(docs.filter(F.col("doc_id").isNotNull()).select("doc_id", "text"))
    gone = connected_components(near).filter("node != root").select(F.col("node").alias("first"))
    chosen = firsts.join(gone, "first", "left_anti").withColumnRenamed("first", "doc_id")
    named = docs.filter(F.col("doc_id").isNotNull()).join(chosen, "doc_id", "left_semi")
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
