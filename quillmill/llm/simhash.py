"""SimHash near-duplicates: fingerprints, BK-trees over shards of them, and connected groups.

A fingerprint pair within `radius` differing bits must be found, whatever the number of
fingerprints. Every shard is a BK-tree whose children are keyed by their integer Hamming
distance to the parent; a query follows only the edges within the radius of its own distance.
Shards are formed so that two fingerprints within the radius always meet in one: with the 64
bits cut into more bands than `radius`, at most `radius` bands differ and the others agree, and
each choice of so many bands with its bits names a shard. The number of bands grows with that of
fingerprints, so that shards stay small. That routing replaces sending every tree to every task,
which would cost the square of the number of fingerprints.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

SEED = 42
#: Bytes that separate words.
_SEPARATORS = str.maketrans("\t\n\x0b\x0c\r", "     ")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str) -> list[str]:
    return [w for w in text.translate(_SEPARATORS).split(" ") if w]


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words of the A-Z-lowered text; of all words if they are fewer."""
    tokens = words((text or "").translate(_LOWER)) if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= width:
        return np.array([digest(" ".join(tokens), SEED)], np.uint64)
    runs = zip(*(tokens[i:] for i in range(width)), strict=False)
    return np.fromiter((digest(s, SEED) for s in map(" ".join, runs)), np.uint64, len(tokens) - width + 1)


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536]
        counts += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, for every row. A null text has no words: fp 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint_of(shingle_hashes(x.as_py(), width)) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A tree over integers: each child hangs on the edge that is its Hamming distance to the parent."""

    def __init__(self) -> None:
        self.nodes: list[int] = []
        self.edges: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        if not self.nodes:
            self.nodes.append(value)
            self.edges.append({})
            return
        at = 0
        while True:
            d = (self.nodes[at] ^ value).bit_count()
            if d == 0:
                return
            child = self.edges[at].get(d)
            if child is None:
                self.edges[at][d] = len(self.nodes)
                self.nodes.append(value)
                self.edges.append({})
                return
            at = child

    def within(self, value: int, radius: int) -> list[int]:
        """All values at most `radius` away, following only edges between d - radius and d + radius."""
        found: list[int] = []
        stack = [0] if self.nodes else []
        while stack:
            at = stack.pop()
            d = (self.nodes[at] ^ value).bit_count()
            if d <= radius:
                found.append(self.nodes[at])
            if edges := self.edges[at]:
                lo, hi = d - radius, d + radius
                stack += [child for edge, child in edges.items() if lo <= edge <= hi]
        return found


def spanning_links(tree_values: list[int], queries: list[int], radius: int, same: bool) -> list[tuple[int, int]]:
    """Links that join the same values as all links between the two lists do, at most one fewer than values.

    same: the lists are one list, and each value is looked up before it is added.
    """
    tree, root = BKTree(), {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    links = []
    if not same:
        for v in tree_values:
            tree.add(v)
    for q in queries:
        for v in tree.within(q, radius):
            a, b = find(q), find(v)
            if a != b:
                root[a] = b
                links.append((q, v))
        if same:
            tree.add(q)
    return links


def block_links(tree: np.ndarray, queries: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """spanning_links() of two blocks of a crowded shard, whose fingerprints are so close that a tree rules little out: all distances of a query at once."""
    values = tree if same else np.concatenate([tree, queries])
    group = np.arange(len(values))
    first = 0 if same else len(tree)
    links = []
    for q in range(len(queries)):
        at = first + q
        near = np.flatnonzero(np.bitwise_count(values[: at if same else len(tree)] ^ queries[q]) <= radius)
        if not len(near):
            continue
        met, where = np.unique(group[near], return_index=True)
        new = met != group[at]
        if new.any():
            links += [(int(queries[q]), int(values[near[k]])) for k in where[new]]
            group[np.isin(group, met)] = group[at]
    return links


#: How many fingerprints a shard holds if they are spread evenly; more, and there are more bands.
SHARD = 64


def _bands(radius: int, count: int = 0) -> list[tuple[int, int]]:
    """Where bands start and how wide they are: radius + 2 at least, and more, up to radius + 5, while shards of `count` fingerprints would be large."""
    more = 2
    while more < 5 and count >> (64 * more // (radius + more)) > SHARD:
        more += 1
    cuts = [64 * i // (radius + more) for i in range(radius + more + 1)]
    return [(lo, hi - lo) for lo, hi in itertools.pairwise(cuts)]


def shard_keys(radius: int, count: int) -> list[F.Column]:
    """A long for each choice of the bands that must agree: their bits, and in the top bits which choice it is, hashed together where both don't fit."""
    bands = _bands(radius, count)
    out = []
    for t, chosen in enumerate(itertools.combinations(bands, len(bands) - radius)):
        key, width = F.lit(t + 1).cast("long"), 8
        for lo, n in chosen:
            key = F.shiftleft(key, n).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND((1 << n) - 1))
            width += n
        if width > 63:
            raise ValueError("a shard's key has more than 63 bits")
        out.append(key)
    return out


def fingerprint_links(distinct: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """Links a, b (fp, signed) that connect the same fingerprints as all pairs within the radius do.

    distinct has one row for each fp. A shard of over `block` fingerprints is cut into hash
    blocks and each pair of blocks is searched apart, so a crowded shard is spread and no task
    holds more than two blocks at once.
    """
    keys = shard_keys(radius, distinct.count())
    routed = distinct.select("fp", F.explode(F.array(*keys)).alias("shard"))
    sizes = routed.groupBy("shard").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = materialize(sizes.filter(F.col("n") > block), "crowded")
    if crowded.isEmpty():
        placed = routed.select("shard", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", F.lit(0).alias("own"))
    else:
        many = routed.join(crowded, "shard", "left").withColumn("k", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
        many = many.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        placed = many.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "own")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (shard, i, j); a run of equal keys is one search."""
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

        def links_of(key, fps: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
            _, i, j = key
            if i != j:
                return block_links(fps[own == i], fps[own == j], radius, False)
            if len(fps) > block // 2:
                return block_links(fps, fps, radius, True)
            return spanning_links([], fps.tolist(), radius, True)

        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            fps = cols[3].view(np.uint64)
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, [*cols[:3], fps, cols[4]], strict=True)]
                fps = cols[3]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            edges = np.concatenate([[0], change, [len(fps)]])
            out: list[tuple[int, int]] = []
            for at in np.flatnonzero(np.diff(edges[:-1]) > 1):
                lo, hi = edges[at], edges[at + 1]
                out += links_of((cols[0][lo], cols[1][lo], cols[2][lo]), fps[lo:hi], cols[4][lo:hi])
            last = edges[-2]
            held = [cols[0][last:], cols[1][last:], cols[2][last:], fps[last:], cols[4][last:]]
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)
        if held is not None and len(held[3]) > 1:
            out = links_of((held[0][0], held[1][0], held[2][0]), held[3], held[4])
            if out:
                pairs = np.array(out, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    keyed = placed.repartition("shard", "i", "j").sortWithinPartitions("shard", "i", "j", "fp")
    return keyed.mapInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links.

    Rows link if their fingerprints differ in at most `radius` bits. Equal texts share a
    fingerprint and are one node of the search, however many they are. Texts without a word
    (null, empty, blank) have fingerprint zero and link like any other. A null doc_id keeps its
    row, and takes part; a component of nothing but null ids has a null component_id. Repeated
    rows come out as often as they came in. A very long text is hashed whole, in one task. An
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = materialize(fingerprints(docs, width), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    links = fingerprint_links(nodes.select("fp"), radius).distinct()
    members = connected_components(links)
    named = nodes.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.select("fp", "root").join(roots, "root").select("fp", "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return rows.join(classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: those with its smallest doc_id.

    Rows that share a doc_id are one document and stay or go together. Rows without a doc_id
    are kept, since they can't be named.
    """
    chosen = near_duplicates(docs.select("doc_id", "text"), width, radius).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.filter(F.col("doc_id").isNotNull()).join(chosen, "doc_id", "left_semi")
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
