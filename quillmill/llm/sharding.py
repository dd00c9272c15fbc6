"""Sharding by a hierarchical weighted hash tree: region, then rack, then shard.

At each level every child of the current node draws an exponential clock,
-ln(u(key, child)) / weight(child), and the earliest one takes the row. A child's chance is
its share of its siblings' weight, and since a draw depends on nothing but the row's key and
the child's name and weight:

* a heavier child takes rows from its siblings and gives none away;
* changing weights below a node never moves a row out of that node, so movement is confined
  to the subtrees whose weights change.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Bytes that each document costs besides its text.
ROW_OVERHEAD = 16


@dataclass(frozen=True)
class Leaf:
    """One shard and its place. Weights are those of the shard among its rack's shards, of the
    rack among its region's racks, and of the region; the last two repeat on each of a node's leaves."""

    region: int
    rack: int
    shard: int
    weight: float = 1.0
    rack_weight: float = 1.0
    region_weight: float = 1.0


def topology(shards: int, planned: int = 40, racks: int = 4, per_rack: int = 2) -> list[Leaf]:
    """The tree for a shard count.

    The planned shards fill regions of racks x per_rack; a node weighs as many units as it has
    shards. Each shard beyond the plan opens a region of its own with one unit: its draw at the
    root is the only one that changes, so it takes an even share of all rows, only into itself.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    base, block = min(shards, planned), racks * per_rack
    leaves = []
    for s in range(base):
        region, rest = divmod(s, block)
        in_region = min(block, base - region * block)
        rack = rest // per_rack
        leaves.append(Leaf(region, rack, s, 1.0, float(min(per_rack, in_region - rack * per_rack)), float(in_region)))
    first = -(-planned // block)
    leaves += [Leaf(first + s - planned, 0, s) for s in range(base, shards)]
    return leaves


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _node_id(*path: int) -> np.uint64:
    h = 0x9E3779B97F4A7C15
    for depth, p in enumerate(path):
        h = (h * 0x100000001B3 + (int(p) + 1) * 0x9E3779B97F4A7C15 + depth) & 0xFFFFFFFFFFFFFFFF
    return np.uint64(h)


def _draw(keys: np.ndarray, children: list[tuple[tuple[int, ...], float]]) -> np.ndarray:
    """For each key the index of the child whose clock rings first; ties go to the earlier child."""
    best = np.full(len(keys), np.inf)
    take = np.zeros(len(keys), dtype=np.int64)
    for i, (path, weight) in enumerate(children):
        if weight <= 0:
            continue
        with np.errstate(over="ignore"):
            h = _mix(_mix(keys ^ _node_id(*path)) + np.uint64(0x9E3779B97F4A7C15))
        clock = -np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / weight
        won = clock < best
        best[won], take[won] = clock[won], i
    return take


def descend(keys: np.ndarray, leaves: list[Leaf]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Region, rack and shard of each key."""
    regions = {leaf.region: leaf.region_weight for leaf in leaves}
    names = list(regions)
    region = np.array(names, dtype=np.int32)[_draw(keys, [((r,), regions[r]) for r in names])]
    rack, shard = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
    for r in np.unique(region):
        in_region = np.flatnonzero(region == r)
        racks = {leaf.rack: leaf.rack_weight for leaf in leaves if leaf.region == r}
        ks = list(racks)
        rack[in_region] = np.array(ks, np.int32)[_draw(keys[in_region], [((r, k), racks[k]) for k in ks])]
        for k in np.unique(rack[in_region]):
            here = in_region[rack[in_region] == k]
            own = [leaf for leaf in leaves if (leaf.region, leaf.rack) == (r, k)]
            shard[here] = np.array([x.shard for x in own], np.int32)[_draw(keys[here], [((r, k, x.shard), x.weight) for x in own])]
    return region, rack, shard


def assign(docs: DataFrame, leaves: list[Leaf], grown: list[Leaf] | None = None) -> DataFrame:
    """Adds region, rack, shard, and grown_shard (the shard under the tree `grown`, if given).

    Only doc_id decides. A null doc_id is a key like any other, so such rows share a shard.
    Existing columns of these names are replaced; no row is dropped or repeated.
    """

    @F.pandas_udf("region int, rack int, shard int, grown_shard int")
    def place(key: pd.Series) -> pd.DataFrame:
        keys = key.to_numpy(np.int64).view(np.uint64)
        region, rack, shard = descend(keys, leaves)
        later = pd.array(descend(keys, grown)[2] if grown else [None] * len(keys), dtype="Int32")
        return pd.DataFrame({"region": region, "rack": rack, "shard": shard, "grown_shard": later})

    names = ("region", "rack", "shard", "grown_shard")
    placed = docs.drop(*names).withColumn("_p", place(F.xxhash64("doc_id")))
    return placed.select("*", *(F.col(f"_p.{n}").alias(n) for n in names)).drop("_p")


def shard_documents(docs: DataFrame, shards: int = 40, planned: int = 40, bucket_rows: int = 50_000) -> DataFrame:
    """Places every document in a shard and numbers each shard's rows without gaps from 0.

    Returns doc_id, size (UTF-8 bytes plus 16; a null text has no bytes), text_crc32 (of those
    bytes), law ("key"), region, rack, shard, slot and grown_shard (with one shard more).
    Slots follow (bucket, doc_id, text_crc32, size): a shard is cut into hash buckets of about
    bucket_rows rows that are numbered apart, and start where the counts of the buckets before
    end, so no task holds a whole shard; they depend on the rows and bucket_rows alone. Repeated
    rows are counted where they are read, numbered as one, and told apart again in parts, so
    they take slots of their own and no task numbers them one by one. A very long text costs its
    bytes once. An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text")).select(
        "doc_id", (F.octet_length("_text").cast("long") + ROW_OVERHEAD).alias("size"), F.crc32(F.encode("_text", "UTF-8")).alias("text_crc32")
    )
    copies = materialize(rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n")), "copies")
    total, most = copies.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    buckets = max(1, math.ceil(total / shards / bucket_rows))
    placed = assign(copies, topology(shards, planned), topology(shards + 1, planned))
    placed = materialize(placed.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))), "shards")
    counts = placed.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_bucket", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("shard", "_bucket").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_at", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(starts, ["shard", "_bucket"])
    part = F.lit(bucket_rows).cast("long")
    if most > bucket_rows:
        numbered = numbered.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {bucket_rows}")))).repartition("doc_id", "text_crc32", "_part")
    else:
        numbered = numbered.withColumn("_part", F.lit(0).cast("long"))
    each = F.explode(F.sequence(F.col("_part") * part, F.least(F.col("_n"), (F.col("_part") + 1) * part) - 1)).alias("_k")
    told = numbered.select("*", each)
    return told.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard", (F.col("_start") + F.col("_at") + F.col("_k")).cast("long").alias("slot"), "grown_shard")
