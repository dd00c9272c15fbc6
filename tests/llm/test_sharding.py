import zlib
from collections import defaultdict

import numpy as np

from quillmill.llm import sharding

from .helpers import ODD, SF, documents, driver_rows


def keys(n):
    return np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64)


def test_one_more_shard_takes_rows_only_into_itself():
    k = keys(40000)
    for n in (40, 41, 47, 63):
        before, after = (sharding.descend(k, sharding.topology(m))[2] for m in (n, n + 1))
        moved = before != after
        assert set(after[moved]) == {n}
        assert abs(moved.mean() - 1 / (n + 1)) < 0.005


def test_weights_are_followed():
    shard = sharding.descend(keys(80000), sharding.topology(40))[2]
    counts = np.bincount(shard, minlength=40)
    assert counts.min() > 1700 and counts.max() < 2300


def test_reweighting_inside_a_rack_moves_nothing_outside_it():
    leaves = sharding.topology(40)
    changed = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 9 else x.weight, x.rack_weight, x.region_weight) for x in leaves]
    k = keys(20000)
    a, b = sharding.descend(k, leaves), sharding.descend(k, changed)
    moved = a[2] != b[2]
    assert moved.any() and set(a[2][moved]) == {8} and set(b[2][moved]) == {9}


def test_uneven_trees_reach_every_shard():
    for n in (1, 2, 7, 13, 39):
        assert set(sharding.descend(keys(20000), sharding.topology(n))[2]) == set(range(n))


def check(rows, got):
    assert len(got) == len(rows)
    text = defaultdict(list)
    for i, t in rows:
        text[i].append((t or "").encode())
    slots = defaultdict(list)
    for r in got:
        assert any(r.size == len(b) + 16 and r.text_crc32 == zlib.crc32(b) for b in text[r.doc_id])
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    place = defaultdict(set)
    for r in got:
        place[r.doc_id].add(r.shard)
    assert all(len(p) == 1 for p in place.values())


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in driver_rows("documents")]
    check(rows, sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect())


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 as shard", "2 as slot", "'x' as law")
    check(ODD, sharding.shard_documents(docs).collect())
    assert sharding.shard_documents(documents(spark, [])).count() == 0


def plain_shard(doc_id, n, planned=40):
    """The descent with Python's own integers and loops, a row at a time."""
    import math

    import xxhash

    m64 = (1 << 64) - 1

    def mix(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m64
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m64
        return x ^ (x >> 31)

    def clock(key, path, weight):
        node = 0x9E3779B97F4A7C15
        for depth, p in enumerate(path):
            node = (node * 0x100000001B3 + (p + 1) * 0x9E3779B97F4A7C15 + depth) & m64
        h = mix((mix(key ^ node) + 0x9E3779B97F4A7C15) & m64)
        return -math.log(((h >> 11) + 0.5) / (1 << 53)) / weight

    # weights: a region counts its shards, a rack its own; shards beyond the plan are regions of one
    tree = {}
    for s in range(min(n, planned)):
        tree.setdefault(s // 8, {}).setdefault(s % 8 // 2, []).append(s)
    for s in range(planned, n):
        tree[s - planned + 5] = {0: [s]}
    key = xxhash.xxh64_intdigest((doc_id & m64).to_bytes(8, "little"), 42) if doc_id is not None else 42
    region = min(tree, key=lambda r: clock(key, (r,), sum(map(len, tree[r].values()))))
    rack = min(tree[region], key=lambda k: clock(key, (region, k), len(tree[region][k])))
    return min(tree[region][rack], key=lambda s: clock(key, (region, rack, s), 1))


def test_every_shard_is_that_of_a_plain_descent(spark):
    rows = sharding.shard_documents(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    for r in rows:
        assert (r.shard, r.grown_shard) == (plain_shard(r.doc_id, 40), plain_shard(r.doc_id, 41))


def test_a_hot_row_is_counted_once_and_numbered_in_parts(spark):
    rows = [(7, "hot")] * 900 + [(i, f"t{i}") for i in range(100)] + [(None, None)] * 60
    for partitions in ("2", "5"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = sharding.shard_documents(documents(spark, rows), shards=3, planned=3, bucket_rows=50).collect()
        assert len(got) == len(rows)
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        seen = sorted((r.shard, r.slot, r.doc_id) for r in got if r.doc_id is not None)
        assert partitions == "2" or seen == before
        before = seen
    spark.conf.set("spark.sql.shuffle.partitions", "4")
