import math
import random

import numpy as np
import pytest
import xxhash

from quillmill.llm import simhash
from quillmill.llm.components import connected_components

from .helpers import ODD, SF, documents, driver_rows


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    seen, comp = {}, list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, f in enumerate(fps):
        if f in seen:
            comp[find(i)] = find(seen[f])
        else:
            seen[f] = i
    distinct = list(seen)
    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= 4:
                comp[find(seen[distinct[a]])] = find(seen[distinct[b]])
    least = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (least.get(r), doc) if x is not None]
        least[r] = min(known) if known else None
    return sorted(((d, f"{f:016x}", least[find(i)]) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in driver_rows("documents", sf)]
    assert result(simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))) == brute(rows)


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 as fp", "2 as shard", "3 as root")
    assert result(simhash.near_duplicates(docs)) == brute(ODD)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_bk_tree_finds_what_a_scan_finds():
    rnd = random.Random(3)
    values = [rnd.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in values for _ in range(4)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values[::3]:
        assert sorted(tree.within(q, 4)) == sorted(v for v in set(values) if (v ^ q).bit_count() <= 4)


@pytest.mark.parametrize("block", [8, 2048])
def test_links_connect_what_all_pairs_connect(spark, block):
    rnd = random.Random(5)
    seeds = [rnd.getrandbits(64) for _ in range(30)]
    values = set(seeds)
    for s in seeds[:10]:
        for _ in range(25):
            v = s
            for _ in range(rnd.randrange(1, 4)):
                v ^= 1 << rnd.randrange(64)
            values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    links = simhash.fingerprint_links(df, 4, block)
    got = {r.node: r.root for r in connected_components(links).collect()}
    values = sorted(values)
    comp = {v: v for v in values}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                comp[find(a)] = find(b)
    same = {}
    for v in values:
        same.setdefault(find(v), set()).add(signed(v))
    want = {frozenset(s) for s in same.values() if len(s) > 1}
    groups = {}
    for n, r in got.items():
        groups.setdefault(r, set()).add(n)
    assert {frozenset(s) for s in groups.values()} == want


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_one_of_each_group_stays_with_its_columns(spark):
    text = "one two three four five six seven"
    docs = documents(spark, [(3, text), (1, text), (2, "something else entirely in this one"), (None, text)])
    got = sorted((r.doc_id or 0) for r in simhash.keep_one_each(docs).collect())
    assert got == [0, 1, 2] and simhash.keep_one_each(docs).columns == docs.columns


def test_more_fingerprints_have_more_and_narrower_bands():
    sizes = [len(simhash._bands(4, n)) for n in (0, 10**6, 10**9, 5 * 10**10, 10**13)]
    assert sizes == sorted(sizes) and sizes[0] == 6 and sizes[-1] == 9
    for n in (0, 10**9, 5 * 10**10):
        bands = simhash._bands(4, n)
        assert sum(w for _, w in bands) == 64
        shared = sum(sorted(w for _, w in bands)[: len(bands) - 4])
        assert n >> shared <= simhash.SHARD
        assert len(simhash.shard_keys(4, n)) == math.comb(len(bands), 4)


def test_blocks_link_what_trees_link():
    rnd = random.Random(5)
    near = [rnd.getrandbits(64)]
    near += [near[0] ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(7))) for _ in range(300)] + [rnd.getrandbits(64) for _ in range(50)]
    values = np.array(sorted(set(near)), np.uint64)

    def groups(links):
        root = {v: v for v in values.tolist()}
        find = lambda x: x if root[x] == x else find(root[x])
        for a, b in links:
            root[find(a)] = find(b)
        return {v: find(v) for v in root}

    def alike(a, b):
        return {frozenset(v for v in a if a[v] == r) for r in a.values()} == {frozenset(v for v in b if b[v] == r) for r in b.values()}

    assert alike(groups(simhash.block_links(values, values, 4, True)), groups(simhash.spanning_links([], values.tolist(), 4, True)))
    x, y = values[::2], values[1::2]
    assert alike(groups(simhash.block_links(x, y, 4, False)), groups(simhash.spanning_links(x.tolist(), y.tolist(), 4, False)))


def test_wider_routing_finds_the_same_components(spark, monkeypatch):
    rnd = random.Random(6)
    base = [rnd.getrandbits(63) for _ in range(60)]
    fps = sorted({b ^ sum(1 << k for k in rnd.sample(range(63), rnd.randrange(6))) for b in base for _ in range(6)})
    distinct = spark.createDataFrame([(f,) for f in fps], "fp long")

    def components():
        from quillmill.llm.components import connected_components

        return sorted(map(tuple, connected_components(simhash.fingerprint_links(distinct, 4, block=64)).collect()))

    want = components()
    monkeypatch.setattr(simhash, "SHARD", -1)
    assert len(simhash._bands(4, 1)) == 9 and components() == want
