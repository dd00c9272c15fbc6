import random

import corpus_pipeline
from quillmill.llm import near_copies

from .helpers import LONG, ODD, SF, documents, driver_rows


def sets_of(rows):
    out = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
        w = [x for x in w if x]
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def similar_pairs(rows):
    sets = sets_of(rows)
    ids = sorted(sets)
    return {(a, b) for n, b in enumerate(ids) for a in ids[:n] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def brute(rows):
    group = {i: i for i, _ in rows}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in similar_pairs(rows):
        x, y = sorted((find(a), find(b)))
        group[y] = x
    return {i for i in group if find(i) == i}


def stage(spark, docs):
    return dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, docs, SF)


def test_stage_on_documents(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        rows = [(r["doc_id"], r["text"]) for r in driver_rows("documents", sf)]
        assert {r.doc_id for r in stage(spark, spark.read.parquet(f"{sf}/documents.parquet")).collect()} == brute(rows)


def test_stage_removes_texts_at_the_similarity_and_no_others(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(0, 300, 3):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(204)]
        # a word in the middle is in 5 of 200 shingles: four changed leave 180 / 220, five 175 / 225
        like, unlike = list(base), list(base)
        for k in range(4):
            like[20 + 40 * k] = "changed"
        for k in range(5):
            unlike[20 + 40 * k] = f"other{k}"
        rows += [(i, " ".join(base)), (i + 1, " ".join(like)), (i + 2, " ".join(unlike))]
    want = brute(rows)
    assert len(want) == 200 and {r.doc_id for r in stage(spark, documents(spark, rows)).collect()} == want


def test_a_large_group_of_near_copies_is_one(spark):
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(300)]
    rows = []
    for i in range(400):
        own = list(base)
        own[rnd.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(own)))
    docs = documents(spark, rows)
    assert [r.doc_id for r in stage(spark, docs).collect()] == [0]
    _, near = near_copies.links(docs)
    assert near.count() < 400 * 60


def test_groups_that_a_large_bucket_leaves_apart_are_joined(spark, monkeypatch):
    rnd = random.Random(13)
    rows, ids = [], rnd.sample(range(10**6), 700)
    for f in range(10):
        # each text changes its forerunner a little, so that only neighbours in the chain are alike
        now = [f"f{f}w{k}" for k in range(120)]
        for i in ids[70 * f : 70 * f + 70]:
            now[rnd.randrange(120)] = f"x{i}"
            rows.append((i, " ".join(now)))
    rnd.shuffle(rows)
    # two more chains in the largest group's bucket, and a text so long that its block has no other
    rows += [(10**6 + 1, LONG), (10**6 + 2, LONG + " end")]
    docs = spark.createDataFrame(rows, "id long, text string")
    crowded = spark.createDataFrame([(b, i, len(t.split()) - 4) for i, t in rows for b in (1, 2)], "bucket long, id long, n long")
    known = [(min(p), max(p)) for p in sorted(similar_pairs(rows)) if sum(p) % 3]
    monkeypatch.setattr(near_copies, "BLOCK", 64)
    for near in (known, []):
        got = near_copies.crowded_links(docs, crowded, spark.createDataFrame(near, "a long, b long"))
        found = {(r.a, r.b) for r in got.collect()}
        assert found <= similar_pairs(rows)
        group = {i: i for i, _ in rows}
        for a, b in [*found, *near]:
            old, new = sorted((group[a], group[b]), reverse=True)
            group = {i: new if g == old else g for i, g in group.items()}
        assert {i for i, g in group.items() if i == g} == brute(rows)


def test_odd_rows_keep_their_columns(spark):
    docs = documents(spark, [*ODD, (7, "A b  C")]).selectExpr("*", "1 as id", "2 as n", "'k' as keys")
    got = stage(spark, docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 1, 4, 5, 6, 6, 9]
