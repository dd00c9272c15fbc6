import numpy as np

from quillmill.llm import decontamination as dc

from .helpers import LONG, ODD, documents, driver_rows


def brute(docs, items):
    out = []
    forms = [(i, dc.normal_words(t)) for i, t in docs]
    for item_id, text in items:
        words = dc.normal_words(text)
        if not words:
            continue
        width = min(5, len(words))
        own = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
        for i, d in forms:
            n = len(own & {tuple(d[k : k + width]) for k in range(len(d) - width + 1)})
            if n >= 0.8 * len(own):
                out.append((i, item_id, len(own), n, n / len(own)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    pairs = lambda name, key: [(r[key], r["text"]) for r in driver_rows(name, sf)]
    got = result(dc.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")))
    assert got == brute(pairs("documents", "doc_id"), pairs("benchmark", "item_id")) and got


def test_odd_rows_and_empty_tables(spark):
    item = "The quick, brown fox jumps over the lazy dog and runs away from all of them today"
    words = item.split()
    items = [(1, item), (1, item), (2, "two words"), (3, None), (4, ""), (5, "*** !!"), (None, "an item without any id of its own"), (7, "w5 the w6 the w7 the w8 the w9 the w10"), (8, " ".join(f"k{i}" for i in range(3000)))]
    half = " ".join(words[:9]) + " something else here " + " ".join(words[5:])
    rows = [*ODD, (20, item.upper()), (21, LONG + " " + item + " " + LONG), (22, half), (23, " ".join(words[:8])), (24, "there are Two words! in it"), (25, "an item without any id of its own"), (25, "an item without any id of its own"), (26, "x " + items[-1][1])]
    docs = documents(spark, rows).selectExpr("*", "1 as item_id", "2 as n_matched")
    bench = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    want = brute(rows, items)
    assert result(dc.leaks(docs, bench)) == want
    clean = dc.clean_documents(docs, bench)
    bad = {r[0] for r in want}
    assert sorted((r.doc_id for r in clean.collect()), key=repr) == sorted((i for i, _ in rows if i not in bad), key=repr) and clean.columns == docs.columns
    assert result(dc.leaks(docs, bench, rows=0)) == want
    joined = dc.clean_documents(docs, bench, rows=0)
    assert sorted(map(repr, joined.collect())) == sorted(map(repr, clean.collect())) and joined.columns == docs.columns
    assert dc.leaks(documents(spark, []), bench, rows=0).count() == 0
    assert dc.leaks(documents(spark, []), bench).count() == 0
    assert dc.leaks(docs, bench.limit(0)).count() == 0 and dc.clean_documents(docs, bench.limit(0)).count() == len(rows)


def test_more_items_than_go_to_all_tasks_are_joined(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    assert dc.small_index(items, rows=3) is None
    got = result(dc.leaks(docs, items, rows=3))
    assert got == result(dc.leaks(docs, items)) and got


def test_recall_at_the_threshold_when_joined(spark):
    rng = np.random.default_rng(4)
    docs, items = [], []
    for trial in range(60):
        item = [f"w{x}" for x in rng.integers(0, 5000, 5 + int(rng.integers(4, 60)))]
        keep = -(-(len(item) - 4) * 8 // 10) + 4
        doc, at = [f"w{x}" for x in rng.integers(0, 5000, 1000)], int(rng.integers(0, 1000))
        doc[at:at] = item[:keep]
        docs.append((trial, " ".join(doc)))
        items.append((trial, " ".join(item)))
    got = dc.leaks(documents(spark, docs), spark.createDataFrame(items, "item_id long, text string"), rows=0)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(i, i) for i in range(60)]


def test_recall_at_the_threshold():
    """Scattered and contiguous passages of just 0.8, in long random documents."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    missed = 0
    for trial in range(150):
        item = list(rng.choice(vocabulary, 5 + int(rng.integers(4, 60))))
        n = len(item) - 4
        keep = -(-n * 8 // 10) + 4
        at = int(rng.integers(0, 3000))
        doc = list(rng.choice(vocabulary, 3000))
        doc[at:at] = item[:keep]
        index = dc.Index(dc.items_of([(1, " ".join(item))]))
        missed += not list(index.matches([" ".join(doc)], dc.WordHashes(), 0.8))
    assert missed == 0
