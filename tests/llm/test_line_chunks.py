from collections import defaultdict

import xxhash

from quillmill.llm import line_chunks

from .helpers import ODD, SF, documents, driver_rows

M = (1 << 64) - 1


def brute_chunks(text):
    lines = (text or "").split("\n")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        r = h[i]
        if i:
            r ^= (h[i - 1] << 1 | h[i - 1] >> 63) & M
        if i == len(lines) - 1 or r % 4 == 0:
            if i + 1 - start >= 2:
                out.append((start, i + 1, "\n".join(lines[start : i + 1])))
            start = i + 1
    return out


def brute(rows):
    places = defaultdict(set)
    order = lambda i: i if i is not None else 2**63
    for i, t in rows:
        for a, _, c in brute_chunks(t):
            places[c].add((order(i), a))
    n = defaultdict(int)
    for i, t in rows:
        for _, _, c in brute_chunks(t):
            n[c] += 1
    out = []
    for i, t in rows:
        gone = [(a, b) for a, b, c in brute_chunks(t) if (order(i), a) != min(places[c])]
        lines = (t or "").split("\n")
        kept = "\n".join(x for k, x in enumerate(lines) if not any(a <= k < b for a, b in gone))
        out.append((i, t if not gone else kept, len(gone), sum(b - a for a, b in gone), ",".join(f"{a}:{b}" for a, b in gone)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in driver_rows("documents", sf)]
    want = brute(rows)
    assert result(line_chunks.line_dedup(spark.read.parquet(f"{sf}/documents.parquet"))) == want
    assert sum(r[2] for r in want) > 0


def test_odd_rows_and_empty_table(spark):
    block = "\n".join(f"line {i} of the shared passage" for i in range(40))
    rows = [*ODD, (20, block), (21, "x\n" + block), (22, block + "\ny\nz"), (23, block + "\nq\n" + block), (23, block + "\nq\n" + block), (None, block), (30, "\n\n\n"), (31, "\n\n\n"), (32, "a\r\nb\r\n")]
    docs = documents(spark, rows).selectExpr("*", "1 as digest", "2 as _h", "'c' as chunk", "3 as start")
    assert result(line_chunks.line_dedup(docs)) == brute(rows)
    assert line_chunks.line_dedup(documents(spark, [])).count() == 0
    clean = line_chunks.clean_documents(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    assert all(r.n_chars == len(r.text or "") for r in clean.collect())


def test_boundaries_resist_shifts():
    lines = [f"text line number {i * 7919 % 104729}" for i in range(400)]
    a = {c for _, _, c in brute_chunks("\n".join(lines))}
    b = {c for _, _, c in brute_chunks("\n".join([*lines[:100], "an inserted line", *lines[100:]]))}
    assert len(a - b) <= 2


def test_a_digest_of_two_texts_removes_nothing(spark):
    every = spark.createDataFrame([(1, 9, 3, "x\ny"), (2, 9, 3, "x\nz"), (3, 9, 3, "x\ny"), (4, 8, 3, "p\nq"), (5, 8, 3, "p\nq")], "_place long, digest long, n_bytes int, chunk string")
    assert [r.digest for r in line_chunks.repeated_chunks(every).collect()] == [8]


def test_plan_has_no_python(spark):
    plan = line_chunks.line_dedup(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
