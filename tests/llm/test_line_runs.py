import random

from quillmill.llm import line_chunks
from quillmill.llm.queries import QUERIES

from . import test_line_chunks
from .helpers import ODD, SF, documents, driver_rows


def brute(rows):
    """Lines of each pair of lines in a row that occurs earlier, without overlapping its first occurrence there."""
    order = lambda i: i if i is not None else 2**63 - 1
    pairs = lambda t: list(zip((x := (t or "").split("\n")), x[1:], strict=False))
    first = {}
    for i, t in rows:
        for k, p in enumerate(pairs(t)):
            first[p] = min(first.get(p, (order(i), k)), (order(i), k))
    out = []
    for i, t in rows:
        lines, gone = (t or "").split("\n"), set()
        for k, p in enumerate(pairs(t)):
            if first[p] != (order(i), k) and not (p[0] == p[1] and (order(i), k - 1) == first[p]):
                gone |= {k, k + 1}
        ranges = []
        for k in sorted(gone):
            if ranges and ranges[-1][1] == k:
                ranges[-1][1] = k + 1
            else:
                ranges.append([k, k + 1])
        kept = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else t
        out.append((i, kept, len(ranges), len(gone), ",".join(f"{a}:{b}" for a, b in ranges)))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_query_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in driver_rows("documents", sf)]
    want = brute(rows)
    assert result(QUERIES["op3_line_chunks"](spark, sf)) == want
    lines = lambda found: {(i, k) for i, _, _, _, spans in found for s in spans.split(",") if s for k in range(*map(int, s.split(":")))}
    assert lines(want) > lines(test_line_chunks.brute(rows))


def test_planted_runs_go_whole_wherever_they_start(spark):
    rnd = random.Random(4)
    line = lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(30))
    rows, planted = [], {}
    for i in range(0, 120, 2):
        passage = [line() for _ in range(2 + i % 3)]
        before = [line() for _ in range(rnd.randrange(6))]
        rows.append((i, "\n".join([line(), *passage, line()])))
        rows.append((i + 1, "\n".join([*before, *passage, line(), line()])))
        planted[i + 1] = f"{len(before)}:{len(before) + len(passage)}"
    got = {r.doc_id: r.removed for r in line_chunks.line_dedup(documents(spark, rows), whole=True).collect()}
    assert got == {i: planted.get(i, "") for i, _ in rows}


def test_odd_rows_and_empty_table(spark):
    block = "\n".join(f"line {i} of the shared passage" for i in range(40))
    rows = [*ODD, (20, block), (21, "x\n" + block), (23, block + "\nq\n" + block), (23, block + "\nq\n" + block), (None, block), (30, "a\na\na"), (31, "b\nb\nb\nb\nb"), (32, "a\r\nb\r\n")]
    docs = documents(spark, rows).selectExpr("*", "1 as h", "2 as _h", "'c' as line", "3 as start")
    assert result(line_chunks.line_dedup(docs, whole=True)) == brute(rows)
    assert line_chunks.line_dedup(documents(spark, []), whole=True).count() == 0
    clean = line_chunks.clean_documents(docs, whole=True)
    assert clean.columns == docs.columns and all(r.n_chars == len(r.text or "") for r in clean.collect())


def test_a_hash_of_two_lines_is_ambiguous(spark):
    lines = spark.createDataFrame([(9, "x"), (9, "y"), (9, "x"), (8, "z"), (8, "z")], "h long, line string")
    assert [r.h for r in line_chunks.ambiguous(lines).collect()] == [9]


def test_plan_has_no_python(spark):
    plan = QUERIES["op3_line_chunks"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_whole_runs_come_with_the_chunks_of_the_rolling_hash(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nc\nd\ne")], "doc_id long, text string")
    asked, rolling = [], line_chunks.rolling
    monkeypatch.setattr(line_chunks, "rolling", lambda *a: asked.append(a) or rolling(*a))
    got = {r.doc_id: r.text for r in line_chunks.line_dedup(docs, whole=True).collect()}
    assert asked and got == {1: "a\nb\nc\nd\ne", 2: "x\ny", 3: ""}
