from collections import defaultdict

from quillmill.llm import substring_dedup as sd

from .helpers import ODD, documents, driver_rows


def plain_units(text, least=13):
    """Lines and sentences, from positions alone: a line ends after its break, a sentence before the first word after its end."""
    out, at = [], 0
    for line in text.split("\n"):
        line += "\n" if at + len(line) < len(text) else ""
        if len(line.split()) >= least:
            out.append((at, at + len(line), line.split(), False))
            starts = [0] + [k for k in range(1, len(line)) if not line[k].isspace() and line[k - 1].isspace() and line[:k].rstrip()[-1:] in (".", "!", "?")]
            if len(starts) > 1:
                out += [(at + x, at + y, line[x:y].split(), True) for x, y in zip(starts, [*starts[1:], len(line)])]
        at += len(line)
    return [(a, b, " ".join(w).lower(), len(w) if s else 0) for a, b, w, s in out]


def brute(rows, least=13):
    order = lambda i: i if i is not None else 2**63
    first = {}
    for i, t in rows:
        for _, _, form, _ in plain_units(t or "", least):
            first[form] = min(first.get(form, 2**64), order(i))
    out = []
    for i, t in rows:
        body, gone, seen, run = t or "", set(), set(), []
        for a, b, form, words in [*plain_units(body, least), (-1, -1, None, 1)]:
            again = form is not None and (first[form] != order(i) or form in seen)
            if again and not words:
                gone |= set(range(a, b))
            if words and (not again or (run and run[-1][1] != a)):
                if sum(r[2] for r in run) >= 25:
                    gone |= set(range(run[0][0], run[-1][1]))
                run = []
            if again and words:
                run.append((a, b, words))
            seen.add(form)
        out.append((i, t if t is None else "".join(c for k, c in enumerate(body) if k not in gone)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in driver_rows("documents", sf)]
    df = sd.dedup_units(spark.read.parquet(f"{sf}/documents.parquet"), line_words=13).cache()
    assert result(df) == brute(rows)
    texts = defaultdict(set)
    for i, t in rows:
        texts[i].add(t)
    for r in df.collect():
        spans = [tuple(map(int, s.split(":"))) for s in r.kept.split(",") if s]
        assert any("".join(t[a:b] for a, b in spans) == r.text for t in texts[r.doc_id])


def test_odd_rows_and_empty_table(spark):
    words = lambda n, k: " ".join(f"w{n}x{j}" for j in range(k))
    passage = f"This passage has a number of words that are {words(1, 9)}. It goes on for a while, and then some more!  Here it ends at last, my friend."
    rows = [*ODD, (20, passage), (21, "Start of it. " + passage + " End of it."), (22, passage.upper().replace(" A ", " a\t") + f"\nIt is new otherwise and {words(2, 12)} stays here."), (23, passage + "\n" + passage), (None, passage), (None, f"only among rows {words(3, 15)} that have no id"), (None, f"only among rows {words(3, 15)} that have no id"), (25, "\n\n" + passage + "\r\n"), (26, "x " * 50000), (27, f"One short sentence. {words(4, 14)}."), (28, f"One short sentence. {words(5, 14)}."), (29, f"{words(4, 14)}. {words(5, 14)}.")]
    docs = documents(spark, rows).selectExpr("*", "1 as ord", "2 as h1", "'k' as kept", "3 as row")
    df = sd.dedup_units(docs, line_words=13).cache()
    assert result(sd.dedup_units(docs)) == brute(rows, 1)
    assert result(df) == brute(rows)
    got = {r.doc_id: r.text for r in df.collect()}
    assert got[20] == passage and got[21] == "Start of it. End of it." and got[22].startswith("It is new")
    assert got[28].startswith("One short") and got[29] == ""
    assert sd.dedup_units(documents(spark, [])).count() == 0


def test_one_id_of_many_texts_gathers_nothing(spark):
    line = lambda i: " ".join(f"u{i}x{j}" for j in range(20))
    rows = [(1, "\n".join(line(i) for i in range(50)))] + [(None, line(i) + "\n" + line(1000 + i)) for i in range(50)] + [(7, line(i)) for i in range(50)]
    docs = documents(spark, rows)
    gone = sd.removals(docs).collect()
    assert len(gone) == 100 and all(len(r.gone) == 1 for r in gone)
    assert result(sd.dedup_units(docs, line_words=13)) == brute(rows)


def test_units():
    text = "one two three four five six. seven eight nine ten eleven twelve thirteen\nshort\n"
    assert [(a, b, n) for a, b, _, n in sd.units(text, 13)] == [(0, 73, 0), (0, 29, 6), (29, 73, 7)]
    assert list(sd.units("")) == []
