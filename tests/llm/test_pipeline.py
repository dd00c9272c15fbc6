import re

import sentencepiece

import corpus_pipeline
from quillmill.llm.queries import SENTENCEPIECE_MODEL

from . import test_decontamination, test_line_runs, test_near_copies, test_quality
from .helpers import ODD, documents, driver_rows

SF = "/root/testdata/sf0.001"


def good(text):
    text = text or ""
    n, chars, symbols, dup, _, failed = test_quality.brute(text)
    letters = re.findall(r"[^\W\d_]", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return not (failed or symbols * 10 > n * 3 or 2 * sum(c.isupper() for c in letters) > len(letters) or chars < 2 * n or chars > 20 * n or 2 * dup > len(lines))


def brute(rows, items):
    rows = [(i, t) for i, t in rows if good(t)]
    rows = [(r[0], r[1]) for r in test_line_runs.brute(rows)]
    stays = test_near_copies.brute(rows)
    rows = [(i, t) for i, t in rows if i in stays]
    leaks = {r[0] for r in test_decontamination.brute(rows, items)}
    own = sentencepiece.SentencePieceProcessor(model_file=SENTENCEPIECE_MODEL)
    return sorted((i, own.encode(t)) for i, t in rows if i not in leaks)


def test_run(spark):
    rows = [(r["doc_id"], r["text"]) for r in driver_rows("documents")]
    items = [(r["item_id"], r["text"]) for r in driver_rows("benchmark")]
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == brute(rows, items)
    assert all(r.round_trip and r.parity for r in got)
    assert 0 < len(got) < len(rows)


def test_stages_return_the_columns_of_documents_and_take_odd_rows(spark):
    docs = documents(spark, ODD).selectExpr("*", "1 as _doc", "'x' as _words", "2 as fp", "3 as item_id")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(ODD)


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
