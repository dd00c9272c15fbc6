import random

import pytest
import sentencepiece

from quillmill.llm import sp_tokens as sp
from quillmill.llm.queries import SENTENCEPIECE_MODEL

from .helpers import LONG, ODD, documents, driver_rows

DATA = open(SENTENCEPIECE_MODEL, "rb").read()


@pytest.fixture(scope="module")
def codec():
    return sp.Codec(DATA)


def test_model_is_read_as_the_library_reads_it(codec):
    own = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    assert len(codec.model.pieces) == own.get_piece_size()
    for i in range(0, len(codec.model.pieces), 37):
        piece, score, kind = codec.model.pieces[i]
        assert piece == own.id_to_piece(i) and abs(score - own.get_score(i)) < 1e-4 and (kind == sp.BYTE) == own.is_byte(i)
    assert codec.model.unk_id == own.unk_id() and codec.model.byte_fallback


def test_parity_on_random_texts(codec):
    rnd = random.Random(8)
    alphabet = "abc ABC  \n\t.,;-=01éñß你好🙂​▁<s>"
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 60))) for _ in range(2000)] + ["", " ", "  a", "<s></s><0x0A><unk>", "a" * 500, "-" * 300 + " " * 50]
    ids = codec.encode(texts)
    assert ids == codec.library_ids(texts)
    assert [codec.decode(i) for i in ids] == codec.own.decode(ids)


def test_parts_encode_as_the_whole(codec):
    text = ("some words  here\n and   there é🙂 " * 300)[:-1]
    cut = sp.parts(text, codec.model, most=100)
    assert len(cut) > 20 and [i for c in cut for i in codec.encode([c])[0]] == codec.library_ids([text])[0]


def test_documents(spark):
    rows = {r["doc_id"]: r["text"] for r in driver_rows("documents")}
    own = sentencepiece.SentencePieceProcessor(model_proto=DATA)
    got = sp.encode_documents(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), SENTENCEPIECE_MODEL).collect()
    assert sorted(r.doc_id for r in got) == sorted(rows)
    assert all(r.round_trip and r.parity and r.ids == own.encode(rows[r.doc_id]) and r.n_tokens == len(r.ids) for r in got)


def test_odd_rows_and_empty_table(spark):
    docs = documents(spark, [*ODD, (60, LONG * 3)]).selectExpr("*", "1 as ids", "2 as parity")
    got = sp.encode_documents(docs, SENTENCEPIECE_MODEL).collect()
    assert len(got) == len(ODD) + 1
    by = {r.doc_id: r for r in got}
    assert by[1].ids is None and by[1].n_tokens == 0 and by[1].round_trip is None and by[2].ids == []
    assert all(r.round_trip and r.parity for r in got if r.ids is not None)
    assert sp.encode_documents(documents(spark, []), SENTENCEPIECE_MODEL).count() == 0


def test_unigram_models_are_built(codec):
    m = sp.Model(pieces=[("<unk>", 0.0, sp.UNKNOWN), ("▁a", -1.0, sp.NORMAL), ("b", -2.0, sp.NORMAL), ("▁ab", -2.5, sp.NORMAL), ("▁", -3.0, sp.NORMAL)], kind=sp.UNIGRAM)
    t = sp.build(m)
    assert t.encode(" ab  b ").tokens == ["▁ab", "▁", "b"] and t.decode(t.encode("ab b").ids) == "ab b"
