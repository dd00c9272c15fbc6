"""Sentence boundaries from the texts' own counts."""

import math

from quillmill.operators import boundaries as B


def corpus(spark):
    plain = [f"The cat number {w} sat. It slept on the mat of {w} then. Then the dog came home" for w in ("one", "two", "six", "ten")] * 30
    short = [f"We met Dr. Miller and prof. Brown in town. They like cats, e.g. the {w} ones. the rest is not said" for w in ("red", "old", "shy")] * 30
    plain += ["they sat and then in town or home with ones and floors slept said left today and here we are"] * 100
    rows = [(i, t) for i, t in enumerate([*plain, *short])]
    rows += [(9001, "I saw Dr. Miller today. The prof. slept. The 3. floor is \"empty.\" They left! no? Yes."), (9002, None), (9003, " \n\t"), (9004, "one"), (9005, "Ends here."), (9006, "a.b. c")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_abbreviations_are_words_hardly_met_without_a_stop(spark):
    docs = corpus(spark)
    types = B.type_counts(B.tokens(docs.filter("text IS NOT NULL")))
    got = {r.type: r for r in B.abbreviations(types).collect()}
    assert {"dr", "prof", "e.g"} <= set(got) and not {"sat", "then", "town", "home"} & set(got)
    total = {r["type"]: r for r in types.collect()}
    n, stops = sum(r.n for r in total.values()), sum(r.n_stop for r in total.values())
    r = total["e.g"]
    ll = 2 * (r.n_stop * math.log(0.99) + (r.n - r.n_stop) * math.log(0.01) - r.n_stop * math.log(stops / n) - (r.n - r.n_stop) * math.log(1 - stops / n))
    assert math.isclose(got["e.g"].score, ll * math.exp(-2) * 2 * 2.0 ** (r.n_stop - r.n), rel_tol=1e-9)


def test_sentences(spark):
    got = {r.doc_id: r.sentences for r in B.sentences(corpus(spark)).collect()}
    assert got[0] == ["The cat number one sat.", "It slept on the mat of one then.", "Then the dog came home"]
    assert got[220] == ["We met Dr. Miller and prof. Brown in town.", "They like cats, e.g. the red ones.", "the rest is not said"]
    assert got[9001][:2] == ["I saw Dr. Miller today.", "The prof. slept."] and got[9001][-2:] == ["no?", "Yes."]
    assert got[9002] == got[9003] == [] and got[9004] == ["one"] and got[9005] == ["Ends here."]


def test_no_texts(spark):
    none = corpus(spark).limit(0)
    assert B.sentences(none).count() == 0 == B.breaks(none).count()
    assert [r.sentences for r in B.sentences(corpus(spark).filter("text IS NULL")).collect()] == [[]]


def test_only_words_that_may_end_a_sentence_are_stored(spark, monkeypatch):
    stored = {}
    monkeypatch.setattr(B, "materialize", lambda df, what: stored.setdefault(what, df))
    rows = [(1, "One two (three.) four! \"five\" six"), (2, "seven?"), (3, None)]
    B.breaks(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id, r.pos, r.word, r.next) for r in stored["tokens"].collect()) == [(1, 2, "three.", "four!"), (1, 3, "four!", "five")]
    assert sum(r.n for r in stored["types"].collect()) == 7
