import pytest
from pyspark.sql import functions as F

from quillmill.functions import sentiment as S
from quillmill.functions import text as T
from quillmill.operators import entities as E

LEX = S.DEFAULT_LEXICON
GAZ = "name string, _name string, category string, disabled boolean"


@pytest.fixture
def gaz(spark):
    return spark.createDataFrame([("Paris", "paris", "city", False), ("Paris", "paris", "person", False), ("Rome", "rome", "city", None), ("Hidden", "hidden", "x", True)], GAZ)


def pages(spark, rows, extra=""):
    return spark.createDataFrame(rows, "page_key long, site string, title string, text array<string>" + extra)


def test_sentences(spark):
    text = "Mr. Smith met Dr. Jones. They spoke! J. Doe left? Yes, vs. no. End"
    got = spark.createDataFrame([(text,)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s
    assert got == ["Mr. Smith met Dr. Jones.", "They spoke!", "J. Doe left?", "Yes, vs. no.", "End"]


def test_resolution_and_masking(spark, gaz):
    df = pages(spark, [(1, "s", "Title", ["Paris Good was bad.", "Rome is good. Hidden is here. Nowhere too."])])
    resolved = E.resolve(E.piece_table(E.sentence_table(df), LEX), gaz)
    got = {r.surface: (r.name, r.category, r.is_entity) for r in E.mentions(resolved).collect()}
    assert got["Rome"] == ("Rome", "city", True) and got["Hidden"] == (None, None, False)
    assert got["Paris Good"][2] is False
    scores = {r.sentence_idx: r.score for r in E.sentence_scores(resolved).collect()}
    assert scores[0] == pytest.approx(0.0, abs=1e-9) and scores[2] == pytest.approx(0.995054754, abs=1e-9)


def test_entities_are_left_out_of_the_score_and_candidates_stay_in(spark):
    gaz = spark.createDataFrame([("Good", "good", "x", False)], GAZ)
    df = pages(spark, [(1, "s", None, ["Good was bad."]), (2, "s", None, ["Superb was bad."])])
    scores = {r.page_key: r.score for r in E.sentence_scores(E.resolve(E.piece_table(E.sentence_table(df), LEX), gaz)).collect()}
    assert scores[1] == pytest.approx(-0.995054754, abs=1e-9) and scores[2] == pytest.approx(0.761594156, abs=1e-9)


def test_candidate_modes(spark):
    rows = [(1, "s", i, False, "C", None, None, False, x) for i, x in ((0, 0.9), (1, -0.9))]
    scored = spark.createDataFrame(rows, "page_key long, site string, sentence_idx int, is_title boolean, surface string, name string, category string, is_entity boolean, score double")
    last, mean = E.page_candidates(scored, "last").first(), E.page_candidates(scored, "mean").first()
    assert (last["count"], last.score, last.type) == (1, -0.9, "negative") and (mean["count"], mean.score, mean.type) == (2, 0.0, "neutral")
    with pytest.raises(ValueError):
        E.page_candidates(scored, "other")


def test_suggested_order(spark):
    rows = [(1, True, "A", "A", True), (1, False, "B", "B", True), (1, True, "C", None, False), (1, False, "D", None, False)]
    found = spark.createDataFrame(rows, "page_key long, is_title boolean, surface string, name string, is_entity boolean")
    assert {r.name: r.weight for r in E.weights(found).collect()} == {"A": 4, "B": 2, "C": 2, "D": 1}
    assert E.suggested(found).first().suggested == ["A", "B", "C", "D"]


def test_keywords_count_at_zero_and_highlights_as_mentions(spark, gaz):
    df = pages(spark, [(1, "s", "T", ["Rome is good. see paris here."], ["rome", "none"], ["paris", "Rome", "x", "see paris"])], ", keywords array<string>, highlighted_strings array<string>")
    out, rejects = E.extract(df, gaz, LEX)
    row = out.first()
    ents = {e.name: (e.sentiment["count"], e.sentiment.score) for e in row.entities}
    assert ents["Rome"][0] == 3 and ents["Rome"][1] == pytest.approx(0.995054754 * 2 / 3, abs=1e-8)
    assert ents["Paris"][0] == 1
    assert {c.name for c in row.candidates} == {"see paris"} or "see paris" in {c.name for c in row.candidates}
    assert "Paris" not in row.suggested_entities and rejects.count() == 0


def test_pages_without_text_are_rejected(spark, gaz):
    df = pages(spark, [(1, "s", "T", []), (2, "s", "T", None), (3, "s", "T", ["Some text here."])])
    out, rejects = E.extract(df, gaz, LEX)
    assert [r.page_key for r in out.collect()] == [3] and sorted(r.page_key for r in rejects.collect()) == [1, 2]


def test_sentences_are_cut_by_expressions_that_begin_with_the_stop(spark):
    """Expressions that begin with the word before it are tried at each character, which took ten times as long as the rest."""
    forms = ["dr. mr. x", "Dr. Mr. Prof. A. B. C. D. x", "A. A.A. A. ", "x.  y", "?! z.\n\na . b", "xdr. y _dr. z -dr. q", "é. A. éA. b mrs. mr. x", "", "dr. ", "Mr.  A. B.  x", "a. A.\tB. inc.\tC. Dr. E. prof. ", "mr. A. mr. mr. A. A. A. x"]
    df = spark.createDataFrame([(x,) for x in forms], "t string")
    plain = F.regexp_replace("t", rf"(?i)(^|[^A-Za-z0-9_])({'|'.join(T.ABBREVIATIONS)})\.\s", "$1$2\u0001")
    plain = F.regexp_replace(F.regexp_replace(plain, r"(^|[^A-Za-z0-9_])([A-Z])\.\s", "$1$2\u0001"), r"([.?!])\s+", "$1\u0002")
    got = df.select("t", T.sentences(F.col("t")).alias("s"), F.transform(F.split(plain, "\u0002"), lambda x: F.replace(x, F.lit("\u0001"), F.lit(". "))).alias("p"))
    assert [(r.t, r.s) for r in got.collect()] == [(r.t, r.p) for r in got.collect()]
    plan = got.select("s")._jdf.queryExecution().optimizedPlan().toString()
    assert "(^|" not in plan and "(?i)(" not in plan


def test_extraction_reads_its_mentions_and_cuts_no_text_again(spark, gaz):
    df = pages(spark, [(1, "s", "T", ["Rome is good. see paris here."])])
    plan = E.extract(df, gaz, LEX)[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_keywords_of_entities_come_from_stored_mentions(spark):
    from quillmill.plans import more

    plan = more.entities_with_keywords(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


ODD = ["fooBar isn't Good_x BAD", "badFoo LoVe liKe wİn ÉBad éBad goodÉ", "A good I no X", "Good Bad was sad. sad_ _sad sad1 1sad", "", "no Like", "ǅbad BadÉ ha-Ha HaHa", "A1 b2Good good"]


def test_pieces_in_one_pass_have_the_hits_of_the_cut_sentence(spark):
    """A candidate may begin inside a word and end before an underscore: words end there too."""
    lexicon = {**LEX, "a": 1, "i": 2, "x": -1}
    sents = spark.createDataFrame([(1, "s", i, False, x) for i, x in enumerate(ODD)], "page_key long, site string, sentence_idx int, is_title boolean, sentence string")
    found = E.piece_table(sents, lexicon).collect()
    for i, pieces in enumerate(r.p for r in sents.orderBy("sentence_idx").select(T.pieces(F.col("sentence")).alias("p")).collect()):
        named = [p for k, p in enumerate(pieces) if k % 2 and len(p) >= 2]
        assert [r.piece for r in found if r.sentence_idx == i and r.is_candidate] == named
        rest = "\n".join(p for k, p in enumerate(pieces) if not (k % 2 and len(p) >= 2))
        for text, rows in [(rest, [r for r in found if r.sentence_idx == i and not r.is_candidate]), *((n, [r for r in found if r.sentence_idx == i and r.piece == n][:1]) for n in named)]:
            words = spark.createDataFrame([(text,)], "t string").select(S.words(F.col("t")).alias("w")).first().w
            hits = [lexicon[w] for w in words if w in lexicon]
            assert [(r.hit_sum, r.hit_count) for r in rows] == [(sum(hits), len(hits))], (ODD[i], text)


def test_candidates_alone_have_the_score_of_all_pieces(spark):
    gaz = spark.createDataFrame([("Good", "good", "x", False), ("Bad", "bad", "x", True)], GAZ)
    sents = spark.createDataFrame([(1, "s", i, False, x) for i, x in enumerate([*ODD, "Good was bad. Bad", "Good and Good Bad", "Paris is nice Good"])], "page_key long, site string, sentence_idx int, is_title boolean, sentence string")
    both = [sorted(map(tuple, E.mentions(E.with_sentence_score(E.resolve(table(sents, LEX), gaz))).collect()), key=repr) for table in (E.piece_table, E.candidate_table)]
    assert both[0] == both[1] and len(both[0]) > 10
    assert E.candidate_table(sents, LEX).count() == E.piece_table(sents, LEX).filter("is_candidate").count()


def test_known_names_are_broadcast_before_pieces_are_dealt_out(spark, gaz):
    sents = spark.createDataFrame([(1, "s", 0, False, "Rome is good")], "page_key long, site string, sentence_idx int, is_title boolean, sentence string")
    plan = E.resolve(E.candidate_table(sents, LEX), gaz.unionByName(gaz).distinct())._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_scores_are_found_where_sentences_are_cut(spark):
    gaz = spark.createDataFrame([("Good", "good", "x", False), ("Bad Day", "bad day", "x", False), ("Win", "win", "x", True), ("Paris", "paris", "x", False)], GAZ)
    texts = ["Good was bad. Superb Paris was bad.", "Win and Bad Day. Bad Days, Éfun Joy and love_it, éhope!", "Paris, Rome. GOOD Paris; Good_day is nice.", "Good. Day Good Paris. Nothing here."]
    sents = E.sentence_table(pages(spark, [(i, "s", "Happy Paris", [t]) for i, t in enumerate(texts)]))
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(E.mentions(E.with_sentence_score(E.resolve(E.piece_table(sents, LEX), gaz))))
    got = E.scored_candidates(sents, LEX, gaz)
    assert rows(got) == want and len(want) > 10
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    few = E.scored_candidates(sents, LEX, gaz, most=1)  # two known names hold such words: more than may be loaded
    assert rows(few) == want
    assert "Window" in few._jdf.queryExecution().optimizedPlan().toString()


def test_one_test_for_hits_finds_what_cutting_into_words_finds(spark):
    texts = ["Good", "goods", "a good_day", "égood", "Ha Haha", "hahah", "x-war.", "wars", "", "No", "noé", "\u212aill"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for lex in (LEX, {"no": 1, "not at all": 2, "good": 0}, {"good": 0}):
        got = df.select(S.has_hit(F.col("t"), lex).alias("a"), (F.size(S.hits(F.col("t"), lex)) > 0).alias("b")).collect()
        assert all(bool(r.a) == r.b for r in got)
