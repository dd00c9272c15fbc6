import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmill.functions import sentiment as S

GOLDEN = [
    ("Paris was superb and good.", 0.999329300, "positive"),
    ("London was bad.", -0.995054754, "negative"),
    ("Rome is a disaster, a terrible loss", -0.990390494, "negative"),
    ("A table.", 0.0, "neutral"),
    ("good bad", 0.0, "neutral"),
    ("not good", 0.995054754, "positive"),
    ("cover-up", 0.0, "neutral"),
    ("naïve plan", 0.0, "neutral"),
    ("", 0.0, "neutral"),
    ("GOOD_ good", 0.995054754, "positive"),
]


def classify(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("h", S.hits(F.col("t"), S.DEFAULT_LEXICON))
    total, count = S.hit_totals(F.col("h"), S.DEFAULT_LEXICON)
    scored = df.select("i", total.alias("t"), count.alias("n")).withColumn("s", S.score_of(F.col("t"), F.col("n"))).withColumn("k", S.kind_of(F.col("s")))
    return [(r.s, r.k) for r in scored.orderBy("i").collect()]


def test_golden(spark):
    for (text, score, kind), got in zip(GOLDEN, classify(spark, [g[0] for g in GOLDEN])):
        assert got[0] == pytest.approx(score, abs=1e-9) and got[1] == kind, text


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from([*S.DEFAULT_LEXICON, "table", "the"]), max_size=30).map(" ".join), min_size=1, max_size=20))
def test_score_is_the_curve_of_the_mean(spark, texts):
    for text, (score, kind) in zip(texts, classify(spark, texts)):
        found = [S.DEFAULT_LEXICON[w] for w in text.split() if S.DEFAULT_LEXICON.get(w)]
        want = math.tanh(sum(found) / len(found)) if found else 0.0
        assert score == pytest.approx(want, abs=2e-9) and -1 <= score <= 1
        assert kind == ("positive" if score > 0 else "negative" if score < 0 else "neutral")


def test_no_join_and_no_shuffle(spark):
    df = spark.createDataFrame([("good",)], "t string").withColumn("h", S.hits(F.col("t"), S.DEFAULT_LEXICON))
    plan = df.select(*S.hit_totals(F.col("h"), S.DEFAULT_LEXICON))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_a_lexicon_file_is_read(spark, tmp_path):
    from quillmill.sources.web import read_lexicon

    (tmp_path / "words.tsv").write_text("good\t3\nnot good\t-2\n\"odd\t1\n")
    assert read_lexicon(spark, f"file://{tmp_path}/words.tsv") == {"good": 3, "not good": -2, '"odd': 1}
