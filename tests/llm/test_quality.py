import re
from collections import Counter

from quillmill.llm import quality

from .helpers import LONG, ODD, SF, documents, driver_rows


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def compare(rows, got):
    want = sorted(((i, *brute(t)) for i, t in rows), key=repr)
    assert sorted((tuple(r)[:7] for r in got), key=repr) == want
    assert all(not r.kept for r in got if r.base_failed)
    assert all(r.kept == (r.failed_rule is None) for r in got)


def test_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in driver_rows("documents")]
    compare(rows, quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect())


def test_odd_rows_and_empty_table(spark):
    rows = [*ODD, (20, "a b c " * 2), (21, "a a a a a"), (22, "x\n\n x\nx\nx\n"), (23, "a b c d a b"), (24, LONG + " " + LONG)]
    docs = documents(spark, rows).selectExpr("*", "1 as n_words", "2 as _text", "'k' as kept")
    compare(rows, quality.judge(docs).collect())
    assert quality.judge(documents(spark, [])).count() == 0
    assert quality.filter_documents(docs).columns == docs.columns


def test_order_does_not_change_a_verdict(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = quality.features(docs)
    a = seen.select("doc_id", quality.verdict(quality.rules()).isNull().alias("k"))
    b = seen.select("doc_id", quality.verdict(quality.rules()[::-1]).isNull().alias("k"))
    assert sorted(a.collect()) == sorted(b.collect())


def test_cascade_puts_cheap_strict_rules_first(spark):
    docs = documents(spark, [(i, "few words here") for i in range(50)])
    assert quality.ordered_rules(quality.features(docs), quality.rules())[0].name == "few_words"


def test_of_rules_alike_in_rejection_the_dear_one_comes_later_by_measurement(spark, tmp_path):
    docs = documents(spark, [(i, LONG) for i in range(40)])
    quality.features(docs).write.parquet(f"file://{tmp_path}/sample")
    sample = spark.read.parquet(f"file://{tmp_path}/sample")
    dear = quality.Rule("dear", quality.repeated_words(quality.F.col("_words")) >= 0)
    cheap = quality.Rule("cheap", quality.F.col("n_words") > 0)
    assert [r.name for r in quality.ordered_rules(sample, [dear, cheap])] == ["cheap", "dear"]


def test_sample_reads_few_files(spark, tmp_path):
    documents(spark, [(i, f"text {i}") for i in range(400)]).repartition(20).write.parquet(f"file://{tmp_path}/many")
    text = quality.sampled(spark.read.parquet(f"file://{tmp_path}/many"), rows=1000, files=4)
    assert 0 < text.count() < 140
    assert quality.sampled(spark.read.parquet(f"file://{tmp_path}/many").withColumn("x", quality.F.lit(1)).groupBy("text").count(), 1000, 4).count() == 400


def test_plan_has_no_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df in (quality.judge(docs), quality.filter_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_labelled_documents(spark):
    """Documents labelled good meet no rule beyond the base ones, and those labelled poor go."""
    labels = {r["doc_id"]: r["quality"] for r in driver_rows("labels", "/root/testdata/sf0.01")}
    rows = {r.doc_id: r for r in quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    good = [rows[d].kept or rows[d].base_failed for d, q in labels.items() if q == 1]
    poor = [rows[d].kept for d, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.99 and sum(poor) / len(poor) < 0.05
