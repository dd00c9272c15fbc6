"""Reports as files: in order, all or nothing, replaced at once."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillmill.sources import report_sink as R

HEADER = ["Site report for:", "", "Word, Sentiment, count"]


def report(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = [(f"name {rnd.randrange(10**6)} é", kind, i) for i in range(n) for kind in ("positive", "neutral")]
    return spark.createDataFrame(rows, "entity string, sentiment string, count long").repartition(5), rows


def lines(spark, path):
    return [r.line for r in R.read_report(spark, path).orderBy("pos").collect()]


def expected(rows):
    return HEADER + [f"{e}|{s}|{n}" for e, s, n in sorted(sorted(rows, key=lambda r: r[1]), key=lambda r: r[0].encode(), reverse=True)]


def test_lines_come_back_in_order(spark, tmp_path):
    df, rows = report(spark, 300)
    R.write_report(df, HEADER, f"{tmp_path}/r", parts=4)
    assert lines(spark, f"{tmp_path}/r") == expected(rows)
    assert len([f for _, _, fs in os.walk(tmp_path) for f in fs if f.startswith("part-")]) == 4
    df, rows = report(spark, 20, seed=2)
    R.write_report(df, HEADER, f"file://{tmp_path}/r", parts=2)
    assert lines(spark, f"{tmp_path}/r") == expected(rows)
    assert len([f for _, _, fs in os.walk(tmp_path) for f in fs if f.startswith("part-")]) == 2


def test_a_failed_write_leaves_nothing_to_see(spark, tmp_path):
    df, rows = report(spark, 50)
    bad = df.withColumn("count", F.when(F.col("count") == 33, F.raise_error(F.lit("broken row"))).otherwise(F.col("count")))
    with pytest.raises(Exception, match="broken row"):
        R.write_report(bad, HEADER, f"{tmp_path}/new", parts=3)
    with pytest.raises(Exception, match="no whole report"):
        lines(spark, f"{tmp_path}/new")
    assert [f for _, _, fs in os.walk(f"{tmp_path}/new") for f in fs] == []
    R.write_report(df, HEADER, f"{tmp_path}/old", parts=3)
    with pytest.raises(Exception, match="broken row"):
        R.write_report(bad, HEADER, f"{tmp_path}/old", parts=3)
    assert lines(spark, f"{tmp_path}/old") == expected(rows)


def test_odd_reports(spark, tmp_path):
    empty = report(spark, 1)[0].limit(0)
    R.write_report(empty, HEADER, f"{tmp_path}/e")
    assert lines(spark, f"{tmp_path}/e") == HEADER
    odd = spark.createDataFrame([("a\nb", None, 1), (None, "neutral", None)], "entity string, sentiment string, count long")
    R.write_report(odd, [], f"{tmp_path}/o", parts=1)
    assert lines(spark, f"{tmp_path}/o") == ["a b|1", "neutral"]


def test_report_file_extracts_once(spark, monkeypatch):
    from quillmill.plans import queries as Q

    runs, extracted = [], Q._extracted
    monkeypatch.setattr(Q, "_extracted", lambda *a: runs.append(a) or extracted(*a))
    assert Q.report_file(spark, "/root/testdata/sf0.001").count() > 16 and len(runs) == 1
