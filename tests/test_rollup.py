import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillmill.operators import rollup as U

ROWS = "site string, name string, ord long, count long, score double"


def fold(rows):
    out = {}
    for site, name, _, n, x in sorted(rows, key=lambda r: r[2]):
        if (site, name) not in out:
            out[site, name] = (n, x)
        else:
            c, s = out[site, name]
            out[site, name] = (c + n, (s * c + x * n) / (c + n) if x else s)
    return out


def test_golden_fold(spark):
    df = spark.createDataFrame([("s", "A", 1, 1, 0.5), ("s", "A", 2, 2, 0.0), ("s", "A", 3, 1, -0.5)], ROWS)
    entity, candidate = U.fold_entities(df).first(), U.fold_candidates(df).first()
    assert entity["count"] == 4 and entity.sentiment == pytest.approx(0.25)
    assert candidate["count"] == 4 and candidate.sentiment == pytest.approx(0.0)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from("XY"), st.integers(1, 9), st.sampled_from([0.0, 0.5, -0.25, 0.9])), min_size=1, max_size=40), st.integers(0, 40))
def test_fold_is_the_fold_and_merging_batches_gives_the_same(spark, rows, cut):
    rows = [(s, n, i, c, x) for i, (s, n, c, x) in enumerate(rows)]
    want = fold(rows)
    df = spark.createDataFrame(rows, ROWS)
    merged = U.merge_entities(U.fold_entities(df.filter(f"ord < {cut}")), df.filter(f"ord >= {cut}"))
    for got in (U.fold_entities(df), merged):
        got = {(r.site, r.name): (r["count"], r.sentiment) for r in got.collect()}
        assert got.keys() == want.keys()
        for k, (c, s) in want.items():
            assert got[k][0] == c and got[k][1] == pytest.approx(s, abs=1e-12)


def stats(spark, n, count):
    return spark.createDataFrame([("s", f"n{i:03}", f"n{i:03}", count, i / 100) for i in range(n)], "site string, name string, _name string, count long, sentiment double")


def test_threshold_and_top(spark):
    assert U.min_counts(stats(spark, 50, 7)).first().min_count == 7
    assert U.min_counts(stats(spark, 50, 25)).first().min_count == 10
    assert U.min_counts(stats(spark, 0, 1)).count() == 0
    rows = U.site_stats(stats(spark, 50, 12), stats(spark, 3, 1)).collect()
    kinds = {k: [r.name for r in sorted(rows, key=lambda r: r.rank) if r.kind == k] for k in ("entities", "candidates", "positive", "negative")}
    assert [len(kinds[k]) for k in kinds] == [40, 3, 40, 40]
    assert kinds["positive"][0] == "n049" and kinds["negative"][0] == "n000"
    assert U.site_stats(stats(spark, 0, 1), stats(spark, 3, 1)).count() == 0


def test_top_k_is_cut_before_the_shuffle(spark):
    plan = U.top_by_count(stats(spark, 50, 7))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1
