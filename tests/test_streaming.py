import pytest
from pyspark.sql import functions as F

from quillmill.operators import rollup
from quillmill.streaming import jobs


@pytest.fixture
def stream_dir(spark, tmp_path):
    """Page entities in five files, in order of arrival."""
    rows = [("s", f"n{i % 3}", i, 1 + i % 2, [0.5, 0.0, -0.25, 0.9][i % 4]) for i in range(50)]
    df = spark.createDataFrame(rows, "site string, name string, ord long, count long, score double")
    for k in range(5):
        df.filter(f"ord >= {k * 10} and ord < {k * 10 + 10}").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    return df, f"file://{tmp_path}/in", tmp_path


def test_rollup_of_batches_is_the_rollup_of_all(spark, stream_dir):
    df, path, tmp = stream_dir
    empty = spark.createDataFrame([], "site string, name string, _name string, count long, sentiment double")
    table = jobs.Table(spark, f"file://{tmp}/site_entities", empty)
    stream = jobs.stream_parquet(spark, path, df.schema, files_per_batch=1)
    jobs.start(stream, jobs.merge_site_entities(table), f"file://{tmp}/ck").awaitTermination(120)
    # a fold in order of arrival: each batch after the last
    got = {(r.site, r.name): (r["count"], round(r.sentiment, 9)) for r in table.read().collect()}
    want = {(r.site, r.name): (r["count"], round(r.sentiment, 9)) for r in rollup.fold_entities(df).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert len(table._versions()) == 5


def test_a_replayed_batch_changes_nothing(spark, stream_dir):
    df, _, tmp = stream_dir
    empty = spark.createDataFrame([], "site string, name string, _name string, count long, sentiment double")
    table = jobs.Table(spark, f"file://{tmp}/cands", empty)
    each = jobs.merge_site_candidates(table)
    each(df.filter("ord < 25"), 0)
    each(df.filter("ord >= 25"), 1)
    once = sorted(map(tuple, table.read().collect()))
    each(df.filter("ord >= 25"), 1)
    assert sorted(map(tuple, table.read().collect())) == once
    want = sorted(map(tuple, rollup.fold_candidates(df).collect()))
    assert [(w[0], w[1], w[3], round(w[4], 9)) for w in want] == [(o[0], o[1], o[3], round(o[4], 9)) for o in once]


def test_daily_counts_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("user_id").cast("long").alias("crawler_id"), F.col("ts").cast("timestamp").alias("ts"))
    events.repartition(3).write.parquet(f"file://{tmp_path}/ev")
    stream = jobs.with_event_time(jobs.stream_parquet(spark, f"file://{tmp_path}/ev", events.schema))
    q = jobs.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = events.groupBy(F.date_trunc("day", "ts").alias("day"), "crawler_id").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, spark.table("daily").collect())) == sorted(map(tuple, want.collect()))


def test_pages_are_seen_once(spark, tmp_path):
    rows = [(f"u{i % 7}", f"2024-01-01 00:0{i % 10}:00") for i in range(30)]
    spark.createDataFrame(rows, "url string, t string").select("url", F.col("t").cast("timestamp").alias("ts")).write.parquet(f"file://{tmp_path}/pages")
    schema = "url string, ts timestamp"
    stream = jobs.unseen_pages(jobs.with_event_time(jobs.stream_parquet(spark, f"file://{tmp_path}/pages", schema)))
    q = stream.writeStream.outputMode("append").format("memory").queryName("unseen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.url for r in spark.table("unseen").collect()) == [f"u{i}" for i in range(7)]


def test_a_crawl_step_saves_pages_rollup_and_queue(spark, tmp_path):
    pages = spark.createDataFrame([("u1", 1, "A"), ("u2", 2, "A"), ("u1", 3, "B")], "url string, crawled_at long, name string")
    store = jobs.Table(spark, f"file://{tmp_path}/pages", spark.createDataFrame([], pages.schema))
    ents = jobs.Table(spark, f"file://{tmp_path}/ents", spark.createDataFrame([], "site string, name string, _name string, count long, sentiment double"))
    extract = lambda b: b.select(F.lit("s").alias("site"), "name", F.col("crawled_at").alias("ord"), F.lit(1).cast("long").alias("count"), F.lit(0.5).alias("score"))
    step = jobs.save_job(store, ents, f"file://{tmp_path}/queue", extract)
    step(pages.limit(2), 0)
    step(pages, 1)
    step(pages, 1)
    assert sorted((r.url, r.crawled_at) for r in store.read().collect()) == [("u1", 3), ("u2", 2)]
    assert {r.name: r["count"] for r in ents.read().collect()} == {"A": 4, "B": 1}
    assert spark.read.parquet(f"file://{tmp_path}/queue").count() == 5
