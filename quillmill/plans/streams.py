"""Queries that run as streams to the end of a table and give what their sinks then hold, each with an independent SQL form over the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.storage import new_path
from quillmill.streaming import jobs, schedule

from . import tables as D
from .queries import query

#: Runs of each stream; every run begins again from the checkpoint of the one before.
RUNS = 3


def replayed(df: DataFrame, transform: Callable[[DataFrame], DataFrame], partition: str | None = None, runs: int = RUNS, time: str = "ts") -> DataFrame:
    """What the stream's sink holds after all rows of df came in `runs` shares by time, and the query stopped after each share and began again."""
    spark = df.sparkSession
    source, sink, checkpoint = (new_path(spark, f"stream-{x}") for x in ("source", "sink", "checkpoint"))
    lo, hi = df.agg(F.min(F.unix_micros(time)), F.max(F.unix_micros(time))).first()
    at = F.floor(F.lit(runs) * (F.unix_micros(time) - F.lit(lo)) / F.lit((hi or 0) - (lo or 0) + 1))
    for i in range(runs):
        df.filter(at == i).write.mode("append").parquet(source)
        schedule.started(transform(jobs.stream_parquet(spark, source, df.schema)), sink, checkpoint, partition).awaitTermination()
    return spark.read.parquet(sink)


@query("""WITH l AS (SELECT user_id, list(epoch_us(ts) ORDER BY ts) AS t FROM events GROUP BY user_id)
SELECT user_id::BIGINT AS crawler_id, unnest(list_reduce(list_prepend([t[1]], list_transform(t[2:], lambda x: [x])), lambda a, x: CASE WHEN x[1] - a[-1] >= 86400000000 THEN list_concat(a, x) ELSE a END)) AS accepted_us FROM l""")
def frequency_gate_stream(spark, sf_dir):
    visits = D.visits(spark, sf_dir).select("crawler_id", "ts")
    return replayed(visits, lambda s: schedule.frequency_gate(s, 86_400)).select("crawler_id", F.unix_micros("ts").alias("accepted_us"))


@query("SELECT event_id, event_type AS queue, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) <= 41 AS let_through FROM events")
def daily_quota_stream(spark, sf_dir):
    """Let through and put back, together all rows."""
    items = D.read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("queue"), F.col("ts").cast("timestamp").alias("ts"))
    return replayed(items, lambda s: schedule.daily_quota(s, 40, order="event_id"), "let_through").select("event_id", "queue", F.col("let_through").cast("boolean").alias("let_through"))


#: One step of a crawler's state for each row, in three places: a setting due before its return, the return, a setting due after it.
_POOL = """
WITH RECURSIVE v AS (SELECT user_id::BIGINT AS c, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 WHEN 'purchase' THEN -1 END AS x FROM events),
z AS (SELECT max(us) - 1000000 AS h FROM v),
r AS (SELECT c, us, x, false AS fin, row_number() OVER (PARTITION BY c ORDER BY us, x IS NOT NULL, x) AS n FROM v UNION ALL SELECT c, any_value(h), NULL, true, count(*) + 1 FROM v, z GROUP BY c),
s(c, n, st, la, bk, se, sa, a_at, a_st, b_at, b_st, c_at, c_st, p_at) AS (
  SELECT DISTINCT c, 0::BIGINT, 1, NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::BIGINT, NULL::BIGINT, NULL::INTEGER, NULL::BIGINT, NULL::INTEGER, NULL::BIGINT, NULL::INTEGER, NULL::BIGINT FROM v
  UNION ALL
  SELECT c, n, CASE WHEN pause THEN 2 ELSE st END, CASE WHEN visit AND NOT pause THEN us ELSE la END,
         CASE WHEN pause THEN ((la + 86400000000 + 59999999) // 60000000) * 60000000 ELSE bk END,
         CASE WHEN x IS NOT NULL THEN x ELSE se END, CASE WHEN x IS NOT NULL THEN ((us + 59999999) // 60000000) * 60000000 ELSE sa END,
         a_at, a_st, b_at, b_st, c_at, c_st, CASE WHEN pause THEN us END
  FROM (SELECT *, x IS NULL AND NOT fin AND st = 1 AS visit, x IS NULL AND NOT fin AND st = 1 AND la IS NOT NULL AND us - la < 86400000000 AS pause
  FROM (SELECT * REPLACE (CASE WHEN doc THEN coalesce(c_st, st) ELSE st END AS st, CASE WHEN c_st <> 1 THEN NULL ELSE bk END AS bk, CASE WHEN doc THEN NULL ELSE se END AS se, CASE WHEN doc THEN NULL ELSE sa END AS sa)
  FROM (SELECT *, CASE WHEN doc AND (CASE WHEN se = 1 THEN st IN (0, -1) ELSE se <> st END) THEN se END AS c_st, CASE WHEN doc AND (CASE WHEN se = 1 THEN st IN (0, -1) ELSE se <> st END) THEN sa END AS c_at
  FROM (SELECT *, coalesce(sa <= us, false) AS doc
  FROM (SELECT * REPLACE (CASE WHEN dob THEN 1 ELSE st END AS st, CASE WHEN dob THEN bk ELSE la END AS la, CASE WHEN dob THEN NULL ELSE bk END AS bk), CASE WHEN dob THEN bk END AS b_at, CASE WHEN dob THEN 1 END AS b_st
  FROM (SELECT *, coalesce(bk <= us, false) AS dob
  FROM (SELECT * REPLACE (coalesce(a_st, st) AS st, CASE WHEN a_st <> 1 THEN NULL ELSE bk END AS bk, CASE WHEN doa THEN NULL ELSE se END AS se, CASE WHEN doa THEN NULL ELSE sa END AS sa)
  FROM (SELECT *, CASE WHEN doa AND (CASE WHEN se = 1 THEN st IN (0, -1) ELSE se <> st END) THEN se END AS a_st, CASE WHEN doa AND (CASE WHEN se = 1 THEN st IN (0, -1) ELSE se <> st END) THEN sa END AS a_at
  FROM (SELECT r.c, r.n, r.us, r.x, r.fin, s.st, s.la, s.bk, s.se, s.sa, coalesce(s.sa <= r.us AND (s.bk IS NULL OR s.sa <= s.bk), false) AS doa FROM s JOIN r ON r.c = s.c AND r.n = s.n + 1))))))))))
SELECT crawler_id, at_us, crawling_status FROM (
  SELECT c AS crawler_id, a_at AS at_us, a_st AS crawling_status FROM s UNION ALL SELECT c, b_at, b_st FROM s UNION ALL SELECT c, c_at, c_st FROM s UNION ALL SELECT c, p_at, 2 FROM s), z
WHERE at_us IS NOT NULL AND at_us <= h
"""


@query(_POOL)
def pool_history(spark, sf_dir):
    """Sign-ups enable a crawler, errors stop it, purchases stop its site, views and clicks are visits; changes up to the last watermark."""
    setting = F.expr("CASE event_type WHEN 'signup' THEN 1 WHEN 'error' THEN 0 WHEN 'purchase' THEN -1 END")
    events = D.read(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").cast("long").alias("crawler_id"), F.col("ts").cast("timestamp").alias("ts"), setting.cast("int").alias("setting"))
    horizon = rows.agg((F.max(F.unix_micros("ts")) - 1_000_000).alias("h"))
    history = replayed(rows, lambda s: schedule.pool_history(s, 86_400))
    return history.join(F.broadcast(horizon), F.col("at_us") <= F.col("h")).drop("h")
