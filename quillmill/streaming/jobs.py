"""The polling services as Structured Streaming queries: each transform here takes and gives a stream.

Sinks that must be updated in place (pages, rollups, counters) are foreachBatch merges into
Parquet tables, each version written beside the last, so a batch that is replayed after a
failure starts from the version before it.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillmill.operators import mutations, rollup

TTL = "1 hour"


def stream_parquet(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(path)


def with_event_time(visits: DataFrame, column: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The column as a timestamp (watermarks need one with a zone), and a watermark on it."""
    return visits.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, delay)


def unseen_pages(pages: DataFrame) -> DataFrame:
    """Pages (url, watermarked ts) not seen within the time a stored page lives: state is dropped as pages expire."""
    return pages.dropDuplicatesWithinWatermark(["url"])


def daily_counts(visits: DataFrame) -> DataFrame:
    """day and crawler_id with n, visits per day: what the daily quota is held against."""
    return visits.groupBy(F.window("ts", "1 day").alias("w"), "crawler_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("day"), "crawler_id", "n")


def hourly_activity(visits: DataFrame) -> DataFrame:
    """hour and n, the hourly tick."""
    return visits.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")


class Table:
    """A keyed table kept in hash buckets, each as numbered Parquet versions; of a bucket the latest whole version counts.

    A write holds the buckets that its batch touches and no others, so its cost follows the
    batch and not the table's history. Of a bucket the last `keep` versions stay and older ones
    are removed. Without keys there is one bucket.
    """

    def __init__(self, spark: SparkSession, path: str, empty: DataFrame, keys: list[str] | None = None, buckets: int = 16, keep: int = 2) -> None:
        self.spark, self.path, self.empty = spark, path.rstrip("/"), empty
        self.keys, self.buckets, self.keep = keys or [], buckets if keys else 1, keep

    def bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int") if self.keys else F.lit(0)

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, root, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        path, root, fs = self._fs()
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in found if p.getName().startswith("v") and fs.exists(path(p, "_SUCCESS")))

    def _buckets(self) -> dict[int, list[int]]:
        """The versions of each bucket, in order."""
        path, root, fs = self._fs()
        out: dict[int, list[int]] = {}
        for v in self._versions():
            for s in fs.listStatus(path(root, f"v{v}")):
                if (name := s.getPath().getName()).startswith("_b="):
                    out.setdefault(int(name[3:]), []).append(v)
        return out

    def read(self, before: int | None = None, only: list[int] | None = None) -> DataFrame:
        """The table, or these buckets of it, as it was before a version."""
        paths = []
        for b, versions in self._buckets().items():
            held = [v for v in versions if before is None or v < before]
            if held and (only is None or b in only):
                paths.append(f"{self.path}/v{held[-1]}/_b={b}")
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def write(self, df: DataFrame, version: int) -> None:
        """df, all rows of its buckets, as a version."""
        df.withColumn("_b", self.bucket()).repartition("_b").write.partitionBy("_b").mode("overwrite").parquet(f"{self.path}/v{version}")
        path, _, fs = self._fs()
        for b, versions in self._buckets().items():
            for v in versions[: -self.keep]:
                fs.delete(path(f"{self.path}/v{v}/_b={b}"), True)


def merge_into(table: Table, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the touched buckets as they were before this batch, merged with it, become the batch's version."""

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            touched = [r[0] for r in batch.select(table.bucket()).distinct().collect()]  # at most as many as the table has buckets
            table.write(merge(table.read(before=batch_id, only=touched), batch), batch_id)
        finally:
            batch.unpersist()

    return each


def upsert_pages(table: Table, version: str = "crawled_at") -> Callable[[DataFrame, int], None]:
    return merge_into(table, lambda old, new: mutations.upsert(old, new, ["url"], version))


def merge_site_entities(table: Table) -> Callable[[DataFrame, int], None]:
    """Batches of page entities (site, name, ord, count, score) into a site rollup, in the order of ord."""
    return merge_into(table, lambda old, new: rollup.merge_entities(old, new).select(table.empty.columns))


def merge_site_candidates(table: Table) -> Callable[[DataFrame, int], None]:
    return merge_into(table, lambda old, new: rollup.merge_candidates(old, new).select(table.empty.columns))


def count_pages(table: Table) -> Callable[[DataFrame, int], None]:
    """Batches of pages (crawler_id) into counters (crawler_id, crawled_pages)."""

    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        both = old.unionByName(new.groupBy("crawler_id").agg(F.count("*").alias("crawled_pages")))
        return both.groupBy("crawler_id").agg(F.sum("crawled_pages").alias("crawled_pages"))

    return merge_into(table, merge)


def save_job(pages: Table, entities: Table, queue_path: str, extract: Callable[[DataFrame], DataFrame], counters: Table | None = None) -> Callable[[DataFrame, int], None]:
    """One step of the crawl service: pages saved, their entities rolled up, their crawlers' pages counted, their URLs queued, from one batch.

    Each sink is a version or folder of the batch's number, so a batch that is run again writes the same once more.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            upsert_pages(pages)(batch, batch_id)
            merge_site_entities(entities)(extract(batch), batch_id)
            if counters is not None:
                count_pages(counters)(batch, batch_id)
            batch.select("url").write.mode("overwrite").parquet(f"{queue_path}/batch={batch_id}")
        finally:
            batch.unpersist()

    return each


def update_gazetteer(gazetteer: Table, sources: Table, load: Callable[[DataFrame], DataFrame], now=None) -> Callable[[DataFrame, int], None]:
    """One step of the update queue: batches of categories (source, source_category) whose importers run, and which are stamped.

    load gives gazetteer rows for a batch of categories, by whatever importers each has; known
    names stay as they are. A batch that fails isn't stamped, and comes again when the query does.
    """
    cols = gazetteer.empty.columns

    def each(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select("source", "source_category").distinct().persist()
        try:
            merge_into(gazetteer, lambda old, new: mutations.insert_ignore(old, new, ["category", "name"]))(load(asked).select(cols), batch_id)
            stamped = asked.withColumn("last_updated", (F.current_timestamp() if now is None else F.lit(now)).cast("timestamp"))
            merge_into(sources, lambda old, new: mutations.upsert(old, new, ["source", "source_category"], "last_updated"))(stamped, batch_id)
        finally:
            asked.unpersist()

    return each


def keep_running(begin: Callable[[], StreamingQuery], restarts: int = 10, wait_s: float = 10.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs a query to its end; one that fails is logged and begun again from its checkpoint, at most `restarts` times. Gives the number of restarts."""
    for n in range(restarts + 1):
        try:
            begin().awaitTermination()
            return n
        except Exception:
            logging.getLogger(__name__).exception("the query failed")
            if n == restarts:
                raise
            sleep(wait_s)
    return restarts


def start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, every: str = "60 seconds") -> StreamingQuery:
    """Runs a foreachBatch sink: over all that is there, or on a periodic trigger."""
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
