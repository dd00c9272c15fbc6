"""The crawl schedule as arbitrary stateful streams: frequency gate, pause and resume, daily quota.

Each operator takes a stream of rows with event time and keeps, for each crawler or queue, a few
numbers in the state store. Rows of a batch are taken in the order of their time, whatever order they
come in; between batches a row older than the watermark is late and dropped by the engine. What is in
the state survives a stop: a query that begins again from its checkpoint goes on as if it had never
stopped, and a batch that is run again starts from the state before it.

State needs a store that the executors reach and that isn't held in memory: RocksDB, set by `started`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quillmill.operators.frontier import DAILY_QUOTA, FREQUENCY_S

MINUTE = 60_000_000
DAY = 24 * 60 * MINUTE
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STOPPED, RUNNING, PAUSED, SITE_STOPPED = 0, 1, 2, -1


def started(stream: DataFrame, path: str, checkpoint: str, partition: str | None = None, **trigger) -> StreamingQuery:
    """The stream appended to a Parquet folder, partitioned by a column if one is named. Without a trigger: all that is there, and then it ends."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.partitionBy(partition) if partition else writer
    return writer.trigger(**(trigger or {"availableNow": True})).start()


class FrequencyGate(StatefulProcessor):
    """One long a crawler: from when on the next visit is let through."""

    def __init__(self, frequency: int, forget_ms: int | None, columns: list[str]) -> None:
        self.gap, self.forget_ms, self.row = frequency * 1_000_000, forget_ms, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.due = handle.getValueState("due", "us long", self.forget_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        due, before = (self.due.get()[0],) * 2 if self.due.exists() else (None, None)
        for r in sorted(rows, key=lambda r: r[-1]):
            if due is None or r[-1] >= due:
                due = r[-1] + self.gap
                yield self.row(*r[:-1])
        if due != before:
            self.due.update((due,))

    def close(self) -> None:
        pass


def frequency_gate(visits: DataFrame, frequency: int = FREQUENCY_S, forget_ms: int | None = None) -> DataFrame:
    """The visits (crawler_id, ts and more) of a stream that are at least `frequency` seconds after the last one let through.

    Over a log whose batches follow each other in time the rows are those of `frontier.frequency_gate`.
    A null ts never passes; null crawler_ids are one crawler. With forget_ms a crawler that hasn't been let
    through for so long, by the wall clock, is forgotten; that must be longer than a stream may stand still,
    and such a stream runs on a periodic trigger: as its clock ticks on, it never comes to an end by itself.
    """
    schema = visits.schema
    timed = visits.filter(F.col("ts").isNotNull()).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    return timed.groupBy("crawler_id").transformWithState(FrequencyGate(frequency, forget_ms, visits.columns), schema, "append", "None" if forget_ms is None else "ProcessingTime")


class CrawlerPool(StatefulProcessor):
    """A crawler's place in the pool, and what is due at the next tick of the minute, in one row of state.

    Due are a change of its setting and, while it is paused, its return; a timer on event time stands
    at the earlier of them, so that it comes without another row of the crawler.
    """

    def __init__(self, frequency: int) -> None:
        self.gap = frequency * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("pool", "status int, last long, back_at long, setting int, setting_at long")

    def _load(self) -> None:
        self.status, self.last, self.back_at, self.setting, self.setting_at = self.state.get() if self.state.exists() else (RUNNING, None, None, None, None)
        self.said: list[tuple[int, int]] = []

    def _say(self, at: int, status: int) -> None:
        self.status = status
        self.said.append((at, status))

    def _apply(self) -> None:
        value, at, self.setting, self.setting_at = self.setting, self.setting_at, None, None
        if value == RUNNING:
            if self.status in (STOPPED, SITE_STOPPED):
                self._say(at, RUNNING)
        elif value != self.status:
            self.back_at = None
            self._say(at, value)

    def _until(self, us: int) -> None:
        """What is due up to a time, in order; at the same tick the setting first."""
        while due := [x for x in (self.setting_at, self.back_at) if x is not None and x <= us]:
            if self.setting_at == min(due):
                self._apply()
            else:
                self.last, self.back_at = self.back_at, None
                self._say(self.last, RUNNING)

    def _row(self, us: int, setting: int | None) -> None:
        self._until(us)
        if setting is not None:
            self.setting, self.setting_at = setting, -(-us // MINUTE) * MINUTE
        elif self.status == RUNNING:
            if self.last is None or us - self.last >= self.gap:
                self.last = us
            else:
                self.back_at = -(-(self.last + self.gap) // MINUTE) * MINUTE
                self._say(us, PAUSED)

    def _store(self, key) -> Iterator[Row]:
        self.state.update((self.status, self.last, self.back_at, self.setting, self.setting_at))
        want = {min(x for x in (self.setting_at, self.back_at) if x is not None) // 1000} if (self.setting_at, self.back_at) != (None, None) else set()
        have = set(self.handle.listTimers())
        for ms in have - want:
            self.handle.deleteTimer(ms)
        for ms in want - have:
            self.handle.registerTimer(ms)
        for at, status in self.said:
            yield Row(crawler_id=key[0], at_us=at, crawling_status=status)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        self._load()
        for us, setting in sorted(((r._us, r.setting) for r in rows), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
            self._row(us, setting)
        yield from self._store(key)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        # all that the watermark has passed: a timer that is set for it now would wait for a batch that may never come
        mark = timerValues.getCurrentWatermarkInMs() if timerValues is not None else 0
        self._until(max(expiredTimerInfo.getExpiryTimeInMs(), mark) * 1000)
        yield from self._store(key)

    def close(self) -> None:
        pass


def pool_history(rows: DataFrame, frequency: int = FREQUENCY_S, delay: str = "1 second") -> DataFrame:
    """crawler_id, at_us and crawling_status of each change, of a stream of visits and settings (crawler_id long, ts, setting).

    setting is null for a visit of the start page; 1 enables the crawler, 0 stops it, -1 stops its site:
    the configuration as a table of its changes, so that a batch run again sees what it saw before. Of
    settings in one minute the last counts, from the next full minute on. A visit sooner than `frequency`
    seconds after the last one let through pauses the crawler (2); it comes back (1) at the first full
    minute at which it may visit again, which counts as a visit, and visits meanwhile, or while it is
    stopped, are dropped. Crawlers begin enabled. Changes that are due by the watermark are told
    without a further row of their crawler. Rows without a crawler_id or ts are left out.
    """
    timed = rows.filter(F.col("ts").isNotNull() & F.col("crawler_id").isNotNull())
    timed = timed.select("crawler_id", "setting", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay).withColumn("_us", F.unix_micros("ts"))
    return timed.groupBy("crawler_id").transformWithState(CrawlerPool(frequency), "crawler_id long, at_us long, crawling_status int", "append", "EventTime")


class DailyQuota(StatefulProcessor):
    """A map from UTC day to the number let through; a timer at the end of the day clears it.

    What a key gives for a batch is held in Python until all of it is there, so a key is best a queue and one day.
    """

    def __init__(self, quota: int, columns: list[str]) -> None:
        self.most, self.width, self.row = quota + 1, len(columns), Row(*columns, "let_through")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getMapState("used", "day long", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        free: dict[int, int] = {}
        held: dict[int, list] = {}
        for n, r in enumerate(rows):
            us, order = r[-2], r[-1]
            day = us // DAY
            if day not in free:
                free[day] = self.most - (self.used.getValue((day,))[0] if self.used.containsKey((day,)) else 0)
                held[day] = []
            # of a day's rows the earliest that still fit are held, the others go back at once
            heap, entry = held[day], (-us, -order, n, r)
            if len(heap) < free[day]:
                heapq.heappush(heap, entry)
            else:
                yield self.row(*(heapq.heappushpop(heap, entry)[3] if heap else r)[: self.width], False)
        for day, heap in held.items():
            if heap:
                self.used.updateValue((day,), (self.most - free[day] + len(heap),))
                yield from (self.row(*e[3][: self.width], True) for e in heap)
            self.handle.registerTimer((day + 1) * DAY // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.used.removeKey((expiredTimerInfo.getExpiryTimeInMs() * 1000 // DAY - 1,))
        yield from ()

    def close(self) -> None:
        pass


def daily_quota(items: DataFrame, quota: int = DAILY_QUOTA, key: str = "queue", order: str = "item_id", delay: str = "1 second") -> DataFrame:
    """Every row of a stream of items (key, ts, order and more), with let_through: whether it is among the first quota + 1 of its queue and UTC day.

    The others are to be put back. Counts go on from batch to batch, and a day's is cleared once the
    watermark has passed its end. Each queue and day is a key of its own, as Spark holds the rows that a
    key gives for a batch in Python. order, a long, decides between equal times. Rows without a ts are left out.
    """
    columns = items.columns
    timed = items.filter(F.col("ts").isNotNull()).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).withColumn("_us", F.unix_micros("ts"))
    timed = timed.select(*columns, F.floor((F.col("_us") - F.pmod("_us", F.lit(DAY))) / F.lit(DAY)).alias("_day"), "_us", F.col(order).cast("long").alias("_order"))
    schema = ", ".join(f"`{c}` {t}" for c, t in timed.select(columns).dtypes) + ", let_through boolean"
    return timed.groupBy(key, "_day").transformWithState(DailyQuota(quota, columns), schema, "append", "EventTime")
