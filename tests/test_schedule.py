"""The schedule's stateful operators, by themselves and as streams that stop and begin again."""

import glob
import random
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from quillmill.plans import streams
from quillmill.streaming import schedule
from quillmill.streaming.schedule import DAY, MINUTE


class Handle:
    """State and timers of one key, in memory."""

    def __init__(self):
        self.value, self.map, self.timers = None, {}, set()

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def containsKey(self, key):
        return key in self.map

    def getValue(self, key):
        return self.map[key]

    def updateValue(self, key, value):
        self.map[key] = value

    def removeKey(self, key):
        self.map.pop(key, None)

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.discard(ms)

    def listTimers(self):
        return iter(sorted(self.timers))


class Expired:
    def __init__(self, ms):
        self.ms = ms

    def getExpiryTimeInMs(self):
        return self.ms


def by_the_clock(rows, gap, end):
    """The pool looked at every minute, as a service would, for one crawler."""
    status, last, out = 1, None, []
    wanted = None
    rows = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0))
    for tick in range(0, end + MINUTE, MINUTE):
        # rows at the tick itself see what was due then
        due = [r for r in rows if tick - MINUTE <= r[0] < tick]
        for us, setting in due:
            if setting is not None:
                wanted = setting
            elif status == 1:
                if last is None or us - last >= gap:
                    last = us
                else:
                    status = 2
                    out.append((us, 2))
        on_tick = [s for us, s in rows if us == tick and s is not None]
        assert not on_tick
        if wanted is not None:
            if (wanted == 1 and status in (0, -1)) or (wanted != 1 and wanted != status):
                status = wanted
                out.append((tick, status))
            wanted = None
        if status == 2 and tick - last >= gap:
            status, last = 1, tick
            out.append((tick, 1))
    return [x for x in out if x[0] <= end]


def test_pool_against_a_look_every_minute():
    for seed in range(60):
        rnd = random.Random(seed)
        end = 60 * MINUTE
        # never on a full minute, so that no order within a tick is asked for
        rows = [(rnd.randrange(60) * MINUTE + rnd.randrange(1, MINUTE), rnd.choice([None, None, None, 1, 0, -1])) for _ in range(30)]
        gap = rnd.choice([1, 5, 17]) * MINUTE + rnd.randrange(3) * 1000
        handle, pool, got = Handle(), schedule.CrawlerPool(gap // 1_000_000), []
        gap = gap // 1_000_000 * 1_000_000
        pool.init(handle)
        rows.sort()
        cuts = sorted(rnd.sample(range(len(rows)), 4))
        for lo, hi in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            batch = rows[lo:hi]
            rnd.shuffle(batch)
            got += pool.handleInputRows((7,), iter([Row(_us=us, setting=s) for us, s in batch]), None)
            mark = rows[hi - 1][0] if hi else 0
            while due := [t for t in handle.timers if t * 1000 <= mark]:  # the watermark passes
                got += pool.handleExpiredTimer((7,), None, Expired(min(due)))
        while due := [t for t in handle.timers if t * 1000 <= end]:
            got += pool.handleExpiredTimer((7,), None, Expired(min(due)))
        told = [(r.at_us, r.crawling_status) for r in got]
        assert told == sorted(told, key=lambda x: x[0]) and [x for x in told if x[0] <= end] == by_the_clock(rows, gap, end)


def test_quota_counts_on_over_batches_and_forgets_days():
    rnd = random.Random(1)
    rows = [(day * DAY + rnd.randrange(DAY), n) for n, day in enumerate(rnd.choice([0, 1, 1, 1, 2]) for _ in range(400))]
    handle, quota = Handle(), schedule.DailyQuota(9, ["item_id"])
    quota.init(handle)
    out = {}
    rows.sort()
    for at in range(0, 400, 90):
        batch = rows[at : at + 90]
        rnd.shuffle(batch)
        for r in quota.handleInputRows(("q",), iter([(n, us, n) for us, n in batch]), None):
            assert r.item_id not in out
            out[r.item_id] = r.let_through
    want = {n for d in range(3) for _, n in sorted(r for r in rows if r[0] // DAY == d)[:10]}
    assert {n for n, ok in out.items() if ok} == want and len(out) == 400
    assert handle.timers == {DAY // 1000 * (d + 1) for d in range(3)} and set(handle.map) == {(0,), (1,), (2,)}
    assert list(quota.handleExpiredTimer(("q",), None, Expired(2 * DAY // 1000))) == []
    assert set(handle.map) == {(0,), (2,)}


def test_gate_stopped_and_begun_again_gives_the_same(spark):
    rows = [(i % 3, i * 1_700_000_000) for i in range(200)] + [(None, 5), (1, None)]
    df = spark.createDataFrame(rows, "crawler_id long, us long").select("crawler_id", F.timestamp_micros("us").alias("ts"))
    want = None
    for runs in (1, 4):
        got = sorted(map(tuple, streams.replayed(df, lambda s: schedule.frequency_gate(s, 7200), runs=runs).collect()), key=repr)
        assert want is None or got == want
        want = got
    last = {}
    kept = [last.update({c: us}) or (c, us) for c, us in sorted((r for r in rows if r[1] is not None), key=lambda r: r[1]) if c not in last or us - last[c] >= 7_200_000_000]
    assert len(want) == len(kept)


def test_a_gate_that_forgets_runs_on_a_trigger(spark, tmp_path):
    df = spark.createDataFrame([(1, 10), (1, 20), (2, 30)], "crawler_id long, s long").select("crawler_id", F.timestamp_seconds("s").alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = schedule.frequency_gate(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), 15, forget_ms=3_600_000)
    query = schedule.started(stream, f"{tmp_path}/out", f"{tmp_path}/check", processingTime="1 second")
    try:
        for _ in range(60):
            if glob.glob(f"{tmp_path}/out/_spark_metadata/0"):
                break
            time.sleep(1)
    finally:
        query.stop()
    assert sorted((r.crawler_id, r.ts.second) for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [(1, 10), (2, 30)]


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_timer_tells_all_that_the_watermark_has_passed():
    """Of two changes that come due in one batch the second has no batch of its own to wait for."""
    handle, pool = Handle(), schedule.CrawlerPool(60)
    pool.init(handle)
    list(pool.handleInputRows((7,), iter([Row(_us=1, setting=None), Row(_us=2, setting=None), Row(_us=MINUTE - 1, setting=0)]), None))
    (due,) = handle.timers
    told = [(r.at_us, r.crawling_status) for r in pool.handleExpiredTimer((7,), Mark(5 * MINUTE // 1000), Expired(due))]
    assert told == [(MINUTE, 0)] and not handle.timers
    handle, pool = Handle(), schedule.CrawlerPool(60)
    pool.init(handle)
    list(pool.handleInputRows((7,), iter([Row(_us=1, setting=None), Row(_us=2, setting=None), Row(_us=3, setting=1)]), None))
    (due,) = handle.timers
    told = [(r.at_us, r.crawling_status) for r in pool.handleExpiredTimer((7,), Mark(5 * MINUTE // 1000), Expired(due))]
    assert told == [(2 * MINUTE, 1)] and not handle.timers


def test_a_queues_days_are_keys_of_their_own(spark, tmp_path):
    """Spark holds what a key gives for a batch in Python: with a queue alone as key that was all of its rows."""
    df = spark.createDataFrame([(n, 864_000 + n * 3_600) for n in range(60)], "item_id long, s long").select("item_id", F.lit("q").alias("queue"), F.timestamp_seconds("s").alias("ts"))
    plan = schedule.daily_quota(streams.jobs.stream_parquet(spark, str(tmp_path), df.schema), 2)._jdf.queryExecution().logical().toString()
    assert "_day" in plan
    got = streams.replayed(df, lambda s: schedule.daily_quota(s, 2)).collect()
    assert sorted(r.item_id for r in got if r.let_through) == [0, 1, 2, 24, 25, 26, 48, 49, 50] and len(got) == 60
