"""Daily counters with late events and a batch that comes twice; the scan cache."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.sources.cache import ScanCache, signature
from tidemark.sources.stores import scratch_path
from tidemark.streaming.counters import DailyCounters

SCHEMA = "ts timestamp_ntz, key string, amount double"


def events(spark, *rows):
    return spark.createDataFrame([(t and dt.datetime.fromisoformat(t), k, a) for t, k, a in rows], SCHEMA)


def test_days_begin_at_eight_and_late_events_are_told(spark):
    c = DailyCounters(spark, scratch_path(spark, "counters"), late=1)
    first = events(spark, ("2024-01-10 07:59:59", "a", 1.0), ("2024-01-10 08:00:00", "a", 2.0), (None, "a", 1.0), ("2024-01-10 09:00:00", None, 1.0))
    c.take(first, 0)
    c.take(first, 0)  # again after a failure: counts once
    got = {(str(r.day), r.key): (r.calls, r.amount) for r in c.counters().collect()}
    assert got == {("2024-01-09", "a"): (1, 1.0), ("2024-01-10", "a"): (1, 2.0)}
    c.take(events(spark, ("2024-01-09 09:00:00", "a", 5.0), ("2024-01-08 09:00:00", "a", 9.0), ("2024-01-12 09:00:00", "b", 1.0), ("2024-01-10 20:00:00", "a", 1.0)), 1)
    got = {(str(r.day), r.key): (r.calls, r.amount) for r in c.counters().collect()}
    assert got == {("2024-01-09", "a"): (2, 6.0), ("2024-01-10", "a"): (2, 3.0), ("2024-01-12", "b"): (1, 1.0)}
    assert [(r.late, r.batch) for r in c.store.read("late").orderBy("batch").collect()] == [(0, 0), (1, 1)]
    quotas = spark.createDataFrame([("a", 3), ("c", 7)], "key string, quota int")
    left = lambda now: {r.key: (r.used, r.remaining) for r in c.today(F.lit(now).cast("timestamp_ntz"), quotas).collect()}
    assert left("2024-01-11 07:00:00") == {"a": (2, 1), "c": (0, 7)}
    assert left("2024-01-11 08:00:00") == {"a": (0, 3), "c": (0, 7)}, "a new day begins with nothing used"
    assert c.store.read("counters", 1).count() == 2, "the state before the batch can be read"


def test_a_stream_that_fails_counts_once(spark):
    folder = scratch_path(spark, "events")
    events(spark, ("2024-01-10 10:00:00", "a", 1.0)).write.mode("append").parquet(folder)

    class Failing(DailyCounters):
        failed = False

        def take(self, batch, number):
            super().take(batch, number)
            if not Failing.failed:
                Failing.failed = True
                raise RuntimeError("after the commit")

    c = Failing(spark, scratch_path(spark, "counters"))
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(folder)
    try:
        c.start(stream()).awaitTermination()
    except Exception as e:  # noqa: BLE001
        assert "after the commit" in str(e)
    events(spark, ("2024-01-10 11:00:00", "a", 1.0)).write.mode("append").parquet(folder)
    c.start(stream()).awaitTermination()
    assert [(r.calls, r.amount) for r in c.counters().collect()] == [(2, 2.0)]


def test_cache_sees_changes_and_time(spark):
    source, now = scratch_path(spark, "source"), [100.0]
    cache = ScanCache(spark, scratch_path(spark, "cache"), 10.0, lambda: now[0])
    reader = lambda p: spark.read.schema("id long").json(p)
    assert signature(spark, source) == "missing"
    spark.range(3).write.json(source)
    one = signature(spark, source)
    assert cache.read(source, reader).count() == 3 and cache.read(source, reader).count() == 3 and cache.scans == 1
    spark.range(2).write.mode("append").json(source)
    assert signature(spark, source) != one
    assert cache.read(source, reader).count() == 5 and cache.scans == 2
    now[0] += 9
    assert cache.read(source, reader).count() == 5 and cache.scans == 2
    now[0] += 1
    assert cache.read(source, reader).count() == 5 and cache.scans == 3, "its time is over"
    other = ScanCache(spark, cache.store.path, 10.0, lambda: now[0])
    assert other.read(source, reader).count() == 5 and other.scans == 0, "another driver finds the table"
