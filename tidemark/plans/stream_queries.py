"""Queries that run a stream over records that are written as files, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators.records import RECORDS_SQL, _list
from tidemark.sources.cache import ScanCache
from tidemark.sources.stores import materialised, scratch_path
from tidemark.streaming.counters import DailyCounters
from tidemark.streaming.ingest import SAME_NAME, SAME_TITLE, SAVED, BulkIngest

from .analytics_queries import QUOTAS
from .catalog import query, story_records, table

_PARTS = 3
_FP = lambda c: f"array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9 \\t\\r\\n\\f]', '', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT list_contains({_list(V.TITLE_STOPWORDS)}, t))[1:8], ' ')"


@query("M10, J12", RECORDS_SQL.rstrip().replace("WITH base", "WITH RECURSIVE base", 1) + f""", q AS (SELECT *, CASE n % 3 WHEN 0 THEN title WHEN 1 THEN 'upload ' || n ELSE lower(title) END AS proposed FROM records),
 o AS MATERIALIZED (SELECT row_number() OVER (ORDER BY created_at, record_id) AS i, record_id, nullif({_FP('proposed')}, '') AS p, nullif({_FP('title')}, '') AS e, title IS DISTINCT FROM proposed AND title IS NOT NULL AS other FROM q),
 step(i, admitted, record_id, outcome) AS (SELECT 0::BIGINT, []::VARCHAR[], NULL::VARCHAR, NULL::VARCHAR UNION ALL
  SELECT o.i, CASE WHEN list_contains(admitted, p) OR (other AND list_contains(admitted, e)) OR e IS NULL THEN admitted ELSE list_append(admitted, e) END, o.record_id,
   CASE WHEN list_contains(admitted, p) THEN '{SAME_NAME}' WHEN other AND list_contains(admitted, e) THEN '{SAME_TITLE}' ELSE '{SAVED}' END FROM step JOIN o ON o.i = step.i + 1)
 SELECT record_id, outcome FROM step WHERE i > 0""")
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as uploaded files, ingested as a stream in three batches by time of arrival, the stream started anew for each."""
    r, n = story_records(spark, sf_dir), F.col("n")
    proposed = F.when(n % 3 == 0, F.col("title")).when(n % 3 == 1, F.concat(F.lit("upload "), n.cast("string"))).otherwise(F.lower("title"))
    files = materialised(r.select(F.col("record_id").alias("file"), F.col("created_at").alias("arrived_at"), proposed.alias("proposed"), "title"), "uploads")
    ends = files.agg(F.min("arrived_at").alias("a"), F.max("arrived_at").alias("b")).first()
    whole = ends.b - ends.a if ends.a else None
    folder, ingest = scratch_path(spark, "incoming"), BulkIngest(spark, scratch_path(spark, "ingest"))
    for k in range(_PARTS):
        after = F.lit(True) if k == 0 else F.col("arrived_at") > F.lit(ends.a + whole * k / _PARTS)
        until = F.lit(True) if k == _PARTS - 1 else F.col("arrived_at") <= F.lit(ends.a + whole * (k + 1) / _PARTS)
        files.where(after & until).write.mode("append").parquet(folder)
        ingest.start(spark.readStream.schema(files.schema).parquet(folder)).awaitTermination()
    return ingest.outcomes().select(F.col("file").alias("record_id"), "outcome")


def _counted(spark: SparkSession, sf_dir: str) -> DailyCounters:
    """Events as a stream in three batches by time."""
    e = table(spark, sf_dir, "events").select("ts", F.col("event_type").alias("key"), F.col("value").alias("amount"))
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    folder, counters = scratch_path(spark, "events"), DailyCounters(spark, scratch_path(spark, "counters"))
    for k in range(_PARTS):
        after = F.lit(True) if k == 0 else F.col("ts") > F.lit(ends.a + (ends.b - ends.a) * k / _PARTS)
        until = F.lit(True) if k == _PARTS - 1 else F.col("ts") <= F.lit(ends.a + (ends.b - ends.a) * (k + 1) / _PARTS)
        e.where(after & until).write.mode("append").parquet(folder)
        counters.start(spark.readStream.schema(e.schema).parquet(folder)).awaitTermination()
    return counters


@query("S23, A23", "SELECT CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day, event_type AS key, count(*) AS calls, round(sum(value), 4) AS amount FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL")
def daily_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters that a stream of events has kept."""
    return _counted(spark, sf_dir).counters().select(F.col("day").cast("string").alias("day"), "key", "calls", F.round("amount", 4).alias("amount"))


@query("S23, J17", f"""WITH u AS (SELECT event_type AS key, count(*) AS used FROM events WHERE CAST(ts - INTERVAL 8 HOUR AS DATE) = DATE '2024-01-10' GROUP BY 1), q AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in QUOTAS.items())}) AS t(key, quota))
 SELECT coalesce(u.key, q.key) AS key, coalesce(used, 0) AS used, CAST(coalesce(quota, 0) AS INTEGER) AS quota, CAST(greatest(coalesce(quota, 0) - coalesce(used, 0), 0) AS BIGINT) AS remaining FROM u FULL JOIN q ON u.key = q.key""")
def quota_of_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the quotas on the evening of a day, by the counters of the stream."""
    quotas = spark.createDataFrame(list(QUOTAS.items()), "key string, quota int")
    return _counted(spark, sf_dir).today(F.lit("2024-01-10 21:00:00").cast("timestamp_ntz"), quotas)


@query("S22", """WITH n AS (SELECT count(*) AS n, count(*) FILTER (priority = 'High') AS high FROM records) SELECT step, scans, CASE WHEN step < 3 THEN high ELSE n END AS n FROM n, (VALUES (1, 1), (2, 1), (3, 2), (4, 2), (5, 3)) AS t(step, scans)""", on_records=True)
def cached_scan(r: DataFrame) -> DataFrame:
    """A store read by a cache: at first, again, after it has grown, again, and when its time is over; how often it was scanned by then."""
    spark, store, now = r.sparkSession, scratch_path(r.sparkSession, "records"), [0.0]
    rows = materialised(r.select("record_id", "priority"), "records")
    cache = ScanCache(spark, scratch_path(spark, "cache"), 90.0, lambda: now[0])
    out = None
    for step in range(1, 6):
        if step in (1, 3):
            rows.where("priority = 'High'" if step == 1 else "priority <> 'High'").write.mode("append").json(store)
        now[0] += 200.0 if step == 5 else 1.0
        part = cache.read(store, lambda path: spark.read.schema(rows.schema).json(path)).agg(F.count(F.lit(1)).alias("n")).select(F.lit(step).alias("step"), F.lit(cache.scans).alias("scans"), "n")
        out = part if out is None else out.unionByName(part)
    return out
