"""Streaming extensions: windowed event volume with late data, and deduplicating file ingest.  Not part of the batch inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import title_fingerprint


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of Parquet files as they arrive, with ts as an instant."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def weekly_volume(events: DataFrame, late: str = "2 days") -> DataFrame:
    """Counts of each type and week (from Monday); rows later than `late` are dropped by the watermark."""
    week = F.window("ts", "7 days", "7 days", "4 days")  # weeks begin on the fifth day after the epoch, a Monday
    return events.withWatermark("ts", late).groupBy(week.alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("week.start").alias("week"), "event_type", "n", "value")


def fresh_stories(records: DataFrame, horizon: str = "30 days") -> DataFrame:
    """A stream of records (title, created_at) without those whose title fingerprint came within the horizon."""
    marked = records.withColumn("fingerprint", title_fingerprint(F.col("title"), V.TITLE_STOPWORDS))
    return marked.withWatermark("created_at", horizon).dropDuplicatesWithinWatermark(["fingerprint"])
