"""The registry of queries and of their DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.records import RECORDS_SQL, records

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: What each query covers of the operator inventory.
COVERS: dict[str, str] = {}
#: Entries without a query, and why.
LEFT_OUT = {
    "S8": "reads PDF files, for which nothing is installed; texts come from documents",
    "S9": "as S8; a date from metadata is F-d4",
    "S11": "downloads over a network",
    "S12": "calls a language model",
    "S18": "a driver-side spreadsheet; its sheets are findings_pivot, qc_record_scores, kpi_prev, quality_run and qc_findings",
    "S20": "a driver-side document writer, for which nothing is installed",
    "T9": "calls language models in turn",
    "T24": "calls a language model",
    "M9": "locks a user interface",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files are fewer splits than that (one row group is one task); a larger table is left as it is read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def story_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def query(covers: str, sql: str | None = None, on_records: bool = False):
    """Register a query.  on_records: the function takes the records, and the SQL may use `records`."""

    def register(f):
        name = f.__name__
        COVERS[name] = covers
        QUERIES[name] = (lambda spark, sf_dir: f(story_records(spark, sf_dir))) if on_records else f
        if sql:
            # a query's own WITH parts follow those of the records
            body = sql.strip()
            ORACLES[name] = (RECORDS_SQL.rstrip() + (", " + body[5:] if body.startswith("WITH ") else "\n" + body)) if on_records else body
        return f

    return register
