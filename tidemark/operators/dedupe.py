"""Same-story detection: keys, scores and the canonical record of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import mapping, plain_title, title_fingerprint


def dedupe_key() -> Column:
    """publish_date|first topic|first four companies, normalised and sorted|title fingerprint; "unknown" for blanks."""
    companies = F.array_join(F.array_sort(F.filter(F.transform(F.slice("companies", 1, 4), plain_title), lambda c: c != "")), ",")
    unknown = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("unknown"))
    return F.concat_ws("|", unknown(F.col("publish_date").cast("string")), unknown(F.try_element_at("topics", F.lit(1))), unknown(companies), unknown(title_fingerprint(F.coalesce("title", F.lit("")), V.TITLE_STOPWORDS)))


def scored(records: DataFrame) -> DataFrame:
    """Adds dedupe_key, publisher_score, confidence_score and completeness."""
    return records.withColumns({
        "dedupe_key": dedupe_key(),
        "publisher_score": F.coalesce(F.try_element_at(mapping(V.PUBLISHER_SCORES), F.col("source_type")), F.lit(50)),
        "confidence_score": F.when(F.col("confidence") == "High", 3).when(F.col("confidence") == "Medium", 2).otherwise(1),
        "completeness": F.col("publish_date").isNotNull().cast("int") + F.col("url").isNotNull().cast("int") + (F.size("regions") > 0).cast("int") + (F.size("evidence") >= 3).cast("int"),
    })


QUALITY = ("publisher_score", "confidence_score", "completeness", "publish_date", "created_at", "record_id")


def groups(records: DataFrame) -> DataFrame:
    """A row for each key: best (the six quality columns of the canonical row), group_size and sources.

    The canonical row is the greatest struct of the quality columns (null dates last), an aggregate that is combined
    before the shuffle: a key with a third of all rows is no heavy task.
    """
    order = F.struct(*(F.col(c) for c in QUALITY))
    return scored(records).groupBy("dedupe_key").agg(F.max(order).alias("best"), F.count(F.lit(1)).alias("group_size"), F.array_join(F.array_sort(F.collect_set("source_type")), ", ").alias("sources"))


def canonical(records: DataFrame) -> DataFrame:
    """The canonical record of each key, with group_size and sources; records join by record_id, which is unique, not by key."""
    best = groups(records).select(F.col("best.record_id").alias("record_id"), "group_size", "sources")
    return scored(records).join(best, "record_id")


def duplicates(records: DataFrame) -> DataFrame:
    """record_id, canonical_id and sources of the others: only ids and keys go to the join."""
    keyed = scored(records).select("record_id", "dedupe_key")
    best = groups(records).where("group_size > 1").select("dedupe_key", F.col("best.record_id").alias("canonical_id"), "sources")
    return keyed.join(best, "dedupe_key").where("record_id <> canonical_id").select("record_id", "canonical_id", "sources")


def stats(records: DataFrame) -> DataFrame:
    per = groups(records).agg(F.sum("group_size").alias("n_input"), F.count(F.lit(1)).alias("n_canonical"))
    per = per.select(F.coalesce("n_input", F.lit(0)).alias("n_input"), "n_canonical").withColumn("n_duplicates", F.col("n_input") - F.col("n_canonical"))
    return per.withColumn("duplicate_pct", F.round(100.0 * F.col("n_duplicates") / F.greatest(F.col("n_input"), F.lit(1)), 6))


def arrivals(records: DataFrame) -> DataFrame:
    """(record_id, outcome, first_id) of a bulk run: firsts by title fingerprint and by key are found as grouped minima, in the order of arrival."""
    when = F.struct("created_at", "record_id")
    rows = records.select("record_id", "created_at", title_fingerprint(F.coalesce("title", F.lit("")), V.TITLE_STOPWORDS).alias("fp"), dedupe_key().alias("key"))
    by_title = rows.groupBy("fp").agg(F.min(when).alias("t"))
    by_key = rows.groupBy("key").agg(F.min(when).alias("k"))
    both = rows.join(by_title, "fp").join(by_key, "key")
    outcome = F.when(F.col("record_id") != F.col("t.record_id"), "skipped: same title").when(F.col("record_id") != F.col("k.record_id"), "skipped: same story").otherwise("saved")
    return both.select("record_id", outcome.alias("outcome"), F.col("t.record_id").alias("first_id"))
