"""Chunk records as one record for each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILLER = "Evidence extracted from cleaned document chunks."
SHORT_WORDS, LEAST = 25, 2


def merge_lists(chunks: DataFrame, key: str, order: str, caps: dict[str, int], short: str | None = None) -> DataFrame:
    """(key, kind, items): values in the order of chunks, trimmed, without blanks and repeats but for case, at most caps[kind].

    Of the list `short`, values of over 25 words count only where there are no others, and two values are made up to.
    Values are combined before the shuffle and ranked; no list is gathered but what the caps leave.
    """
    parts = None
    for kind, cap in caps.items():
        one = chunks.select(key, F.lit(kind).alias("kind"), F.lit(cap).alias("cap"), F.col(order).alias("_chunk"), F.posexplode(kind).alias("_at", "item"))
        parts = one if parts is None else parts.unionByName(one)
    items = parts.withColumn("item", F.trim("item")).where("item <> ''").withColumn("_low", F.lower("item"))
    first = items.groupBy(key, "kind", "cap", "_low").agg(F.min(F.struct("_chunk", "_at", "item")).alias("f"))
    words = F.size(F.filter(F.split("f.item", " "), lambda w: w != ""))
    first = first.withColumn("_long", F.when((F.col("kind") == F.lit(short)) & (words > SHORT_WORDS), 1).otherwise(0) if short else F.lit(0))
    rank = Window.partitionBy(key, "kind").orderBy("_long", "f")
    ranked = first.withColumn("_n", F.row_number().over(rank)).where("_n <= cap")
    kept = ranked.groupBy(key, "kind").agg(F.array_sort(F.collect_list(F.struct("_long", "_n", F.col("f.item").alias("item")))).alias("all"))  # at most cap values
    some = F.filter("all", lambda x: x["_long"] == F.col("all")[0]["_long"])
    values = F.transform(some, lambda x: x["item"])
    if short:
        values = F.when((F.col("kind") == short) & (F.size(values) < LEAST), F.slice(F.concat(values, F.array(F.lit(FILLER))), 1, LEAST)).otherwise(values)
    return kept.select(key, "kind", values.alias("items"))


def merge_records(chunks: DataFrame, key: str, order: str, caps: dict[str, int], short: str | None = None) -> DataFrame:
    """One record for each document of what its chunks give (in `order`): lists as merge_lists() does, and of the fields

    source_type: the commonest, "Other" only if there is no other, ties to the earliest chunk; title and url: the first that
    is not blank; mentions_our_company: of any chunk; publish_date: with the greatest confidence, then the latest.
    """
    votes = chunks.groupBy(key, "source_type").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = F.struct((F.coalesce("source_type", F.lit("Other")) != "Other").alias("named"), "n", (-F.col("_first")).alias("early"))
    choice = votes.groupBy(key).agg(F.max_by("source_type", best).alias("source_type"))

    def first(c: str) -> Column:
        there = F.trim(c) != ""
        return F.min_by(F.when(there, F.col(c)), F.when(there, F.col(order))).alias(c)

    rank = F.when(F.col("publish_date_confidence") == "High", 3).when(F.col("publish_date_confidence") == "Medium", 2).otherwise(1)
    dated = F.when(F.col("publish_date").isNotNull(), F.struct(rank.alias("rank"), "publish_date", "publish_date_confidence"))
    rest = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), first("title"), first("url"), F.bool_or(F.coalesce("mentions_our_company", F.lit(False))).alias("mentions_our_company"), F.max(dated).alias("d"))
    lists = merge_lists(chunks, key, order, caps, short).groupBy(key).agg(*(F.first(F.when(F.col("kind") == k, F.col("items")), True).alias(k) for k in caps))
    none = F.array().cast("array<string>")
    out = rest.join(choice, key).join(lists, key, "left")
    return out.select(key, "n_chunks", "title", "url", "source_type", "mentions_our_company", "d.publish_date", "d.publish_date_confidence", *(F.coalesce(k, none).alias(k) for k in caps))
