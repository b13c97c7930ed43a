"""Finalising records against a store: approval, and which record of a story counts.

Records come in batches; within a batch they arrive by created_at and record_id.  What a record meets are all records that
arrived before it and whose title fingerprint is similar (0.88) or equal.  If one of them has a greater quality (publisher,
confidence, completeness), the record is a duplicate of the best one: the greatest quality, then the most similar, then
the first to arrive.  Otherwise it wins, also with equal quality, and all that it met become its duplicates.

A batch is done at once.  Qualities have few values, so of each fingerprint and quality only the first record matters to
those that come later; of the winners that meet a fingerprint only the last one counts in the end.  Both are grouped
extremes, so that a title with a third of all records is never paired with itself.  The similar fingerprints are kept in
the store with their links: a batch meets the others with its own new fingerprints only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import title_fingerprint
from tidemark.sources.stores import materialised
from tidemark.sources.versions import VersionedStore

from . import fuzzy as Z
from .dedupe import scored

SAVED, WINS, LOSES = "Saved", "Saved (similar story suppressed)", "Saved (duplicate story excluded from briefs)"


def auto_approved() -> Column:
    """High or medium confidence, a date, a known source and two bullets of evidence."""
    return F.coalesce(F.col("confidence").isin("High", "Medium") & F.col("publish_date").isNotNull() & (F.coalesce("source_type", F.lit("Other")) != "Other") & (F.size("evidence") >= 2), F.lit(False))


class StoryStore:
    """Records with their stories, in a versioned store; each batch is one commit."""

    def __init__(self, spark: SparkSession, path: str, ratio: float = 0.88):
        self.store, self.ratio = VersionedStore(spark, path), ratio

    def _similar(self, fresh: DataFrame) -> dict[str, DataFrame]:
        """What the store gains by new fingerprints (id, title): titles, and links of either direction."""
        t = Z.signed(fresh)
        pairs, all_titles = Z.meetings(t, None, self.ratio), t
        if "titles" in self.store.tables():
            known = self.store.read("titles").select(*t.columns)
            pairs = pairs.unionByName(Z.meetings(t, known, self.ratio))
            all_titles = t.unionByName(known)
        pairs = materialised(pairs, "candidates")
        # the ratio depends on which title is the new one
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        links = Z.exact(both, all_titles, all_titles, self.ratio)
        return {"titles": t, "links": links}

    def add(self, batch: DataFrame) -> int:
        """Add records; the version that has them.

        batch: record_id (new ones), title, source_type, publish_date, created_at, confidence, regions, evidence, url, topics,
        companies, and what else a record has.  Rows without a fingerprint meet nothing.  An empty batch is a version, too.
        """
        store, number = self.store, self.store.version() + 1
        fp = title_fingerprint(F.coalesce("title", F.lit("")), V.TITLE_STOPWORDS)
        rows = scored(batch).withColumns({
            "review_status": F.when(auto_approved(), "Approved").otherwise("Pending"),
            "story": F.when(fp != "", F.md5(fp)),
            "fingerprint": fp,
            "quality": F.struct("publisher_score", "confidence_score", "completeness"),
            "arrival": F.struct(F.lit(number).alias("batch"), "created_at", "record_id"),
        }).select(*batch.columns, *(c for c in ("review_status",) if c not in batch.columns), "story", "fingerprint", "quality", "arrival")
        rows = materialised(rows, "batch")
        fresh = rows.where("story IS NOT NULL").groupBy(F.col("story").alias("id")).agg(F.first("fingerprint").alias("title"))
        if "titles" in store.tables():
            fresh = fresh.join(store.read("titles").select("id"), "id", "left_anti")
        gains = {"titles": Z.signed(fresh)} if self.ratio >= 1 else self._similar(materialised(fresh, "fresh"))
        gains = {name: materialised(df, name) for name, df in gains.items()}

        # (a, b, ratio): of each story of the batch, those that it meets
        own = rows.where("story IS NOT NULL").select("story").distinct()
        met = own.select(F.col("story").alias("a"), F.col("story").alias("b"), F.lit(1.0).alias("ratio"))
        links = [df for df in (gains.get("links"), store.read("links") if "links" in store.tables() else None) if df is not None]
        if links:
            every = reduce(DataFrame.unionByName, links)
            met = met.unionByName(every.join(own.withColumnRenamed("story", "a"), "a", "left_semi"))
        met = materialised(met, "met")

        # the first record of each story and quality, of the batch and of the store
        firsts = rows.where("story IS NOT NULL").groupBy("story", "quality").agg(F.min("arrival").alias("arrival"))
        gains["firsts"] = materialised(firsts, "firsts")
        known = gains["firsts"].unionByName(store.read("firsts")) if "firsts" in store.tables() else gains["firsts"]
        known = known.join(met.select("a", F.col("b").alias("story"), "ratio"), "story").groupBy("a", "quality", "ratio").agg(F.min("arrival").alias("arrival"))
        less = lambda c: (-F.col(c)).alias(c)
        best = F.struct(less("quality.publisher_score"), less("quality.confidence_score"), less("quality.completeness"), less("ratio"), "arrival", "quality")
        lists = known.groupBy(F.col("a").alias("story")).agg(F.sort_array(F.collect_list(best)).alias("met"))
        before = F.filter("met", lambda e: e["arrival"] < F.col("arrival"))
        judged = rows.join(lists, "story", "left").withColumn("before", F.coalesce(before, F.array().cast(lists.schema["met"].dataType)))
        stronger = F.try_element_at(F.filter("before", lambda e: e["quality"] > F.col("quality")), F.lit(1))
        outcome = F.when(F.size("before") == 0, SAVED).when(F.col("best").isNull(), WINS).otherwise(LOSES)
        judged = judged.withColumn("best", stronger["arrival"]["record_id"]).withColumn("outcome", outcome).drop("met", "before")
        judged = materialised(judged, "judged")

        # the last winner that meets a story
        last = judged.where(F.col("outcome") == WINS).groupBy(F.col("story").alias("a")).agg(F.max("arrival").alias("winner"))
        last = materialised(last.join(met, "a").groupBy(F.col("b").alias("story")).agg(F.max("winner").alias("winner")), "winners")
        done = judged.join(last, "story", "left").withColumn("later", F.coalesce(F.col("winner") > F.col("arrival"), F.lit(False)))
        flags = {
            "is_duplicate": F.col("later") | (F.col("outcome") == LOSES),
            "duplicate_story_of": F.when(F.col("later"), F.col("winner.record_id")).otherwise(F.col("best")),
            "story_primary": F.when(F.col("later") | (F.col("outcome") == LOSES), False).when(F.col("outcome") == WINS, True),
        }
        done = done.withColumns(flags).drop("winner", "later", "best", "fingerprint")
        gone = {}
        if "records" in store.tables():
            touched = store.holding("records", lambda df: df.join(last.select("story"), "story", "left_semi"))
            if touched:
                old = store.of_files("records", touched)
                lost = F.col("winner").isNotNull()
                changed = old.join(last, "story", "left").withColumns({"is_duplicate": F.col("is_duplicate") | lost, "duplicate_story_of": F.when(lost, F.col("winner.record_id")).otherwise(F.col("duplicate_story_of")), "story_primary": F.when(lost, False).otherwise(F.col("story_primary"))})
                done, gone = done.unionByName(changed.select(done.columns)), {"records": touched}
        return store.commit(f"batch of {rows.count()}", {"records": done, **gains}, gone)

    def records(self, version: int | None = None) -> DataFrame:
        return self.store.read("records", version)
