"""The history of quality runs: findings, scores and the run's row are one commit; trends and chronic issues come from that log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import mapping
from tidemark.sources.stores import materialised
from tidemark.sources.versions import VersionedStore

from . import quality as Q

#: Columns of a run's row that are compared between runs.
KPIS = ["kpi_r1", "kpi_r2", "kpi_r3", "kpi_r4", "kpi_r5", "kpi_b1", "kpi_b2", "kpi_b3", "kpi_b4", "kpi_b5", "weighted_record_score", "weighted_brief_score", "weighted_overall_score"]
LOWER_IS_BETTER = ["kpi_r1", "kpi_r2", "kpi_b1", "kpi_b2"]
RATIOS = ["kpi_r1", "kpi_r2", "kpi_r3", "kpi_r4", "kpi_r5", "kpi_b3"]
SUGGESTIONS = {
    "evidence_not_grounded": "Ask for exact phrases of the source in evidence.",
    "missing_footprint_region": "Give the extraction examples of regions that follow from countries.",
    "canonicalization_inconsistent": "Add the company's variants to the table of names.",
    "canonicalization_alias_present": "Add the company's variants to the table of names.",
    "missing_evidence": "Require two bullets of evidence.",
    "confidence_evidence_mismatch": "Give bullets of evidence more weight in the confidence.",
    "missing_priority_reason": "Set a reason wherever priority changes.",
    "duplicate_record_in_brief": "Make the dedupe key coarser, or compare titles at ingest.",
    "near_duplicate_titles": "Lower the similarity that ingest asks for.",
    "macro_theme_min_groups_violation": "Look at the theme's groups of signals.",
}


class QualityHistory:
    def __init__(self, spark: SparkSession, path: str):
        self.store = VersionedStore(spark, path)

    def run(self, records: DataFrame, target_mode: str, created_at: str, more: DataFrame | None = None, brief: DataFrame | None = None) -> int:
        """Check reviewed records and commit the run; its version.

        more: findings besides (record_id, severity, finding).  brief: one row with the KPIs b1-b5, the numbers of findings
        brief_qc_high, _medium and _low, and weighted_brief_score.  Without records a run has counts of zero.
        """
        known = self.store.read("runs") if "runs" in self.store.tables() else None
        number = Q.next_version(known).first()[0] if known is not None else 1
        found = Q.raised(records)
        found = materialised(found if more is None else found.unionByName(more.select("record_id", "severity", "finding")), "findings")
        per = materialised(Q.graded(found), "scores")
        columns = {"run_version": F.lit(number), "run_id": F.lit(f"qc_{number:05d}"), "created_at": F.lit(created_at).cast("timestamp_ntz")}
        row = Q.run_row(per, target_mode)
        b = brief if brief is not None else per.sparkSession.range(1).select(*(F.lit(None).cast("double").alias(f"kpi_b{k}") for k in range(1, 6)), *(F.lit(None).cast("long").alias(f"brief_qc_{s}") for s in ("high", "medium", "low")), F.lit(None).cast("double").alias("weighted_brief_score"))
        row = row.crossJoin(F.broadcast(b))  # one row each
        overall = F.coalesce(F.bround((F.col("weighted_record_score") + F.col("weighted_brief_score")) / 2, 1), F.col("weighted_overall_score"))
        tables = {
            "runs": row.withColumn("weighted_overall_score", overall),
            "scores": per.select("record_id", "high", "medium", "low", "score"),
            "findings": found.where("finding IS NOT NULL"),
        }
        return self.store.commit(f"run {number}", {name: df.withColumns(columns) for name, df in tables.items()})

    def long(self) -> DataFrame:
        """(run_version, kpi, value) of all runs."""
        runs = self.store.read("runs")
        return runs.select("run_version", *(F.col(k).cast("double").alias(k) for k in KPIS)).unpivot("run_version", KPIS, "kpi", "value")

    def trends(self, lookback: int = 5) -> DataFrame:
        """Each run's values against those of up to `lookback` runs before it; runs without earlier values have no row.

        The log has a row for each run, numbered for people, so a window for each KPI is small.
        """
        w = Window.partitionBy("kpi").orderBy("run_version").rowsBetween(-lookback, -1)
        rows = self.long().withColumns({"avg_prior": F.avg("value").over(w), "last": F.last("value", True).over(w)}).where("value IS NOT NULL AND avg_prior IS NOT NULL")
        delta = F.col("value") - F.col("avg_prior")
        better = F.when(F.col("kpi").isin(LOWER_IS_BETTER), -delta).otherwise(delta)
        limit = F.when(F.col("kpi").isin(RATIOS), V.RATIO_ALERT).otherwise(V.COUNT_ALERT)
        direction = F.when(better > 0, "improving").when(better < 0, "declining").otherwise("stable")
        return rows.select("run_version", "kpi", F.col("value").alias("current"), "last", F.round("avg_prior", 4).alias("avg_prior"), F.round(delta, 4).alias("delta_from_avg"), F.round(F.col("value") - F.col("last"), 4).alias("delta_from_last"), direction.alias("direction"), ((better < 0) & (F.abs(delta) >= limit)).alias("alert"))

    def recent(self, lookback: int) -> DataFrame:
        return self.store.read("runs").select("run_version").orderBy(F.desc("run_version")).limit(lookback)

    def chronic(self, lookback: int = 5, examples: int = 3) -> DataFrame:
        """Kinds of findings in at least half of the last runs (rounded down, one at least), with a suggestion and the first records."""
        recent = F.broadcast(self.recent(lookback))
        runs = recent.agg(F.count(F.lit(1)).alias("n_runs"))  # one row
        rows = self.store.read("findings").join(recent, "run_version").select("finding", "run_version", "record_id")
        # the first few ids of each kind: as many of each run would do, and are combined before the shuffle
        per = rows.groupBy("finding", "run_version").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
        kinds = per.groupBy("finding").agg(F.count(F.lit(1)).alias("frequency"), F.sum("n").alias("n_findings"), F.array_join(F.slice(F.array_sort(F.collect_set("first")), 1, examples), ", ").alias("examples"))
        kept = kinds.crossJoin(F.broadcast(runs)).where(F.col("frequency") >= F.greatest(F.lit(1), F.floor(F.col("n_runs") / 2)))
        return kept.select("finding", "frequency", "n_runs", F.round(F.col("frequency") / F.col("n_runs"), 2).alias("ratio"), "n_findings", F.coalesce(F.try_element_at(mapping(SUGGESTIONS), F.col("finding")), F.lit("")).alias("suggestion"), "examples")

    def breakdown(self, records: DataFrame, run_version: int, top: int = 3) -> DataFrame:
        """Each record with its numbers of findings in a run, its score and its commonest kinds (ties by name); records that the run did not see have none."""
        mine = self.store.read("findings").where(F.col("run_version") == run_version).groupBy("record_id", "finding", "severity").agg(F.count(F.lit(1)).alias("n"))
        kinds = mine.groupBy("record_id", "finding").agg(F.sum("n").alias("n"))
        line = lambda x: F.concat(x["finding"], F.lit(" ("), (-x["o"]).cast("string"), F.lit(")"))
        tops = kinds.groupBy("record_id").agg(F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "finding"))), 1, top), line), ", ").alias("top_finding_types"))
        count = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("n"))), F.lit(0)).alias(s.lower())
        per = mine.groupBy("record_id").agg(*map(count, V.LEVELS), F.sum("n").alias("total_findings")).join(tops, "record_id")
        zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("high", "medium", "low", "total_findings")}
        rows = records.select("record_id", "title", "priority", "confidence", "review_status").join(per, "record_id", "left").withColumns(zero)
        score = F.greatest(F.lit(0), 100 - 25 * F.col("high") - 10 * F.col("medium") - 2 * F.col("low"))
        return rows.withColumns({"score": score, "top_finding_types": F.coalesce("top_finding_types", F.lit(""))})

    def score_buckets(self) -> DataFrame:
        """Mean record, brief and overall score of runs by hour, day and week of their time, and by version."""
        at = F.col("created_at")
        units: dict[str, Column] = {"hour": F.date_format(F.date_trunc("hour", at), "yyyy-MM-dd HH:mm:ss"), "day": at.cast("date").cast("string"), "week": F.date_trunc("week", at).cast("date").cast("string"), "version": F.col("run_version").cast("string")}
        rows = self.store.read("runs").select("created_at", "run_version", *(F.col(f"weighted_{s}_score").cast("double").alias(s) for s in ("record", "brief", "overall"))).unpivot(["created_at", "run_version"], ["record", "brief", "overall"], "score", "value").where("value IS NOT NULL")
        each = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), b.alias("bucket")) for u, b in units.items())))
        return rows.select(each.alias("u"), "score", "value").groupBy("u.unit", "u.bucket", "score").agg(F.round(F.avg("value"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))
