"""Queries over stores with versions: changes and rollback, quality runs, records finalised in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.operators import history as H
from tidemark.operators import quality as Q
from tidemark.operators.finalize import LOSES, SAVED, WINS, StoryStore
from tidemark.operators.records import _list
from tidemark.sources.stores import materialised, scratch_path
from tidemark.sources.versions import VersionedStore

from .catalog import query
from .record_queries import _SCORED, _map
from .rule_queries import _FOUND

_MOVED = {"Germany": "West Europe", "France": "West Europe"}
_TIME = "2024-01-01 01:00:00"


def _changed(r: DataFrame) -> VersionedStore:
    """Records stored, approved, less those from before a time, with other names of regions, and rolled back to before that."""
    s = VersionedStore(r.sparkSession, scratch_path(r.sparkSession, "records"))
    s.append("records", r.select("record_id", "created_at", "priority", "confidence", "review_status", "regions"), "load")
    s.update("records", (F.col("review_status") == "Pending") & (F.col("priority") == "High") & (F.col("confidence") == "High"), {"review_status": F.lit("Approved")}, "approve")
    s.delete("records", F.col("created_at") < F.lit(_TIME).cast("timestamp_ntz"), "delete by time")
    names = F.create_map(*(F.lit(x) for pair in _MOVED.items() for x in pair))
    moved = F.array_distinct(F.transform("regions", lambda x: F.coalesce(F.try_element_at(names, x), x)))
    s.update("records", F.arrays_overlap("regions", F.array(*map(F.lit, _MOVED))), {"regions": moved}, "migrate regions")
    s.rollback(2)
    return s


_VERSIONS = f"""v1 AS (SELECT record_id, created_at, review_status, priority, confidence, regions FROM records),
 v2 AS (SELECT * REPLACE (CASE WHEN review_status = 'Pending' AND priority = 'High' AND confidence = 'High' THEN 'Approved' ELSE review_status END AS review_status) FROM v1),
 v3 AS (SELECT * FROM v2 WHERE created_at >= TIMESTAMP '{_TIME}'),
 v4 AS (SELECT * REPLACE (list_transform(regions, lambda x: coalesce({_map(_MOVED)}[x], x)) AS regions) FROM v3),
 v AS (SELECT 1 AS version, * FROM v1 UNION ALL SELECT 2, * FROM v2 UNION ALL SELECT 3, * FROM v3 UNION ALL SELECT 4, * FROM v4 UNION ALL SELECT 5, * FROM v2)"""


@query("M1, M3, M4, M5", f"WITH {_VERSIONS} SELECT CAST(version AS INTEGER) AS version, review_status, count(*) AS n, coalesce(sum(len(list_distinct(regions))), 0)::BIGINT AS n_regions, count(*) FILTER (list_contains(regions, 'Germany')) AS in_germany FROM v GROUP BY ALL", on_records=True)
def store_versions(r: DataFrame) -> DataFrame:
    """Every version of a store of records, read after the last: load, approve, delete by time, migrate regions, roll back."""
    s = _changed(r)
    out = None
    for v in range(1, s.version() + 1):
        rows = s.read("records", v).groupBy("review_status").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("regions")), F.lit(0)).alias("n_regions"), F.count_if(F.array_contains("regions", "Germany")).alias("in_germany")).withColumn("version", F.lit(v))
        out = rows if out is None else out.unionByName(rows)
    return out.select("version", "review_status", "n", "n_regions", "in_germany")


@query("M1, M4, M6", f"WITH {_VERSIONS} SELECT v1.record_id, v1.review_status AS before, v2.review_status AS after FROM v1 JOIN v2 ON v1.record_id = v2.record_id WHERE v1.review_status <> v2.review_status", on_records=True)
def changes_between_versions(r: DataFrame) -> DataFrame:
    """Records whose status differs between the first and the last version."""
    s = _changed(r)
    old, new = s.read("records", 1), s.read("records")
    return old.select("record_id", F.col("review_status").alias("before")).join(new.select("record_id", F.col("review_status").alias("after")), "record_id").where("before <> after")


def _runs(r: DataFrame) -> H.QualityHistory:
    """Three runs: over pending records, over approved ones, and over all."""
    rows = materialised(Q.reviewed(r), "reviewed")
    h = H.QualityHistory(r.sparkSession, scratch_path(r.sparkSession, "runs"))
    h.run(rows.where("review_status = 'Pending'"), "record_only", "2024-03-04 09:30:00")
    h.run(rows.where("review_status = 'Approved'"), "record_only", "2024-03-05 09:30:00")
    h.run(rows, "all_records", "2024-03-05 16:00:00")
    return h


_HISTORY = (
    _FOUND
    + f""", t AS (SELECT 1 AS run_version, record_id, dedupe_key FROM keyed WHERE review_status = 'Pending' UNION ALL SELECT 2, record_id, dedupe_key FROM keyed WHERE review_status = 'Approved' UNION ALL SELECT 3, record_id, dedupe_key FROM keyed),
 ff AS (SELECT run_version, t.record_id, severity, finding FROM t JOIN f ON f.record_id = t.record_id WHERE finding <> 'duplicate_record_in_brief' UNION ALL SELECT run_version, record_id, 'High', 'duplicate_record_in_brief' FROM (SELECT *, min(record_id) OVER (PARTITION BY run_version, dedupe_key) AS m FROM t) WHERE record_id <> m),
 per AS (SELECT t.run_version, t.record_id, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m, count(*) FILTER (severity = 'Low') AS l, coalesce(max(CAST(finding IN ({', '.join(f"'{x}'" for x in Q.EVIDENCE)}) AS INTEGER)), 0) AS e,
  coalesce(max(CAST(finding = 'canonicalization_inconsistent' AS INTEGER)), 0) AS c, coalesce(max(CAST(finding IN ({', '.join(f"'{x}'" for x in Q.GEOGRAPHY)}) AS INTEGER)), 0) AS g FROM t LEFT JOIN ff ON ff.run_version = t.run_version AND ff.record_id = t.record_id GROUP BY ALL),
 runs AS (SELECT run_version, round(sum(h) / count(*)::DOUBLE, 4) AS kpi_r1, round(sum(m) / count(*)::DOUBLE, 4) AS kpi_r2, round(1 - sum(e) / count(*)::DOUBLE, 4) AS kpi_r3, round(1 - sum(c) / count(*)::DOUBLE, 4) AS kpi_r4, round(1 - sum(g) / count(*)::DOUBLE, 4) AS kpi_r5, round_even(round_even(avg(greatest(0, 100 - 25 * h - 10 * m - 2 * l)), 1), 0)::DOUBLE AS score FROM per GROUP BY 1),
 kpis AS (SELECT run_version, unnest(['kpi_r1', 'kpi_r2', 'kpi_r3', 'kpi_r4', 'kpi_r5', 'weighted_record_score', 'weighted_overall_score']) AS kpi, unnest([kpi_r1, kpi_r2, kpi_r3, kpi_r4, kpi_r5, score, score]) AS value FROM runs)"""
)


@query("T27, T28, A31", _HISTORY + f""", w AS (SELECT *, avg(value) OVER o AS pa, last_value(value) OVER o AS pl FROM kpis WINDOW o AS (PARTITION BY kpi ORDER BY run_version ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)), d AS (SELECT *, value - pa AS delta, CASE WHEN kpi IN {tuple(H.LOWER_IS_BETTER)} THEN pa - value ELSE value - pa END AS better FROM w WHERE pa IS NOT NULL)
 SELECT CAST(run_version AS INTEGER) AS run_version, kpi, value AS current, pl AS last, round(pa, 4) AS avg_prior, round(delta, 4) AS delta_from_avg, round(value - pl, 4) AS delta_from_last, CASE WHEN better > 0 THEN 'improving' WHEN better < 0 THEN 'declining' ELSE 'stable' END AS direction,
 better < 0 AND abs(delta) >= CASE WHEN kpi IN {tuple(H.RATIOS)} THEN {V.RATIO_ALERT} ELSE {V.COUNT_ALERT} END AS alert FROM d""", on_records=True)
def run_trends(r: DataFrame) -> DataFrame:
    """Trends and alerts of the runs that the history has."""
    return _runs(r).trends()


@query("A18, T29", _HISTORY + f""", p AS (SELECT finding, run_version, min(record_id) AS first, count(*) AS n FROM ff GROUP BY ALL)
 SELECT finding, count(*) AS frequency, 3::BIGINT AS n_runs, round(count(*) / 3.0::DOUBLE, 2) AS ratio, sum(n)::BIGINT AS n_findings, coalesce({_map(H.SUGGESTIONS)}[finding], '') AS suggestion, array_to_string(list_sort(list_distinct(list(first)))[1:3], ', ') AS examples FROM p GROUP BY finding""", on_records=True)
def run_chronic_issues(r: DataFrame) -> DataFrame:
    """Kinds of findings that recur in the runs, with suggestions."""
    return _runs(r).chronic()


@query("T30, A12", _HISTORY + """, k AS (SELECT record_id, finding, count(*) AS n FROM ff WHERE run_version = 3 GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY n DESC, finding) AS rn FROM k),
 tops AS (SELECT record_id, string_agg(finding || ' (' || n || ')', ', ' ORDER BY rn) FILTER (rn <= 3) AS top, sum(n)::BIGINT AS total FROM s GROUP BY 1)
 SELECT p.record_id, p.h AS high, p.m AS medium, p.l AS low, coalesce(total, 0) AS total_findings, greatest(0, 100 - 25 * h - 10 * m - 2 * l) AS score, coalesce(top, '') AS top_finding_types FROM per p LEFT JOIN tops ON tops.record_id = p.record_id WHERE run_version = 3""", on_records=True)
def run_breakdown(r: DataFrame) -> DataFrame:
    """Each record's findings in the last run."""
    return _runs(r).breakdown(r, 3).select("record_id", "high", "medium", "low", "total_findings", "score", "top_finding_types")


@query("A17, F-d10", _HISTORY + """, a AS (SELECT run_version, CASE run_version WHEN 1 THEN TIMESTAMP '2024-03-04 09:30:00' WHEN 2 THEN TIMESTAMP '2024-03-05 09:30:00' ELSE TIMESTAMP '2024-03-05 16:00:00' END AS moment, score AS value FROM runs),
 b AS (SELECT 'hour' AS unit, strftime(date_trunc('hour', moment), '%Y-%m-%d %H:%M:%S') AS bucket, value FROM a UNION ALL SELECT 'day', CAST(CAST(moment AS DATE) AS VARCHAR), value FROM a UNION ALL SELECT 'week', CAST(CAST(date_trunc('week', moment) AS DATE) AS VARCHAR), value FROM a UNION ALL SELECT 'version', CAST(run_version AS VARCHAR), value FROM a)
 SELECT unit, bucket, score, round(avg(value), 6) AS mean, count(*) AS n FROM b, (SELECT unnest(['record', 'overall']) AS score) GROUP BY ALL""", on_records=True)
def run_score_buckets(r: DataFrame) -> DataFrame:
    """Scores of the runs by hour, day, week and version."""
    return _runs(r).score_buckets()


def _finalised(r: DataFrame, ratio: float) -> DataFrame:
    s = StoryStore(r.sparkSession, scratch_path(r.sparkSession, "stories"), ratio)
    own = ("record_id", "title", "source_type", "publish_date", "created_at", "confidence", "regions", "evidence", "url", "topics", "companies", "n")
    rows = materialised(r.select(*own), "records")
    for first in (F.col("n") % 2 == 0, F.col("n") % 2 != 0):  # two uploads; all records are in one of them
        s.add(rows.where(first))
    return s.records().select("record_id", "review_status", "outcome", "is_duplicate", "duplicate_story_of", "story_primary")


@query("T20, J9", on_records=True)
def finalized_records(r: DataFrame) -> DataFrame:
    """Two batches added to a store: approval, and which record of similar stories counts."""
    return _finalised(r, 0.88)


@query("T20, J12", _SCORED + f""", b AS (SELECT *, n % 2 AS batch, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 \\t\\r\\n\\f]', '', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT list_contains({_list(V.TITLE_STOPWORDS)}, t))[1:8], ' ') AS fp, publisher_score * 100 + confidence_score * 10 + completeness AS quality FROM keyed),
 o AS (SELECT *, row_number() OVER (ORDER BY batch, created_at, record_id) AS arrival FROM b),
 s AS (SELECT *, CASE WHEN fp <> '' THEN max(quality) OVER w END AS strongest, CASE WHEN fp <> '' THEN count(*) OVER w ELSE 0 END AS met FROM o WINDOW w AS (PARTITION BY fp ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 j AS (SELECT *, CASE WHEN met = 0 THEN '{SAVED}' WHEN strongest > quality THEN '{LOSES}' ELSE '{WINS}' END AS outcome FROM s),
 l AS (SELECT *, CASE WHEN fp <> '' THEN max(CASE WHEN outcome = '{WINS}' THEN arrival END) OVER (PARTITION BY fp) END AS last_winner FROM j),
 d AS (SELECT l.*, coalesce(last_winner > arrival, false) AS later, (SELECT arg_min(x.record_id, x.arrival) FROM j x WHERE x.fp = l.fp AND x.quality = l.strongest AND x.arrival < l.arrival) AS best FROM l)
 SELECT d.record_id, CASE WHEN d.confidence IN ('High', 'Medium') AND d.publish_date IS NOT NULL AND d.source_type <> 'Other' AND len(d.evidence) >= 2 THEN 'Approved' ELSE 'Pending' END AS review_status, d.outcome, d.later OR d.outcome = '{LOSES}' AS is_duplicate, CASE WHEN d.later THEN win.record_id WHEN d.outcome = '{LOSES}' THEN d.best END AS duplicate_story_of,
 CASE WHEN d.later OR d.outcome = '{LOSES}' THEN false WHEN d.outcome = '{WINS}' THEN true END AS story_primary FROM d LEFT JOIN o AS win ON win.arrival = d.last_winner""", on_records=True)
def finalized_equal_titles(r: DataFrame) -> DataFrame:
    """The same where only equal fingerprints are one story."""
    return _finalised(r, 1.0)
