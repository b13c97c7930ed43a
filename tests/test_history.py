"""The history of quality runs by hand, and relinking against a loop."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from tidemark.operators import fuzzy as Z
from tidemark.operators import quality as Q
from tidemark.operators.history import QualityHistory
from tidemark.plans.catalog import story_records
from tidemark.sources.stores import scratch_path


def test_runs_trends_and_chronic_issues(spark, sf_dir):
    rows = Q.reviewed(story_records(spark, sf_dir)).cache()
    h = QualityHistory(spark, scratch_path(spark, "runs"))
    brief = spark.range(1).select(F.lit(2.0).alias("kpi_b1"), F.lit(0.0).alias("kpi_b2"), F.lit(1.0).alias("kpi_b3"), F.lit(3.0).alias("kpi_b4"), F.lit(4.0).alias("kpi_b5"), *(F.lit(k).cast("long").alias(f"brief_qc_{s}") for k, s in enumerate(("high", "medium", "low"))), F.lit(81.0).alias("weighted_brief_score"))
    clean = rows.where("record_id = 'none'")
    more = spark.createDataFrame([("r0000001", "Medium", "near_duplicate_titles")], "record_id string, severity string, finding string")
    assert h.run(rows, "all_records", "2024-01-01 10:00:00") == 1 and h.run(rows, "all_records", "2024-01-08 10:00:00", more, brief) == 2 and h.run(clean, "record_only", "2024-01-09 10:00:00") == 3
    runs = {r.run_version: r for r in h.store.read("runs").collect()}
    assert runs[2].record_qc_medium == runs[1].record_qc_medium + 1 and runs[2].weighted_overall_score == round((runs[2].weighted_record_score + 81) / 2, 1)
    assert runs[3].target_record_count == 0 and runs[3].kpi_r1 is None
    trends = {(r.run_version, r.kpi): r for r in h.trends().collect()}
    assert (1, "kpi_r1") not in trends and (2, "kpi_b1") not in trends, "no earlier value"
    assert trends[2, "kpi_r1"].direction == "stable" and trends[2, "kpi_r2"].direction == "declining" and not trends[2, "kpi_r2"].alert
    assert trends[2, "weighted_overall_score"].alert == (abs(runs[2].weighted_overall_score - runs[1].weighted_overall_score) >= 2 and runs[2].weighted_overall_score < runs[1].weighted_overall_score)
    chronic = {r.finding: r for r in h.chronic().collect()}
    assert chronic["near_duplicate_titles"].frequency == 1 and chronic["near_duplicate_titles"].examples == "r0000001" and chronic["missing_evidence"].frequency == 2
    assert {r.finding for r in h.chronic(1).collect()} == set(), "the last run has no finding"
    per = {r.record_id: r for r in h.breakdown(rows, 2).collect()}
    assert "near_duplicate_titles" in per["r0000001"].top_finding_types or per["r0000001"].total_findings > 3
    assert sum(r.total_findings for r in per.values()) == h.store.read("findings", 2).where("run_version = 2").count()
    weeks = {r.bucket: r.n for r in h.score_buckets().where("unit = 'week' AND score = 'record'").collect()}
    assert weeks == {"2024-01-01": 1, "2024-01-08": 1}, "a run without records has no score"
    assert h.store.read("runs", 1).count() == 1 and h.store.tables() == ["findings", "runs", "scores"]


def test_relinking_as_a_loop(spark):
    r = random.Random(2)
    titles = [" ".join("".join(r.choices("abcdeilmnorst", k=6)) for _ in range(8)) for _ in range(6)]

    def some(n, kind):
        out = []
        for k in range(n):
            t = r.choice([*titles, ""])
            if t and r.random() < 0.4:
                at = r.randrange(len(t))
                t = t[:at] + r.choice("xyz ") + t[at + 1 :]
            out.append((f"{kind}{k:02}", t, r.choice([None, "", "u1", "u2", f"own{kind}{k}"]), r.choice(["a", "b"]), r.choice([None, "2024-01-01", "2024-01-02"]), r.choice(["x", "y"])))
        return out

    old, new = some(40, "old"), some(60, "new")
    want = {}
    for i, t, u, source, day, _ in old:
        hits, stage = [x for x in new if u and x[2] == u], "url"
        if not hits:
            hits, stage = [x for x in new if t and x[1] == t], "title"
        if not hits:
            hits, stage = [x for x in new if t and x[1] and SequenceMatcher(None, t, x[1]).ratio() >= 0.93], "similar"
        best = max(hits, key=lambda x: (4 * (x[3] == source) + 3 * (day is not None and x[4] == day), x[5], x[0]), default=None)
        want[i] = (best[0], stage) if best else (None, "none")
    schema = "id string, title_key string, url_key string, source string, day string, created string"
    got = {x.id: (x.new_id, x.stage) for x in Z.relinked(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert got == want and {s for _, s in want.values()} >= {"url", "title", "similar"}
