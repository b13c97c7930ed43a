"""The versioned store, and records finalised against it as a loop would do it."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tidemark.operators import finalize as N
from tidemark.sources.stores import scratch_path
from tidemark.sources.versions import Conflict, VersionedStore


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_stay_readable(spark):
    s = VersionedStore(spark, scratch_path(spark, "v"))
    assert s.version() == 0 and s.tables() == []
    df = spark.range(10).select(F.col("id").cast("int").alias("k"), F.lit("a").alias("v"))
    assert s.append("t", df.where("k < 5")) == 1 and s.append("t", df.where("k >= 5")) == 2
    before = set(s.manifest()["tables"]["t"]["files"])
    assert s.dry_run("t", "k", F.col("k") > 7, {"v": F.lit("b")}).count() == 2 and s.version() == 2
    assert s.update("t", F.col("k") > 7, {"v": F.lit("b")}) == 3
    assert set(s.manifest()["tables"]["t"]["files"]) & before, "files without such rows are not copied"
    assert s.delete("t", F.col("k") == 0) == 4 and s.delete("t", F.col("k") == 77) == 4
    assert s.upsert("t", spark.createDataFrame([(1, "c"), (50, "d")], "k int, v string"), "k") == 5
    assert rows_of(s.read("t")) == [(1, "c"), *((k, "a") for k in range(2, 8)), (8, "b"), (9, "b"), (50, "d")]
    assert rows_of(s.read("t", 2)) == [(k, "a") for k in range(10)]
    assert s.rollback(2) == 6 and rows_of(s.read("t")) == rows_of(s.read("t", 2))
    assert [r.operation for r in s.history().orderBy("version").collect()] == ["append", "append", "update", "delete", "upsert", "rollback to 2"]
    assert s.overwrite("t", df.limit(0)) == 7 and s.read("t").count() == 0
    assert s.vacuum(1) > 0 and s.read("t").count() == 0 and s.version() == 7


def test_a_commit_is_whole_or_fails(spark):
    s = VersionedStore(spark, scratch_path(spark, "v"))
    df = spark.range(3).select("id")
    s.commit("both", {"a": df, "b": df})
    files = set(s.manifest()["tables"]["a"]["files"])
    s.overwrite("a", df.limit(1))
    with pytest.raises(Conflict):
        s.commit("late", {"a": df}, {"a": files})
    assert s.version() == 2 and s.read("a").count() == 1 and s.read("b").count() == 3
    assert not s._publish("manifests/00000002.json", "{}"), "a version has one manifest"


def loop(batches, ratio):
    """Records one after another, as a single ingest does it."""
    store = []
    for batch in batches:
        for rec in sorted(batch, key=lambda r: (r["created_at"], r["record_id"])):
            rec = dict(rec, is_duplicate=False, duplicate_story_of=None, story_primary=None, outcome=N.SAVED)
            similar = [(e, q) for e in store if rec["fp"] and e["fp"] and (q := 1.0 if rec["fp"] == e["fp"] else SequenceMatcher(None, rec["fp"], e["fp"]).ratio()) >= ratio]
            similar.sort(key=lambda x: -x[1])
            if similar:
                best, top = rec, rec["quality"]
                for e, _ in similar:
                    if e["quality"] > top:
                        best, top = e, e["quality"]
                if best is rec:
                    rec.update(story_primary=True, outcome=N.WINS)
                    for e, _ in similar:
                        e.update(is_duplicate=True, duplicate_story_of=rec["record_id"], story_primary=False)
                else:
                    rec.update(is_duplicate=True, duplicate_story_of=best["record_id"], story_primary=False, outcome=N.LOSES)
            store.append(rec)
    return sorted((r["record_id"], r["outcome"], r["is_duplicate"], r["duplicate_story_of"], r["story_primary"]) for r in store)


@pytest.mark.parametrize("ratio", [0.88, 1.0])
def test_batches_end_as_a_loop_does(spark, ratio):
    r = random.Random(7)
    stories = [" ".join("".join(r.choices("abcdeilmnorst", k=7)) for _ in range(7)) for _ in range(9)] + [""]
    sources = {"S&P": 100, "Reuters": 80, "Other": 50}
    batches = []
    for b in range(3):
        batch = []
        for k in range(25):
            fp, source, confidence, bullets = r.choice(stories), r.choice(list(sources)), r.choice(["High", "Medium", "Low"]), r.randint(0, 3)
            if fp and r.random() < 0.5:
                at = r.randrange(len(fp))
                fp = " ".join((fp[:at] + r.choice("xyz") + fp[at + 1 :]).split())
            quality = (sources[source], {"High": 3, "Medium": 2, "Low": 1}[confidence], (b + k) % 2 + 0 + 0 + (bullets >= 3))
            batch.append(dict(record_id=f"r{b}{k:02}", fp=fp, title=fp.upper(), source_type=source, confidence=confidence, url="u" if (b + k) % 2 else None, evidence=["e"] * bullets, created_at=f"2024-01-01 00:{r.randint(0, 9):02}:00", quality=quality))
        batches.append(batch)
    s = N.StoryStore(spark, scratch_path(spark, "stories"), ratio)
    schema = "record_id string, title string, source_type string, confidence string, url string, evidence array<string>, created_at string, publish_date date, regions array<string>, topics array<string>, companies array<string>"
    for batch in batches:
        rows = [(x["record_id"], x["title"], x["source_type"], x["confidence"], x["url"], x["evidence"], x["created_at"], None, [], [], []) for x in batch]
        s.add(spark.createDataFrame(rows, schema))
    got = sorted(tuple(x) for x in s.records().select("record_id", "outcome", "is_duplicate", "duplicate_story_of", "story_primary").collect())
    want = loop(batches, ratio)
    assert got == want
    assert {x[1] for x in want} == {N.SAVED, N.WINS, N.LOSES}
    assert s.records(1).count() == 25 and s.records(2).count() == 50
