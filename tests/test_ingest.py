"""Bulk ingest as a loop over files would do it, in batches, and again after a failure."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.sources.stores import scratch_path
from tidemark.streaming.ingest import SAME_NAME, SAME_TITLE, SAVED, BulkIngest, decide

SCHEMA = "file string, arrived_at string, proposed string, title string"


def fingerprint(text):
    kept = [w for w in "".join(c for c in (text or "").lower() if c.isascii() and (c.isalnum() or c in " \t\r\n")).split() if w not in V.TITLE_STOPWORDS]
    return " ".join(kept[:8])


def loop(files):
    admitted, out = set(), {}
    for file, _, proposed, title in sorted(files, key=lambda f: (f[1], f[0])):
        p, e = fingerprint(proposed), fingerprint(title)
        if p and p in admitted:
            out[file] = SAME_NAME
        elif title is not None and title != proposed and e and e in admitted:
            out[file] = SAME_TITLE
        else:
            out[file] = SAVED
            admitted |= {e} - {""}
    return out


def some_files(n=90, seed=5):
    r = random.Random(seed)
    names = [f"story {k}" for k in range(14)] + ["", None, "The Story 3!"]
    return [(f"f{k:03}", f"2024-01-{1 + k // 30:02} 00:{r.randint(0, 20):02}", r.choice(names), r.choice(names)) for k in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_a_batch_is_decided_as_a_loop_does(spark, seed):
    files = some_files(seed=seed)
    got = {r.file: r.outcome for r in decide(spark.createDataFrame(files, SCHEMA), spark.createDataFrame([], "fingerprint string")).collect()}
    assert got == loop(files) and set(got.values()) == {SAVED, SAME_NAME, SAME_TITLE}


def test_a_chain_where_each_file_keeps_out_the_next(spark):
    files = [(f"f{k}", f"{k:02}", f"title {k}", f"title {k + 1}") for k in range(6)] + [("g", "99", "title 3", "title 3")]
    got = {r.file: r.outcome for r in decide(spark.createDataFrame(files, SCHEMA), spark.createDataFrame([("title 0",)], "fingerprint string")).collect()}
    want = {"f0": SAME_NAME, "f1": SAVED, "f2": SAME_NAME, "f3": SAVED, "f4": SAME_NAME, "f5": SAVED, "g": SAVED}
    assert got == want


def test_a_stream_goes_on_after_a_failure(spark):
    files, folder = some_files(), scratch_path(spark, "incoming")
    for day in range(3):
        part = [f for f in files if f[1].startswith(f"2024-01-{day + 1:02}")]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)

    class Failing(BulkIngest):
        failed = False

        def take(self, batch, number):
            super().take(batch, number)
            if number == 1 and not Failing.failed:
                Failing.failed = True
                raise RuntimeError("after the commit, before the checkpoint knows")

    s = Failing(spark, scratch_path(spark, "ingest"))
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    with pytest.raises(Exception, match="after the commit"):
        s.start(stream()).awaitTermination()
    assert s.store.version() == 2
    s.start(stream()).awaitTermination()
    rows = s.outcomes().collect()
    assert {r.file: r.outcome for r in rows} == loop(files) and len(rows) == len(files)
    assert s.store.version() == 3 and s.outcomes().select("batch").distinct().count() == 3
    s.start(stream()).awaitTermination()
    assert s.store.version() == 3, "nothing new, nothing done"
