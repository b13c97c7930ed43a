"""The CSV export against its SQL on titles that a CSV may lose."""

import duckdb

from tidemark.plans.queries import ORACLES, QUERIES

TEXTS = [None, "", " \n", "plain", 'a "quoted" b', '"', '""', "\\", '\\"', "ends with \\", "a,b", "\x0blead", "trail\x0c", "\x00", "\x00nul", "end\x00", "\x01a", "a\x1f", "\x0c", "x ", " x", "﻿bom", "# c", "null", "\\N", "tab\tand\rlines\nhere"]


def test_titles_come_back_as_they_are(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(i, t, "en", "web-01", 40 + i) for i, t in enumerate(TEXTS)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    odd.select(*(c for c in docs.columns if c in odd.columns)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{sf_dir}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    got = {tuple(r) for r in QUERIES["csv_export"](spark, str(tmp_path)).select("record_id", "topics", "regions", "title").collect()}
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.execute(f"SELECT record_id, topics, regions, title FROM ({ORACLES['csv_export']})").fetchall()
    assert got == set(want) and len(want) == len(TEXTS)
    assert {None, "", "\x0blead", "a\x1f"} <= {r[3] for r in want}
