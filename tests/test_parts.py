"""Stores, maintenance, cleaning, chunking, streaming."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from tidemark.operators import chunking as K
from tidemark.operators import cleaning as C
from tidemark.operators import maintenance as M
from tidemark.sources import stores as S


def test_jsonl_skips_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"record_id": "1", "topics": ["x"]}\n\n{broken\n{"record_id": "2"}\n')
    assert sorted(r.record_id for r in S.read_jsonl(spark, str(tmp_path)).collect()) == ["1", "2"]
    bad = S.read_jsonl(spark, str(tmp_path), report=True).cache().where("_corrupt_record IS NOT NULL").collect()
    assert [(r._corrupt_record, r._file) for r in bad] == [("{broken", "a.jsonl")]


def test_overwrite_append_seed(spark, tmp_path):
    store, base = str(tmp_path / "store"), str(tmp_path / "base")
    row = lambda i: spark.createDataFrame([(i,)], "record_id string")
    S.overwrite_jsonl(row("1"), base)
    assert S.seed(spark, store, base) and not S.seed(spark, store, base)
    S.append_jsonl(row("2"), store)
    S.overwrite_jsonl(S.read_jsonl(spark, store).select("record_id"), store)
    assert sorted(r.record_id for r in S.read_jsonl(spark, store).collect()) == ["1", "2"]


def test_dimension_and_csv(spark, tmp_path):
    (tmp_path / "d.csv").write_bytes("﻿Row type , Country name (new)\ncountry, France \n".encode())
    got = S.read_dimension(spark, str(tmp_path / "d.csv"), {"row": "kind", "country name": "country"}).collect()
    assert [tuple(r) for r in got] == [("country", "France")]
    df = spark.createDataFrame([(["a", "", "b"], "x")], "b array<string>, a string")
    assert S.flatten(df).columns == ["a", "b"] and S.flatten(df).first().b == "a; b"
    S.write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "out")).collect()] == [("x", "a; b")]


def test_latest_file_and_texts(spark, tmp_path):
    import os

    for i, name in enumerate(("b.md", "a.md")):
        (tmp_path / name).write_text(f"text {name}\nmore")
        os.utime(tmp_path / name, (1000 + i, 1000 + i))
    assert S.latest_file(spark, str(tmp_path)).first().path.endswith("a.md")
    assert S.latest_file(spark, str(tmp_path), 1).first().path.endswith("b.md")
    assert {r.name: r.text for r in S.read_texts(spark, str(tmp_path)).collect()}["b.md"] == "text b.md\nmore"


def test_maintenance(spark):
    store = spark.createDataFrame([("1", "t", "a"), ("2", "t", "b")], "record_id string, created_at string, title string")
    out = M.replace_records(store, spark.createDataFrame([("2", "z", "new")], "record_id string, created_at string, title string"))
    assert sorted(map(tuple, out.collect())) == [("1", "t", "a"), ("2", "t", "new")]
    assert M.delete_records(store, store.where("record_id = '1'")).count() == 1
    index = spark.createDataFrame([("f", 1, "final"), ("f", 2, "final"), ("g", 1, "final")], "family string, version int, status string")
    assert sorted((r.family, r.version, r.status) for r in M.supersede(index).collect()) == [("f", 1, "superseded"), ("f", 2, "final"), ("g", 1, "final")]
    a = spark.createDataFrame([("x", "1", "i")], "file string, created_at string, status string")
    b = spark.createDataFrame([("x", "1", "s"), ("y", "1", "s")], "file string, created_at string, status string")
    assert sorted((r.file, r.status) for r in M.merge_history(a, b).collect()) == [("x", "i"), ("y", "s")]
    before = spark.createDataFrame([("1", "2024-01-01"), ("2", "bad")], "record_id string, publish_date string")
    after = spark.createDataFrame([("1", "2024-01-02", "guess"), ("2", "2024-01-02", "guess")], "record_id string, publish_date string, rule string")
    assert [r.record_id for r in M.guard_dates(before, after, ("header",)).collect()] == ["1"]
    assert M.guard_dates(before, after, ("guess",)).count() == 0


LINES = [
    ("Page 3 of 12", "page_number"), ("https://a.b https://c.d", "link_heavy"), ("=== 12 === 34 ===", "symbol_heavy"), ("12 | 34 | 56", None),
    ("Please subscribe today", "nav"), ("Sponsored content", "promo"), ("Read next: more", "related"), ("Find us on LinkedIn now", "social"), ("Create an account for more", "paywall"), ("Already a subscriber? go", "nav"),
    ("Copyright 2024 Someone", "legal"), ("Photo: J. Doe", "image_credit_short"), ("FIRST MENU", None), ("SECOND MENU", "short_allcaps_menu"), ("By Jane Doe", "byline"), ("An ordinary line of text here", None),
]


def test_line_reasons(spark):
    df = spark.createDataFrame([(1, "\n".join(x for x, _ in LINES)), (2, None), (3, "same foot\n" * 3 + "inter-\nnal word")], "doc_id int, text string")
    got = {(r.doc_id, r.line): r.reason for r in C.line_reasons(df).collect()}
    assert {x: got[1, x] for x, _ in LINES} == dict(LINES)
    assert got[3, "same foot"] == "repeated_header_footer" and got[3, "internal word"] is None


def plain_sentences(text, most, enough):
    """What sentence_chunks() says, word for word."""
    out = []
    for p in filter(None, (x.strip(" \t\n") for x in re.split(r"\n\s*\n+", text))):
        if len(p) <= most:
            out.append(p)
            continue
        parts = []
        for s in filter(None, (x.strip(" ") for x in re.split(r"(?<=[.!?])\s+", p))):
            if parts and not parts[-1][1] and len(parts[-1][0]) + 1 + len(s) <= most:
                parts[-1][0] += " " + s
                parts[-1][1] = len(parts[-1][0]) >= enough
            else:
                first = not parts or parts[-1][1]  # what follows a chunk that is full may be full itself
                parts.append([s, first and len(s) >= enough])
        out += [x for x, _ in parts]
    return out


def test_chunks_lose_no_words_and_follow_the_rule(spark):
    r = random.Random(5)
    texts = ["", "one", "a " * 500, " \n\n \n\n"] + ["".join(r.choice(["ab", "c", ". ", " ", "\n", "\n\n", "! ", "é"]) for _ in range(r.randrange(200))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string")
    rows = df.select("i", "t", K.sentence_chunks(F.col("t"), 60, 40).alias("s"), K.overlap_chunks(F.col("t"), F.lit("T"), 1100, 0).alias("o")).collect()
    for x in rows:
        if x.t is None:
            assert x.s == [] and x.o == []
            continue
        assert x.s == plain_sentences(x.t, 60, 40), repr(x.t)
        bodies = [c.split("\n\n", 1)[1] for c in x.o]
        assert all(c.startswith(f"CHUNK {k}/{len(bodies)}\nDOC TITLE (if detected): T\n") for k, c in enumerate(x.o, 1))
        for chunks in (x.s, bodies):
            assert " ".join(" ".join(chunks).split()) == " ".join(x.t.split())


def test_trimming_takes_blanks_only_not_the_digits_of_an_index(spark):
    text = " ".join(f"{k}{k} words of the sentence {k}." for k in range(14))
    got = spark.createDataFrame([(text,)], "t string").select(K.sentence_chunks(F.col("t"), 60, 40).alias("s"), K.ordered_distinct(F.array(F.lit(" a"), F.lit("12 "), F.lit("2b2")), 3).alias("o")).first()
    assert " ".join(got.s) == text and got.o == ["a", "12", "2b2"]
    lines = spark.createDataFrame([("x\n" + "1" * 25 + "\n" + "2" * 25,)], "chunk string")
    assert "nav_like" not in C.chunk_scores(lines, [], []).first().flags, "one of three lines is short"


def test_overlap_is_recursive(spark):
    text = "\n\n".join((f"{c} " * 300).strip() for c in "abc")
    out = spark.range(1).select(K.overlap_chunks(F.lit(text), F.lit(""), 1100, 700).alias("o")).first().o
    bodies = [c.split("\n\n", 1)[1] for c in out]
    assert len(bodies) == 3 and bodies[1].startswith("a") and "a" in bodies[2]
    t = lambda s, n: spark.range(1).select(K.tail(F.lit(s), n)).first()[0]
    assert [t("one two three", 5), t("one two three", 8), t("one", 9), t("onetwo", 3)] == ["three", "three", "one", ""]


def test_streaming_weeks_match_batch(spark, sf_dir, tmp_path):
    import shutil

    from tidemark.streaming.events import event_stream, weekly_volume

    (tmp_path / "in").mkdir()
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "in" / "events.parquet")
    q = weekly_volume(event_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("weeks").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.week, r.event_type): r.n for r in spark.sql("SELECT * FROM weeks").collect()}
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    want = {(r.w, r.event_type): r["count"] for r in e.groupBy(F.date_trunc("week", F.col("ts").cast("timestamp")).alias("w"), "event_type").count().collect()}
    assert got == want


def test_streaming_fresh_stories(spark, tmp_path):
    from tidemark.streaming.events import fresh_stories

    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("The big  Story!", t), ("big story", t + dt.timedelta(days=1)), ("other", t)], "title string, created_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    q = fresh_stories(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("fresh").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.fingerprint for r in spark.sql("SELECT * FROM fresh").collect()) == ["big story", "other"]


def test_context_pack_against_recomputing(spark):
    """Chunks go one by one until the rendered pack is short enough."""
    r = random.Random(2)
    rows = []
    for doc in range(8):
        for idx in range(r.randrange(1, 9)):
            rows.append((doc, idx, "x" * r.randrange(1, 4000), r.randrange(0, 4), "header" if idx < 2 else "body"))
    df = spark.createDataFrame(rows, "doc_id int, idx int, chunk string, score int, part string")
    got = {x.doc_id: x.pack for x in C.render_pack(df, F.lit("T")).collect()}
    for doc in {x[0] for x in rows}:
        heads, bodies = ([x for x in rows if x[0] == doc and x[4] == p] for p in ("header", "body"))
        while True:
            pack = "\n".join(["TITLE: T\n", "DOC_HEADER_CHUNKS:", *(f"[H{i}] {x[2]}" for i, x in enumerate(heads, 1)), "", "DOC_BODY_CHUNKS:", *(f"[B{i}] {x[2]}" for i, x in enumerate(bodies, 1)), "", "CONSTRAINTS:", "Use only these chunks. Ignore ads/sidebars/navigation."])
            if len(pack) <= 12_000 or not bodies:
                break
            bodies.remove(min(bodies, key=lambda x: (x[3], -x[1])))
        assert got[doc] == pack[:12_000]


def test_titles_and_fallback(spark):
    df = spark.createDataFrame([(1, "\nhttp://a b\nNews Desk - one two three four\n"), (2, "Great Makers Of Cars Meet In Town\nx"), (3, "ALL IN CAPITALS IS NO TITLE HERE\nplain"), (4, "So-Called O'Neil Plan 12 34 Is Far Off")], "doc_id int, text string")
    assert {r.doc_id: r.title for r in C.title_line(df).collect()} == {1: "News Desk - one two three four", 2: "Great Makers Of Cars Meet In Town", 4: "So-Called O'Neil Plan 12 34 Is Far Off"}
    f = lambda a, b: spark.range(1).select(C.with_fallback(F.lit(a), F.lit(b))).first()[0]
    assert [f("", "o"), f("c", "o"), f("c", "o" * 2000) == "o" * 2000, f("c" * 2000, "o" * 3000) == "c" * 2000] == ["o", "c", True, True]
    meta = C.clean_meta(C.line_reasons(spark.createDataFrame([(1, "a word -\n\nPage 3\n")], "doc_id int, text string"))).first()
    assert (meta.raw_chars, meta.clean_text, meta.removed_chars) == (17, "a word -", 9)


def test_point_fix_files_and_pages(spark):
    from tidemark.operators import filters as P

    store = spark.createDataFrame([("1", "2024-01-01"), ("2", None)], "record_id string, publish_date string")
    out = {r.record_id: r for r in M.point_fix(store, F.col("record_id") == "1", "publish_date", F.lit("2024-02-02"), "by hand").collect()}
    assert out["1"].publish_date == "2024-02-02" and "by hand" in out["1"].mutation and out["2"].mutation is None
    page = P.paged(spark.range(12), [F.col("id").asc()], 5).where("id = 7").first()
    assert (page.place, page.page, page.total) == (8, 1, 12)
    letters = spark.createDataFrame([(n,) for n in (0, 1, 26, 27, 52, 702, 703, 728, 18278)], "n int").select(P.column_letters(F.col("n"))).collect()
    assert [r[0] for r in letters] == ["A", "A", "Z", "AA", "AZ", "ZZ", "AAA", "AAZ", "ZZZ"]
    p = lambda field, old, new: spark.range(1).select(P.apply_policy(field, F.lit(old).cast("string"), F.lit(new), F.lit(False))).first()[0]
    assert [p("priority", "a", "b"), p("title", "a", "b"), p("title", None, "b"), p("event_date", "a", "b")] == ["b", "a", "b", "b"]


def test_overwrite_survives(spark, tmp_path):
    store = str(tmp_path / "s")
    row = lambda i: spark.createDataFrame([(i, None)], "record_id string, title string")
    S.overwrite_jsonl(row("1"), store)
    S.overwrite_jsonl(row("2"), store)
    S.append_jsonl(spark.createDataFrame([(None, None)], "record_id string, title string"), store)
    assert [r.record_id for r in S.read_jsonl(spark, store).collect()] == ["2"] and [p.name for p in tmp_path.iterdir()] == ["s"]


def test_line_differences(spark):
    cases = [("a\nb", "a\nc", 1, 1), ("", "x\ny", 2, 0), (None, None, 0, 0), ("a\nb", "a\nb", 0, 0), ("a\nb\nc", "c", 0, 2), ("x\na\nb", "a\nb\nx", 1, 1), ("a", None, 0, 1)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, a string, b string")
    got = df.select("i", K.line_diff("a", "b").alias("d")).orderBy("i").collect()
    assert [(r.d.added, r.d.removed) for r in got] == [(x, y) for _, _, x, y in cases]
