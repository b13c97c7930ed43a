"""Queries of the review queue, merges of chunk records, snapshots, run bookkeeping and changes to stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import clean_list, texts
from tidemark.operators import dedupe as D
from tidemark.operators import filters as P
from tidemark.operators import maintenance as M
from tidemark.operators import quality as Q
from tidemark.operators.merging import merge_lists, merge_records
from tidemark.operators.records import RECORDS_SQL, _list

from .catalog import query, table
from .record_queries import _BRIEFS, _SCORED, _briefs
from .rule_queries import _FOUND

_ROWS = f"""WITH {_BRIEFS}, h AS (SELECT DISTINCT record_id FROM b),
 q AS (SELECT r.*, h.record_id IS NOT NULL AS briefed, coalesce(CAST(created_at AS DATE), publish_date) AS queue_day, lower(replace(concat_ws(' ', title, source_type, array_to_string(keywords, ' '), array_to_string(topics, ' '), 'in_brief ' || CASE WHEN h.record_id IS NOT NULL THEN 'yes' ELSE 'no' END), ',', ' ')) AS blob FROM records r LEFT JOIN h ON h.record_id = r.record_id) """


def _rows(r: DataFrame) -> DataFrame:
    """Review rows: defaults, whether a brief has the record, and the blob that is searched."""
    h = _briefs(r).select("record_id").distinct().withColumn("briefed", F.lit(True))
    q = r.join(h, "record_id", "left").withColumn("briefed", F.coalesce("briefed", F.lit(False)))
    words = F.concat_ws(" ", "title", "source_type", F.array_join("keywords", " "), F.array_join("topics", " "), F.when(F.col("briefed"), "in_brief yes").otherwise("in_brief no"))
    return q.withColumns({"queue_day": F.coalesce(F.col("created_at").cast("date"), F.col("publish_date")), "blob": F.lower(F.replace(words, F.lit(","), F.lit(" ")))})


@query("P4", _ROWS + "SELECT record_id, review_status, briefed, CAST(queue_day AS VARCHAR) AS queue_day, review_status = 'Approved' AND publish_date IS NOT NULL AND NOT briefed AS eligible, md5(blob) AS blob_md5 FROM q", on_records=True)
def review_rows(r: DataFrame) -> DataFrame:
    eligible = (F.col("review_status") == "Approved") & F.col("publish_date").isNotNull() & ~F.col("briefed")
    return _rows(r).select("record_id", P.status(F.col("review_status")).alias("review_status"), "briefed", F.col("queue_day").cast("string").alias("queue_day"), eligible.alias("eligible"), F.md5("blob").alias("blob_md5"))


PAGE_ROWS = 5
_MASK = "review_status IN ('Approved', 'Pending') AND priority IN ('High', 'Medium', 'Low') AND confidence IN ('High', 'Medium') AND source_type <> 'Patent' AND publish_date BETWEEN DATE '2024-01-03' AND DATE '2024-02-25'"


@query("P6, P9, O2, O3", _ROWS + f""", f AS (SELECT * FROM q WHERE {_MASK} AND NOT briefed AND contains(blob, 'ev') AND contains(blob, 'in_brief no') AND len(list_intersect(topics, ['Market & Competition', 'Regulatory & Safety', 'Supply Chain & Manufacturing'])) > 0),
 k AS (SELECT *, row_number() OVER (ORDER BY queue_day DESC NULLS LAST, record_id) AS rn, count(*) OVER () AS total FROM f) SELECT record_id, title, CAST(rn AS INTEGER) AS place, CAST((rn - 1) // {PAGE_ROWS} AS INTEGER) AS page, CAST(least(7, (total - 1) // {PAGE_ROWS}) AS INTEGER) AS shown_page FROM k""", on_records=True)
def filter_review_queue(r: DataFrame) -> DataFrame:
    """The queue under all filters, newest first, with each record's page and the page shown for a wish of page 7, clamped."""
    f = P.search(_rows(r).where(_MASK).where(~F.col("briefed") & F.arrays_overlap("topics", texts(["Market & Competition", "Regulatory & Safety", "Supply Chain & Manufacturing"]))), "EV, in_brief no", blob_column="blob")
    f = P.paged(f.select("record_id", "title", "queue_day"), [F.col("queue_day").desc_nulls_last(), F.col("record_id").asc()], PAGE_ROWS)
    return f.select("record_id", "title", "place", "page", F.least(F.lit(7), F.floor((F.col("total") - 1) / PAGE_ROWS)).cast("int").alias("shown_page"))


@query("P17", _ROWS + """, b2 AS (SELECT brief_id, record_id, row_number() OVER (PARTITION BY brief_id ORDER BY created_at DESC, record_id) AS pos FROM b), k AS (SELECT brief_id, count(*) AS n FROM b2 GROUP BY 1)
 SELECT 'digest' AS target, record_id, CAST(pos AS INTEGER) AS pos FROM b2 WHERE brief_id = 'digest' UNION ALL SELECT 'recent', record_id, CAST(row_number() OVER (ORDER BY record_id) AS INTEGER) FROM records WHERE review_status = 'Approved' AND coalesce(publish_date, CAST(created_at AS DATE)) >= DATE '2024-02-15' - 7""", on_records=True)
def qc_targets(r: DataFrame) -> DataFrame:
    """Records to be judged: those of a brief in its order; without a brief, the approved ones of the last 7 days."""
    ids = _briefs(r).where("brief_id = 'digest'")
    ordered = Q.targets(r, ids.select("record_id", F.row_number().over(Window.partitionBy("brief_id").orderBy(F.col("created_at").desc(), "record_id")).alias("pos")))
    recent = Q.targets(r, None, "2024-02-15", 7)
    return ordered.select(F.lit("digest").alias("target"), "record_id", "pos").unionByName(recent.select(F.lit("recent").alias("target"), "record_id", "pos"))


_SLIM = ["record_id", "title", "priority"]


@query("P1, F-s32, P21", """SELECT record_id, title, priority, array_to_string(keywords[1:2], ', ') || CASE WHEN len(keywords) > 2 THEN ' (+' || (len(keywords) - 2) || ')' ELSE '' END AS preview,
 CASE WHEN trim(coalesce(url, '')) <> '' THEN 'url' WHEN n % 2 = 0 THEN 'store' ELSE 'local' END AS link_kind, coalesce(nullif(trim(url), ''), CASE WHEN n % 2 = 0 THEN 'store/' || record_id ELSE 'files/' || record_id END) AS link FROM records""", on_records=True)
def slim_records(r: DataFrame) -> DataFrame:
    """Records without internal fields, with a preview of their keywords and their best link."""
    full = r.withColumns({"notes": F.lit("n"), "is_duplicate": F.lit(False), "source_pdf_path": F.concat(F.lit("files/"), "record_id"), "store_url": F.when(F.col("n") % 2 == 0, F.concat(F.lit("store/"), "record_id"))})
    best = P.best_link({"url": F.col("url"), "store": F.col("store_url"), "local": F.col("source_pdf_path")})
    slim = P.slim(full.withColumns({"preview": P.preview(F.col("keywords"), 2), "_link": best}))
    return slim.select(*_SLIM, "preview", F.col("_link.kind").alias("link_kind"), F.col("_link.link").alias("link"))


@query("P22", """WITH f AS (SELECT record_id, created_at, 'files/' || record_id || '.pdf' AS stored, 'pdf/' || record_id || '_' || n || '.pdf' AS named, n FROM records)
 SELECT record_id, CASE WHEN n % 3 = 0 THEN stored WHEN n % 3 = 1 THEN replace(stored, 'files/', 'pdf/') WHEN n % 2 = 0 THEN named END AS path FROM f""", on_records=True)
def attachments(r: DataFrame) -> DataFrame:
    """A record's file: as stored, else of the same name in the folder, else the newest whose name begins with its id."""
    stored = F.concat(F.lit("files/"), "record_id", F.lit(".pdf"))
    names = r.where("n % 3 = 0").select(stored.alias("path"), "created_at").unionByName(r.where("n % 3 = 1").select(F.concat(F.lit("pdf/"), "record_id", F.lit(".pdf")).alias("path"), "created_at"))
    old = r.where("n % 3 = 2 AND n % 2 = 0").select(F.concat(F.lit("pdf/"), "record_id", F.lit("_"), (F.col("n") - 1).cast("string"), F.lit(".pdf")).alias("path"), (F.col("created_at") - F.expr("INTERVAL '1' DAY")).alias("created_at"))
    new = r.where("n % 3 = 2 AND n % 2 = 0").select(F.concat(F.lit("pdf/"), "record_id", F.lit("_"), F.col("n").cast("string"), F.lit(".pdf")).alias("path"), "created_at")
    return M.resolve_files(r.select("record_id", stored.alias("stored")), names.unionByName(old).unionByName(new), "pdf")


@query("P23", """SELECT record_id, CASE n % 4 WHEN 1 THEN 'rule:regex_publish_date' WHEN 2 THEN 'rule:pdf_header_publish_date' ELSE 'edit' END AS rule FROM records WHERE publish_date IS NOT NULL AND n % 4 <> 0 AND n % 4 <> 2""", on_records=True)
def date_guard(r: DataFrame) -> DataFrame:
    """Records whose valid date was changed by a rule that may not change it."""
    before = r.select("record_id", F.col("publish_date").cast("string").alias("publish_date"))
    rule = F.when(F.col("n") % 4 == 1, "rule:regex_publish_date").when(F.col("n") % 4 == 2, "rule:pdf_header_publish_date").otherwise("edit")
    after = r.select("record_id", F.when(F.col("n") % 4 == 0, F.col("publish_date").cast("string")).otherwise("2020-01-01").alias("publish_date"), rule.alias("rule"))
    return M.guard_dates(before, after, ("rule:pdf_header_publish_date", "rule:pdf_metadata_publish_date")).select("record_id", "rule")


_COUNT = "len(list_filter(string_split({x}, ' '), lambda w: w <> ''))"
_MERGE = f"""WITH c AS (SELECT conv_id, turn, length(coalesce(text, '')) AS n, trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\f]+', ' ', 'g')) AS body FROM conversations),
 x AS (SELECT conv_id, turn, [{_list(V.TOPICS)}[(n % 9) + 1], upper({_list(V.TOPICS)}[((n + 4) % 9) + 1]), ' '] AS topics, [{_list(V.DEALT_KEYWORDS)}[(n % 13) + 1], ' ' || {_list(V.DEALT_KEYWORDS)}[((n * 3) % 13) + 1] || ' '] AS keywords, [body, 'Point ' || (n % 7)] AS bullets FROM c),
 u AS (SELECT conv_id, 'topics' AS kind, 3 AS cap, turn, unnest(topics) AS item, generate_subscripts(topics, 1) AS nth FROM x UNION ALL SELECT conv_id, 'keywords', 12, turn, unnest(keywords), generate_subscripts(keywords, 1) FROM x UNION ALL SELECT conv_id, 'bullets', 4, turn, unnest(bullets), generate_subscripts(bullets, 1) FROM x),
 d AS (SELECT conv_id, kind, cap, arg_min(trim(item), {{'turn': turn, 'nth': nth}}) AS item, min({{'turn': turn, 'nth': nth}}) AS place FROM u WHERE trim(item) <> '' GROUP BY conv_id, kind, cap, lower(trim(item))),
 e AS (SELECT *, kind <> 'bullets' OR {_COUNT.format(x="item")} <= 25 AS short FROM d), s AS (SELECT *, max(short) OVER (PARTITION BY conv_id, kind) AS any_short FROM e),
 k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY place) AS rn FROM s WHERE short OR NOT any_short) """


def _turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the extraction of each turn of a conversation may have given."""
    n, body = F.length(F.coalesce("text", F.lit(""))), F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[ \t\r\n\f]+", " "))
    pick = lambda values, at: F.element_at(texts(values), (at % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn",
        F.array(pick(V.TOPICS, n), F.upper(pick(V.TOPICS, n + 4)), F.lit(" ")).alias("topics"),
        F.array(pick(V.DEALT_KEYWORDS, n), F.concat(F.lit(" "), pick(V.DEALT_KEYWORDS, n * 3), F.lit(" "))).alias("keywords"),
        F.array(body, F.concat(F.lit("Point "), (n % 7).cast("string"))).alias("bullets"),
        F.when(n % 4 == 0, "Other").when(n % 4 == 1, "Reuters").otherwise("S&P").alias("source_type"),
        F.when(n % 3 != 0, body).alias("title"),
        F.when(n % 5 == 0, F.concat(F.lit("https://example.com/"), n.cast("string"))).otherwise(" ").alias("url"),
        (n % 11 == 0).alias("mentions_our_company"),
        F.when(n % 6 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 28).cast("int"))).alias("publish_date"),
        pick(["High", "Medium", "Low"], n).alias("publish_date_confidence"),
    )


_CAPS = {"topics": 3, "keywords": 12, "bullets": 4}


@query("A20", _MERGE + """, g AS (SELECT conv_id, kind, string_agg(item, ' | ' ORDER BY rn) AS items, count(*) AS n FROM k WHERE rn <= cap GROUP BY ALL)
 SELECT conv_id, kind, md5(CASE WHEN kind = 'bullets' AND n < 2 THEN items || ' | Evidence extracted from cleaned document chunks.' ELSE items END) AS items_md5, CAST(CASE WHEN kind = 'bullets' THEN greatest(n, 2) ELSE n END AS INTEGER) AS n FROM g""")
def chunk_merge_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of a conversation's turns as one, by order, without repeats, capped; short bullets first, and two at least."""
    m = merge_lists(_turn_chunks(spark, sf_dir), "conv_id", "turn", _CAPS, short="bullets")
    return m.select("conv_id", "kind", F.md5(F.array_join("items", " | ")).alias("items_md5"), F.size("items").alias("n"))


@query("T10, A19, A20, A21, A22", _MERGE + """, g AS (SELECT conv_id, kind, string_agg(item, ' | ' ORDER BY rn) AS items, count(*) AS n FROM k WHERE rn <= cap GROUP BY ALL),
 li AS (SELECT conv_id, max(items) FILTER (kind = 'topics') AS topics, max(items) FILTER (kind = 'keywords') AS keywords, max(CASE WHEN n < 2 THEN items || ' | Evidence extracted from cleaned document chunks.' ELSE items END) FILTER (kind = 'bullets') AS bullets FROM g GROUP BY 1),
 v AS (SELECT *, CASE n % 4 WHEN 0 THEN 'Other' WHEN 1 THEN 'Reuters' ELSE 'S&P' END AS source, CASE WHEN n % 3 <> 0 THEN body END AS title, CASE WHEN n % 5 = 0 THEN 'https://example.com/' || n ELSE ' ' END AS url, CASE WHEN n % 6 <> 0 THEN DATE '2024-01-01' + CAST(n % 28 AS INTEGER) END AS day, ['High', 'Medium', 'Low'][(n % 3) + 1] AS conf FROM c),
 w AS (SELECT conv_id, source, row_number() OVER (PARTITION BY conv_id ORDER BY (source = 'Other'), count(*) DESC, min(turn)) AS place FROM v GROUP BY conv_id, source),
 dd AS (SELECT conv_id, day, conf, row_number() OVER (PARTITION BY conv_id ORDER BY CASE conf WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 ELSE 3 END, day DESC) AS place FROM v WHERE day IS NOT NULL),
 t AS (SELECT conv_id, count(*) AS n_chunks, arg_min(title, turn) FILTER (trim(title) <> '') AS title, arg_min(url, turn) FILTER (trim(url) <> '') AS url, bool_or(n % 11 = 0) AS ours FROM v GROUP BY 1)
 SELECT t.conv_id, n_chunks, md5(coalesce(title, '')) AS title_md5, url, w.source AS source_type, ours AS mentions_our_company, CAST(dd.day AS VARCHAR) AS publish_date, dd.conf AS publish_date_confidence, coalesce(topics, '') AS topics, coalesce(keywords, '') AS keywords, md5(coalesce(bullets, '')) AS bullets_md5
 FROM t JOIN w ON w.conv_id = t.conv_id AND w.place = 1 LEFT JOIN dd ON dd.conv_id = t.conv_id AND dd.place = 1 LEFT JOIN li ON li.conv_id = t.conv_id""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of a conversation, taken as chunk records, merged into one record."""
    m = merge_records(_turn_chunks(spark, sf_dir), "conv_id", "turn", _CAPS, short="bullets")
    joined = lambda c: F.array_join(c, " | ")
    return m.select("conv_id", "n_chunks", F.md5(F.coalesce("title", F.lit(""))).alias("title_md5"), "url", "source_type", "mentions_our_company", F.col("publish_date").cast("string").alias("publish_date"), "publish_date_confidence", joined("topics").alias("topics"), joined("keywords").alias("keywords"), F.md5(joined("bullets")).alias("bullets_md5"))


_NOW, _BEFORE = "publish_date BETWEEN DATE '2024-02-16' AND DATE '2024-02-22'", "publish_date BETWEEN DATE '2024-02-09' AND DATE '2024-02-15'"
_CLOSURE = f"(list_contains(topics, 'Closure Technology & Innovation') OR regexp_matches(concat_ws(' ', title, array_to_string(keywords, ' '), array_to_string(evidence, ' '), array_to_string(insights, ' '), array_to_string(topics, ' ')), '(?i)(^|[^A-Za-z0-9_]){V.CLOSURE_PATTERN}($|[^A-Za-z0-9_])'))"
_SIGNED = lambda d: f"CASE WHEN {d} > 0 THEN 'Increase ' || {d} WHEN {d} < 0 THEN 'Decrease ' || abs({d}) ELSE 'No change' END"


@query("A10, F-s27", f"""WITH w AS (SELECT *, {_NOW} AS late, {_CLOSURE} AS closure FROM records WHERE {_NOW} OR {_BEFORE}), t AS (SELECT topic, count(*) FILTER (late) AS n, count(*) FILTER (NOT late) AS p FROM (SELECT unnest(topics) AS topic, late FROM w) GROUP BY 1),
 g AS (SELECT region, count(*) AS n FROM (SELECT unnest(regions) AS region FROM w WHERE late AND closure) GROUP BY 1), c AS (SELECT count(*) FILTER (late) AS n, count(*) FILTER (NOT late) AS p FROM w WHERE closure)
 SELECT 1 AS line_no, 'Market Shift: Top topic signals in the latest filtered window are ' || (SELECT string_agg(topic || ' (' || n || ')', ', ' ORDER BY n DESC, topic) FROM (SELECT * FROM t WHERE n > 0 ORDER BY n DESC, topic LIMIT 2)) || '.' AS line FROM c
 UNION ALL SELECT 2, 'Momentum Signal: Fastest-rising topic is ' || topic || ' (' || ({_SIGNED("(n - p)")}) || ' mention(s) vs prior window).' FROM (SELECT * FROM t ORDER BY n - p DESC, n DESC, topic DESC LIMIT 1) WHERE n - p > 0
 UNION ALL SELECT 3, CASE WHEN n > 0 THEN 'Closure Signal: Closure-system mentions appear in ' || n || ' record(s) (' || ({_SIGNED("(n - p)")}) || ' vs prior window).' ELSE 'Closure Signal: No closure-system mention detected in the latest filtered window.' END FROM c
 UNION ALL SELECT 4, coalesce('Regional Focus: Closure hotspot region is ' || (SELECT region || ' (' || n || ' mention(s)).' FROM g ORDER BY n DESC, region LIMIT 1), 'Regional Focus: Closure-system mentions are present, but no footprint region signal was detected.') FROM c WHERE n > 0""", on_records=True)
def snapshot_lines(r: DataFrame) -> DataFrame:
    """What changed from one week to the next, in at most five lines."""
    from tidemark.operators.analytics import snapshot

    return snapshot(r.where("publish_date BETWEEN DATE '2024-02-09' AND DATE '2024-02-22'").withColumn("late", F.col("publish_date") >= "2024-02-16"))


@query("A29", """WITH f AS (SELECT record_id, created_at, lower(title) AS t, n FROM records), o AS (SELECT record_id, CASE WHEN n % 9 = 0 THEN 'failed: no text' WHEN row_number() OVER (PARTITION BY t ORDER BY created_at, record_id) > 1 THEN 'skipped: duplicate title' WHEN n % 4 = 0 THEN 'saved with warnings' ELSE 'saved' END AS status FROM f)
 SELECT count(*) FILTER (starts_with(status, 'saved')) AS n_saved, count(*) FILTER (starts_with(status, 'skipped')) AS n_skipped, count(*) FILTER (starts_with(status, 'failed')) AS n_failed, count(*) FILTER (contains(status, 'warning')) AS n_warned, count(*) AS n FROM o""", on_records=True)
def bulk_summary(r: DataFrame) -> DataFrame:
    """How many files of a bulk run were saved, skipped, failed."""
    t = r.select("record_id", "created_at", F.lower("title").alias("t"), "n")
    first = t.groupBy("t").agg(F.min_by("record_id", F.struct("created_at", "record_id")).alias("first"))
    status = F.when(F.col("n") % 9 == 0, "failed: no text").when(F.col("record_id") != F.col("first"), "skipped: duplicate title").when(F.col("n") % 4 == 0, "saved with warnings").otherwise("saved")
    o = t.join(first, t.t.eqNullSafe(first.t)).select(status.alias("status"))
    begins = lambda p: F.count_if(F.col("status").startswith(p))
    return o.agg(begins("saved").alias("n_saved"), begins("skipped").alias("n_skipped"), begins("failed").alias("n_failed"), F.count_if(F.col("status").contains("warning")).alias("n_warned"), F.count(F.lit(1)).alias("n"))


@query("A23, S23", "WITH e AS (SELECT CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day, event_type AS model, value FROM events), m AS (SELECT day, model, count(*) AS n, sum(value) AS v FROM e GROUP BY ALL) SELECT day, arg_max(model, {'n': n, 'model': model}) AS model, CAST(sum(n) AS BIGINT) AS calls, round(sum(v), 4) AS tokens FROM m GROUP BY 1")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and tokens of a quota day, which begins at 8 UTC, and the model used most."""
    e = table(spark, sf_dir, "events")
    m = e.groupBy((F.col("ts") - F.expr("INTERVAL '8' HOUR")).cast("date").cast("string").alias("day"), F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return m.groupBy("day").agg(F.max_by("model", F.struct("n", "model")).alias("model"), F.sum("n").alias("calls"), F.round(F.sum("v"), 4).alias("tokens"))


@query("F-json1, F-json2", """SELECT event_id, json_extract_string(props, '$.ref') AS ref, CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN len(json_keys(props)) END AS n_keys FROM events""")
def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of JSON objects; what is no object has none."""
    v = F.try_parse_json("props")
    is_object = F.schema_of_variant(v).startswith("OBJECT")
    return table(spark, sf_dir, "events").select("event_id", F.when(is_object, F.try_variant_get(v, "$.ref", "string")).alias("ref"), F.when(is_object, F.size(F.map_keys(F.from_json("props", "map<string,string>")))).cast("long").alias("n_keys"))


_RUNS = "WITH d AS (SELECT CAST(ts AS DATE) AS day, min(ts) AS created_at, count(*) AS n FROM events GROUP BY 1), runs AS (SELECT 'run-' || day AS run_id, CASE WHEN day = DATE '2024-01-05' THEN NULL ELSE CAST(day - DATE '2024-01-01' + 1 AS INTEGER) END AS run_version, created_at, CASE CAST(day - DATE '2024-01-01' AS INTEGER) % 3 WHEN 0 THEN 'brief' WHEN 1 THEN 'record_only' ELSE 'all_records' END AS target_mode FROM d) "


def _qc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.min("ts").alias("created_at"))
    k = F.date_diff("day", F.lit("2024-01-01").cast("date"))
    return d.select(F.concat(F.lit("run-"), F.col("day").cast("string")).alias("run_id"), F.when(F.col("day") != "2024-01-05", k + 1).alias("run_version"), "created_at", F.when(k % 3 == 0, "brief").when(k % 3 == 1, "record_only").otherwise("all_records").alias("target_mode"))


@query("O8, W11", _RUNS + """SELECT 'latest' AS what, run_id, run_version FROM (SELECT * FROM runs ORDER BY (target_mode IN ('record_only', 'all_records')) DESC, run_version DESC NULLS LAST, created_at DESC LIMIT 1)
 UNION ALL SELECT 'next', NULL, CAST(coalesce(max(run_version) + 1, count(*) + 1) AS INTEGER) FROM runs UNION ALL SELECT 'next_without_versions', NULL, CAST(coalesce(max(run_version) + 1, count(*) + 1) AS INTEGER) FROM runs WHERE run_version IS NULL""")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run over records, and the version of the next one."""
    runs = _qc_runs(spark, sf_dir)
    latest = Q.latest_run(runs).select(F.lit("latest").alias("what"), "run_id", "run_version")
    after = lambda name, df: Q.next_version(df).select(F.lit(name).alias("what"), F.lit(None).cast("string").alias("run_id"), "run_version")
    return latest.unionByName(after("next", runs)).unionByName(after("next_without_versions", runs.where("run_version IS NULL")))


@query("A11, A12, T27", _FOUND + """, p AS (SELECT r.record_id, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m, count(*) FILTER (severity = 'Low') AS l FROM records r LEFT JOIN f ON f.record_id = r.record_id GROUP BY 1),
 s AS (SELECT CAST(sum(h) AS BIGINT) AS high, CAST(sum(m) AS BIGINT) AS medium, CAST(sum(l) AS BIGINT) AS low, count(*) AS n, round_even(avg(greatest(0, 100 - 25 * h - 10 * m - 2 * l)), 1) AS mean FROM p)
 SELECT 'all_records' AS target_mode, n AS target_record_count, high AS record_qc_high, medium AS record_qc_medium, low AS record_qc_low, round(high / n::DOUBLE, 4) AS kpi_r1, round(medium / n::DOUBLE, 4) AS kpi_r2, CAST(round_even(mean, 0) AS INTEGER) AS weighted_record_score, round_even(mean, 0)::DOUBLE AS weighted_overall_score FROM s""", on_records=True)
def quality_run(r: DataFrame) -> DataFrame:
    """The row of a run over all records, as the history of runs keeps it."""
    return Q.run_row(Q.graded(Q.raised(Q.reviewed(r))), "all_records").select("target_mode", "target_record_count", "record_qc_high", "record_qc_medium", "record_qc_low", "kpi_r1", "kpi_r2", "weighted_record_score", "weighted_overall_score")


@query("A14", _FOUND + """, i AS (SELECT record_id, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, record_id LIMIT 20)
 SELECT 'severity' AS pivot, severity AS name, count(*) AS n FROM f GROUP BY severity UNION ALL SELECT 'finding', finding, count(*) FROM f GROUP BY finding UNION ALL SELECT 'record', record_id, n FROM i""", on_records=True)
def findings_pivot(r: DataFrame) -> DataFrame:
    """Findings by severity and type, and the twenty records with most."""
    f = Q.findings(Q.reviewed(r))
    counts = f.groupingSets([["severity"], ["finding"]], "severity", "finding").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.when(F.col("severity").isNotNull(), "severity").otherwise("finding").alias("pivot"), F.coalesce("severity", "finding").alias("name"), "n")
    most = f.groupBy("record_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "record_id").limit(20)
    return counts.unionByName(most.select(F.lit("record").alias("pivot"), F.col("record_id").alias("name"), "n"))


@query("M2, M1", """SELECT record_id, CASE WHEN n % 2 = 0 THEN 'new ' || title ELSE title END AS title, CASE WHEN n % 2 = 0 THEN 'Approved' ELSE review_status END AS review_status, CAST(created_at AS VARCHAR) AS created_at, priority,
 CASE WHEN n % 2 = 0 THEN 'desk' END AS reviewer FROM records""", on_records=True)
def replaced_records(r: DataFrame) -> DataFrame:
    """Records after an edit of every second one; identity stays, blanks of the edit too."""
    store = r.select("record_id", "title", "review_status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"), "priority", F.lit(None).cast("string").alias("reviewer"))
    edited = r.where("n % 2 = 0").select("record_id", F.concat(F.lit("new "), "title").alias("title"), F.lit("Approved").alias("review_status"), F.lit("1999-01-01").alias("created_at"), F.lit(None).cast("string").alias("priority"), F.lit("desk").alias("reviewer"))
    return M.replace_records(store, edited)


@query("M3", """SELECT 'by_id' AS how, count(*) FILTER (NOT (priority = 'Low' AND n % 3 = 0)) AS n_left FROM records UNION ALL SELECT 'by_day', count(*) FILTER (CAST(created_at AS DATE) <> DATE '2024-01-01') FROM records UNION ALL SELECT 'all', 0""", on_records=True)
def deletions(r: DataFrame) -> DataFrame:
    """What is left after a deletion by ids, by day of creation, and of all."""
    left = lambda how, df: df.agg(F.count(F.lit(1)).alias("n_left")).select(F.lit(how).alias("how"), "n_left")
    by_id = M.delete_records(r.select("record_id"), r.where("priority = 'Low' AND n % 3 = 0"))
    by_day = M.delete_days(r, ["2024-01-01"])
    return left("by_id", by_id).unionByName(left("by_day", by_day)).unionByName(left("all", r.limit(0)))


@query("M4, M6", f"""WITH m AS (SELECT record_id, regions, list_transform(regions, lambda x: CASE x WHEN 'Germany' THEN 'West Europe' WHEN 'France' THEN 'West Europe' ELSE x END) AS moved FROM records), e AS (SELECT record_id, unnest(regions) AS old, unnest(moved) AS new FROM m)
 SELECT record_id, old, new FROM e WHERE old <> new""", on_records=True)
def migration_log(r: DataFrame) -> DataFrame:
    """A dry run of a change of region names: a row for each value that would change."""
    return M.migrate_log(r, "regions", {"Germany": "West Europe", "France": "West Europe"})


@query("M7", """SELECT record_id FROM records WHERE NOT (n % 7 = 0 AND confidence <> 'High')""", on_records=True)
def without_demo(r: DataFrame) -> DataFrame:
    """Records less those whose usage says that they came from the demo."""
    usage = F.struct(F.when(F.col("n") % 7 == 0, "demo").otherwise("live").alias("mode"), (F.col("confidence") == "High").alias("kept"))
    return M.purge(r.withColumn("usage", usage), (F.col("usage.mode") == "demo") & ~F.col("usage.kept")).select("record_id")


@query("J15", f"""WITH x AS (SELECT record_id, unnest(companies) AS c FROM records), g AS (SELECT record_id, {{alias}}[trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g'))] AS canonical, c FROM x), k AS (SELECT record_id, canonical, count(DISTINCT c) AS variants, bool_or(lower(c) = canonical) AS has_canonical FROM g WHERE canonical IS NOT NULL GROUP BY ALL)
 SELECT record_id, canonical, variants, CASE WHEN variants > 1 THEN 'canonicalization_inconsistent' ELSE 'canonicalization_alias_present' END AS finding FROM k WHERE variants > 1 OR NOT has_canonical""".replace("{alias}", "MAP {" + ", ".join(f"'{a}': '{c}'" for a, c in Q.alias_groups().items()) + "}"), on_records=True)
def alias_findings(r: DataFrame) -> DataFrame:
    """Companies named in several ways, or only by another than their main name."""
    return Q.alias_findings(r)


@query("J18", RECORDS_SQL.rstrip() + f""", c AS (SELECT conv_id, list_concat(['r000000' || (conv_id % 9), 'r999999' || (conv_id % 3)], ['r000000' || (conv_id % 9)]) AS refs FROM (SELECT DISTINCT conv_id FROM conversations)), d AS (SELECT conv_id, list_filter(refs, lambda x, i: list_position(refs, x) = i) AS refs FROM c),
 e AS (SELECT conv_id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM d) SELECT conv_id, CAST(pos AS INTEGER) AS pos, ref, r.title, CASE WHEN r.record_id IS NULL THEN 'unresolved' ELSE 'found' END AS state FROM e LEFT JOIN records r ON r.record_id = e.ref""")
def cited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations in order, once each, with the records they name; those that name none stay."""
    from .catalog import story_records

    own = F.col("conv_id") % 9
    refs = F.array_distinct(F.array(F.concat(F.lit("r000000"), own.cast("string")), F.concat(F.lit("r999999"), (F.col("conv_id") % 3).cast("string")), F.concat(F.lit("r000000"), own.cast("string"))))
    cited = table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.posexplode_outer(refs).alias("at", "ref"))
    known = story_records(spark, sf_dir).select(F.col("record_id").alias("ref"), "title", F.lit("found").alias("state"))
    return cited.join(known, "ref", "left").select("conv_id", (F.col("at") + 1).alias("pos"), "ref", "title", F.coalesce("state", F.lit("unresolved")).alias("state"))


@query("F-arr5", r"""SELECT record_id, array_to_string(list_filter(list_transform(list_concat(keywords, [' ', ' x ']), lambda k: trim(k)), lambda k: k <> ''), '; ') AS cleaned FROM records""", on_records=True)
def cleaned_lists(r: DataFrame) -> DataFrame:
    """Lists trimmed and without blanks."""
    return r.select("record_id", F.array_join(clean_list(F.concat("keywords", F.array(F.lit(" "), F.lit(" x "), F.lit(None).cast("string")))), "; ").alias("cleaned"))


@query("W6", f"""WITH x AS (SELECT record_id, list_concat(list_concat(keywords, list_transform(keywords, lambda k: upper(k))), [' ', 'tail']) AS k FROM records), t AS (SELECT record_id, list_filter(list_transform(k, lambda v: trim(v)), lambda v: v <> '') AS k FROM x)
 SELECT record_id, array_to_string(list_filter(k, lambda v, i: list_position(list_transform(k, lambda y: lower(y)), lower(v)) = i)[1:3], '; ') AS firsts FROM t""", on_records=True)
def first_values(r: DataFrame) -> DataFrame:
    """The first three values that differ by more than case."""
    from tidemark.operators.chunking import ordered_distinct

    return r.select("record_id", F.array_join(ordered_distinct(F.concat("keywords", F.transform("keywords", F.upper), F.array(F.lit(" "), F.lit("tail"))), 3), "; ").alias("firsts"))


@query("J12, M10", _SCORED + """, f AS (SELECT *, array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'), '[ ]+', ' ', 'g')), ' '), lambda t: t <> '' AND NOT list_contains(""" + _list(V.TITLE_STOPWORDS) + """, t))[1:8], ' ') AS fp FROM keyed)
 SELECT record_id, CASE WHEN rn = 1 THEN CASE WHEN kn = 1 THEN 'saved' ELSE 'skipped: same story' END ELSE 'skipped: same title' END AS outcome, first_id FROM (SELECT record_id, row_number() OVER (PARTITION BY fp ORDER BY created_at, record_id) AS rn, first_value(record_id) OVER (PARTITION BY fp ORDER BY created_at, record_id) AS first_id, row_number() OVER (PARTITION BY dedupe_key ORDER BY created_at, record_id) AS kn FROM f)""", on_records=True)
def bulk_ingest_outcome(r: DataFrame) -> DataFrame:
    """A bulk run in the order of arrival: a title that came before is skipped by its fingerprint, then a story that did by its key."""
    return D.arrivals(r)


_ERR = "CASE n % 5 WHEN 0 THEN 'Validation failed' WHEN 1 THEN 'timeout' WHEN 2 THEN 'JSON_PARSE_ERROR at 3' WHEN 3 THEN NULL ELSE 'INVALID_ARGUMENT' END"
_WHY = """CASE WHEN n % 7 = 0 THEN 'The file is empty (0 bytes).' WHEN n % 7 = 1 THEN 'The PDF is password-protected/encrypted, so text extraction is blocked.' WHEN n % 7 = 2 THEN 'Both PDF extractors failed to parse this file (one: bad; two: worse).' WHEN n % 7 = 3 THEN 'No selectable text layer was found across ' || (n % 4 + 1) || ' page(s); this is likely a scanned/image-only PDF.' WHEN n % 7 = 4 THEN 'No selectable text layer was found.' ELSE 'Only whitespace text was extracted (' || (n % 3 + 1) || ', 0 chars).' END"""


@query("T8, S10", f"SELECT record_id, coalesce(regexp_matches(lower({_ERR}), '{'|'.join(V.RETRY_MARKERS)}'), false) AS retry, {_WHY} AS why FROM records", on_records=True)
def extraction_failures(r: DataFrame) -> DataFrame:
    """Errors that a stronger model is asked about again, and why a file gave no text."""
    n = F.col("n")
    error = F.when(n % 5 == 0, "Validation failed").when(n % 5 == 1, "timeout").when(n % 5 == 2, "JSON_PARSE_ERROR at 3").when(n % 5 == 4, "INVALID_ARGUMENT")
    errors = F.when(n % 7 == 2, texts(["one: bad", "two: worse"])).otherwise(F.array(F.lit(None).cast("string"), F.lit("two: worse")))
    chars = F.when(n % 7 < 5, F.array(F.lit(0), F.lit(0))).otherwise(F.array((n % 3 + 1).cast("int"), F.lit(0)))
    pages = F.when(n % 7 == 3, F.array((n % 4 + 1).cast("int"), F.lit(0))).otherwise(F.array(F.lit(0), F.lit(0)))
    return r.select("record_id", P.retry_with_strong(error).alias("retry"), P.why_no_text(n % 7, n % 7 == 1, errors, chars, pages).alias("why"))


@query("F-s1, F-s10, F-s22, S15, F-m2", r"""SELECT record_id, trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g')) = '' AS blank, md5(trim(regexp_replace(text, '[ \t\r\n\f]+', ' ', 'g'))) AS collapsed_md5, md5(regexp_replace(regexp_replace(regexp_replace(text || ' co-' || chr(10) || ' op', '([A-Za-z])-[ \t\r\n\f]*\n[ \t\r\n\f]*([A-Za-z])', '\1\2', 'g'), '\r\n?', chr(10), 'g'), '[ \t]+', ' ', 'g')) AS repaired_md5,
 regexp_matches(lower(title || ' ' || array_to_string(companies, ' ')), '(^|[^a-z0-9_])byd($|[^a-z0-9_])') AS names_byd, coalesce(nullif(trim(regexp_replace(record_id || '/a:b*' || n || '.pdf', '[^\p{L}\p{N}_. -]', '', 'g')), ''), 'source.pdf') AS safe_name, CASE WHEN n % 800 < 26 THEN '' WHEN n % 800 < 702 THEN chr(CAST((n % 800) // 26 - 1 + 65 AS INTEGER)) ELSE 'A' || chr(CAST(((n % 800) - 702) // 26 + 65 AS INTEGER)) END || chr(CAST((n % 800) % 26 + 65 AS INTEGER)) AS letters FROM records""", on_records=True)
def text_helpers(r: DataFrame) -> DataFrame:
    """White space collapsed, line ends and hyphens repaired, names as words, safe file names, letters of a sheet's columns."""
    from tidemark.functions.columns import collapse
    from tidemark.operators.cleaning import repaired
    from tidemark.operators.enrich import alias_pattern

    flat = collapse(F.col("text"))
    named = F.lower(F.concat_ws(" ", "title", F.array_join("companies", " "))).rlike(alias_pattern("byd"))
    safe = P.safe_name(F.concat("record_id", F.lit("/a:b*"), F.col("n").cast("string"), F.lit(".pdf")))
    return r.select("record_id", (flat == "").alias("blank"), F.md5(flat).alias("collapsed_md5"), F.md5(repaired(F.concat("text", F.lit(" co-\n op")))).alias("repaired_md5"), named.alias("names_byd"), safe.alias("safe_name"), P.column_letters(F.col("n") % 800 + 1).alias("letters"))
