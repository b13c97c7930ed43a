"""Story records, dealt out from documents and labels.

All attributes of a story follow from its content (n_chars, source, text) only, so that copies collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import distinct_ignoring_case, texts


def dealt(values: list[str], count: Column, at) -> Column:
    """values[at(i)] for i = 0 .. count - 1, without repeats (ignoring case)."""
    table = texts(values)
    picked = F.transform(F.sequence(F.lit(0), F.lit(len(values))), lambda i: F.try_element_at(table, (at(i) % len(values) + 1).cast("int")))
    return distinct_ignoring_case(F.slice(picked, F.lit(1), count.cast("int")))


def records(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One record for each document; labels join on doc_id and must have it once."""
    n = F.col("n")
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    d = documents.join(labels, "doc_id", "left").withColumn("n", F.coalesce("n_chars", F.lit(0))).withColumn("s", F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).cast("int"), F.lit(0)))
    return d.select(
        "doc_id",
        "n",
        F.concat(F.lit("r"), F.lpad(F.col("doc_id").cast("string"), 7, "0")).alias("record_id"),
        F.array_join(F.slice(F.filter(F.split("text", "[ \n\t\r]+", 14), lambda t: t != ""), 1, 12), " ").alias("title"),
        F.element_at(texts(V.PUBLISHER_SCORES), F.col("s") % 10 + 1).alias("source_type"),
        F.when(n % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (n % 60).cast("int"))).alias("publish_date"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("created_at"),
        F.when(F.col("quality") == 1, "High").when(F.col("quality") == 0, "Low").otherwise("Medium").alias("confidence"),
        F.when(F.col("toxic") == 1, "High").when(n % 2 == 0, "Medium").otherwise("Low").alias("priority"),
        dealt(V.TOPICS, F.lit(2), lambda i: n * (1 + 3 * i) + i).alias("topics"),
        dealt(V.REGIONS, n % 4, lambda i: n * 7 + i * 5).alias("regions"),
        dealt(V.DEALT_COMPANIES, n % 3 + 1, lambda i: n + i * 3).alias("companies"),
        dealt(V.DEALT_KEYWORDS, F.lit(3), lambda i: n + i * 7).alias("keywords"),
        dealt(V.DEALT_COUNTRIES, n % 3, lambda i: n * 3 + i * 4).alias("countries"),
        F.slice(lines, F.lit(1), (n % 5).cast("int")).alias("evidence"),
        F.slice(lines, (n % 5 + 1).cast("int"), F.lit(2)).alias("insights"),
        F.when(n % 3 != 0, F.concat(F.lit("https://example.com/"), n.cast("string"))).alias("url"),
        F.when(F.col("doc_id") % 5 == 0, "Pending").when(F.col("doc_id") % 5 == 4, "Disapproved").otherwise("Approved").alias("review_status"),
        "text",
    )


def drafts(records_: DataFrame) -> DataFrame:
    """Records as an extractor may have left them: aliases, blanks, values out of the vocabularies, dates in texts and hints."""
    n = F.col("n")
    pick = lambda values, at: F.element_at(texts(values), (at % len(values) + 1).cast("int"))
    none = F.lit(None).cast("array<string>")
    mentioned = dealt(V.DEALT_REGIONS, n % 5, lambda i: n * 2 + i * 3)
    return records_.withColumns({
        "notes": pick(V.DEALT_NOTES, n * 5),
        "source_text": F.concat(pick(V.DEALT_HEADERS, n), F.lit("\n"), F.coalesce("text", F.lit(""))),
        "publish_date": F.when(n % 7 == 3, "").when(n % 7 == 5, "n/a").otherwise(F.col("publish_date").cast("string")),
        "publish_date_confidence": pick(["High", "Medium", "Low", ""], n),
        "original_url": F.when(n % 5 == 0, F.concat(F.lit("  "), "url", F.lit(" "))).when(n % 5 == 1, "not a url").when(n % 5 == 2, "").otherwise(F.col("url")),
        "source_type": F.when(n % 13 == 0, "marklines").when(n % 13 == 1, "Blog").otherwise(F.col("source_type")),
        "actor_type": pick(V.DEALT_ACTORS, n),
        "mentions_our_company": n % 2 == 0,
        "government_entities": dealt(V.DEALT_ENTITIES, n % 4, lambda i: n + i * 3),
        "regions_mentioned": F.when(n % 53 == 0, none).when(n % 19 == 0, F.concat(mentioned, mentioned)).otherwise(mentioned),
        "regions_relevant": F.when(n % 59 == 0, none).otherwise(dealt(V.DEALT_REGIONS, n % 2, lambda i: n + i)),
        "topics": F.when(n % 47 == 0, none).when(n % 23 == 0, texts(["Gossip"])).otherwise(F.col("topics")),
        "keywords": F.when(n % 29 == 0, F.slice("keywords", 1, 2)).otherwise(F.col("keywords")),
        "priority": F.when(n % 31 == 0, "Urgent").otherwise(F.col("priority")),
        "confidence": F.when(n % 37 == 0, "Sure").otherwise(F.col("confidence")),
        "review_status": F.when(n % 41 == 0, "Reviewed").when(n % 43 == 0, "Lost").otherwise(F.col("review_status")),
        "hint": F.when(n % 6 == 1, F.concat(F.lit("2024-03-"), F.lpad((n % 28 + 1).cast("string"), 2, "0"))).when(n % 6 == 2, "2024-13-01"),
        "hint_source": F.when(n % 18 == 1, F.lit(None).cast("string")).when(n % 12 == 1, "pdf_header_publish_date").otherwise("pdf_metadata_publish_date"),
    })


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _dealt(values: list[str], count: str, at: str) -> str:
    picked = f"list_transform(range(0, {count}), lambda i: {_list(values)}[(({at}) % {len(values)}) + 1])"
    return f"list_filter({picked}, lambda x, i: list_position(list_transform({picked}, lambda y: lower(y)), lower(x)) = i)"


#: The same for DuckDB: a WITH clause that defines `records`.
RECORDS_SQL = f"""
WITH base AS (
  SELECT d.doc_id, d.text, coalesce(d.n_chars, 0) AS n, l.quality, l.toxic,
         coalesce(TRY_CAST(nullif(regexp_extract(d.source, '([0-9]+)$', 1), '') AS INTEGER), 0) AS s,
         list_filter(string_split(d.text, chr(10)), lambda x: trim(x) <> '') AS lines
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
records AS (
  SELECT doc_id, n, 'r' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS record_id,
         array_to_string(list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda t: t <> '')[1:12], ' ') AS title,
         {_list(V.PUBLISHER_SCORES)}[(s % 10) + 1] AS source_type,
         CASE WHEN n % 17 <> 0 THEN DATE '2024-01-01' + CAST(n % 60 AS INTEGER) END AS publish_date,
         TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS created_at,
         CASE quality WHEN 1 THEN 'High' WHEN 0 THEN 'Low' ELSE 'Medium' END AS confidence,
         CASE WHEN toxic = 1 THEN 'High' WHEN n % 2 = 0 THEN 'Medium' ELSE 'Low' END AS priority,
         {_dealt(V.TOPICS, "2", "n * (1 + 3 * i) + i")} AS topics,
         {_dealt(V.REGIONS, "n % 4", "n * 7 + i * 5")} AS regions,
         {_dealt(V.DEALT_COMPANIES, "n % 3 + 1", "n + i * 3")} AS companies,
         {_dealt(V.DEALT_KEYWORDS, "3", "n + i * 7")} AS keywords,
         {_dealt(V.DEALT_COUNTRIES, "n % 3", "n * 3 + i * 4")} AS countries,
         lines[1:n % 5] AS evidence, lines[(n % 5) + 1:(n % 5) + 2] AS insights,
         CASE WHEN n % 3 <> 0 THEN 'https://example.com/' || n END AS url,
         CASE doc_id % 5 WHEN 0 THEN 'Pending' WHEN 4 THEN 'Disapproved' ELSE 'Approved' END AS review_status,
         text
  FROM base)
"""


def _pick(values: list[str], at: str) -> str:
    return f"{_list(values)}[(({at}) % {len(values)}) + 1]"


#: The same for DuckDB: CTEs `records` and `drafts`.
DRAFTS_SQL = f"""{RECORDS_SQL.rstrip()},
drafts AS (
  SELECT * REPLACE (
    CASE n % 7 WHEN 3 THEN '' WHEN 5 THEN 'n/a' ELSE CAST(publish_date AS VARCHAR) END AS publish_date,
    CASE n % 13 WHEN 0 THEN 'marklines' WHEN 1 THEN 'Blog' ELSE source_type END AS source_type,
    CASE WHEN n % 47 = 0 THEN NULL WHEN n % 23 = 0 THEN ['Gossip'] ELSE topics END AS topics,
    CASE WHEN n % 29 = 0 THEN keywords[1:2] ELSE keywords END AS keywords,
    CASE WHEN n % 31 = 0 THEN 'Urgent' ELSE priority END AS priority,
    CASE WHEN n % 37 = 0 THEN 'Sure' ELSE confidence END AS confidence,
    CASE WHEN n % 41 = 0 THEN 'Reviewed' WHEN n % 43 = 0 THEN 'Lost' ELSE review_status END AS review_status),
    {_pick(V.DEALT_NOTES, "n * 5")} AS notes,
    replace({_pick([h.replace(chr(10), "<lf>") for h in V.DEALT_HEADERS], "n")}, '<lf>', chr(10)) || chr(10) || coalesce(text, '') AS source_text,
    {_pick(["High", "Medium", "Low", ""], "n")} AS publish_date_confidence,
    CASE n % 5 WHEN 0 THEN '  ' || url || ' ' WHEN 1 THEN 'not a url' WHEN 2 THEN '' ELSE url END AS original_url,
    {_pick(V.DEALT_ACTORS, "n")} AS actor_type, n % 2 = 0 AS mentions_our_company,
    {_dealt(V.DEALT_ENTITIES, "n % 4", "n + i * 3")} AS government_entities,
    CASE WHEN n % 53 = 0 THEN NULL WHEN n % 19 = 0 THEN list_concat({_dealt(V.DEALT_REGIONS, "n % 5", "n * 2 + i * 3")}, {_dealt(V.DEALT_REGIONS, "n % 5", "n * 2 + i * 3")}) ELSE {_dealt(V.DEALT_REGIONS, "n % 5", "n * 2 + i * 3")} END AS regions_mentioned,
    CASE WHEN n % 59 = 0 THEN NULL ELSE {_dealt(V.DEALT_REGIONS, "n % 2", "n + i")} END AS regions_relevant,
    CASE n % 6 WHEN 1 THEN '2024-03-' || lpad(CAST(n % 28 + 1 AS VARCHAR), 2, '0') WHEN 2 THEN '2024-13-01' END AS hint,
    CASE WHEN n % 18 = 1 THEN NULL WHEN n % 12 = 1 THEN 'pdf_header_publish_date' ELSE 'pdf_metadata_publish_date' END AS hint_source
  FROM records)
"""
