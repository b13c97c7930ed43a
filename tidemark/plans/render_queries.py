"""Queries that render texts; the SQL renders them, too, and both are compared by digest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import renderers as W
from tidemark.operators.records import DRAFTS_SQL, drafts

from .catalog import query, story_records
from .record_queries import _SCORED


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _items(ready: str, heading: str, between: str) -> str:
    return f"CASE WHEN bool_or(ready = {ready}) THEN {_q(heading)} || string_agg('- ' || title || '{between}' || insight || chr(10), '' ORDER BY place) FILTER (ready = {ready}) || chr(10) ELSE '' END"


@query("F-s25, O1", _SCORED + f""", w AS (SELECT CAST(date_trunc('week', publish_date) AS DATE) AS week, priority = 'High' AND confidence = 'High' AS ready, title, coalesce(insights[1], '') AS insight, publisher_score, confidence_score, completeness, record_id FROM keyed WHERE publish_date IS NOT NULL),
 p AS (SELECT *, row_number() OVER (PARTITION BY week ORDER BY ready DESC, publisher_score DESC, confidence_score DESC, completeness DESC, record_id) AS place FROM w), s AS (SELECT * FROM p WHERE place <= {W.MOST}),
 t AS (SELECT week, strftime(week, '%Y-%m-%d') || ' to ' || strftime(week + 6, '%Y-%m-%d') AS label, count(*) AS n, {_items('true', W.READY, ' :: ')} || {_items('false', W.OTHER, ' :: ')} AS listed, {_items('true', W.MAIL_READY, ' — ')} || {_items('false', W.MAIL_OTHER, ' — ')} AS mailed FROM s GROUP BY week)
 SELECT CAST(week AS VARCHAR) AS week, CAST(n AS INTEGER) AS n_items, 'Executive Intelligence Brief (' || label || ')' AS subject, md5({_q(W.BRIEF_TITLE)} || 'Week: ' || label || chr(10) || chr(10) || listed || {_q(W.NOTES)}) AS brief_md5, md5({_q(W.HELLO)} || mailed || {_q(W.REGARDS)}) AS email_md5 FROM t""", on_records=True)
def weekly_texts(r: DataFrame) -> DataFrame:
    """The brief and the e-mail of each week."""
    return W.weekly_texts(r).select(F.col("week").cast("string").alias("week"), "n_items", "subject", F.md5("brief").alias("brief_md5"), F.md5("email").alias("email_md5"))


_B = lambda c: f"CASE WHEN coalesce(len({c}), 0) = 0 THEN '- [None]' || chr(10) ELSE array_to_string(list_transform({c}, lambda x: '- ' || x || chr(10)), '') END"
_J = lambda c: f"coalesce(nullif(array_to_string({c}, ', '), ''), '[None]')"
_DAY = "2024-03-01"


@query("F-s25", DRAFTS_SQL.rstrip() + f""" SELECT record_id, md5({_q(f"INTELLIGENCE BRIEF{chr(10)}{chr(10)}Summary Date: {_DAY}{chr(10)}Source Type: ")} || source_type || {_q(chr(10) + "Publish Date: ")} || coalesce(nullif(publish_date, ''), 'Unknown') || {_q(chr(10) + "Original URL: ")} || coalesce(nullif(original_url, ''), '[optional]') || {_q(chr(10) * 2 + "Title" + chr(10))} || title ||
 {_q(chr(10) * 2 + "Companies Mentioned" + chr(10))} || {_B('companies')} || {_q(chr(10) + "Actor Type" + chr(10) + "- ")} || actor_type || chr(10) || CASE WHEN len(government_entities) > 0 THEN {_q(chr(10) + "Government/Regulators (if applicable)" + chr(10))} || {_B('government_entities')} ELSE '' END || {_q(chr(10) + "Countries Mentioned: ")} || {_J('countries')} || ' | Relevant Regions: ' || {_J('regions_relevant')} || chr(10) || chr(10) ||
 {_q(W.SECTIONS['topics'] + chr(10))} || {_B('topics')} || {_q(chr(10) + "Priority: ")} || priority || ' | Confidence: ' || confidence || {_q(chr(10) * 2 + W.SECTIONS['evidence'] + chr(10))} || {_B('evidence')} || {_q(chr(10) + W.SECTIONS['insights'] + chr(10))} || {_B('insights')} || {_q(chr(10) + "Review" + chr(10) + "Reviewed By: [name]" + chr(10) + "Review Status: ")} || review_status || chr(10) ||
 CASE WHEN notes <> '' THEN 'Notes: ' || notes || chr(10) ELSE '' END) AS brief_md5 FROM drafts""")
def intelligence_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief of each draft."""
    return drafts(story_records(spark, sf_dir)).select("record_id", F.md5(W.intelligence_brief(_DAY)).alias("brief_md5"))
