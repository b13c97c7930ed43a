"""Queries of post-processing and validation of drafts, with SQL for every step."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import vocab as V
from tidemark.operators import enrich as E
from tidemark.operators import rules as R
from tidemark.operators.records import DRAFTS_SQL, _list, drafts

from .catalog import query, story_records
from .record_queries import _map
from .rule_queries import _FLAGS, _theme_sql

OWN_NAMES = ["Stellantis", "Stellantis NV"]


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafts(story_records(spark, sf_dir))


def _sql(*parts: str) -> str:
    return DRAFTS_SQL.rstrip() + "".join(f",\n{p}" for p in parts[:-1]) + "\n" + parts[-1]


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _ci(x: str) -> str:
    """Firsts of what agrees but for case."""
    return f"list_filter({x}, lambda v, i: list_position(list_transform({x}, lambda y: lower(y)), lower(v)) = i)"


def _once(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _space(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[ \t\r\n\f]+', ' ', 'g'))"


def _made(text: str, pattern: str, year: int, month: int, day: int) -> str:
    g = lambda k: f"regexp_extract({text}, {_q(pattern)}, {k})"
    number = f"{_map(C.MONTHS)}[lower({g(month)})]"
    return f"TRY_CAST(CASE WHEN {g(year)} <> '' THEN {g(year)} || '-' || lpad(CAST({number} AS VARCHAR), 2, '0') || '-' || lpad({g(day)}, 2, '0') END AS DATE)"


def _first_date(text: str) -> str:
    iso = f"TRY_CAST(nullif(regexp_extract({text}, {_q(C.ISO_DATE)}, 2), '') AS DATE)"
    return f"CAST(coalesce({iso}, {_made(text, C.DAY_MONTH_YEAR, 4, 3, 2)}, {_made(text, C.MONTH_DAY_YEAR, 4, 2, 3)}) AS VARCHAR)"


def _iso(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST({x} AS DATE) IS NOT NULL, false)"


def _header(kind: str) -> str:
    return "CAST(coalesce(" + ", ".join(_made("zone", "(?i)" + E.MONTH_DAY_YEAR + e, 4, 2, 3) for e in E.HEADER_ENDINGS[kind]) + ") AS VARCHAR)"


_ALIAS = f"{_map(V.SOURCE_ALIASES)}[lower(trim(source_type))]"
_TEXTS = "texts AS (SELECT *, concat_ws(' ', title, notes, coalesce(array_to_string(keywords, ' '), ''), coalesce(array_to_string(evidence, ' '), ''), coalesce(array_to_string(insights, ' '), '')) AS field_text FROM drafts),\n t0 AS (SELECT *, concat_ws(' ', CASE WHEN trim(source_text) <> '' THEN source_text END, field_text) AS all_text, lower(field_text) AS hint_text FROM texts)"
_DATES = (
    _TEXTS
    + rf""",
 t1 AS (SELECT *, CASE WHEN {_ALIAS} IS NOT NULL AND {_ALIAS} <> source_type THEN {_ALIAS} ELSE source_type END AS source_1, nullif(publish_date, '') AS date_0, coalesce(publish_date_confidence, '') AS conf_0,
   string_split(regexp_replace(all_text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM t0),
 t2 AS (SELECT *, substr(array_to_string(ls[1:{E.HEADER_LINES}], chr(10)), 1, {E.HEADER_CHARS}) AS zone, {_iso("date_0")} AS iso_0,
   array_to_string(list_filter(CASE WHEN len(ls) > {E.HEADER_LINES} THEN ls[{E.HEADER_LINES + 1}:] ELSE ls END, lambda x: NOT regexp_matches(x, {_q(E.STAMP_LINE)})), chr(10)) AS event_zone FROM t1),
 t3 AS (SELECT *, CASE WHEN source_1 = 'Bloomberg' THEN {_header("bloomberg")} WHEN source_1 = 'Reuters' THEN {_header("reuters")} WHEN list_contains({_list([p for p in V.HEADER_RULES if p not in ("Bloomberg", "Reuters")])}, source_1) THEN {_header("other")} END AS header FROM t2),
 t4 AS (SELECT *, coalesce(header IS NOT NULL AND header IS DISTINCT FROM date_0 AND (NOT iso_0 OR conf_0 IN ('Low', '')), false) AS use_header FROM t3),
 t5 AS (SELECT *, CASE WHEN use_header THEN header ELSE date_0 END AS date_1, CASE WHEN use_header THEN 'High' ELSE publish_date_confidence END AS conf_1, CASE WHEN use_header THEN 'rule:' || {_map(V.HEADER_RULES)}[source_1] || '_header_publish_date' END AS from_1, coalesce(hint_source, 'pdf_publish_date_hint') AS by_hint FROM t4),
 t6 AS (SELECT *, {_iso("hint")} AND hint IS DISTINCT FROM date_1 AS use_hint, {_first_date("all_text")} AS in_text FROM t5),
 t7 AS (SELECT *, CASE WHEN use_hint THEN hint ELSE date_1 END AS date_2, CASE WHEN use_hint THEN CASE WHEN by_hint = 'pdf_header_publish_date' THEN 'High' ELSE 'Medium' END ELSE conf_1 END AS conf_2,
   CASE WHEN use_hint THEN 'rule:' || by_hint ELSE from_1 END AS from_2, CASE WHEN use_hint AND {_iso("date_1")} THEN date_1 END AS event_2 FROM t6),
 t8 AS (SELECT *, in_text IS NOT NULL AND date_2 IS NULL AS backfill FROM t7),
 t9 AS (SELECT *, CASE WHEN in_text IS NOT NULL AND NOT backfill THEN {_first_date("event_zone")} END AS event_found, CASE WHEN backfill THEN in_text ELSE date_2 END AS date_3, CASE WHEN backfill THEN 'High' ELSE conf_2 END AS conf_3, CASE WHEN backfill THEN 'rule:regex_publish_date' ELSE from_2 END AS from_3 FROM t8),
 t10 AS (SELECT *, coalesce(event_found <> date_2, false) AS use_event, iso_0 AND date_0 IS DISTINCT FROM date_3 AND NOT coalesce(ends_with(from_3, '_header_publish_date') OR from_3 = 'rule:pdf_metadata_publish_date', false) AS restore FROM t9),
 dated AS (SELECT *, CASE WHEN restore THEN date_0 ELSE date_3 END AS date_final, CASE WHEN use_event THEN event_found ELSE event_2 END AS event_date, iso_0 AND (use_header OR (use_hint AND event_2 IS NOT NULL)) AS date_overridden FROM t10)"""
)


@query("F-d1, F-d5", _sql(_TEXTS, f"SELECT record_id, {_first_date('source_text')} AS in_source, {_first_date('field_text')} AS in_fields, {_iso('publish_date')} AS is_iso FROM t0"))
def text_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First dates of whole source texts and of the records' own fields."""
    d = E.with_texts(_drafts(spark, sf_dir))
    return d.select("record_id", C.first_date(F.col("source_text")).cast("string").alias("in_source"), C.first_date(F.col("field_text")).cast("string").alias("in_fields"), F.coalesce(C.is_iso(F.col("publish_date")), F.lit(False)).alias("is_iso"))


@query("F-d2, F-d3, F-s29", _sql(_DATES, "SELECT record_id, date_final, conf_3 AS confidence, from_3 AS source, event_date, date_overridden, restore FROM dated"))
def post_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish and event dates by header, hint and text, in their order of precedence."""
    d = E.dates(E.with_texts(_drafts(spark, sf_dir)))
    return d.select("record_id", "date_final", F.col("conf_3").alias("confidence"), F.col("from_3").alias("source"), "event_date", "date_overridden", "restore")


_SUFFIX = "|".join(sorted({s.rstrip(".") for s in V.LEGAL_SUFFIXES}, key=lambda s: (-len(s), s)))
_COMPANY = f"coalesce({_map(V.COMPANY_NAMES)}[lower({_space('c')})], {_map(E.known_companies())}[regexp_replace(regexp_replace(lower({_space('c')}), '[.,]', '', 'g'), '( ({_SUFFIX}))+$', '')], {_space('c')})"
_BAG = "lower(concat_ws(' ', CASE WHEN trim(source_text) <> '' THEN source_text END, CASE WHEN trim(title) <> '' THEN title END, " + ", ".join(f"coalesce(array_to_string(list_filter({c}, lambda x: trim(x) <> ''), ' '), '')" for c in ("evidence", "insights", "keywords")) + "))"
_SP = " OR ".join(f"contains(lower(all_text), '{m}')" for m in E.SP_MARKERS)
_ACTOR = f"coalesce({_map(V.ACTOR_ALIASES)}[lower(trim(actor_type))], lower(trim(actor_type)))"
_KEY = f"lower({_space('e')})"
_NAMES = f"""n0 AS (SELECT *, {_space("original_url")} AS u, {_BAG} AS bag, {_ACTOR} AS actor, coalesce(countries, []) AS cs, coalesce(companies, []) AS cos, coalesce(government_entities, []) AS ge FROM dated),
 n1 AS (SELECT *, CASE WHEN regexp_matches(u, '^https?://[^ ]+$') THEN u END AS url_final, {" OR ".join(f"regexp_matches(bag, {_q(E.alias_pattern(n.lower()))})" for n in OWN_NAMES)} AS mentions_final,
   coalesce(CASE WHEN {_SP} THEN 'S&P' WHEN contains(lower(all_text), 'marklines') THEN 'MarkLines' WHEN contains(lower(all_text), 'automotive news') THEN 'Automotive News' WHEN regexp_matches(all_text, {_q(E.REUTERS_LINE)}) THEN 'Reuters' END, source_1) AS source_final,
   CASE WHEN coalesce(actor, '') = '' THEN actor_type WHEN list_contains({_list(V.ACTOR_TYPES)}, actor) THEN actor ELSE 'other' END AS actor_final,
   list_transform(cs, lambda e: coalesce({_map(V.COUNTRY_ALIASES)}[{_KEY}], {_space("e")})) AS cs1, list_transform(cos, lambda c: {_COMPANY}) AS cos1 FROM n0),
 n2 AS (SELECT *, {_ci("cs1")} AS countries_final, {_ci("cos1")} AS companies_final FROM n1),
 n3 AS (SELECT *, list_transform(countries_final, lambda x: lower(x)) AS low_countries FROM n2),
 n4 AS (SELECT *, list_transform(list_filter(ge, lambda e: NOT (list_contains(low_countries, {_KEY}) OR coalesce(list_contains(low_countries, lower({_map(V.COUNTRY_ALIASES)}[{_KEY}])), false))), lambda e: coalesce({_map(V.REGULATOR_ALIASES)}[{_KEY}], {_space("e")})) AS ge1 FROM n3),
 named AS (SELECT *, {_ci("ge1")} AS entities_final FROM n4)"""
_JOIN = lambda c: f"array_to_string({c}, '; ')"


@query("F-s12, F-s6", _sql(_DATES, _NAMES, f"SELECT record_id, url_final, mentions_final, source_final, actor_final, coalesce({_JOIN('countries_final')}, '') AS countries, coalesce({_JOIN('companies_final')}, '') AS companies, coalesce({_JOIN('entities_final')}, '') AS entities, lower(rtrim(regexp_replace(trim(coalesce(url_final, '')), '#.*$', ''), '/')) AS url_key, trim(regexp_replace(lower(trim(title)), '[^a-z0-9]+', ' ', 'g')) AS title_key FROM named"))
def post_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs, publishers, actors, countries, companies and government entities; keys of URL and title."""
    d = E.names(E.dates(E.with_texts(_drafts(spark, sf_dir))), OWN_NAMES)
    lists = [F.array_join(f"{c}_final", "; ").alias(c) for c in ("countries", "companies", "entities")]
    url_key = F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce("url_final", F.lit(""))), "#.*$", ""), "/+$", ""))
    return d.select("record_id", "url_final", "mentions_final", "source_final", "actor_final", *lists, url_key.alias("url_key"), C.plain_text(F.trim("title")).alias("title_key"))


def _table(c: str, table: dict[str, str]) -> str:
    return f"list_transform(coalesce({c}, []), lambda e: coalesce({_map(table)}[{_KEY}], {_space('e')}))"


_HINTS = ", ".join([f"CASE WHEN regexp_matches(hint_text, {_q(E.alias_pattern(a))}) THEN '{r}' END" for a, r in V.REGION_ALIASES.items()] + [f"CASE WHEN contains(hint_text, '{r.lower()}') THEN '{r}' END" for r in V.REGIONS] + [f"CASE WHEN contains(hint_text, '{c}') THEN '{r}' END" for c, r in V.CITY_REGIONS.items()])
_OLD = lambda c: f"len(list_filter(coalesce({c}, []), lambda e: {_KEY} = 'europe (including russia)')) > 0"
_REGIONS = f"""r0 AS (SELECT *, {_table("regions_mentioned", V.REGION_ALIASES)} AS m1, {_table("regions_relevant", V.REGION_ALIASES)} AS v1, {_OLD("regions_mentioned")} OR {_OLD("regions_relevant")} AS migrated, list_filter([{_HINTS}], lambda x: x IS NOT NULL) AS h1,
   list_filter(list_transform(countries_final, lambda c: {_map(V.COUNTRY_REGIONS)}[c]), lambda x: x IS NOT NULL) AS derived,
   len(countries_final) = 0 AND regexp_matches(hint_text, {_q(E.EUROPE_WORD)}) AND NOT regexp_matches(hint_text, {_q(E.SUB_EUROPE)}) AS defaulted FROM named),
 r1 AS (SELECT *, list_filter({_ci("m1")}, lambda x: list_contains({_list(V.REGIONS)}, x)) AS mentioned_0, list_concat(derived, list_filter({_ci("v1")}, lambda x: list_contains({_list(V.REGIONS)}, x))) AS im FROM r0),
 r2 AS (SELECT *, {_once("im")} AS implied FROM r1),
 r3 AS (SELECT *, list_concat(list_concat(list_concat(mentioned_0, implied), h1), CASE WHEN defaulted THEN ['Europe'] ELSE [] END) AS me FROM r2),
 r4 AS (SELECT *, {_once("me")} AS merged, len(list_intersect(low_countries, ['united states', 'canada'])) > 0 OR regexp_matches(field_text, {_q(E.US_NAMES)}) OR regexp_matches(field_text, {_q(E.US_TOKEN)}) AS us FROM r3),
 r5 AS (SELECT *, list_contains(merged, 'United States') AND NOT us AS no_us, list_contains(merged, 'China') AND NOT list_contains(implied, 'China') AS no_china FROM r4),
 r6 AS (SELECT *, list_filter(merged, lambda x: NOT (x = 'United States' AND no_us) AND NOT (x = 'China' AND no_china)) AS shown FROM r5),
 placed AS (SELECT *, shown[1:15] AS regions_final, list_filter([CASE WHEN no_us THEN 'us_region_removed_no_us_evidence' END, CASE WHEN no_china THEN 'china_region_removed_no_china_country_mention' END, CASE WHEN len(shown) > 15 THEN 'regions_mentioned_truncated_to_15' END, CASE WHEN len(implied) = 0 AND len(shown) = 0 THEN 'empty_region_signal' END], lambda x: x IS NOT NULL) AS region_flags FROM r6)"""


@query("F-s11, F-s30, F-arr4", _sql(_DATES, _NAMES, _REGIONS, f"SELECT record_id, coalesce({_JOIN('regions_final')}, '') AS mentioned, coalesce({_JOIN('implied')}, '') AS relevant, coalesce({_JOIN('region_flags')}, '') AS flags, migrated, defaulted FROM placed"))
def post_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions mentioned and implied, with flags for what was migrated, defaulted and taken out."""
    d = _drafts(spark, sf_dir).withColumn("regions_none", F.array().cast("array<string>"))
    d = E.regions(E.names(E.dates(E.with_texts(d)), OWN_NAMES))
    return d.select("record_id", F.array_join("regions_final", "; ").alias("mentioned"), F.array_join("implied", "; ").alias("relevant"), F.array_join("region_flags", "; ").alias("flags"), "migrated", "defaulted")


def _changed(before: str, after: str, reason: str, when: str = "true") -> str:
    return f"CASE WHEN ({when}) AND ({before}) IS DISTINCT FROM ({after}) THEN {reason} END"


_REASONS = ", ".join([
    _changed("publish_date", "date_0", "'empty_publish_date_to_null'", "publish_date = ''"), _changed("original_url", "url_final", "'url_normalization'", "original_url IS NOT NULL"),
    _changed("source_type", "source_1", "'source_type_alias_normalization'"), _changed("mentions_our_company", "mentions_final", "CASE WHEN mentions_final THEN 'company_alias_detected' ELSE 'company_alias_not_found' END"),
    _changed("date_0", "date_1", "'publisher_header_timestamp_preferred'", "use_header"), _changed("publish_date_confidence", "conf_1", "'publisher_header_timestamp_preferred'", "use_header"),
    _changed("date_1", "date_2", "'pdf_publish_date_hint_preferred'", "use_hint"), _changed("conf_1", "conf_2", "'pdf_publish_date_hint_preferred'", "use_hint"), "CASE WHEN event_2 IS NOT NULL THEN 'prior_publish_date_reclassified_as_event_date' END",
    _changed("date_2", "date_3", "'publish_date_missing_backfill'", "backfill"), _changed("conf_2", "conf_3", "'publish_date_missing_backfill'", "backfill"), _changed("event_2", "event_found", "'regex_detected_event_date'", "use_event"),
    _changed("source_1", "source_final", "'publisher_marker_inference'"), _changed("actor_type", "actor_final", "'actor_type_normalization'"), _changed("countries", "countries_final", "'country_canonicalization_dedupe'"),
    _changed("regions_mentioned", "regions_final", "'regions_bucketed_deduped'"), _changed("regions_relevant", "implied", "'derived_from_country_mentions'"), _changed("government_entities", "entities_final", "'government_entity_cleanup'"),
    _changed("companies_in", "companies_final", "'company_canonicalization_dedupe'"), "CASE WHEN boosted <> priority_llm THEN boost_reason END", "CASE WHEN priority_final <> boosted THEN theme_reason END",
    "'final_priority_after_rules'", "CASE WHEN priority_reason IS NOT NULL THEN 'priority_changed_by_rules' END", _changed("date_3", "date_final", "'preserve_existing_valid_publish_date'", "restore"),
])
_FIELDS = {"empty_publish_date_to_null": "publish_date", "url_normalization": "original_url"}
_ON = lambda part, source: part.strip().removeprefix("WITH ").replace("FROM records", f"FROM {source}").rstrip()
_PROCESSED = ",\n ".join([
    "ready AS (SELECT * REPLACE (coalesce(topics, []) AS topics, companies_final AS companies, implied AS regions, coalesce(priority, 'Medium') AS priority), companies AS companies_in, coalesce(priority, 'Medium') AS priority_llm FROM placed)",
    _ON(_FLAGS, "ready"),
    "boost AS (SELECT * REPLACE (list_concat(implied, list_filter(regions_final, lambda x: NOT list_contains(implied, x))) AS regions), CASE WHEN reason IS NULL THEN priority WHEN reason = 'missing_footprint_region' THEN 'Low' ELSE 'High' END AS boosted, reason AS boost_reason FROM ruled)",
    _ON(_theme_sql(), "boost"),
    f"e0 AS (SELECT *, list_filter(themes, lambda t: list_contains({_list(V.ESCALATION_THEMES)}, t))[1] AS first_theme FROM th)",
    "e1 AS (SELECT *, CASE WHEN boosted <> 'High' AND len(implied) > 0 AND first_theme IS NOT NULL THEN 'footprint_and_macro_theme:' || first_theme END AS theme_reason FROM e0)",
    "e2 AS (SELECT *, CASE WHEN theme_reason IS NOT NULL THEN 'High' ELSE boosted END AS priority_final FROM e1)",
    "e3 AS (SELECT *, CASE WHEN priority_final <> priority_llm THEN coalesce(theme_reason, CASE WHEN boosted <> priority_llm THEN boost_reason END, 'rule_adjustment') END AS priority_reason FROM e2)",
    f"e4 AS (SELECT *, list_filter([{_REASONS}], lambda x: x IS NOT NULL) AS reasons FROM e3)",
    "processed AS (SELECT *, CASE WHEN date_final IS NOT NULL THEN 2 ELSE 0 END AS q1, CASE WHEN source_final <> 'Other' THEN 2 ELSE 0 END AS q2, CASE WHEN len(evidence) >= 3 THEN 2 WHEN len(evidence) >= 2 THEN 1 ELSE 0 END AS q3, CASE WHEN len(insights) >= 2 THEN 1 ELSE 0 END AS q4, -CAST(floor(len(reasons) / 3.0) AS INTEGER) AS q5, CASE WHEN from_3 = 'rule:regex_publish_date' AND NOT restore THEN -1 ELSE 0 END AS q6 FROM e4)",
])
_ALL = (_DATES, _NAMES, _REGIONS, _PROCESSED)
_SCORE = "q1 + q2 + q3 + q4 + q5 + q6"


def _processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.postprocess(_drafts(spark, sf_dir), OWN_NAMES)


@query("T11, P20, F-json3, F-map1", _sql(*_ALL, f"""SELECT record_id, date_final AS publish_date, source_final AS source_type, coalesce({_JOIN('regions_final')}, '') AS regions_mentioned, coalesce({_JOIN('themes')}, '') AS themes, priority_llm, priority_final, priority_reason,
  array_to_string(list_transform(list_sort(list_distinct(reasons)), lambda r: r || '=' || len(list_filter(reasons, lambda x: x = r))), '; ') AS impact, CAST(len(reasons) AS INTEGER) AS n_changes, CAST({_SCORE} AS INTEGER) AS score, CASE WHEN {_SCORE} >= 7 THEN 'High' WHEN {_SCORE} >= 4 THEN 'Medium' ELSE 'Low' END AS confidence FROM processed"""))
def postprocess_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All post-processing steps of every draft, with the number of changes by rule."""
    p = _processed(spark, sf_dir)
    impact = F.array_join(F.transform(F.array_sort(F.map_entries("impact")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "; ")
    return p.select("record_id", "publish_date", "source_type", F.array_join("regions_mentioned", "; ").alias("regions_mentioned"), F.array_join("themes", "; ").alias("themes"), "priority_llm", "priority_final", "priority_reason", impact.alias("impact"), F.size("changes").alias("n_changes"), F.col("confidence_score").alias("score"), "confidence")


@query("A16", _sql(*_ALL, "x AS (SELECT unnest(reasons) AS name FROM processed WHERE CAST(created_at AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-03')", "c AS (SELECT name, count(*) AS n FROM x GROUP BY 1)", "SELECT 'rule' AS kind, name, n, (SELECT CAST(sum(n) AS BIGINT) FROM c) AS total FROM c ORDER BY n DESC, name LIMIT 10"))
def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest rules of the first three days' records."""
    return E.impact_summary(_processed(spark, sf_dir), first="2024-01-01", last="2024-01-03").where("kind = 'rule'").select("kind", "name", "n", "total")


_DRIVERS = "list_filter([" + ", ".join(f"CASE WHEN {g} <> 0 THEN {{'a': -abs({g}), 'k': '{k}', 'v': {g}}} END" for g, k in (("q1", "publish_date_present"), ("q2", "source_type_known"), ("q3", "evidence_bullets"), ("q4", "key_insights"), ("q5", "rule_corrections"), ("q6", "date_backfilled"))) + "], lambda x: x IS NOT NULL)"


@query("T33, T15", _sql(*_ALL, f"""SELECT record_id, CASE WHEN priority_final = priority_llm THEN 'Priority ' || priority_final || ' as extracted.' ELSE 'Priority ' || priority_llm || ' changed to ' || priority_final || ': ' || replace(priority_reason, '_', ' ') || '.' END AS sentence,
  array_to_string(list_transform(list_sort({_DRIVERS})[1:8], lambda e: e.k || CASE WHEN e.v > 0 THEN ' +' ELSE ' ' END || e.v), '; ') AS drivers, CAST({_SCORE} AS INTEGER) AS confidence_score FROM processed"""))
def record_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a record has its priority and confidence."""
    return E.diagnostics(_processed(spark, sf_dir))


_IN = lambda c, values: f"coalesce(list_contains({_list(values)}, {c}), false)"
_BAD = lambda c, values: f"len(list_filter({c}, lambda x: NOT list_contains({_list(values)}, x))) > 0"
_CHECKS = [
    ("source_type", f"NOT {_IN('source_type', V.SOURCE_TYPES)}"), ("actor_type", f"NOT {_IN('actor_type', V.ACTOR_TYPES)}"), ("publish_date", f"publish_date IS NOT NULL AND publish_date <> '' AND NOT {_iso('publish_date')}"),
    ("publish_date_confidence", f"NOT {_IN('publish_date_confidence', V.LEVELS)}"), ("priority", f"NOT {_IN('priority', V.LEVELS)}"), ("confidence", f"NOT {_IN('confidence', V.LEVELS)}"),
    ("review_status", f"NOT {_IN('review_status', V.REVIEW_STATES + V.LEGACY_REVIEW_STATES)}"), ("topics_list", "topics IS NULL"), ("topics_count", "coalesce(len(topics), -1) NOT BETWEEN 1 AND 4"), ("topics_label", f"topics IS NULL OR {_BAD('topics', V.TOPICS)}"),
    ("keywords_count", "coalesce(len(keywords), -1) NOT BETWEEN 3 AND 15"), ("evidence_count", "coalesce(len(evidence), -1) NOT BETWEEN 2 AND 4"), ("insights_count", "coalesce(len(insights), -1) NOT BETWEEN 2 AND 4"),
    ("regions_list", "regions_mentioned IS NULL"), ("regions_repeat", "regions_mentioned IS NULL OR len(regions_mentioned) <> len(list_distinct(regions_mentioned))"), ("regions_count", "regions_mentioned IS NULL OR len(regions_mentioned) > 15"),
    ("regions_label", f"regions_mentioned IS NULL OR {_BAD('regions_mentioned', V.REGIONS)}"), ("relevant_list", "regions_relevant IS NULL"), ("relevant_label", f"regions_relevant IS NULL OR {_BAD('regions_relevant', V.REGIONS)}"),
]


@query("T16, F-arr2", _sql("SELECT record_id, coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _CHECKS) + "], lambda x: x IS NOT NULL), '; '), '') AS errors FROM drafts"))
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checks that each draft fails."""
    d = _drafts(spark, sf_dir)
    if R.missing_keys(d.columns):
        raise ValueError(f"fields are missing: {R.missing_keys(d.columns)}")
    return d.select("record_id", F.array_join(R.errors(), "; ").alias("errors"))


_LINE = lambda x: "coalesce(" + ", ".join(f"CASE WHEN NOT (month({d}) = 12 AND day({d}) = 31) THEN {d} END" for d in (f"TRY_CAST(nullif(regexp_extract({x}, {_q(C.ISO_DATE)}, 2), '') AS DATE)", _made(x, E.ANY_MONTH_DAY_YEAR, 4, 2, 3), _made(x, E.DAY_MONTH_DOT_YEAR, 4, 3, 2))) + ")"
_META = "CASE n % 4 WHEN 0 THEN 'D:20240' || (n % 9 + 1) || '15103000Z' WHEN 1 THEN 'made 2024-02-03' WHEN 2 THEN 'D:20241399' END"
_META_DATE = f"CAST(coalesce(TRY_CAST(TRY_STRPTIME(nullif(replace(regexp_extract(meta, 'D:([0-9]{{4}})([0-9]{{2}})([0-9]{{2}})', 0), 'D:', ''), ''), '%Y%m%d') AS DATE), TRY_CAST(nullif(regexp_extract(meta, {_q(C.ISO_DATE)}, 2), '') AS DATE)) AS VARCHAR)"
_GIVEN_DATE = f"CAST(TRY_CAST(nullif(regexp_extract(hint, {_q(C.ISO_DATE)}, 2), '') AS DATE) AS VARCHAR)"


@query("F-d4", _sql(f"m AS (SELECT record_id, hint, {_META} AS meta, list_filter(list_transform(string_split(regexp_replace(source_text || CASE WHEN n % 8 = 7 THEN chr(10) || 'Dec 31, 2023' ELSE '' END, '\\r\\n?', chr(10), 'g'), chr(10))[1:{E.HEADER_LINES}], lambda x: {_LINE('x')}), lambda x: x IS NOT NULL)[1] AS head FROM drafts)", f"SELECT record_id, coalesce(CAST(head AS VARCHAR), {_GIVEN_DATE}, {_META_DATE}) AS hint, CASE WHEN head IS NOT NULL THEN 'pdf_header_publish_date' WHEN coalesce({_GIVEN_DATE}, {_META_DATE}) IS NOT NULL THEN 'pdf_metadata_publish_date' END AS hint_source FROM m"))
def date_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's date by the lines of its header, a hint given, or its file's metadata."""
    n = F.col("n")
    meta = F.when(n % 4 == 0, F.concat(F.lit("D:20240"), (n % 9 + 1).cast("string"), F.lit("15103000Z"))).when(n % 4 == 1, "made 2024-02-03").when(n % 4 == 2, "D:20241399")
    text = F.concat("source_text", F.when(n % 8 == 7, "\nDec 31, 2023").otherwise(""))
    return _drafts(spark, sf_dir).select("record_id", E.date_hint(text, F.col("hint"), meta).alias("h")).select("record_id", "h.hint", "h.hint_source")


def _hits(patterns: list[str]) -> str:
    parts = []
    for p in patterns:
        found = f"list_filter(fragments, lambda f: regexp_matches(f.text, {_q(C.bounded(p))}))"
        firsts = f"list_filter({found}, lambda f, i: list_position(list_transform({found}, lambda g: g.field), f.field) = i)"
        parts.append(f"list_transform({firsts}, lambda f: {{'term': {_q(p)}, 'place': f.place}})")
    return "flatten([" + ", ".join(parts) + "])"


def _fragments(name: str, label: str) -> str:
    return f"list_transform(coalesce({name}, []), lambda x, i: {{'field': '{label}', 'place': CASE WHEN len({name}) > 1 THEN '{label}[' || (i - 1) || ']' ELSE '{label}' END, 'text': lower(x)}})"


def _detail_sql() -> str:
    parts = []
    for name, rule in V.THEMES.items():
        meets = lambda kind, values: f"coalesce(len(list_intersect({'low_companies' if kind == 'companies' else kind}, {_list(values)})) > 0, false)"
        groups = ", ".join(f"CASE WHEN {'len(keys) > 0' if kind == 'keywords' else meets(kind, rule[kind])} THEN '{kind}' END" for kind in R.KINDS if kind in rule)
        anti = f"list_transform({_hits(rule['anti'])}, lambda h: h.term)" if "anti" in rule else "CAST([] AS VARCHAR[])"
        parts.append(f"SELECT record_id, '{name}' AS theme, keys, list_filter([{groups}], lambda x: x IS NOT NULL) AS groups, {anti} AS against, {meets('companies', V.PREMIUM_MAKERS) if rule.get('premium') else 'true'} AS premium, {meets('regions', rule['required']) if 'required' in rule else 'true'} AS region FROM (SELECT *, {_hits(rule['keywords'])} AS keys FROM fr)")
    return " UNION ALL ".join(parts)


_FRAGMENTS = f"list_concat(list_concat(list_concat(CASE WHEN trim(title) <> '' THEN [{{'field': 'title', 'place': 'title', 'text': lower(title)}}] ELSE [] END, {_fragments('evidence', 'evidence_bullets')}), {_fragments('insights', 'key_insights')}), {_fragments('keywords', 'keywords')})"


@query("F-map2, F-map3", f"""WITH fr AS (SELECT *, list_transform(companies, lambda c: lower(c)) AS low_companies, {_FRAGMENTS} AS fragments FROM records), d AS ({_detail_sql()}), x AS (SELECT *, CASE WHEN len(groups) >= 2 THEN {_once("against")} ELSE [] END AS ag, list_transform(keys, lambda k: k.term) AS ts, list_transform(keys, lambda k: k.place) AS ps FROM d WHERE len(groups) > 0),
 y AS (SELECT *, CASE WHEN len(groups) = 2 AND len(ag) > 0 THEN 'anti_keyword' WHEN NOT premium THEN 'premium_gate' WHEN NOT region THEN 'region_requirement' END AS held_by FROM x)
 SELECT record_id, theme, array_to_string(groups, ',') AS groups, coalesce(array_to_string({_once("ts")}, ' '), '') AS terms, coalesce(array_to_string({_once("ps")}, ' '), '') AS places, coalesce(array_to_string(ag, ' '), '') AS anti_terms, held_by, held_by IS NULL AND len(groups) >= 2 AS fired FROM y""", on_records=True)
def theme_details(r: DataFrame) -> DataFrame:
    """What speaks for and against each theme of a record, and where it stands."""
    d = E.theme_details(r)
    return d.select("record_id", "theme", F.array_join("groups", ",").alias("groups"), F.array_join("terms", " ").alias("terms"), F.array_join("places", " ").alias("places"), F.array_join("anti_terms", " ").alias("anti_terms"), "held_by", "fired")


@query("M13", _sql(*_ALL, "SELECT record_id, title, CASE WHEN n % 3 = 0 THEN date_final ELSE publish_date END AS publish_date, CASE WHEN n % 3 = 0 THEN source_final ELSE source_type END AS source_type, review_status, CAST(created_at AS VARCHAR) AS created_at FROM processed"))
def reingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third draft post-processed again and put in its record's place, of which identity and review stay."""
    from tidemark.operators import maintenance as M

    columns = ["record_id", "title", "publish_date", "source_type", "review_status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at")]
    d = _drafts(spark, sf_dir)
    again = E.postprocess(d.where("n % 3 = 0"), OWN_NAMES)
    return M.replace_records(d.select(*columns), again.select(*columns), ("record_id", "created_at", "review_status"), blanks=True)
