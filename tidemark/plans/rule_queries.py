"""Queries of the rule engine and of quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import bounded
from tidemark.operators import quality as Q
from tidemark.operators import rules as R
from tidemark.operators.records import _dealt, _list

from .catalog import query
from .record_queries import _SCORED, _map

_TEXT = "lower(concat_ws(' ', title, array_to_string(evidence, ' '), array_to_string(insights, ' '), array_to_string(keywords, ' ')))"
_LOWER = "list_transform(companies, lambda c: lower(c))"


def _like(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({text}, '{bounded(p)}')" for p in patterns) + ")"


def _coalesced(condition: str) -> str:
    return f"coalesce({condition}, false)"


def _overlap(a: str, values: list[str]) -> str:
    return f"(len(list_intersect({a}, {_list(values)})) > 0)"


_FLAGS = f"""WITH flags AS (SELECT *, len(regions) > 0 AS fp, list_contains(topics, 'Closure Technology & Innovation') AS tp,
  regexp_matches(concat_ws(' ', title, array_to_string(evidence, ' '), array_to_string(insights, ' '), array_to_string(keywords, ' ')), '(?i)(^|[^A-Za-z0-9_]){V.CLOSURE_PATTERN}($|[^A-Za-z0-9_])') AS kw,
  len(list_filter(companies, lambda c: len(list_filter({_list(V.KEY_SUPPLIER_TOKENS)}, lambda t: contains(lower(c), t))) > 0)) > 0 AS su, {_overlap(_LOWER, V.KEY_MAKERS)} AS mk FROM records),
 ruled AS (SELECT *, CASE WHEN priority = 'High' THEN NULL WHEN su AND fp THEN 'footprint_and_key_supplier' WHEN fp AND tp THEN 'footprint_and_closure_topic' WHEN su AND tp THEN 'key_supplier_and_closure_topic'
  WHEN fp AND kw THEN 'footprint_and_closure_keyword' WHEN su AND kw THEN 'key_supplier_and_closure_keyword' WHEN fp AND mk THEN 'footprint_and_key_oem' WHEN NOT fp AND NOT tp AND NOT kw AND NOT mk AND NOT su THEN 'missing_footprint_region' END AS reason FROM flags) """


@query("T12, P24", _FLAGS + "SELECT record_id, CASE WHEN reason IS NULL THEN priority WHEN reason = 'missing_footprint_region' THEN 'Low' ELSE 'High' END AS priority_final, reason FROM ruled", on_records=True)
def priority_rules(r: DataFrame) -> DataFrame:
    value, reason = R.priority()
    return r.select("record_id", value.alias("priority_final"), reason.alias("reason"))


@query("F-s26", _FLAGS + "SELECT upper(reason[1:1]) || replace(reason[2:], '_', ' ') AS rule, count(*) AS n FROM ruled WHERE reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, rule LIMIT 10", on_records=True)
def rule_impact(r: DataFrame) -> DataFrame:
    reason = R.priority()[1]
    label = F.concat(F.upper(F.substring("reason", 1, 1)), F.replace(F.expr("substring(reason, 2)"), F.lit("_"), F.lit(" ")))
    return r.select(reason.alias("reason")).where("reason IS NOT NULL").groupBy(label.alias("rule")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rule").limit(10)


def _groups(rule: dict) -> str:
    parts = []
    for kind in ("companies", "keywords", "topics", "regions"):
        if kind in rule:
            parts.append(_like(_TEXT, rule[kind]) if kind == "keywords" else _overlap(_LOWER if kind == "companies" else kind, rule[kind]))
    return " + ".join(f"CAST({p} AS INTEGER)" for p in parts)


def _theme_sql() -> str:
    counted = ", ".join(f"{_groups(rule)} AS g{k}" for k, rule in enumerate(V.THEMES.values()))
    strengths = []
    for k, rule in enumerate(V.THEMES.values()):
        fires = [f"g{k} >= 2"]
        if "anti" in rule:
            fires.append(f"NOT ({_like(_TEXT, rule['anti'])} AND g{k} < 3)")
        if rule.get("premium"):
            fires.append(_overlap(_LOWER, V.PREMIUM_MAKERS))
        if "required" in rule:
            fires.append(_overlap("regions", rule["required"]))
        value = f"CASE WHEN g{k} >= 4 THEN 3 WHEN g{k} = 3 THEN 2 ELSE 1 END"
        strengths.append(f"CASE WHEN {' AND '.join(fires)} THEN {f'least({value}, {rule["cap"]})' if 'cap' in rule else value} ELSE 0 END AS s{k}")
    names = list(V.THEMES)
    fired = "list_filter([" + ", ".join(f"CASE WHEN s{k} > 0 THEN '{n}' END" for k, n in enumerate(names)) + "], lambda x: x IS NOT NULL)"
    own = [f"CASE WHEN s{k} > 0 THEN '{rule['rollup']}' END" for k, rule in enumerate(V.THEMES.values()) if "rollup" in rule]
    built = ["CASE WHEN " + " AND ".join(f"s{names.index(p)} > 0" for p in parts) + f" THEN '{label}' END" for label, parts in V.STRUCTURAL_ROLLUPS.items()]
    rollups = "list_filter([" + ", ".join(own + built) + "], lambda x: x IS NOT NULL)"
    return f"WITH g AS (SELECT *, {counted} FROM records), st AS (SELECT *, {', '.join(strengths)} FROM g), th AS (SELECT *, {fired} AS themes, {rollups} AS ru, greatest({', '.join(f's{k}' for k in range(len(names)))}) AS strength FROM st) "


_THEMES = _theme_sql()


@query("T13", _THEMES + "SELECT record_id, array_to_string(themes, '; ') AS themes, array_to_string(list_filter(ru, lambda x, i: list_position(ru, x) = i), '; ') AS rollups, CAST(strength AS INTEGER) AS strength FROM th", on_records=True)
def theme_tags(r: DataFrame) -> DataFrame:
    return R.themes(r).select("record_id", F.array_join("themes", "; ").alias("themes"), F.array_join("rollups", "; ").alias("rollups"), "strength")


@query("T13", _THEMES + "SELECT theme, count(*) AS n, CAST(max(strength) AS INTEGER) AS strongest FROM (SELECT unnest(themes) AS theme, strength FROM th) GROUP BY 1", on_records=True)
def theme_rollups(r: DataFrame) -> DataFrame:
    # explode_outer: explode's filter on the list, pushed down through every step, would make all themes' texts anew for each use
    return R.themes(r).select(F.explode_outer("themes").alias("theme"), "strength").where("theme IS NOT NULL").groupBy("theme").agg(F.count(F.lit(1)).alias("n"), F.max("strength").alias("strongest"))


@query("T14", _THEMES + f"SELECT record_id, CASE WHEN len(regions) > 0 AND len(list_intersect(themes, {_list(V.ESCALATION_THEMES)})) > 0 THEN 'High' ELSE priority END AS priority_final FROM th", on_records=True)
def theme_escalation(r: DataFrame) -> DataFrame:
    from tidemark.functions.columns import texts

    up = (F.size("regions") > 0) & F.arrays_overlap("themes", texts(V.ESCALATION_THEMES))
    return R.themes(r).select("record_id", F.when(up, "High").otherwise(F.col("priority")).alias("priority_final"))


_CONF = "2 * CAST(publish_date IS NOT NULL AS INTEGER) + 2 * CAST(source_type <> 'Other' AS INTEGER) + CASE WHEN len(evidence) >= 3 THEN 2 WHEN len(evidence) = 2 THEN 1 ELSE 0 END + CAST(len(insights) >= 2 AS INTEGER) - CAST(floor((n % 5) / 3.0) AS INTEGER) - CAST(n % 11 = 0 AS INTEGER)"


@query("T15", f"SELECT record_id, CAST({_CONF} AS INTEGER) AS score, CASE WHEN {_CONF} >= 7 THEN 'High' WHEN {_CONF} >= 4 THEN 'Medium' ELSE 'Low' END AS level FROM records", on_records=True)
def confidence_score(r: DataFrame) -> DataFrame:
    score, level = R.confidence(F.col("n") % 5, F.col("n") % 11 == 0)
    return r.select("record_id", score.cast("int").alias("score"), level.alias("level"))


_PLAIN = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g'))"
_ALIAS = _map(Q.alias_groups())
_NORMS = lambda c: f"list_filter(list_transform({c}, lambda v: {_PLAIN('v')}), lambda v: v <> '')"
_PAIRS = f"list_distinct(list_transform(list_filter(list_transform(companies, lambda v: {_PLAIN('v')}), lambda v: {_ALIAS}[v] IS NOT NULL), lambda v: {{'main': {_ALIAS}[v], 'name': v}}))"
_EXP = f"list_distinct(list_filter(list_transform(countries, lambda c: {_map(V.COUNTRY_REGIONS)}[coalesce({_map(V.COUNTRY_ALIASES)}[lower(c)], c)]), lambda x: x IS NOT NULL))"
_PARENTS = "MAP {" + ", ".join(f"'{k}': {_list(v)}" for k, v in V.PARENT_REGIONS.items()) + "}"
_WORDS = lambda c: f"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 4 AND NOT list_contains({_list(V.KEYWORD_STOPWORDS)}, t)))"
_BAD = f"len(list_filter(evidence, lambda b: NOT (contains({_PLAIN('text')}, {_PLAIN('b')}) OR len({_WORDS('b')}) = 0 OR len(list_intersect({_WORDS('b')}, {_WORDS('text')})) >= 0.60 * len({_WORDS('b')})))) > 0"


def _theme_findings() -> str:
    out = []
    for name, rule in V.THEMES.items():
        fired = f"list_contains(detected, '{name}')"
        out.append(f"SELECT record_id, 'High', 'macro_theme_min_groups_violation' FROM x WHERE {fired} AND coalesce(theme_groups['{name}'], 0) < {V.THEME_GROUPS}")
        if rule.get("premium"):
            out.append(f"SELECT record_id, 'High', 'macro_theme_premium_gate_violation' FROM x WHERE {fired} AND NOT {_overlap(_LOWER, V.PREMIUM_MAKERS)}")
        if "required" in rule:
            out.append(f"SELECT record_id, 'High', 'macro_theme_region_requirement_violation' FROM x WHERE {fired} AND NOT {_overlap('list_concat(regions, shown)', rule['required'])}")
    return " UNION ALL ".join(out)


_GROUPS = "MAP {" + ", ".join(f"'{name}': 1 + (n + {k}) % 3" for k, name in enumerate(V.THEMES)) + "}"
_OUTSIDE = lambda c: f"len(list_filter({c}, lambda v: NOT list_contains({_list(V.REGIONS)}, v))) > 0"
_FOUND = (
    _SCORED
    + ", "
    + _FLAGS.removeprefix("WITH ").replace("FROM records)", "FROM keyed)")
    + f""", x AS (SELECT * REPLACE (CASE WHEN reason IS NULL THEN priority WHEN reason = 'missing_footprint_region' THEN 'Low' ELSE 'High' END AS priority, CASE WHEN n % 13 <> 0 THEN reason END AS reason),
  priority AS priority_llm, {_dealt(V.DEALT_REGIONS, "n % 3", "n + i * 2")} AS shown, {_dealt(list(V.THEMES), "CASE WHEN n % 5 = 0 THEN 1 + n % 2 ELSE 0 END", "n + i * 2")} AS detected, CASE WHEN n % 4 <> 0 THEN {_GROUPS} END AS theme_groups, {_PAIRS} AS pairs, {_EXP} AS ex FROM ruled),
 y AS (SELECT *, len(pairs) > len(list_distinct(list_transform(pairs, lambda p: p.main))) AS several FROM x),
 f AS (SELECT record_id, 'Medium' AS severity, 'duplicate_values' AS finding FROM x WHERE len({_NORMS('companies')}) > len(list_distinct({_NORMS('companies')}))
 UNION ALL SELECT record_id, 'Medium', 'duplicate_values' FROM x WHERE len({_NORMS('countries')}) > len(list_distinct({_NORMS('countries')}))
 UNION ALL SELECT record_id, 'Medium', 'duplicate_values' FROM x WHERE len({_NORMS('regions')}) > len(list_distinct({_NORMS('regions')}))
 UNION ALL SELECT record_id, 'High', 'geo_leakage' FROM x WHERE {_OUTSIDE('regions')}
 UNION ALL SELECT record_id, 'High', 'invalid_display_region' FROM x WHERE {_OUTSIDE('shown')}
 UNION ALL SELECT record_id, 'Medium', 'missing_footprint_region' FROM x WHERE len(list_filter(ex, lambda e: NOT list_contains(regions, e) AND NOT coalesce(len(list_intersect({_PARENTS}[e], regions)) > 0, false))) > 0
 UNION ALL SELECT record_id, 'Medium', 'canonicalization_inconsistent' FROM y WHERE several
 UNION ALL SELECT record_id, 'Low', 'canonicalization_alias_present' FROM y WHERE NOT several AND len(list_filter(pairs, lambda p: p.main <> p.name)) > 0
 UNION ALL SELECT record_id, 'High', 'missing_evidence' FROM x WHERE len(evidence) = 0
 UNION ALL SELECT record_id, 'Medium', 'evidence_check_skipped' FROM x WHERE len(evidence) > 0 AND length(text) < 100
 UNION ALL SELECT record_id, 'High', 'evidence_not_grounded' FROM x WHERE length(text) >= 100 AND {_BAD}
 UNION ALL {_theme_findings()}
 UNION ALL SELECT record_id, 'Medium', 'confidence_evidence_mismatch' FROM x WHERE confidence = 'High' AND len(evidence) < 2
 UNION ALL SELECT record_id, 'Low', 'confidence_source_mismatch' FROM x WHERE confidence = 'High' AND source_type = 'Other'
 UNION ALL SELECT record_id, 'Medium', 'missing_priority_reason' FROM x WHERE priority <> priority_llm AND reason IS NULL
 UNION ALL SELECT record_id, 'Low', 'missing_priority_reason' FROM x WHERE priority = 'High' AND reason IS NULL
 UNION ALL SELECT record_id, 'High', 'duplicate_record_in_brief' FROM (SELECT record_id, min(record_id) OVER (PARTITION BY dedupe_key) AS m FROM x) WHERE record_id <> m) """
)


@query("T25, U1, J14, J15, J16", _FOUND + "SELECT * FROM f", on_records=True)
def qc_findings(r: DataFrame) -> DataFrame:
    """All findings about single records and repeated stories; similar titles are near_title_findings."""
    return Q.findings(Q.reviewed(r))


@query("T25, J10", on_records=True)
def near_title_findings(r: DataFrame) -> DataFrame:
    """Later records whose title is like that of an earlier record of another story."""
    return Q.near_title_findings(r)


_PER = ", s AS (SELECT r.record_id, count(*) FILTER (severity = 'High') AS high, count(*) FILTER (severity = 'Medium') AS medium, count(*) FILTER (severity = 'Low') AS low FROM records r LEFT JOIN f ON f.record_id = r.record_id GROUP BY 1) "


@query("A12, J7, T30", _FOUND + _PER + "SELECT record_id, high, medium, low, greatest(0, 100 - 25 * high - 10 * medium - 2 * low) AS score FROM s", on_records=True)
def qc_record_scores(r: DataFrame) -> DataFrame:
    s = Q.record_scores(Q.reviewed(r))
    return s.select("record_id", "high", "medium", "low", F.col("score").cast("long").alias("score"))


@query("O7", _FOUND + _PER + "SELECT record_id, score FROM (SELECT record_id, greatest(0, 100 - 25 * high - 10 * medium - 2 * low) AS score, high, medium FROM s) ORDER BY score, high DESC, medium DESC, record_id LIMIT 1", on_records=True)
def worst_record(r: DataFrame) -> DataFrame:
    return Q.record_scores(Q.reviewed(r)).orderBy("score", F.desc("high"), F.desc("medium"), "record_id").limit(1).select("record_id", F.col("score").cast("long").alias("score"))


@query("A15", _FOUND + """, p AS (SELECT r.record_id, count(*) FILTER (severity = 'High') AS h, count(*) FILTER (severity = 'Medium') AS m,
  coalesce(max(CAST(finding IN ('missing_evidence', 'evidence_check_skipped', 'evidence_not_grounded') AS INTEGER)), 0) AS e, coalesce(max(CAST(finding = 'canonicalization_inconsistent' AS INTEGER)), 0) AS c,
  coalesce(max(CAST(finding IN ('geo_leakage', 'invalid_display_region', 'missing_footprint_region') AS INTEGER)), 0) AS g FROM records r LEFT JOIN f ON f.record_id = r.record_id GROUP BY 1)
 SELECT count(*) AS n_records, round(sum(h) / greatest(count(*), 1)::DOUBLE, 4) AS kpi_r1, round(sum(m) / greatest(count(*), 1)::DOUBLE, 4) AS kpi_r2, round(1 - sum(e) / greatest(count(*), 1)::DOUBLE, 4) AS kpi_r3, round(1 - sum(c) / greatest(count(*), 1)::DOUBLE, 4) AS kpi_r4, round(1 - sum(g) / greatest(count(*), 1)::DOUBLE, 4) AS kpi_r5 FROM p""", on_records=True)
def qc_kpis(r: DataFrame) -> DataFrame:
    return Q.kpis(Q.reviewed(r))


@query("A14", _FOUND + "SELECT severity, finding, count(*) AS n FROM f GROUP BY GROUPING SETS ((severity), (finding))", on_records=True)
def summary_pivot(r: DataFrame) -> DataFrame:
    return Q.findings(Q.reviewed(r)).groupingSets([["severity"], ["finding"]], "severity", "finding").agg(F.count(F.lit(1)).alias("n"))
