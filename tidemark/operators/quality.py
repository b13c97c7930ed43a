"""Record quality: findings, scores, KPIs and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import bind, keyword_set, mapping, plain_text, renamed, texts, title_fingerprint
from tidemark.sources.stores import materialised

from . import rules
from .dedupe import dedupe_key
from .fuzzy import fuzzy_pairs
from .records import dealt


def expected_regions() -> Column:
    canonical = renamed(F.col("countries"), V.COUNTRY_ALIASES)
    return F.array_distinct(F.filter(F.transform(canonical, lambda c: F.try_element_at(mapping(V.COUNTRY_REGIONS), c)), lambda x: x.isNotNull()))


def missing_regions() -> Column:
    """Regions that follow from the countries but are neither present nor covered by a wider one."""
    parents = F.create_map(*(x for k, v in V.PARENT_REGIONS.items() for x in (F.lit(k), texts(v))))
    return F.filter(expected_regions(), lambda e: ~F.array_contains("regions", e) & ~F.coalesce(F.arrays_overlap(F.try_element_at(parents, e), F.col("regions")), F.lit(False)))


def grounded(bullet: Column, source: Column) -> Column:
    """A bullet stands in the source's normalised text, or 0.60 of its words do; one without words passes."""
    words = keyword_set(bullet, V.KEYWORD_STOPWORDS)
    overlap = F.size(F.array_intersect(words, keyword_set(source, V.KEYWORD_STOPWORDS))) / F.greatest(F.size(words), F.lit(1))
    return F.contains(plain_text(source), plain_text(bullet)) | (F.size(words) == 0) | (overlap >= V.EVIDENCE_THRESHOLD)


def ungrounded(bullets: Column, source: Column) -> Column:
    """Whether a bullet is not grounded().  One that stands in the source as it is does so in its normalised text too; for the others that text is made once."""
    rest = F.filter(bullets, lambda b: ~F.coalesce(F.contains(source, b), F.lit(False)))
    judged = lambda r: F.when(F.size(r) > 0, bind(plain_text(source), lambda plain: F.exists(r, lambda b: ~grounded(b, plain)))).otherwise(F.lit(False))
    return bind(rest, judged)


def reviewed(records: DataFrame) -> DataFrame:
    """Records as a store keeps them: priority by the rules with its reason (some cleared by an editor), the regions shown, and the themes found with the numbers of groups that matched."""
    n = F.col("n")
    value, reason = rules.priority()
    groups = F.create_map(*(x for k, name in enumerate(V.THEMES) for x in (F.lit(name), 1 + (n + k) % 3)))
    return records.withColumns({
        "priority_llm": F.col("priority"),
        "priority": value,
        "priority_reason": F.when(n % 13 != 0, reason),
        "regions_mentioned": dealt(V.DEALT_REGIONS, n % 3, lambda i: n + i * 2),
        "themes": dealt(list(V.THEMES), F.when(n % 5 == 0, 1 + n % 2).otherwise(0), lambda i: n + i * 2),
        "theme_groups": F.when(n % 4 != 0, groups),
    })


def aliases(companies: Column) -> Column:
    """Distinct (main, name) of the companies that belong to a group of names; name is normalised."""
    table = mapping(alias_groups())
    both = F.transform(companies, lambda c: F.struct(F.try_element_at(table, plain_text(c)).alias("main"), plain_text(c).alias("name")))
    return F.array_distinct(F.filter(both, lambda x: x["main"].isNotNull()))


def _repeated(values: Column) -> Column:
    norm = F.filter(F.transform(values, plain_text), lambda v: v != "")
    return F.size(norm) > F.size(F.array_distinct(norm))


def _theme_checks() -> list[tuple[Column, str, str]]:
    """For each theme that a record has: too few groups, no premium maker, none of the regions that it needs."""
    out = []
    regions = F.array_union("regions", "regions_mentioned")
    for name, rule in V.THEMES.items():
        fired = F.array_contains("themes", name)
        groups = F.coalesce(F.try_element_at("theme_groups", F.lit(name)), F.lit(0))
        out.append((fired & (groups < V.THEME_GROUPS), "High", "macro_theme_min_groups_violation"))
        if rule.get("premium"):
            makers = F.transform("companies", lambda c: F.lower(c))
            out.append((fired & ~F.arrays_overlap(makers, texts(V.PREMIUM_MAKERS)), "High", "macro_theme_premium_gate_violation"))
        if "required" in rule:
            out.append((fired & ~F.arrays_overlap(regions, texts(rule["required"])), "High", "macro_theme_region_requirement_violation"))
    return out


def raised(records: DataFrame) -> DataFrame:
    """(record_id, severity, finding) of reviewed records: a row for each finding, and one of nulls for a record without any of its own.

    All checks of a record and its key are made in one pass over the records and stored; findings and repeated keys come from there.
    """
    pairs = F.col("_aliases")
    mains = F.transform(pairs, lambda p: p["main"])
    several = F.size(mains) > F.size(F.array_distinct(mains))
    no_reason = F.coalesce(F.trim("priority_reason"), F.lit("")) == ""
    moved = (F.coalesce(F.trim("priority_llm"), F.lit("")) != "") & (F.col("priority") != F.col("priority_llm"))
    checks = [
        *((_repeated(F.col(c)), "Medium", "duplicate_values") for c in ("companies", "countries", "regions")),
        (F.size(F.array_except("regions", texts(V.REGIONS))) > 0, "High", "geo_leakage"),
        (F.size(F.array_except("regions_mentioned", texts(V.REGIONS))) > 0, "High", "invalid_display_region"),
        (F.size(missing_regions()) > 0, "Medium", "missing_footprint_region"),
        (several, "Medium", "canonicalization_inconsistent"),
        (~several & F.exists(pairs, lambda p: p["main"] != p["name"]), "Low", "canonicalization_alias_present"),
        (F.size("evidence") == 0, "High", "missing_evidence"),
        ((F.size("evidence") > 0) & (F.length("text") < 100), "Medium", "evidence_check_skipped"),
        ((F.length("text") >= 100) & ungrounded(F.col("evidence"), F.col("text")), "High", "evidence_not_grounded"),
        *_theme_checks(),
        ((F.col("confidence") == "High") & (F.size("evidence") < 2), "Medium", "confidence_evidence_mismatch"),
        ((F.col("confidence") == "High") & (F.col("source_type") == "Other"), "Low", "confidence_source_mismatch"),
        (moved & no_reason, "Medium", "missing_priority_reason"),
        ((F.col("priority") == "High") & no_reason, "Low", "missing_priority_reason"),
    ]
    hit = lambda c, severity, kind: F.when(F.coalesce(c, F.lit(False)), F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("finding")))
    own = F.filter(F.array(*(hit(c, s, k) for c, s, k in checks)), lambda x: x.isNotNull())
    checked = records.withColumn("_aliases", aliases(F.col("companies"))).select("record_id", own.alias("own"), F.unhex(F.md5(dedupe_key())).alias("k"))
    checked = materialised(checked, "checked")
    found = checked.select("record_id", F.explode_outer("own").alias("f")).select("record_id", "f.severity", "f.finding")
    # every row of a key after the first; ids and keys only, and only of keys that occur twice
    keyed = checked.select("record_id", "k")
    first = keyed.groupBy("k").agg(F.min("record_id").alias("first"), F.max("record_id").alias("last")).where("first < last").select("k", "first")
    again = keyed.join(first, "k").where("record_id <> first")
    return found.unionByName(again.select("record_id", F.lit("High").alias("severity"), F.lit("duplicate_record_in_brief").alias("finding")))


def findings(records: DataFrame) -> DataFrame:
    """(record_id, severity, finding), a row for each finding."""
    return raised(records).where("finding IS NOT NULL")


def near_title_findings(records: DataFrame, ratio: float = 0.85) -> DataFrame:
    """(record_id, severity, finding, similar_to, ratio) of later records whose title fingerprint is like that of an earlier one of another story.

    A record is named with the first record of each similar fingerprint, so that a common title gives no pairs of its records.
    """
    fp = title_fingerprint(F.coalesce("title", F.lit("")), V.TITLE_STOPWORDS)
    keyed = materialised(records.select("record_id", fp.alias("title"), F.md5(dedupe_key()).alias("key")).where("title <> ''"), "titles")
    t = keyed.groupBy("title").agg(F.min(F.struct("record_id", "key")).alias("first")).select(F.col("first.record_id").alias("id"), "title", F.col("first.key").alias("key"))
    t = materialised(t, "fingerprints")
    pairs = fuzzy_pairs(t.select("id", "title"), ratio)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))
    # records by their fingerprint's first record, with the first records of the similar ones and of their own
    near = both.unionByName(t.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("ratio")))
    near = near.join(t.select(F.col("id").alias("b"), F.col("key").alias("other")), "b").join(t.select(F.col("id").alias("a"), "title"), "a")
    met = keyed.join(near.select("title", "b", "other", "ratio"), "title").where("record_id > b AND key <> other")
    return met.select("record_id", F.lit("Medium").alias("severity"), F.lit("near_duplicate_titles").alias("finding"), F.col("b").alias("similar_to"), "ratio")


EVIDENCE = ["missing_evidence", "evidence_check_skipped", "evidence_not_grounded"]
GEOGRAPHY = ["geo_leakage", "invalid_display_region", "missing_footprint_region"]


def graded(found: DataFrame) -> DataFrame:
    """Of rows of raised(): for each record its numbers of findings, its score and whether evidence, names and regions fail."""
    failed = lambda kinds: F.coalesce(F.max(F.col("finding").isin(kinds).cast("int")), F.lit(0))
    per = found.groupBy("record_id").agg(*(F.count_if(F.col("severity") == s).alias(s.lower()) for s in V.LEVELS), failed(EVIDENCE).alias("e"), failed(["canonicalization_inconsistent"]).alias("c"), failed(GEOGRAPHY).alias("g"))
    return per.withColumn("score", F.greatest(F.lit(0), 100 - 25 * F.col("high") - 10 * F.col("medium") - 2 * F.col("low")))


def record_scores(records: DataFrame) -> DataFrame:
    return graded(raised(records)).select("record_id", "high", "medium", "low", "score")


def kpis(records: DataFrame) -> DataFrame:
    """R1 and R2: findings per record; R3, R4, R5: shares of records that pass."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    return graded(raised(records)).agg(F.count(F.lit(1)).alias("n_records"), F.round(F.sum("high") / n, 4).alias("kpi_r1"), F.round(F.sum("medium") / n, 4).alias("kpi_r2"), F.round(1 - F.sum("e") / n, 4).alias("kpi_r3"), F.round(1 - F.sum("c") / n, 4).alias("kpi_r4"), F.round(1 - F.sum("g") / n, 4).alias("kpi_r5"))


def targets(records: DataFrame, chosen: DataFrame | None, as_of: str | None = None, days: int = 7) -> DataFrame:
    """Records with their place: those of chosen (record_id, pos) in that order, else the approved ones of the last days."""
    if chosen is not None:
        return records.join(chosen, "record_id")
    day = F.coalesce(F.col("publish_date"), F.col("created_at").cast("date"))
    recent = records.where((F.col("review_status") == "Approved") & (day >= F.date_sub(F.lit(as_of).cast("date"), days)))
    return recent.withColumn("pos", F.row_number().over(Window.orderBy("record_id")))  # a week's approved records, numbered for people


def latest_run(runs: DataFrame) -> DataFrame:
    """The run with the greatest version, records' runs before others."""
    preferred = F.col("target_mode").isin(V.LATEST_RUN_MODES)
    return runs.orderBy(preferred.desc(), F.col("run_version").desc_nulls_last(), F.col("created_at").desc()).limit(1)


def next_version(runs: DataFrame) -> DataFrame:
    """One more than the greatest version; without any, one more than the number of runs."""
    return runs.agg(F.coalesce(F.max("run_version") + 1, F.count(F.lit(1)) + 1).cast("int").alias("run_version"))


def run_row(per: DataFrame, target_mode: str, brief_score: Column | None = None) -> DataFrame:
    """The row that the history of runs keeps, of graded() rows; the mean score is rounded half to even, to one place and then to none."""
    n = F.greatest(F.count(F.lit(1)), F.lit(1))
    share = lambda c: F.round(1 - F.sum(c) / n, 4)
    ratio = lambda c: F.round(F.sum(c) / n, 4)
    sums = per.agg(F.count(F.lit(1)).alias("target_record_count"), *(F.sum(s).alias(f"record_qc_{s}") for s in ("high", "medium", "low")), ratio("high").alias("kpi_r1"), ratio("medium").alias("kpi_r2"), share("e").alias("kpi_r3"), share("c").alias("kpi_r4"), share("g").alias("kpi_r5"), F.bround(F.avg("score"), 1).alias("_mean"))
    score = F.bround("_mean", 0)
    overall = F.bround((score + brief_score) / 2, 1) if brief_score is not None else score
    return sums.select(F.lit(target_mode).alias("target_mode"), "target_record_count", "record_qc_high", "record_qc_medium", "record_qc_low", *(f"kpi_r{k}" for k in range(1, 6)), score.cast("int").alias("weighted_record_score"), overall.alias("weighted_overall_score"))


def alias_groups() -> dict[str, str]:
    """Main name by name, for makers that have more than one."""
    groups: dict[str, set[str]] = {}
    for name, main in V.COMPANY_NAMES.items():
        groups.setdefault(main.lower(), set()).update({name, main.lower()})
    for name in [*V.KEY_MAKERS, *V.PREMIUM_MAKERS]:
        groups.setdefault(V.COMPANY_NAMES.get(name, name).lower(), set()).add(name)
    for main, names in V.MORE_ALIASES.items():
        groups.setdefault(main, set()).update(names)
    plain = lambda n: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in n.lower()).split())
    return {plain(n): main for main, names in groups.items() if len(names) > 1 for n in sorted(names)}


def alias_findings(records: DataFrame) -> DataFrame:
    """(record_id, canonical, variants, finding) of makers named in several ways or only by another name than the main one."""
    named = records.select("record_id", F.explode("companies").alias("c")).withColumn("canonical", F.try_element_at(mapping(alias_groups()), plain_text(F.col("c")))).where("canonical IS NOT NULL")
    per = named.groupBy("record_id", "canonical").agg(F.countDistinct("c").alias("variants"), F.bool_or(F.lower("c") == F.col("canonical")).alias("main"))
    return per.where("variants > 1 OR NOT main").select("record_id", "canonical", "variants", F.when(F.col("variants") > 1, "canonicalization_inconsistent").otherwise("canonicalization_alias_present").alias("finding"))
