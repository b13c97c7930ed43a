"""Rule engine: priority, themes, confidence, validation.  Rules are data, compiled to columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import bind, tells_any, texts, word

from .filters import key_maker, key_supplier


def priority() -> tuple[Column, Column]:
    """(priority, reason): the first rule that holds."""
    footprint = F.size("regions") > 0
    topic = F.coalesce(F.array_contains("topics", "Closure Technology & Innovation"), F.lit(False))
    text = F.concat_ws(" ", "title", F.array_join("evidence", " "), F.array_join("insights", " "), F.array_join("keywords", " "))
    keyword = text.rlike(word(V.CLOSURE_PATTERN))
    supplier, maker = key_supplier(F.col("companies")), key_maker(F.col("companies"))
    own = F.when(F.col("priority") == "High", F.lit(None).cast("string"))
    own = own.when(supplier & footprint, "footprint_and_key_supplier").when(footprint & topic, "footprint_and_closure_topic").when(supplier & topic, "key_supplier_and_closure_topic")

    def by_text(keyword: Column) -> Column:
        """The rules that need the text, which is looked through once and only if none before them holds."""
        found = F.when(footprint & keyword, "footprint_and_closure_keyword").when(supplier & keyword, "key_supplier_and_closure_keyword").when(footprint & maker, "footprint_and_key_oem")
        return found.when(~footprint & ~topic & ~keyword & ~maker & ~supplier, "missing_footprint_region")

    def both(reason: Column) -> Column:
        value = F.when(reason == "missing_footprint_region", "Low").when(reason.isNotNull(), "High").otherwise(F.col("priority"))
        return F.struct(value.alias("value"), reason.alias("reason"))

    told = bind(own.otherwise(bind(keyword, by_text)), both)
    return told["value"], told["reason"]


def theme_text() -> Column:
    return F.lower(F.concat_ws(" ", "title", F.array_join("evidence", " "), F.array_join("insights", " "), F.array_join("keywords", " ")))


def _group(kind: str, values: list[str]) -> Column:
    if kind == "keywords":
        return tells_any(F.col("_text"), values)
    return F.coalesce(F.arrays_overlap("_companies" if kind == "companies" else kind, texts(values)), F.lit(False))


KINDS = ("companies", "keywords", "topics", "regions")


def _strength(k: int, rule: dict) -> Column:
    """0: the theme does not fire."""
    groups, fires = F.col(f"_g{k}"), F.col(f"_g{k}") >= 2
    if "anti" in rule:
        fires &= (groups >= 3) | ~tells_any(F.col("_text"), rule["anti"])
    if rule.get("premium"):
        fires &= _group("companies", V.PREMIUM_MAKERS)
    if "required" in rule:
        fires &= _group("regions", rule["required"])
    strength = F.when(groups >= 4, 3).when(groups == 3, 2).otherwise(1)
    if "cap" in rule:
        strength = F.least(strength, F.lit(rule["cap"]))
    return F.when(fires, strength).otherwise(0)


def themes(records: DataFrame) -> DataFrame:
    """Adds themes, rollups and strength (the greatest).  Text, groups and strengths are each made once, in steps."""
    rows = records.withColumns({"_text": theme_text(), "_companies": F.transform("companies", lambda c: F.lower(c))})
    counted = {f"_g{k}": sum((_group(kind, rule[kind]).cast("int") for kind in KINDS if kind in rule), F.lit(0)) for k, rule in enumerate(V.THEMES.values())}
    rows = rows.withColumns(counted).withColumns({f"_s{k}": _strength(k, rule) for k, rule in enumerate(V.THEMES.values())})
    strengths = {name: F.col(f"_s{k}") for k, name in enumerate(V.THEMES)}
    rows = rows.withColumn("themes", F.filter(F.array(*(F.when(s > 0, F.lit(n)) for n, s in strengths.items())), lambda x: x.isNotNull()))
    own = [F.when(s > 0, F.lit(V.THEMES[n]["rollup"])) for n, s in strengths.items() if "rollup" in V.THEMES[n]]
    built = [F.when(F.size(F.array_except(texts(parts), F.col("themes"))) == 0, F.lit(label)) for label, parts in V.STRUCTURAL_ROLLUPS.items()]
    rollups = F.array_distinct(F.filter(F.array(*own, *built), lambda x: x.isNotNull()))
    steps = ["_text", "_companies", *counted, *(f"_s{k}" for k in range(len(strengths)))]
    return rows.withColumns({"rollups": rollups, "strength": F.greatest(*strengths.values())}).drop(*steps)


def confidence(rule_changes: Column, backfilled: Column) -> tuple[Column, Column]:
    """(score, level) from what can be observed."""
    score = 2 * F.col("publish_date").isNotNull().cast("int") + 2 * (F.col("source_type") != "Other").cast("int") + F.when(F.size("evidence") >= 3, 2).when(F.size("evidence") == 2, 1).otherwise(0) + (F.size("insights") >= 2).cast("int") - F.floor(rule_changes / 3).cast("int") - backfilled.cast("int")
    return score, F.when(score >= 7, "High").when(score >= 4, "Medium").otherwise("Low")


def errors() -> Column:
    """Names of the checks that a draft fails, in order."""
    bad = lambda condition, name: F.when(F.coalesce(condition, F.lit(True)), F.lit(name))
    count = lambda c, a, b: ~F.coalesce(F.size(c), F.lit(-1)).between(a, b)
    status = F.when(F.col("review_status").isin(V.LEGACY_REVIEW_STATES), "Pending").otherwise(F.col("review_status"))
    iso = F.col("publish_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date("publish_date", "yyyy-MM-dd").isNotNull()
    return F.filter(
        F.array(
            bad(~F.col("source_type").isin(V.SOURCE_TYPES), "source_type"),
            bad(~F.col("actor_type").isin(V.ACTOR_TYPES), "actor_type"),
            bad(F.col("publish_date").isNotNull() & (F.col("publish_date") != "") & ~iso, "publish_date"),
            bad(~F.col("publish_date_confidence").isin(V.LEVELS), "publish_date_confidence"),
            bad(~F.col("priority").isin(V.LEVELS), "priority"),
            bad(~F.col("confidence").isin(V.LEVELS), "confidence"),
            bad(~status.isin(V.REVIEW_STATES), "review_status"),
            bad(F.col("topics").isNull(), "topics_list"),
            bad(count("topics", 1, 4), "topics_count"),
            bad(F.size(F.array_except("topics", texts(V.TOPICS))) > 0, "topics_label"),
            bad(count("keywords", 3, 15), "keywords_count"),
            bad(count("evidence", 2, 4), "evidence_count"),
            bad(count("insights", 2, 4), "insights_count"),
            bad(F.col("regions_mentioned").isNull(), "regions_list"),
            bad(F.size("regions_mentioned") != F.size(F.array_distinct("regions_mentioned")), "regions_repeat"),
            bad(F.size("regions_mentioned") > 15, "regions_count"),
            bad(F.size(F.array_except("regions_mentioned", texts(V.REGIONS))) > 0, "regions_label"),
            bad(F.col("regions_relevant").isNull(), "relevant_list"),
            bad(F.size(F.array_except("regions_relevant", texts(V.REGIONS))) > 0, "relevant_label"),
        ),
        lambda x: x.isNotNull(),
    )


REQUIRED = ["title", "source_type", "publish_date", "publish_date_confidence", "original_url", "actor_type", "government_entities", "companies", "mentions_our_company", "topics", "keywords", "countries", "regions_mentioned", "regions_relevant", "priority", "confidence", "evidence", "insights", "review_status", "notes"]


def missing_keys(columns: list[str]) -> list[str]:
    """Required fields that a table of drafts doesn't have; with any of them no other check is made."""
    return [c for c in REQUIRED if c not in columns]
