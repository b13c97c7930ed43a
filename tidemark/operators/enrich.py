"""Post-processing of draft records: dates, publishers, names, regions, priority, themes and confidence, with a log of changes.

A draft is what an extractor gives (operators/records.py has the columns).  Each step makes new columns from those of
the steps before; what a step changes is an entry of `changes` (field, before, after, source, reason), and the number of
entries by reason is the rule impact, which lowers the confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import ISO_DATE, bind, bounded, collapse, distinct_ignoring_case, first_date, is_iso, made_date, mapping, texts

from . import rules as R

EDGE = "(^|[^A-Za-z0-9_])"
END = "($|[^A-Za-z0-9_])"
WS = r"[ \t\r\n\f]"
MONTH_DAY_YEAR = rf"{EDGE}([A-Za-z]{{3,9}}){WS}+([0-9]{{1,2}}),{WS}*([0-9]{{4}})"
CLOCK = "[0-9]{1,2}:[0-9]{2}"
#: What follows the date in a publisher's header, in the order in which it is looked for.
HEADER_ENDINGS = {
    "bloomberg": [rf"{WS}+at{WS}+{CLOCK}{WS}*(AM|PM){WS}*({V.ZONES}){END}", rf"{WS}+at{WS}+{CLOCK}{WS}*(AM|PM){END}", END],
    "reuters": [rf"({WS}+at)?{WS}+{CLOCK}{WS}*(AM|PM)({WS}*({V.ZONES}))?{END}", END],
    "other": [rf"{WS}+at{WS}+{CLOCK}{WS}*(AM|PM)?{END}", END],
}
STAMP_LINE = rf"(?i){EDGE}at{WS}+{CLOCK}{WS}*(AM|PM){WS}*({V.ZONES}){END}"
US_NAMES = r"(?i)(^|[^A-Za-z0-9_])(United States|U\.S\.A\.?|USA)($|[^A-Za-z0-9_])"
US_TOKEN = "(^|[^A-Za-z])US($|[^A-Za-z])"
EUROPE_WORD = r"(^|[^a-z0-9_])(europe|eu)($|[^a-z0-9_])|(^|[^a-z0-9_])e\.u\.[a-z0-9_]"
SUB_EUROPE = r"(^|[^a-z0-9_])(west(ern)?[ \t\r\n\f]*europe|east(ern)?[ \t\r\n\f]*europe|central[ \t\r\n\f]*europe|russia)($|[^a-z0-9_])"
SP_MARKERS = ["s&p global", "autointelligence | headline analysis"]
REUTERS_LINE = rf"(?i)(^|\n){WS}*reuters{END}"
HEADER_LINES, HEADER_CHARS = 60, 5000
ANY_MONTH_DAY_YEAR = rf"{EDGE}([A-Za-z]{{3,9}})\.?{WS}+([0-9]{{1,2}}),{WS}*([0-9]{{4}}){END}"
DAY_MONTH_DOT_YEAR = rf"{EDGE}([0-9]{{1,2}}){WS}+([A-Za-z]{{3,9}})\.?{WS}+([0-9]{{4}}){END}"


def alias_pattern(alias: str) -> str:
    """The alias between word boundaries: behind its last character, if that is no letter, a word has to go on."""
    body = alias.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)")
    return f"(^|[^a-z0-9_]){body}" + ("($|[^a-z0-9_])" if alias[-1].isalnum() else "[a-z0-9_]")


def has_alias(text: Column, alias: str) -> Column:
    """Whether a lower-cased text has alias_pattern(alias): looked up as it stands, then by its first letter and what stands before that."""
    pattern = alias_pattern(alias).removeprefix("(^|[^a-z0-9_])")
    return text.contains(alias) & text.rlike(f"{pattern[0]}(?<![a-z0-9_]{pattern[0]}){pattern[1:]}")


def joined(*columns: str) -> Column:
    """Text and list columns as one text; nulls are left out."""
    lists = ("keywords", "evidence", "insights")
    return F.concat_ws(" ", *(F.array_join(c, " ") if c in lists else F.col(c) for c in columns))


def with_texts(d: DataFrame) -> DataFrame:
    """Adds the three bags of text: all_text (with the source's), field_text (the record's own) and hint_text (lower case)."""
    source = F.when(F.trim("source_text") != "", F.col("source_text"))
    own = joined("title", "notes", "keywords", "evidence", "insights")
    return d.withColumns({"all_text": F.concat_ws(" ", source, own), "field_text": own, "hint_text": F.lower(own)})


def plain_ends(text: Column) -> Column:
    """Lines end with a line feed; a text without a carriage return is left as it is."""
    return bind(text, lambda t: F.when(t.contains("\r"), F.regexp_replace(t, r"\r\n?", "\n")).otherwise(t))


def lines(text: Column) -> Column:
    return F.split(plain_ends(text), "\n")


def head_lines(text: Column) -> Column:
    """The header's lines as one text; what follows them is not split."""
    return F.substring_index(plain_ends(text), "\n", HEADER_LINES)


def header_zone(text: Column) -> Column:
    return F.substring(head_lines(text), 1, HEADER_CHARS)


def event_zone(text: Column) -> Column:
    """What follows the header, or all if nothing does, without lines that bear a time stamp."""
    def body(all_lines: Column) -> Column:
        rest = F.when(F.size(all_lines) > HEADER_LINES, F.slice(all_lines, HEADER_LINES + 1, 1 << 30)).otherwise(all_lines)
        # a time has a colon: few lines go to the pattern
        return F.array_join(F.filter(rest, lambda x: ~(x.contains(":") & x.rlike(STAMP_LINE))), "\n")

    return bind(lines(text), body)


def header_date(zone: Column, kind: str) -> Column:
    """The date of a header; only the first place of each pattern is tried."""

    def found(text: Column, pattern: str) -> Column:
        return bind(F.regexp_extract(text, pattern, 0), lambda m: made_date(*(F.regexp_extract(m, pattern, k) for k in (4, 2, 3))))

    # each form's digits and ending first: a search by digits passes over letters at once
    forms = [(rf"(?i)[0-9],{WS}*[0-9]{{4}}{e}", "(?i)" + MONTH_DAY_YEAR + e) for e in HEADER_ENDINGS[kind]]
    return bind(zone, lambda z: F.when(z.rlike("[0-9]{4}"), F.coalesce(*(F.when(z.rlike(needs), found(z, p)) for needs, p in forms))))


def dates(d: DataFrame) -> DataFrame:
    """Steps 2 and 4 to 8, and 21: publish date, its confidence and event date, and where they come from."""
    raw = F.col("source_type")
    alias = F.try_element_at(mapping(V.SOURCE_ALIASES), F.lower(F.trim(raw)))
    d = d.withColumn("source_1", F.when(alias.isNotNull() & (alias != raw), alias).otherwise(raw))
    d = d.withColumns({"date_0": F.nullif("publish_date", F.lit("")), "zone": header_zone(F.col("all_text")), "conf_0": F.coalesce("publish_date_confidence", F.lit(""))})
    found = F.lit(None).cast("date")
    for publisher in V.HEADER_RULES:
        found = F.when(F.col("source_1") == publisher, header_date(F.col("zone"), publisher.lower() if publisher in ("Bloomberg", "Reuters") else "other")).otherwise(found)
    d = d.withColumns({"header": found.cast("string"), "iso_0": F.coalesce(is_iso(F.col("date_0")), F.lit(False))})
    d = d.withColumn("use_header", F.coalesce(F.col("header").isNotNull() & ~F.col("header").eqNullSafe(F.col("date_0")) & (~F.col("iso_0") | F.col("conf_0").isin("Low", "")), F.lit(False)))
    tag = F.concat(F.lit("rule:"), F.try_element_at(mapping(V.HEADER_RULES), F.col("source_1")), F.lit("_header_publish_date"))
    d = d.withColumns({"date_1": F.when(F.col("use_header"), F.col("header")).otherwise(F.col("date_0")), "conf_1": F.when(F.col("use_header"), "High").otherwise(F.col("publish_date_confidence")), "from_1": F.when(F.col("use_header"), tag)})
    by = F.coalesce("hint_source", F.lit("pdf_publish_date_hint"))
    d = d.withColumn("use_hint", F.coalesce(is_iso(F.col("hint")), F.lit(False)) & ~F.col("hint").eqNullSafe(F.col("date_1")))
    d = d.withColumns({
        "date_2": F.when(F.col("use_hint"), F.col("hint")).otherwise(F.col("date_1")),
        "conf_2": F.when(F.col("use_hint"), F.when(by == "pdf_header_publish_date", "High").otherwise("Medium")).otherwise(F.col("conf_1")),
        "from_2": F.when(F.col("use_hint"), F.concat(F.lit("rule:"), by)).otherwise(F.col("from_1")),
        "event_2": F.when(F.col("use_hint") & F.coalesce(is_iso(F.col("date_1")), F.lit(False)), F.col("date_1")),
        "in_text": first_date(F.col("all_text")).cast("string"),
    })
    d = d.withColumn("backfill", F.col("in_text").isNotNull() & F.col("date_2").isNull())
    event = F.when(F.col("in_text").isNotNull() & ~F.col("backfill"), first_date(event_zone(F.col("all_text"))).cast("string"))
    d = d.withColumn("event_found", event)
    d = d.withColumns({
        "date_3": F.when(F.col("backfill"), F.col("in_text")).otherwise(F.col("date_2")),
        "conf_3": F.when(F.col("backfill"), "High").otherwise(F.col("conf_2")),
        "from_3": F.when(F.col("backfill"), "rule:regex_publish_date").otherwise(F.col("from_2")),
        "use_event": F.coalesce(F.col("event_found") != F.col("date_2"), F.lit(False)),
    })
    allowed = F.coalesce(F.col("from_3").endswith("_header_publish_date") | (F.col("from_3") == "rule:pdf_metadata_publish_date"), F.lit(False))
    d = d.withColumn("restore", F.col("iso_0") & ~F.col("date_0").eqNullSafe(F.col("date_3")) & ~allowed)
    return d.withColumns({
        "date_final": F.when(F.col("restore"), F.col("date_0")).otherwise(F.col("date_3")),
        "event_date": F.when(F.col("use_event"), F.col("event_found")).otherwise(F.col("event_2")),
        "date_overridden": F.col("iso_0") & (F.col("use_header") | (F.col("use_hint") & F.col("event_2").isNotNull())),
    })


def publisher(text: Column) -> Column:
    """The publisher that a text's markers tell."""

    def told(low: Column) -> Column:
        sp = F.lit(False)
        for m in SP_MARKERS:
            sp = sp | low.contains(m)
        reuters = low.contains("reuters") & text.rlike(REUTERS_LINE)
        return F.when(sp, "S&P").when(low.contains("marklines"), "MarkLines").when(low.contains("automotive news"), "Automotive News").when(reuters, "Reuters")

    return bind(F.lower(text), told)


def known_companies() -> dict[str, str]:
    """Canonical name by lower-cased name without punctuation and legal suffixes, for known makers."""
    return {n: V.COMPANY_NAMES.get(n, n.title()) for n in dict.fromkeys([*V.PREMIUM_MAKERS, *V.KEY_MAKERS])}


def canonical_company(c: Column) -> Column:
    """By table, else a known maker without legal suffixes, else the name as it stands."""
    name = collapse(c)
    suffixes = "|".join(sorted({s.rstrip(".") for s in V.LEGAL_SUFFIXES}, key=lambda s: (-len(s), s)))
    base = F.regexp_replace(F.regexp_replace(F.lower(name), "[.,]", ""), f"( ({suffixes}))+$", "")
    return F.coalesce(F.try_element_at(mapping(V.COMPANY_NAMES), F.lower(name)), F.try_element_at(mapping(known_companies()), base), name)


def by_table(c: Column, table: dict[str, str]) -> Column:
    """Each element collapsed and renamed by its lower-cased self; firsts of what agrees but for case."""
    return distinct_ignoring_case(F.transform(c, lambda x: F.coalesce(F.try_element_at(mapping(table), F.lower(collapse(x))), collapse(x))))


def no_list(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def names(d: DataFrame, own_names: list[str]) -> DataFrame:
    """Steps 3, 5, 9 to 11, 17 and 18: URL, own company, source, actor, countries, government entities, companies."""
    url = collapse(F.col("original_url"))
    bag = F.lower(F.concat_ws(" ", F.when(F.trim("source_text") != "", F.col("source_text")), F.when(F.trim("title") != "", F.col("title")), *(F.array_join(F.filter(c, lambda x: F.trim(x) != ""), " ") for c in ("evidence", "insights", "keywords"))))

    def names_own(text: Column) -> Column:
        out = F.lit(False)
        for n in own_names:
            out = out | has_alias(text, n.lower())
        return out

    actor = F.lower(F.trim("actor_type"))
    actor = F.coalesce(F.try_element_at(mapping(V.ACTOR_ALIASES), actor), actor)
    d = d.withColumns({
        "url_final": F.when(url.rlike(r"^https?://[^ ]+$"), url),
        "mentions_final": bind(bag, names_own),
        "source_final": F.coalesce(publisher(F.col("all_text")), F.col("source_1")),
        "actor_final": F.when(F.coalesce(actor, F.lit("")) == "", F.col("actor_type")).when(actor.isin(V.ACTOR_TYPES), actor).otherwise("other"),
        "countries_final": by_table(no_list("countries"), V.COUNTRY_ALIASES),
        "companies_final": distinct_ignoring_case(F.transform(no_list("companies"), canonical_company)),
    })
    there = F.transform("countries_final", lambda c: F.lower(c))
    is_country = lambda e: F.array_contains(there, F.lower(collapse(e))) | F.coalesce(F.array_contains(there, F.lower(F.try_element_at(mapping(V.COUNTRY_ALIASES), F.lower(collapse(e))))), F.lit(False))
    return d.withColumn("entities_final", by_table(F.filter(no_list("government_entities"), lambda e: ~is_country(e)), V.REGULATOR_ALIASES))


def region_hints(text: Column) -> Column:
    """Regions that a lower-cased text tells: by alias as a word, by name anywhere, by city."""
    found = [F.when(has_alias(text, a), F.lit(r)) for a, r in V.REGION_ALIASES.items()]
    found += [F.when(text.contains(r.lower()), F.lit(r)) for r in V.REGIONS] + [F.when(text.contains(c), F.lit(r)) for c, r in V.CITY_REGIONS.items()]
    return F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))


def generic_europe(text: Column) -> Column:
    # what each alternative of a pattern has is looked up before the pattern
    word = (text.contains("eu") | text.contains("e.u.")) & text.rlike(EUROPE_WORD)
    return word & ~((text.contains("europe") | text.contains("russia")) & text.rlike(SUB_EUROPE))


def append_once(log: Column, entry: Column) -> Column:
    """The log with the entry, if that is neither null nor there."""
    return F.when(entry.isNull(), log).otherwise(F.array_union(log, F.array(entry)))


def regions(d: DataFrame) -> DataFrame:
    """Steps 12 to 16: regions mentioned and implied, with what was migrated, defaulted and taken out."""
    known = lambda c: F.filter(c, lambda r: r.isin(V.REGIONS))
    old = lambda c: F.exists(no_list(c), lambda r: F.lower(collapse(r)) == "europe (including russia)")
    d = d.withColumns({"mentioned_0": known(by_table(no_list("regions_mentioned"), V.REGION_ALIASES)), "relevant_0": known(by_table(no_list("regions_relevant"), V.REGION_ALIASES)), "migrated": old("regions_mentioned") | old("regions_relevant")})
    derived = F.filter(F.transform("countries_final", lambda c: F.try_element_at(mapping(V.COUNTRY_REGIONS), c)), lambda r: r.isNotNull())
    d = d.withColumns({"implied": F.array_distinct(F.concat(derived, F.col("relevant_0"))), "hinted": region_hints(F.col("hint_text")), "defaulted": (F.size("countries_final") == 0) & generic_europe(F.col("hint_text"))})
    d = d.withColumn("merged", F.array_distinct(F.concat("mentioned_0", "implied", "hinted", F.when(F.col("defaulted"), texts(["Europe"])).otherwise(no_list("regions_none")))))
    low = F.transform("countries_final", lambda c: F.lower(c))
    hint, own = F.col("hint_text"), F.col("field_text")
    named = (hint.contains("united states") | hint.contains("u.s.a") | hint.contains("usa")) & own.rlike(US_NAMES)
    us = F.arrays_overlap(low, texts(["united states", "canada"])) | named | (own.contains("US") & own.rlike(US_TOKEN))
    d = d.withColumns({"no_us": F.array_contains("merged", "United States") & ~us, "no_china": F.array_contains("merged", "China") & ~F.array_contains("implied", "China")})
    shown = F.filter("merged", lambda r: ~((r == "United States") & F.col("no_us")) & ~((r == "China") & F.col("no_china")))
    d = d.withColumn("shown", shown)
    flags = F.array().cast("array<string>")
    for condition, name in ((F.col("no_us"), "us_region_removed_no_us_evidence"), (F.col("no_china"), "china_region_removed_no_china_country_mention"), (F.size("shown") > 15, "regions_mentioned_truncated_to_15"), ((F.size("implied") == 0) & (F.size("shown") == 0), "empty_region_signal")):
        flags = append_once(flags, F.when(condition, F.lit(name)))
    return d.withColumns({"regions_final": F.slice("shown", 1, 15), "region_flags": flags})


def _change(field: str, before: Column, after: Column, source: Column, reason: Column, when: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.when(when & ~before.eqNullSafe(after), F.struct(F.lit(field).alias("field"), text(before).alias("before"), text(after).alias("after"), source.alias("source"), reason.alias("reason")))


def _listed(c: str) -> Column:
    return F.to_json(F.col(c))


def rule_impact(changes: Column) -> Column:
    """Number of changes by reason."""
    count = lambda reasons: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(reasons)), lambda r: F.struct(r, F.size(F.filter(reasons, lambda x: x == r)))))
    return bind(F.transform(changes, lambda x: x["reason"]), count)


def postprocess(drafts: DataFrame, own_names: list[str]) -> DataFrame:
    """All steps.  Columns: those of the drafts, with final values, and event_date, date_overridden, migrated, defaulted, region_flags,
    themes, rollups, strength, priority_llm, priority_reason, changes, impact, confidence_score."""
    d = drafts.withColumn("regions_none", F.array().cast("array<string>"))
    d = regions(names(dates(with_texts(d)), own_names))
    boosted, why = R.priority()
    work = d.withColumns({"priority_llm": F.coalesce("priority", F.lit("Medium")), "_companies_in": F.col("companies"), "companies": F.col("companies_final"), "regions": F.col("implied")}).withColumn("priority", F.col("priority_llm"))
    work = work.withColumns({"boosted": boosted, "boost_reason": why})
    work = R.themes(work.withColumn("regions", F.array_union("implied", "regions_final")))
    first = F.try_element_at(F.filter("themes", lambda t: t.isin(V.ESCALATION_THEMES)), F.lit(1))
    work = work.withColumn("theme_reason", F.when((F.col("boosted") != "High") & (F.size("implied") > 0) & first.isNotNull(), F.concat(F.lit("footprint_and_macro_theme:"), first)))
    work = work.withColumn("priority_final", F.when(F.col("theme_reason").isNotNull(), "High").otherwise(F.col("boosted")))
    work = work.withColumn("priority_reason", F.when(F.col("priority_final") != F.col("priority_llm"), F.coalesce("theme_reason", F.when(F.col("boosted") != F.col("priority_llm"), F.col("boost_reason")), F.lit("rule_adjustment"))))
    post, yes = F.lit("postprocess"), F.lit(True)
    c, s = F.col, F.lit
    own = F.when(c("mentions_final"), "company_alias_detected").otherwise("company_alias_not_found")
    log = [
        _change("publish_date", c("publish_date"), c("date_0"), post, s("empty_publish_date_to_null"), c("publish_date") == ""),
        _change("original_url", c("original_url"), c("url_final"), post, s("url_normalization"), c("original_url").isNotNull()),
        _change("source_type", c("source_type"), c("source_1"), post, s("source_type_alias_normalization"), yes),
        _change("mentions_our_company", c("mentions_our_company"), c("mentions_final"), post, own, yes),
        _change("publish_date", c("date_0"), c("date_1"), c("from_1"), s("publisher_header_timestamp_preferred"), c("use_header")),
        _change("publish_date_confidence", c("publish_date_confidence"), c("conf_1"), c("from_1"), s("publisher_header_timestamp_preferred"), c("use_header")),
        _change("publish_date", c("date_1"), c("date_2"), c("from_2"), s("pdf_publish_date_hint_preferred"), c("use_hint")),
        _change("publish_date_confidence", c("conf_1"), c("conf_2"), c("from_2"), s("pdf_publish_date_hint_preferred"), c("use_hint")),
        _change("event_date", F.lit(None).cast("string"), c("event_2"), c("from_2"), s("prior_publish_date_reclassified_as_event_date"), yes),
        _change("publish_date", c("date_2"), c("date_3"), c("from_3"), s("publish_date_missing_backfill"), c("backfill")),
        _change("publish_date_confidence", c("conf_2"), c("conf_3"), c("from_3"), s("publish_date_missing_backfill"), c("backfill")),
        _change("event_date", c("event_2"), c("event_found"), post, s("regex_detected_event_date"), c("use_event")),
        _change("source_type", c("source_1"), c("source_final"), post, s("publisher_marker_inference"), yes),
        _change("actor_type", c("actor_type"), c("actor_final"), post, s("actor_type_normalization"), yes),
        _change("countries", _listed("countries"), _listed("countries_final"), post, s("country_canonicalization_dedupe"), yes),
        _change("regions_mentioned", _listed("regions_mentioned"), _listed("regions_final"), post, s("regions_bucketed_deduped"), yes),
        _change("regions_relevant", _listed("regions_relevant"), _listed("implied"), post, s("derived_from_country_mentions"), yes),
        _change("government_entities", _listed("government_entities"), _listed("entities_final"), post, s("government_entity_cleanup"), yes),
        _change("companies", _listed("_companies_in"), _listed("companies_final"), post, s("company_canonicalization_dedupe"), yes),
        _change("priority", c("priority_llm"), c("boosted"), post, c("boost_reason"), yes),
        _change("priority", c("boosted"), c("priority_final"), post, c("theme_reason"), yes),
        _change("priority_final", F.lit(None).cast("string"), c("priority_final"), post, s("final_priority_after_rules"), yes),
        _change("priority_reason", F.lit(None).cast("string"), c("priority_reason"), post, s("priority_changed_by_rules"), yes),
        _change("publish_date", c("date_3"), c("date_final"), post, s("preserve_existing_valid_publish_date"), c("restore")),
    ]
    work = work.withColumn("changes", F.filter(F.array(*log), lambda x: x.isNotNull()))
    size = lambda name: F.coalesce(F.size(name), F.lit(0))
    signals = F.create_map(
        s("publish_date_present"), F.when(c("date_final").isNotNull(), 2).otherwise(0),
        s("source_type_known"), F.when(c("source_final") != "Other", 2).otherwise(0),
        s("evidence_bullets"), F.when(size("evidence") >= 3, 2).when(size("evidence") >= 2, 1).otherwise(0),
        s("key_insights"), F.when(size("insights") >= 2, 1).otherwise(0),
        s("rule_corrections"), (-F.floor(F.size("changes") / 3)).cast("int"),
        s("date_backfilled"), F.when((c("from_3") == "rule:regex_publish_date") & ~c("restore"), -1).otherwise(0),
    )
    work = work.withColumn("signals", signals)
    work = work.withColumn("confidence_score", F.aggregate(F.map_values("signals"), F.lit(0), lambda a, x: a + x))
    level = F.when(c("confidence_score") >= 7, "High").when(c("confidence_score") >= 4, "Medium").otherwise("Low")
    final = {
        "publish_date": c("date_final"), "publish_date_confidence": c("conf_3"), "original_url": c("url_final"), "source_type": c("source_final"), "actor_type": c("actor_final"),
        "mentions_our_company": c("mentions_final"), "countries": c("countries_final"), "regions_mentioned": c("regions_final"), "regions_relevant": c("implied"),
        "government_entities": c("entities_final"), "companies": c("companies_final"), "priority": c("priority_final"), "confidence_llm": c("confidence"), "confidence": level,
    }
    keep = [x for x in drafts.columns if x not in final]
    return work.select(*keep, *(v.alias(k) for k, v in final.items()), "event_date", "date_overridden", "migrated", "defaulted", "region_flags", "themes", "rollups", "strength", "priority_llm", "priority_final", "priority_reason", "changes", rule_impact(c("changes")).alias("impact"), "signals", "confidence_score")


def impact_summary(processed: DataFrame, most: int = 10, first: str | None = None, last: str | None = None) -> DataFrame:
    """(kind, name, n, total): the commonest rules and changed fields of records created in the days given, with the total of each kind."""
    rows = processed
    if first and last:
        rows = rows.where(F.col("created_at").cast("date").between(first, last))
    # explode_outer: a filter on the whole log's expression, pushed down through every step, would be planned for ever
    entry = rows.select(F.explode_outer("changes").alias("x")).where("x IS NOT NULL")
    named = entry.select(F.explode(F.array(F.struct(F.lit("rule").alias("kind"), F.col("x.reason").alias("name")), F.struct(F.lit("field").alias("kind"), F.col("x.field").alias("name")))).alias("e")).select("e.*")
    counts = named.groupBy("kind", "name").agg(F.count(F.lit(1)).alias("n"))  # a row for each rule and field
    total = counts.groupBy("kind").agg(F.sum("n").alias("total"))
    kinds = [counts.where(F.col("kind") == k).orderBy(F.desc("n"), "name").limit(most) for k in ("rule", "field")]
    return kinds[0].unionByName(kinds[1]).join(F.broadcast(total), "kind")


def diagnostics(processed: DataFrame, most: int = 8) -> DataFrame:
    """record_id, sentence on the priority, and the confidence's drivers by absolute value (ties by name), none that is 0."""
    reason = F.replace("priority_reason", F.lit("_"), F.lit(" "))
    sentence = F.when(F.col("priority_final") == F.col("priority_llm"), F.concat(F.lit("Priority "), "priority_final", F.lit(" as extracted."))).otherwise(F.concat(F.lit("Priority "), "priority_llm", F.lit(" changed to "), "priority_final", F.lit(": "), reason, F.lit(".")))
    entries = F.filter(F.map_entries("signals"), lambda e: e["value"] != 0)
    ordered = F.slice(F.array_sort(F.transform(entries, lambda e: F.struct((-F.abs(e["value"])).alias("a"), e["key"].alias("k"), e["value"].alias("v")))), 1, most)
    drivers = F.array_join(F.transform(ordered, lambda e: F.concat(e["k"], F.when(e["v"] > 0, " +").otherwise(" "), e["v"].cast("string"))), "; ")
    return processed.select("record_id", sentence.alias("sentence"), drivers.alias("drivers"), "confidence_score")


def line_date(line: Column) -> Column:
    """The date of a header's line: ISO, else month-day-year, else day-month-year; the last of a year is a fiscal date and doesn't count."""
    year_end = lambda d: F.when(~((F.month(d) == 12) & (F.day(d) == 31)), d)

    def counted(d: Column) -> Column:
        return bind(d, year_end)

    def found(x: Column, pattern: str, year: int, month: int, day: int) -> Column:
        # the parts come from what is found
        return bind(F.regexp_extract(x, pattern, 0), lambda m: F.when(m != "", counted(made_date(*(F.regexp_extract(m, pattern, k) for k in (year, month, day))))))

    iso = lambda x: counted(F.try_to_date(F.nullif(F.regexp_extract(x, ISO_DATE, 2), F.lit("")), "yyyy-MM-dd"))
    forms = lambda x: F.coalesce(iso(x), found(x, ANY_MONTH_DAY_YEAR, 4, 2, 3), found(x, DAY_MONTH_DOT_YEAR, 4, 3, 2))
    return bind(line, lambda x: F.when(x.rlike("[0-9]{4}"), forms(x)))


def date_hint(text: Column, given: Column, metadata: Column) -> Column:
    """(hint, hint_source): the first dated line of the header, else the date given, else that of the file's metadata."""
    dated = F.filter(F.transform(F.split(head_lines(text), "\n"), line_date), lambda d: d.isNotNull())

    def of(value: Column) -> Column:
        compact = F.regexp_extract(value, "D:([0-9]{4})([0-9]{2})([0-9]{2})", 0)
        return F.coalesce(F.try_to_date(F.nullif(F.regexp_replace(compact, "D:", ""), F.lit("")), "yyyyMMdd"), F.try_to_date(F.nullif(F.regexp_extract(value, ISO_DATE, 2), F.lit("")), "yyyy-MM-dd")).cast("string")

    def named(header: Column) -> Column:
        say = lambda found: F.struct(found.alias("hint"), F.when(header.isNotNull(), "pdf_header_publish_date").when(found.isNotNull(), "pdf_metadata_publish_date").alias("hint_source"))
        return bind(F.coalesce(header, of(given), of(metadata)), say)

    return bind(F.try_element_at(dated, F.lit(1)).cast("string"), named)


def fragments(title: str = "title") -> Column:
    """Lower-cased texts of a record with the place that each has: a field alone, or field[n] where it has several."""
    one = F.array(F.struct(F.lit("title").alias("field"), F.lit("title").alias("place"), F.lower(title).alias("text")))

    def many(name: str, label: str) -> Column:
        return F.transform(F.coalesce(name, F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(label).alias("field"), F.when(F.size(name) > 1, F.concat(F.lit(f"{label}["), i.cast("string"), F.lit("]"))).otherwise(label).alias("place"), F.lower(x).alias("text")))

    return F.concat(F.when(F.trim(title) != "", one).otherwise(F.slice(one, 1, 0)), many("evidence", "evidence_bullets"), many("insights", "key_insights"), many("keywords", "keywords"))


def _first_places(pattern: str) -> Column:
    """(term, place) of each field's first fragment that holds the pattern."""
    found = F.filter("fragments", lambda f: f["text"].rlike(bounded(pattern)))
    fields = F.transform(found, lambda f: f["field"])
    firsts = F.filter(found, lambda f, i: F.array_position(fields, f["field"]) == i + 1)
    return F.transform(firsts, lambda f: F.struct(F.lit(pattern).alias("term"), f["place"].alias("place")))


def hits(patterns: list[str]) -> Column:
    """(term, place) of all patterns, in their order."""
    return F.concat(*map(_first_places, patterns))


def theme_details(records: DataFrame) -> DataFrame:
    """A row for each record and theme of which a group is met: groups, terms and places of keywords, terms against it, and what holds it back."""
    rows = records.withColumns({"fragments": fragments(), "_companies": F.transform("companies", lambda c: F.lower(c))})
    told = []
    for name, rule in V.THEMES.items():
        keys, anti = hits(rule["keywords"]), hits(rule["anti"]) if "anti" in rule else F.array().cast("array<struct<term:string,place:string>>")
        meets = lambda kind, values: F.coalesce(F.arrays_overlap("_companies" if kind == "companies" else kind, texts(values)), F.lit(False))
        groups = [F.when(F.size(keys) > 0 if kind == "keywords" else meets(kind, rule[kind]), F.lit(kind)) for kind in R.KINDS if kind in rule]
        told.append(F.struct(F.lit(name).alias("theme"), F.filter(F.array(*groups), lambda x: x.isNotNull()).alias("groups"), keys.alias("keys"), anti.alias("anti"), (F.lit(True) if not rule.get("premium") else meets("companies", V.PREMIUM_MAKERS)).alias("premium"), (F.lit(True) if "required" not in rule else meets("regions", rule["required"])).alias("region"), F.lit("anti" in rule).alias("can_be_held")))
    d = rows.select("record_id", F.explode(F.array(*told)).alias("t")).select("record_id", "t.*").where(F.size("groups") > 0)
    n = F.size("groups")
    against = F.when((n >= 2) & F.col("can_be_held"), F.array_distinct(F.transform("anti", lambda x: x["term"]))).otherwise(F.array().cast("array<string>"))
    held = F.when((n >= 2) & (n < 3) & (F.size(against) > 0), "anti_keyword").when(~F.col("premium"), "premium_gate").when(~F.col("region"), "region_requirement")
    distinct = lambda c: F.array_distinct(F.transform("keys", lambda x: x[c]))
    return d.select("record_id", "theme", "groups", distinct("term").alias("terms"), distinct("place").alias("places"), against.alias("anti_terms"), held.alias("held_by"), (held.isNull() & (n >= 2)).alias("fired"))
