"""Hand-written cases for rules that the dealt records meet by chance only."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import vocab as V
from tidemark.operators import analytics as A
from tidemark.operators import filters as P
from tidemark.operators import quality as Q
from tidemark.operators import rules as R
from tidemark.plans.catalog import story_records

SCHEMA = "record_id string, title string, source_type string, publish_date date, priority string, confidence string, review_status string, topics array<string>, regions array<string>, companies array<string>, keywords array<string>, countries array<string>, evidence array<string>, insights array<string>, url string, text string"


def record(spark, **over):
    base = dict(record_id="r1", title="A quiet day", source_type="Reuters", publish_date=None, priority="Medium", confidence="Medium", review_status="Pending", topics=[V.TOPICS[0]], regions=[], companies=[], keywords=[], countries=[], evidence=["one two"], insights=["x", "y"], url=None, text="one two " * 30)
    return spark.createDataFrame([Row(**{k: (base | over)[k] for k in base})], SCHEMA)


@pytest.mark.parametrize(
    ("over", "value", "reason"),
    [
        ({"priority": "High"}, "High", None),
        ({"companies": ["Magna International"], "regions": ["Germany"]}, "High", "footprint_and_key_supplier"),
        ({"topics": [V.TOPICS[1]], "regions": ["Germany"]}, "High", "footprint_and_closure_topic"),
        ({"topics": [V.TOPICS[1]], "companies": ["BROSE se"]}, "High", "key_supplier_and_closure_topic"),
        ({"regions": ["China"], "evidence": ["a new door  handle"]}, "High", "footprint_and_closure_keyword"),
        ({"companies": ["hi-lex"], "insights": ["the striker", "b"]}, "High", "key_supplier_and_closure_keyword"),
        ({"companies": ["BMW"], "regions": ["China"]}, "High", "footprint_and_key_oem"),
        ({}, "Low", "missing_footprint_region"),
        ({"companies": ["BMW"]}, "Medium", None),
        ({"evidence": ["unhandled case"]}, "Low", "missing_footprint_region"),
    ],
)
def test_priority(spark, over, value, reason):
    v, why = R.priority()
    assert tuple(record(spark, **over).select(v.alias("v"), why.alias("w")).first()) == (value, reason)


@pytest.mark.parametrize(
    ("over", "themes", "strength"),
    [
        ({"companies": ["BMW"], "keywords": ["margin"]}, ["Luxury OEM Stress", "Margin Compression at Premium OEMs"], 1),
        ({"companies": ["BMW"], "keywords": ["margin", "record profit"]}, [], 0),
        ({"companies": ["byd"], "keywords": ["price war"], "regions": ["China"]}, ["China EV Competitive Acceleration"], 2),
        ({"companies": ["byd"], "keywords": ["price war"]}, [], 0),
        ({"keywords": ["tariff"], "regions": ["Mexico"]}, [], 0),
        ({"keywords": ["tariff"], "regions": ["Mexico", "Russia"]}, ["Tariff & Trade Disruption"], 1),
        ({"keywords": ["ev adoption"], "topics": [V.TOPICS[0]]}, ["EV Transition Slowdown"], 1),
        ({"companies": ["google"], "keywords": ["ota"], "topics": [V.TOPICS[1]]}, ["Software-Defined Premium Shift"], 2),
    ],
)
def test_themes(spark, over, themes, strength):
    row = R.themes(record(spark, **over)).first()
    assert (row.themes, row.strength) == (themes, strength)


def test_rollup_of_two_themes(spark):
    row = R.themes(record(spark, companies=["byd", "google"], keywords=["price war", "ota"], regions=["China"])).first()
    assert row.rollups == ["China Tech-Driven Premium Disruption"]


def test_confidence_levels(spark):
    score, level = R.confidence(F.lit(0), F.lit(False))
    r = record(spark, publish_date=__import__("datetime").date(2024, 1, 1), evidence=["a", "b", "c"])
    assert tuple(r.select(score.alias("s"), level.alias("l")).first()) == (7, "High")
    score, level = R.confidence(F.lit(3), F.lit(True))
    assert tuple(r.select(score.alias("s"), level.alias("l")).first()) == (5, "Medium")


def test_every_finding_and_class_occurs(spark, sf_dir):
    r = Q.reviewed(story_records(spark, sf_dir)).cache()
    kinds = {x.finding for x in Q.findings(r).select("finding").distinct().collect()}
    assert {"duplicate_record_in_brief", "missing_evidence", "evidence_check_skipped", "missing_footprint_region", "canonicalization_alias_present", "confidence_evidence_mismatch", "confidence_source_mismatch", "missing_priority_reason", "invalid_display_region", "macro_theme_min_groups_violation", "macro_theme_premium_gate_violation", "macro_theme_region_requirement_violation"} <= kinds
    assert "geo_leakage" not in kinds
    assert Q.record_scores(r).count() == r.count(), "records without findings have a score, too"


STORED = dict(priority_llm="Medium", priority_reason="because", regions_mentioned=[], themes=[], theme_groups={})


@pytest.mark.parametrize(
    ("over", "found"),
    [
        ({}, []),
        ({"companies": ["Acme", "acme!"]}, [("Medium", "duplicate_values")]),
        ({"companies": ["Acme", "acme!"], "countries": ["Utopia", "UTOPIA "], "regions": ["China", "china"]}, [("High", "geo_leakage"), *[("Medium", "duplicate_values")] * 3]),
        ({"regions": ["Atlantis"]}, [("High", "geo_leakage")]),
        ({"regions_mentioned": ["Atlantis", "China"]}, [("High", "invalid_display_region")]),
        ({"countries": ["Germany"]}, [("Medium", "missing_footprint_region")]),
        ({"countries": ["Germany"], "regions": ["West Europe"]}, []),
        ({"companies": ["GM", "General Motors"]}, [("Medium", "canonicalization_inconsistent")]),
        ({"companies": ["GM"]}, [("Low", "canonicalization_alias_present")]),
        ({"evidence": []}, [("High", "missing_evidence")]),
        ({"text": "short"}, [("Medium", "evidence_check_skipped")]),
        ({"evidence": ["nothing like that stands there"]}, [("High", "evidence_not_grounded")]),
        ({"themes": ["EV Transition Slowdown"], "theme_groups": {"EV Transition Slowdown": 1}}, [("High", "macro_theme_min_groups_violation")]),
        ({"themes": ["Luxury OEM Stress"], "theme_groups": {"Luxury OEM Stress": 2}}, [("High", "macro_theme_premium_gate_violation")]),
        ({"themes": ["Luxury OEM Stress"], "theme_groups": {"Luxury OEM Stress": 2}, "companies": ["BMW"]}, []),
        ({"themes": ["Tariff & Trade Disruption"], "theme_groups": {"Tariff & Trade Disruption": 3}}, [("High", "macro_theme_region_requirement_violation")]),
        ({"themes": ["Tariff & Trade Disruption"], "theme_groups": {"Tariff & Trade Disruption": 3}, "regions_mentioned": ["Russia"]}, []),
        ({"themes": ["EV Transition Slowdown"], "theme_groups": None}, [("High", "macro_theme_min_groups_violation")]),
        ({"confidence": "High"}, [("Medium", "confidence_evidence_mismatch")]),
        ({"confidence": "High", "evidence": ["one two", "two one"], "source_type": "Other"}, [("Low", "confidence_source_mismatch")]),
        ({"priority": "Low", "priority_reason": " "}, [("Medium", "missing_priority_reason")]),
        ({"priority": "High", "priority_reason": None}, [("Low", "missing_priority_reason"), ("Medium", "missing_priority_reason")]),
        ({"priority": "High", "priority_llm": None, "priority_reason": None}, [("Low", "missing_priority_reason")]),
    ],
)
def test_each_finding_by_hand(spark, over, found):
    own = {k: v for k, v in over.items() if k not in STORED}
    row = Row(**(STORED | {k: v for k, v in over.items() if k in STORED}))
    kept = spark.createDataFrame([row], "priority_llm string, priority_reason string, regions_mentioned array<string>, themes array<string>, theme_groups map<string,int>")
    rows = record(spark, **own).crossJoin(kept)
    assert sorted((x.severity, x.finding) for x in Q.findings(rows).collect()) == sorted(found)
    h, m, low = (sum(s == level for s, _ in found) for level in ("High", "Medium", "Low"))
    assert Q.record_scores(rows).first().score == max(0, 100 - 25 * h - 10 * m - 2 * low)


def test_similar_titles_of_other_stories(spark, sf_dir):
    from difflib import SequenceMatcher

    from tidemark.operators.dedupe import dedupe_key

    r = story_records(spark, sf_dir)
    rows = r.select("record_id", C.title_fingerprint("title", V.TITLE_STOPWORDS).alias("fp"), dedupe_key().alias("key")).orderBy("record_id").collect()
    # the pair of fingerprints has the ratio in the order of their first records
    first = {}
    for x in rows:
        first.setdefault(x.fp, x)
    want = set()
    for x in rows:
        for e in first.values():
            a, b = sorted((first[x.fp], e), key=lambda y: y.record_id)
            if x.fp and e.fp and e.record_id < x.record_id and e.key != x.key and SequenceMatcher(None, a.fp, b.fp).ratio() >= 0.85:
                want.add((x.record_id, e.record_id))
    assert {(x.record_id, x.similar_to) for x in Q.near_title_findings(r).collect()} == want and want


def test_grounding(spark):
    g = lambda b, s: spark.range(1).select(Q.grounded(F.lit(b), F.lit(s))).first()[0]
    assert g("Alpha, beta!", "so alpha beta it is")
    assert g("alpha gamma delta omega zeta", "zeta then delta then alpha")  # 3 of 5
    assert not g("alpha gamma delta omega zeta", "delta then alpha")
    assert g("a b c", "nothing")  # no words of four letters


def test_united_states_is_no_pronoun(spark):
    f = lambda t: spark.range(1).select(P.mentions_united_states(F.lit(t))).first()[0]
    assert [f(t) for t in ("in the US market", "tell us more", "USA", "the united states", "BUSY", "U.S.A. plant")] == [True, False, True, True, False, True]


@pytest.mark.parametrize(("raw", "want"), [("BMW AG", "BMW"), ("Volkswagen Group AG", "Volkswagen"), ("Stellantis NV", "Stellantis"), ("vw", "Volkswagen"), ("Acme Group Holding", "Acme Group Holding"), ("Toyota  Motor", "Toyota")])
def test_company_names(spark, raw, want):
    assert spark.range(1).select(C.company_name(F.lit(raw), V.COMPANY_NAMES, V.LEGAL_SUFFIXES)).first()[0] == want


def test_distinct_keeps_the_first_form(spark):
    assert spark.range(1).select(C.distinct_ignoring_case(C.texts(["B", "a", "b", "A", "c"]))).first()[0] == ["B", "a", "c"]


def test_momentum_classes(spark):
    rows = [(0.0, 3.0, "Emerging"), (2.0, 3.0, "Expanding"), (3.0, 1.0, "Fading"), (1.0, 1.0, "Stable"), (0.0, 1.0, "Stable")]
    df = spark.createDataFrame(rows, "p double, r double, want string").withColumn("got", A.momentum_class(F.col("p"), F.col("r")))
    assert all(x.got == x.want for x in df.collect())


def test_vocabulary_is_closed():
    assert len(V.TOPICS) == 9 and len(V.REGIONS) == 34 and len(V.COUNTRY_REGIONS) == 79
    assert set(V.COUNTRY_REGIONS.values()) <= set(V.REGIONS)
    assert {x for p in V.PARENT_REGIONS.values() for x in p} <= set(V.REGIONS)


def test_null_and_empty_documents(spark):
    from tidemark.operators.records import records

    d = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "x", 0), (3, "word", "en", "src3", 4)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(2, None, 1)], "doc_id long, quality int, toxic int")
    assert records(d, labels).count() == 3
    assert records(d.limit(0), labels).count() == 0


def test_days_are_those_of_utc_less_8_hours_in_summer_too(spark):
    from tidemark.plans.record_queries import date_functions

    # 07:30 UTC is half past midnight by summer time in Los Angeles
    r = spark.sql("SELECT 'r' AS record_id, timestamp_ntz'2024-07-01 07:30:00' AS created_at")
    assert tuple(date_functions(r).select("pacific_day", "quota_day", "week").first()) == ("2024-06-30", "2024-06-30", "2024-07-01")


def test_rollups_make_themes_once(spark, sf_dir):
    from tidemark.plans.rule_queries import theme_rollups

    plan = theme_rollups(story_records(spark, sf_dir))._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Filter" in x and "size(filter(" in x], "no filter repeats the themes' expression"


def test_bullets_are_judged_as_one_by_one(spark):
    bullets = ["Foo, Bar", "oo, Ba", "", "foo bar", "nothing of the kind here", "İ ΑΣ foo", None]
    for source in ("x Foo, Bar y", "foo-bar nothing kind", "İ ΑΣ foo bar", "", None):
        for some in ([b] for b in bullets):
            got = spark.range(1).select(Q.ungrounded(F.array(*(F.lit(b).cast("string") for b in some)), F.lit(source).cast("string")), *(~Q.grounded(F.lit(b).cast("string"), F.lit(source).cast("string")) for b in some)).first()
            assert bool(got[0]) == any(x for x in got[1:]), (some, source)


def test_findings_come_from_one_pass_over_the_records(spark, sf_dir):
    from tidemark.plans.catalog import story_records

    found = Q.raised(Q.reviewed(story_records(spark, sf_dir)))
    assert found.inputFiles() and all("/checked-" in f for f in found.inputFiles())
