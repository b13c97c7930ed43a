"""Texts made of records: the brief of a record, and the brief and the e-mail of a week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .dedupe import scored

#: Fixed wording of the texts.
NO_ITEMS = "No items selected for this week."
BRIEF_TITLE, READY, OTHER, NOTES = "EXECUTIVE INTELLIGENCE BRIEF\n", "High-Importance (Share-Ready)\n", "Other Notable Items\n", "Selection Notes\n- Duplicates are suppressed when a better source is available.\n"
HELLO, MAIL_READY, MAIL_OTHER, REGARDS = "Hello team,\n\n", "High-importance items (share-ready):\n", "Other notable items:\n", "Regards,\n[Your Name]\n"
SECTIONS = {"topics": "Topics Covered (canonical)", "evidence": "Evidence (verifiable facts)", "insights": "Key Insights (interpretation)"}
MOST = 20  # items of a week's texts


def _text(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _bullets(c: str) -> Column:
    items = F.coalesce(F.col(c), F.array().cast("array<string>"))
    return F.when(F.size(items) == 0, "- [None]\n").otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))


def _joined(c: str) -> Column:
    return F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("[None]"))


def _or(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def intelligence_brief(as_of: str) -> Column:
    """A record's brief, of the columns of a draft; lists that are empty say so, optional parts are left out."""
    entities = F.when(F.size("government_entities") > 0, _text("\nGovernment/Regulators (if applicable)\n", _bullets("government_entities"))).otherwise("")
    notes = F.when(F.coalesce("notes", F.lit("")) != "", _text("Notes: ", F.col("notes"), "\n")).otherwise("")
    field = lambda c: F.coalesce(F.col(c), F.lit("None"))
    return _text(
        f"INTELLIGENCE BRIEF\n\nSummary Date: {as_of}\nSource Type: ", field("source_type"), "\nPublish Date: ", _or("publish_date", "Unknown"), "\nOriginal URL: ", _or("original_url", "[optional]"), "\n\nTitle\n", field("title"),
        "\n\nCompanies Mentioned\n", _bullets("companies"), "\nActor Type\n- ", field("actor_type"), "\n", entities, "\nCountries Mentioned: ", _joined("countries"), " | Relevant Regions: ", _joined("regions_relevant"), "\n\n",
        SECTIONS["topics"] + "\n", _bullets("topics"), "\nPriority: ", field("priority"), " | Confidence: ", field("confidence"), "\n\n", SECTIONS["evidence"] + "\n", _bullets("evidence"), "\n", SECTIONS["insights"] + "\n", _bullets("insights"),
        "\nReview\nReviewed By: [name]\nReview Status: ", field("review_status"), "\n", notes,
    )


def _listing(items: Column, ready: bool, heading: str, between: str) -> Column:
    mine = F.filter(items, lambda x: x["ready"] == ready)
    lines = F.array_join(F.transform(mine, lambda x: F.concat(F.lit("- "), x["title"], F.lit(between), x["insight"], F.lit("\n"))), "")
    return F.when(F.size(mine) > 0, _text(heading, lines, "\n")).otherwise("")


def weekly_texts(records: DataFrame) -> DataFrame:
    """(week, n_items, subject, brief, email) of the weeks (from Monday) in which records were published.

    A week's items are its MOST best: high priority and confidence first, then by the source's quality, then by record_id.
    """
    rows = scored(records.where("publish_date IS NOT NULL")).withColumns({"week": F.date_trunc("week", "publish_date").cast("date"), "ready": F.coalesce((F.col("priority") == "High") & (F.col("confidence") == "High"), F.lit(False))})
    best = Window.partitionBy("week").orderBy(F.desc("ready"), F.desc("publisher_score"), F.desc("confidence_score"), F.desc("completeness"), "record_id")
    some = rows.select("week", "ready", F.coalesce("title", F.lit("Untitled")).alias("title"), F.coalesce(F.try_element_at("insights", F.lit(1)), F.lit("")).alias("insight"), F.row_number().over(best).alias("place")).where(F.col("place") <= MOST)
    per = some.groupBy("week").agg(F.array_sort(F.collect_list(F.struct("place", "ready", "title", "insight"))).alias("items"))
    label = _text(F.date_format("week", "yyyy-MM-dd"), " to ", F.date_format(F.date_add("week", 6), "yyyy-MM-dd"))
    items = F.col("items")
    brief = _text(BRIEF_TITLE, "Week: ", label, "\n\n", _listing(items, True, READY, " :: "), _listing(items, False, OTHER, " :: "), NOTES)
    email = _text(HELLO, _listing(items, True, MAIL_READY, " — "), _listing(items, False, MAIL_OTHER, " — "), REGARDS)
    return per.select("week", F.size("items").alias("n_items"), _text("Executive Intelligence Brief (", label, ")").alias("subject"), brief.alias("brief"), email.alias("email"))
