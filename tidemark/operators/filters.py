"""Predicates and derived columns over records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import texts


def status(c: Column) -> Column:
    """Review status with blanks and legacy values as Pending."""
    return F.when(c.isNull() | (F.trim(c) == "") | c.isin(V.LEGACY_REVIEW_STATES), "Pending").otherwise(c)


def share_ready() -> Column:
    return (F.col("priority") == "High") & (F.col("confidence") == "High")


def auto_approved() -> Column:
    return F.col("confidence").isin("High", "Medium") & F.col("publish_date").isNotNull() & (F.col("source_type") != "Other") & (F.size("evidence") >= 2)


def blob(*columns: str) -> Column:
    """Lower-cased text of scalar and list columns, commas as blanks."""
    parts = [F.coalesce(F.array_join(c, " ") if c in ("topics", "regions", "companies", "keywords", "countries", "evidence", "insights") else F.col(c), F.lit("")) for c in columns]
    return F.lower(F.translate(F.concat_ws(" ", *parts), ",", " "))


def search(df: DataFrame, query: str, *columns: str, blob_column: str | None = None) -> DataFrame:
    """Rows whose blob (of columns, or a column that is one) contains every token of the query."""
    text = F.col(blob_column) if blob_column else blob(*columns)
    for token in query.lower().replace(",", " ").split():
        df = df.where(text.contains(token))
    return df


def paged(df: DataFrame, order: list[Column], rows: int) -> DataFrame:
    """Adds place (from 1), page (from 0) and total.  Pages number a queue that people go through, so the window has no key."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    placed = df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    return placed.withColumn("page", F.floor((F.col("place") - 1) / rows).cast("int")).crossJoin(F.broadcast(total))


def slim(df: DataFrame) -> DataFrame:
    """Without internal fields."""
    return df.drop(*V.INTERNAL_FIELDS)


def preview(c: Column, most: int) -> Column:
    """The first values, and how many more there are."""
    more = F.size(c) - most
    return F.concat(F.array_join(F.slice(c, 1, most), ", "), F.when(more > 0, F.concat(F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(""))


def best_link(links: dict[str, Column]) -> Column:
    """(kind, link) of the first that is not blank."""
    return F.coalesce(*(F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.struct(F.lit(k).alias("kind"), F.trim(c).alias("link"))) for k, c in links.items()))


def record_date() -> Column:
    """The publish date, else the day of creation."""
    return F.coalesce(F.col("publish_date"), F.col("created_at").cast("date"))


def within_days(as_of: str, days: int) -> Column:
    """No upper bound: a date after as_of is within."""
    return record_date() >= F.date_sub(F.lit(as_of).cast("date"), days)


def key_supplier(companies: Column) -> Column:
    return F.exists(companies, lambda c: F.exists(texts(V.KEY_SUPPLIER_TOKENS), lambda t: F.contains(F.lower(c), t)))


def key_maker(companies: Column) -> Column:
    return F.arrays_overlap(F.transform(companies, lambda c: F.lower(c)), texts(V.KEY_MAKERS))


def missing(c: Column, kind: str) -> Column:
    """A value that counts as missing: null, blank text or empty list."""
    return c.isNull() | ((F.size(c) == 0) if kind == "list" else (F.trim(c) == ""))


def mentions_united_states(c: Column) -> Column:
    """The country's names in any case, or upper-case US as a word: never the pronoun."""
    return c.rlike(r"(?i)(^|[^A-Za-z0-9_])(United States|U\.S\.A\.?|USA)($|[^A-Za-z0-9_])") | c.rlike(r"(^|[^A-Za-z])US($|[^A-Za-z])")


def apply_policy(field: str, old: Column, new: Column, invalid: Column) -> Column:
    """Fields that rules own, alone or with the extractor, are overwritten; the extractor's only where they are missing or invalid."""
    extractors = field in V.FIELD_OWNERS["extractor"]
    return F.when(F.lit(not extractors) | old.isNull() | invalid, new).otherwise(old)


def safe_name(c: Column) -> Column:
    """A file's name of letters, digits and - _ . blank alone."""
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_. -]", "")), F.lit("")), F.lit("source.pdf"))


def column_letters(n: Column) -> Column:
    """A column's name in a sheet, from 1: A, ..., Z, AA, ... (up to three letters)."""
    letter = lambda k: F.chr((k % 26 + 65).cast("int"))
    i = F.greatest(n, F.lit(1)) - 1
    second, third = F.floor(i / 26) - 1, F.floor((F.floor(i / 26) - 1) / 26) - 1
    return F.concat(F.when(third >= 0, letter(third)).otherwise(""), F.when(second >= 0, letter(second)).otherwise(""), letter(i))


def retry_with_strong(error: Column) -> Column:
    """An error that a stronger model may not make."""
    low, out = F.lower(F.coalesce(error, F.lit(""))), F.lit(False)
    for m in V.RETRY_MARKERS:
        out = out | low.contains(m)
    return out


def why_no_text(size: Column, encrypted: Column, errors: Column, chars: Column, pages: Column) -> Column:
    """Why a file gave no text, from its size and what the extractors (arrays, one entry each) say."""
    text = lambda c: c.cast("string")
    most = F.array_max(pages)
    failed = F.forall(errors, lambda e: e.isNotNull())
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "The file is empty (0 bytes).")
        .when(encrypted, "The PDF is password-protected/encrypted, so text extraction is blocked.")
        .when(failed, F.concat(F.lit("Both PDF extractors failed to parse this file ("), F.array_join(errors, "; "), F.lit(").")))
        .when((F.array_max(chars) == 0) & (most > 0), F.concat(F.lit("No selectable text layer was found across "), text(most), F.lit(" page(s); this is likely a scanned/image-only PDF.")))
        .when(F.array_max(chars) == 0, "No selectable text layer was found.")
        .otherwise(F.concat(F.lit("Only whitespace text was extracted ("), F.array_join(F.transform(chars, text), ", "), F.lit(" chars).")))
    )
