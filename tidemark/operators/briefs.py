"""Briefs as lines: sections, citations, findings, metrics, scores, validation and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import collapse, texts

TITLE = r"^[ \t]*#*[ \t]*([A-Z][A-Z0-9 &/()-]+)[ \t]*$"
SUMMARY = r"(?i)<summary>[ \t]*([^<]*[^< \t])[ \t]*</summary>"
DETAILS = r"(?i)^</?details>[ \t]*$"
REFERENCE = r"(?i)(?:^|[^A-Za-z0-9_])REC[ \t]*[:#][ \t]*([A-Za-z0-9_-]*[A-Za-z0-9_])"
NONE = r"(?i)(^|[^A-Za-z0-9_])(none observed|none|n/?a)($|[^A-Za-z0-9_])"
OVERREACH = rf"(?i)(^|[^A-Za-z0-9_]){V.OVERREACH_PATTERN}($|[^A-Za-z0-9_])"
UNCERTAIN = rf"(?i)(^|[^A-Za-z0-9_]){V.UNCERTAINTY_PATTERN}($|[^A-Za-z0-9_])"
MOST_OVERREACH = 3
UNKNOWN = "UNKNOWN"


def heading(line: Column) -> Column:
    """A known section's name that a line is the heading of: capitals behind any #, or a summary tag."""
    title, summary = F.regexp_extract(line, TITLE, 1), F.upper(collapse(F.regexp_extract(line, SUMMARY, 1)))
    return F.when(F.trim(title).isin(V.KNOWN_SECTIONS), F.trim(title)).when(summary.isin(V.KNOWN_SECTIONS), summary)


def loose_heading(line: Column) -> Column:
    """Also with marks of emphasis, in any case, or with a colon behind."""
    summary = F.regexp_extract(line, SUMMARY, 1)
    text = F.when(summary != "", summary).otherwise(line)
    text = F.trim(F.regexp_replace(F.trim(text), r"^#+[ \t]*", ""))
    text = F.upper(F.trim(F.regexp_replace(F.trim(F.regexp_replace(text, r"\*\*|__", "")), r"[:：][ \t]*$", "")))
    return F.coalesce(F.when(text.isin(V.KNOWN_SECTIONS), text), F.when(F.trim(F.regexp_extract(line, TITLE, 1)).isin(V.KNOWN_SECTIONS), F.trim(F.regexp_extract(line, TITLE, 1))))


def is_bullet(line: Column) -> Column:
    return F.ltrim(line).rlike(r"^[-*•]")


def is_topic_label(line: Column, section: Column) -> Column:
    """A bullet that only names a topic."""
    text = F.trim(F.regexp_replace(F.trim(F.regexp_replace(line, r"^[ \t]*[-*•][ \t]*", "")), "[*_`]", ""))
    text = F.lower(F.trim(F.regexp_replace(text, ":$", "")))
    return (section == "KEY DEVELOPMENTS BY TOPIC") & is_bullet(line) & text.isin([t.lower() for t in V.TOPICS])


def references(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(REFERENCE), F.lit(1))


def resolved(refs: Column, ids: Column) -> Column:
    """References as ids; a number that is no id stands for the id at its place."""
    place = lambda r: F.when(r.rlike("^[0-9]{1,9}$"), r.cast("int"))
    return F.transform(refs, lambda r: F.when(F.array_contains(ids, r), r).otherwise(F.coalesce(F.try_element_at(ids, F.when(place(r) >= 1, place(r))), r)))


def sections(lines: DataFrame) -> DataFrame:
    """(brief_id, line_no, section, line) of a brief's lines below their headings; what stands behind a summary tag is a line too.

    lines: brief_id, line_no, line.  Lines before any heading are of the section UNKNOWN.
    """
    w = Window.partitionBy("brief_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("heading", heading(F.trim("line")))
    rows = rows.withColumn("section", F.coalesce(F.last("heading", True).over(w), F.lit(UNKNOWN)))
    behind = F.trim(F.regexp_replace("line", r"(?i)^.*</summary>", ""))
    rows = rows.withColumn("line", F.when(F.col("heading").isNull(), F.col("line")).when(F.col("line").rlike(SUMMARY) & (behind != ""), behind))
    return rows.where(F.col("line").isNotNull() & ~F.trim("line").rlike(DETAILS)).select("brief_id", "line_no", "section", "line")


def line_findings(lines: DataFrame, selected: DataFrame) -> DataFrame:
    """(brief_id, line_no, section, claim, issue, severity) of lines: references to no selected id, and claims without any.

    selected: brief_id, ids (array).  Only briefs that cite at all are judged.
    """
    cites = lines.groupBy("brief_id").agg(F.max(F.size(references(F.col("line")))).alias("cites")).where("cites > 0").select("brief_id")
    rows = sections(lines).join(selected, "brief_id").join(cites, "brief_id", "left_semi").withColumn("claim", F.trim("line")).where("claim <> ''")
    rows = rows.withColumn("refs", resolved(references(F.col("claim")), F.col("ids")))
    bad = (F.size("ids") > 0) & (F.size(F.array_except("refs", "ids")) > 0)
    bare = (F.size("refs") == 0) & F.col("section").isin(V.CLAIM_SECTIONS) & is_bullet(F.col("claim")) & ~is_topic_label(F.col("claim"), F.col("section"))
    issue = F.when(bad, "rec_mismatch").when(bare, "ungrounded_claim")
    return rows.withColumn("issue", issue).where("issue IS NOT NULL").select("brief_id", "line_no", "section", "claim", "issue", F.lit("High").alias("severity"))


def needs(records: DataFrame) -> DataFrame:
    """(brief_id, uncertain, soft) of selected records (brief_id, confidence, said)."""
    soft = F.col("said").rlike(UNCERTAIN)
    return records.groupBy("brief_id").agg(F.bool_or(F.col("confidence").isin("Medium", "Low") | soft).alias("uncertain"), F.bool_or(soft).alias("soft"))


def metrics(lines: DataFrame, selected: DataFrame, records: DataFrame) -> DataFrame:
    """A row for each brief: numbers of findings, compliance, cross-record bullets, specificity of actions, and the score."""
    rows = sections(lines).join(selected, "brief_id").withColumn("valid", F.array_intersect(references(F.col("line")), F.col("ids")))
    cross = F.col("section").isin(V.CROSS_RECORD_SECTIONS) & is_bullet(F.col("line")) & (F.size("valid") >= 2)
    unsure = F.col("section") == "CONFLICTS & UNCERTAINTY"
    actions = [F.bool_or((F.col("section") == "RECOMMENDED ACTIONS") & F.col("line").rlike(rf"(?i)(^|[^A-Za-z0-9_])({p})($|[^A-Za-z0-9_])")).cast("int").alias(f"_a{k}") for k, p in enumerate(V.ACTION_CHECKS)]
    per = rows.groupBy("brief_id").agg(F.count_if(cross).alias("kpi_b4"), F.bool_or(unsure & (F.trim("line") != "")).alias("said"), F.bool_or(unsure & F.col("line").rlike(NONE)).alias("none"), *actions)
    over = lines.groupBy("brief_id").agg(F.sum(F.regexp_count("line", F.lit(OVERREACH))).alias("over"))
    found = line_findings(lines, selected).groupBy("brief_id").agg(F.count_if(F.col("issue") == "rec_mismatch").alias("mismatch"), F.count_if(F.col("issue") == "ungrounded_claim").alias("ungrounded"))
    m = selected.select("brief_id").join(per, "brief_id", "left").join(over, "brief_id", "left").join(found, "brief_id", "left").join(needs(records), "brief_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    m = m.select(
        "brief_id",
        (zero(F.col("ungrounded")) + zero(F.col("mismatch"))).alias("kpi_b1"),
        F.when(yes("uncertain") & yes("soft"), F.least(zero(F.col("over")), F.lit(MOST_OVERREACH))).otherwise(0).cast("long").alias("kpi_b2"),
        F.when(~yes("uncertain") | (yes("said") & ~yes("none")), 1.0).otherwise(0.0).alias("kpi_b3"),
        zero(F.col("kpi_b4")).alias("kpi_b4"),
        F.greatest(F.lit(1), F.least(F.lit(5), zero(sum((F.col(f"_a{k}") for k in range(len(actions))), F.lit(0))))).cast("int").alias("kpi_b5"),
        zero(F.col("mismatch")).alias("mismatch"),
    )
    score = 100 - 25 * F.col("kpi_b1") - 20 * F.col("mismatch") - 10 * F.col("kpi_b2") - F.when(F.col("kpi_b3") == 0, 20).otherwise(0) - F.when(F.col("kpi_b4") < 2, 15).otherwise(0)
    return m.withColumn("score", F.greatest(F.lit(0).cast("long"), score.cast("long"))).drop("mismatch")


def brief_findings(lines: DataFrame, selected: DataFrame, records: DataFrame) -> DataFrame:
    """Findings of lines and of whole briefs: missing uncertainty, and overreach with the lines that hold it (at most three words of it)."""
    found = line_findings(lines, selected)
    m = metrics(lines, selected, records)
    missing = m.where("kpi_b3 = 0").select("brief_id", F.lit(None).cast("long").alias("line_no"), F.lit("CONFLICTS & UNCERTAINTY").alias("section"), F.lit("").alias("claim"), F.lit("missing_uncertainty").alias("issue"), F.lit("High").alias("severity"))
    hits = lines.join(m.where("kpi_b2 > 0").select("brief_id"), "brief_id", "left_semi").select("brief_id", "line_no", F.trim("line").alias("claim"), F.explode(F.sequence(F.lit(1), F.nullif(F.regexp_count("line", F.lit(OVERREACH)), F.lit(0)))).alias("k"))
    order = Window.partitionBy("brief_id").orderBy("line_no", "k")
    over = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= MOST_OVERREACH)
    over = over.select("brief_id", "line_no", F.lit("EXECUTIVE SUMMARY").alias("section"), "claim", F.lit("overreach").alias("issue"), F.lit("Medium").alias("severity"))
    return found.unionByName(missing).unionByName(over)


def validation(lines: DataFrame, selected: DataFrame, own_name: str) -> DataFrame:
    """(brief_id, error, n): what a draft does against the rules: prose or no bullet in the summary, references to no id, claims without one, one opener twice."""
    w = Window.partitionBy("brief_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("heading", loose_heading(F.col("line"))).withColumn("section", F.last("heading", True).over(w))
    rows = rows.where("heading IS NULL AND section IS NOT NULL").withColumn("text", F.trim("line")).where("text <> ''").join(selected, "brief_id")
    cites = lines.groupBy("brief_id").agg((F.max(F.size(references(F.col("line")))) > 0).alias("cites"))
    rows = rows.join(cites, "brief_id").withColumn("refs", references(F.col("text")))
    summary, bullet, refs = F.col("section") == "EXECUTIVE SUMMARY", is_bullet(F.col("text")), F.size("refs") > 0
    prose = summary & ~bullet
    opener = F.lower(F.trim(F.regexp_replace(F.trim(F.regexp_replace("text", r"^[ \t]*[-*•][ \t]*", "")), "[*_`]", ""))).startswith(own_name.lower())
    per = rows.groupBy("brief_id").agg(
        F.count_if(prose).alias("prose_in_summary"),
        F.count_if(~prose & refs & (F.size("ids") > 0) & (F.size(F.array_except("refs", "ids")) > 0)).alias("invalid_reference"),
        F.count_if(~prose & ~refs & F.col("cites") & F.col("section").isin(V.CLAIM_SECTIONS) & bullet & ~is_topic_label(F.col("text"), F.col("section"))).alias("uncited_claim"),
        (F.count_if(summary & bullet & opener) > 1).cast("long").alias("opener_repeated"),
        (F.bool_or(summary) & ~F.bool_or(summary & bullet)).cast("long").alias("summary_without_bullets"),
    )
    kinds = ["prose_in_summary", "invalid_reference", "uncited_claim", "opener_repeated", "summary_without_bullets"]
    return per.unpivot("brief_id", kinds, "error", "n").where("n > 0")


def mode(n: Column) -> Column:
    return F.when(n <= V.BRIEF_MODES["single"], "single").when(n <= V.BRIEF_MODES["compact"], "compact").otherwise("standard")


def focused_regions(records: DataFrame, group: str, most: int = 8) -> DataFrame:
    """(group, region, n): the commonest regions of each group, without those that a narrower one there stands for."""
    counts = records.select(group, F.explode("regions").alias("region")).where(F.col("region").isin(V.REGIONS)).groupBy(group, "region").agg(F.count(F.lit(1)).alias("n"))
    there = counts.groupBy(group).agg(F.collect_set("region").alias("there"))  # at most as many as the vocabulary has
    gone = F.lit(False)
    for wide, narrow in V.WIDER_REGIONS.items():
        gone = gone | ((F.col("region") == wide) & F.arrays_overlap("there", texts(narrow)))
    for countries, buckets in V.BUCKETS_BY_COUNTRY:
        gone = gone | (F.col("region").isin(buckets) & F.arrays_overlap("there", texts(countries)))
    order = Window.partitionBy(group).orderBy(F.desc("n"), "region")
    return counts.join(there, group).where(~gone).withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select(group, "region", "n", "place")


def labelled(line: Column, labels: Column) -> Column:
    """Citations of a line replaced by "[label]" where the map has one."""
    refs = F.array_distinct(references(line))
    return F.aggregate(refs, line, lambda text, r: F.when(F.try_element_at(labels, r).isNotNull(), F.regexp_replace(text, F.concat(F.lit(r"(?i)\bREC[ \t]*[:#][ \t]*"), r, F.lit(r"(?![A-Za-z0-9_-])")), F.concat(F.lit("["), F.try_element_at(labels, r), F.lit("]")))).otherwise(text))


def escaped(line: Column) -> Column:
    """Dollar signs escaped outside of code spans; an indented label becomes a quotation."""
    parts = F.transform(F.split(line, "`"), lambda x, i: F.when(i % 2 == 0, F.replace(x, F.lit("$"), F.lit("\\$"))).otherwise(x))
    return F.regexp_replace(F.array_join(parts, "`"), r"^[ ]{2,}([A-Z][A-Za-z ]*:)", "> $1")


def period(lines: DataFrame) -> DataFrame:
    """(brief_id, period): what stands behind "Period:" in a brief's first such line."""
    value = F.regexp_extract("line", r"(?i)^[ \t]*period:[ \t]*(.*)$", 1)
    return lines.where(F.col("line").rlike(r"(?i)^[ \t]*period:")).groupBy("brief_id").agg(F.min_by(F.trim(value), "line_no").alias("period"))


def days_of(label: Column) -> Column:
    """N of "last N days", 1 to 365; 7 for any other label."""
    n = F.regexp_extract(label, r"(?i)(^|[^A-Za-z0-9_])last[ \t]+([0-9]{1,6})[ \t]+days($|[^A-Za-z0-9_])", 2)
    return F.when(n == "", 7).otherwise(F.least(F.greatest(n.cast("int"), F.lit(1)), F.lit(365)))


def week_range(label: Column, as_of: str) -> Column:
    """A range label with its dates: blank and "last N days" are counted back from as_of, others stay."""
    text = F.trim(F.coalesce(label, F.lit("")))
    form = r"(?i)^last[ \t]+([0-9]{1,6})[ \t]+days([ \t]+by[ \t]+([a-z_ ]+))?$"
    n, by = F.regexp_extract(text, form, 1), F.lower(F.trim(F.regexp_extract(text, form, 3)))
    end = F.lit(as_of).cast("date")
    span = lambda days: F.concat(F.date_sub(end, days).cast("string"), F.lit(" to "), end.cast("string"))
    basis = F.when(by.isin("created_at", "upload date", "upload_date", "created"), " (Upload date)").when(by.isin("publish_date", "publish date", "published", "publication date"), " (Publish date)").otherwise("")
    dated = text.contains(" to ") & text.rlike("[0-9]{4}-[0-9]{2}-[0-9]{2}")
    return F.when(text == "", F.concat(span(F.lit(30)), F.lit(" (Publish date)"))).when(dated, text).when(n != "", F.concat(span(F.greatest(F.nullif(n, F.lit("")).cast("int"), F.lit(1))), basis)).otherwise(text)


def publish_range(records: DataFrame, group: str) -> DataFrame:
    """(group, week_range): first to last publish date."""
    per = records.groupBy(group).agg(F.min("publish_date").alias("a"), F.max("publish_date").alias("b"))
    return per.select(group, F.when(F.col("a").isNull(), "Publish date unavailable").otherwise(F.concat(F.col("a").cast("string"), F.lit(" to "), F.col("b").cast("string"), F.lit(" (Publish date)"))).alias("week_range"))


def listing(history: DataFrame, chosen: DataFrame, records: DataFrame, most: int = 5) -> DataFrame:
    """The newest briefs with their code, versions, numbers of ids found and lost, and the first three topics in the order of their ids.

    history: file, family, version, created_at; chosen: file, pos, record_id; records: record_id, topics.
    """
    codes = history.groupBy("family").agg(F.min("created_at").alias("first")).withColumn("code", F.concat(F.lit("BRIEF-"), F.lpad(F.row_number().over(Window.orderBy("first", "family")).cast("string"), 3, "0"))).select("family", "code")  # a row for each family
    newest = history.orderBy(F.desc("created_at"), F.desc("file")).limit(most).join(codes, "family")
    ids = chosen.join(F.broadcast(newest.select("file")), "file").join(records.select("record_id", "topics", F.lit(1).alias("there")), "record_id", "left")
    counts = ids.groupBy("file").agg(F.count(F.lit(1)).alias("n_ids"), F.count_if(F.col("there").isNull()).alias("n_missing"))
    seen = ids.select("file", "pos", F.posexplode("topics").alias("at", "topic")).groupBy("file", "topic").agg(F.min(F.struct("pos", "at")).alias("first"))
    w = Window.partitionBy("file").orderBy("first")  # a row for each topic of the vocabulary
    three = seen.withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "topic"))), lambda x: x["topic"]), "; ").alias("topics"))
    return newest.join(counts, "file", "left").join(three, "file", "left").select("file", "code", "version", F.coalesce("n_ids", F.lit(0)).alias("n_ids"), F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("topics", F.lit("")).alias("topics"))


def collapsible(lines: DataFrame) -> DataFrame:
    """(brief_id, section, block): each section as saved, under its name or, but for the open ones, folded."""
    rows = sections(lines).where(F.col("section") != UNKNOWN)
    one = rows.groupBy("brief_id", "section").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("all"))  # a section's lines
    body = F.trim(F.array_join(F.transform("all", lambda x: x["line"]), "\n"))
    folded = F.concat(F.lit("<details>\n<summary>"), "section", F.lit("</summary>\n\n"), F.when(body == "", "_No content in this section._").otherwise(body), F.lit("\n\n</details>"))
    return one.select("brief_id", "section", F.when(F.col("section").isin(V.OPEN_SECTIONS), F.concat("section", F.when(body == "", "").otherwise(F.concat(F.lit("\n"), body)))).otherwise(folded).alias("block"))
