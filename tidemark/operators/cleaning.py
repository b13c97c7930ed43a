"""Line cleaner, title detection, routing, chunks and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import any_like, collapse, contains_any

def repaired(text: Column) -> Column:
    """Words broken at a line's end joined, line ends unified, blanks and tabs collapsed."""
    joined = F.regexp_replace(text, r"([A-Za-z])-[ \t\r\n\f]*\n[ \t\r\n\f]*([A-Za-z])", "$1$2")
    return F.regexp_replace(F.regexp_replace(joined, r"\r\n?", "\n"), r"[ \t]+", " ")


def lines_of(text: Column) -> Column:
    """Repaired lines, collapsed, without blanks."""
    t = repaired(text)
    return F.filter(F.transform(F.split(t, "\n"), collapse), lambda x: x != "")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda w: w != ""))


def line_reasons(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, raw_chars, idx, line, reason): why each non-blank line goes; null: it stays.  The first reason that holds counts.

    raw_chars is the length of the whole text.
    """
    rows = docs.select(id_column, F.length(F.coalesce("text", F.lit(""))).alias("raw_chars"), lines_of(F.coalesce("text", F.lit(""))).alias("lines"))
    rows = rows.select(id_column, "raw_chars", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("idx", "line"))
    # all windows and groups that follow are by document: one shuffle of lines
    doc = Window.partitionBy(id_column)
    rows = rows.repartition(id_column).withColumn("n_same", F.count(F.lit(1)).over(Window.partitionBy(id_column, "line")))
    line, words = F.col("line"), word_count(F.col("line"))
    solid = F.regexp_replace(line, " ", "")
    symbols = F.length(F.regexp_replace(solid, r"\p{L}", "")) / F.greatest(F.length(solid), F.lit(1))
    table_fact = line.rlike("[0-9]") & line.contains("|")
    reason = (
        F.when((F.col("n_same") >= F.greatest(F.lit(3), F.floor(F.col("n_lines") * 0.015))) & (words <= 12), "repeated_header_footer")
        .when(line.rlike(V.PAGE_NUMBER), "page_number")
        .when(F.regexp_count(line, F.lit(V.URL_MARK)) >= 2, "link_heavy")
        .when((F.col("idx") > 10) & line.rlike(V.BARE_URL), "link_heavy")
        .when((symbols > 0.35) & ~table_fact & ~line.rlike(V.STAMP), "symbol_heavy")
    )
    for group, patterns in V.JUNK_PATTERNS.items():
        reason = reason.when(any_like(line, patterns), group)
    reason = reason.when(line.rlike(V.CREDIT) & (words < 8), "image_credit_short")
    rows = rows.withColumn("early", reason)
    letters = F.regexp_replace(line, "[^A-Za-z]+", " ")
    alpha = word_count(letters)
    capitals = F.col("early").isNull() & (alpha > 0) & (alpha <= 6) & (F.length(line) <= 60) & (F.upper(letters) == letters)
    rows = rows.withColumn("menu", capitals)
    first = F.min(F.when(F.col("menu") & (F.col("idx") < 20), F.col("idx"))).over(doc)
    late = F.when(F.col("menu") & ~F.coalesce(F.col("idx") == first, F.lit(False)), "short_allcaps_menu").when(line.rlike(V.BYLINE) & (words <= 8), "byline")
    return rows.select(id_column, "raw_chars", "idx", "line", F.coalesce("early", late).alias("reason"))


def clean_meta(reasons: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Per document: lines, removed lines, characters of the text and those that the cleaned text lacks, distinct reasons, and the text left."""
    gone = F.col("reason").isNotNull()
    kept = F.collect_list(F.when(~gone, F.struct("idx", "line")))
    meta = reasons.groupBy(id_column).agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(gone).alias("n_removed"),
        F.max("raw_chars").cast("long").alias("raw_chars"),
        F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"),
        F.array_join(F.transform(F.array_sort(kept), lambda x: x["line"]), "\n").alias("clean_text"),
    )
    return meta.withColumn("removed_chars", F.greatest(F.lit(0).cast("long"), F.col("raw_chars") - F.length("clean_text")))


def with_fallback(clean: Column, original: Column) -> Column:
    """The cleaned text, or the original where cleaning left nothing, or little of a text that was not short."""
    little = (F.length(F.trim(clean)) == 0) | ((F.length(clean) < V.SHORT_CLEAN) & (F.length(original) >= V.SHORT_CLEAN))
    return F.when(clean.isNull() | little, original).otherwise(clean)


def route(meta: DataFrame) -> DataFrame:
    """Noise level and routing from the cleaner's figures."""
    ratio = F.col("removed_chars") / F.greatest(F.col("raw_chars"), F.lit(1))
    pattern = F.lit(False)
    for p in V.NOISE["high_patterns"]:
        pattern = pattern | F.array_contains(F.split("reasons", ","), p)
    high = (ratio > V.NOISE["high_ratio"]) | (F.col("n_removed") > V.NOISE["high_lines"]) | pattern
    low = (ratio < V.NOISE["low_ratio"]) & (F.col("n_removed") < V.NOISE["low_lines"])
    level = F.when(high, "high").when(low, "low").otherwise("normal")
    # cleaning leaves no blank line, so a text that is left is one chunk
    chunks = (F.length("clean_text") > 0).cast("int")
    return meta.withColumns({"noise_level": level, "removed_ratio": F.round(ratio, 3), "model": F.when(level == "high", "strong").otherwise("lite"), "chunked": chunks > 1, "n_chunks": chunks})


def title_line(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The first of the first 40 lines that looks like a title."""
    rows = docs.select(id_column, F.posexplode(F.slice(F.split(F.regexp_replace("text", r"\r\n?", "\n"), "\n"), 1, 40)).alias("idx", "raw"))
    line = collapse(F.col("raw"))
    words = F.regexp_extract_all(line, F.lit("([A-Za-z][A-Za-z'-]*)"), F.lit(1))
    n = F.size(words)
    upper = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    shout = F.size(F.filter(words, lambda w: w.rlike("^[A-Z'-]+$")))
    good = (line != "") & ~line.rlike(V.URL_MARK) & ((line.contains(" - ") & word_count(line).between(6, 30)) | (n.between(6, 20) & (upper >= 0.55 * n) & (shout < 0.7 * n)))
    return rows.where(good).groupBy(id_column).agg(F.min_by(line, "idx").alias("title"))


def chunk_scores(chunks: DataFrame, watch: list[str], topics: list[str]) -> DataFrame:
    """Adds score and flags to rows with a chunk column."""
    c, low = F.col("chunk"), F.lower("chunk")
    month = "(Jan|January|Feb|February|Mar|March|Apr|April|May|Jun|June|Jul|July|Aug|August|Sep|Sept|September|Oct|October|Nov|November|Dec|December)"
    date = c.rlike(rf"(?i)(^|[^A-Za-z0-9_])(20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}\s+{month}\s+20[0-9]{{2}}|{month}\.?\s+[0-9]{{1,2}},\s+20[0-9]{{2}})($|[^A-Za-z0-9_])")
    lines = F.filter(F.transform(F.split("chunk", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.size(F.filter(lines, lambda x: F.length(x) < 25))
    farm = F.size(lines) > 0

    # one to five words, each of the menu's or capitalised: the whole line as one pattern
    one = "(" + "|".join(["[A-Z][a-z]*", *(f"(?i:{w})" for w in V.NAV_WORDS)]) + ")"

    def nav(x: Column) -> Column:
        return x.rlike(f"^[^A-Za-z]*({one}[^A-Za-z]+){{0,4}}{one}[^A-Za-z]*$")

    farm = farm & ((short > 0.4 * F.size(lines)) | (F.size(F.filter(lines, nav)) > 0.4 * F.size(lines)))
    signals = [
        ("date_marker", date, 5),
        ("publisher_marker", contains_any(low, V.PUBLISHER_MARKERS), 5),
        ("copyright_marker", contains_any(low, V.COPYRIGHT_MARKERS), 3),
        ("watch_term", contains_any(low, map(str.lower, watch)), 3),
        ("topic_term", contains_any(low, map(str.lower, topics)), 2),
        ("numeric_signal", contains_any(low, V.NUMERIC_MARKERS), 1),
        ("noise_marker", contains_any(low, V.NOISE_MARKERS), -5),
        ("many_urls", F.regexp_count(low, F.lit("https?://")) >= 2, -3),
        ("nav_like", farm, -3),
    ]
    rows = chunks.withColumn("_s", F.struct(*(F.coalesce(hit, F.lit(False)).alias(name) for name, hit, _ in signals)))
    score = sum((F.when(F.col(f"_s.{name}"), points).otherwise(0) for name, _, points in signals), F.lit(0))
    flags = F.filter(F.array(*(F.when(F.col(f"_s.{name}"), F.lit(name)) for name, *_ in signals)), lambda x: x.isNotNull())
    return rows.withColumns({"score": score, "flags": flags}).drop("_s")


def select_chunks(scored: DataFrame, id_column: str = "doc_id", header_k: int = 2, body_k: int = 6) -> DataFrame:
    """Header chunks (dated, published or copyright) and body chunks, the best of each by (score, place).

    Of the header candidates the first `header_k` are header, the others compete for the body: a document's first
    header_k + body_k rows in the order of the score hold all that is chosen, so one window and one group suffice.
    """
    header = F.arrays_overlap("flags", F.array(F.lit("date_marker"), F.lit("publisher_marker"), F.lit("copyright_marker")))
    order = Window.partitionBy(id_column).orderBy(F.desc("score"), "idx")
    rows = scored.withColumn("is_header", header)
    rows = rows.withColumns({"_h": F.sum(F.col("is_header").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_n": F.row_number().over(order)})
    is_head = F.col("is_header") & (F.col("_h") <= header_k)
    # how many rows up to here are header: the rest have their place in the body
    place = F.col("_n") - F.least(F.col("_h"), F.lit(header_k))
    return rows.where(is_head | (place <= body_k)).withColumn("part", F.when(is_head, "header").otherwise("body")).drop("_h", "_n", "is_header")


def render_pack(chosen: DataFrame, title: Column, id_column: str = "doc_id") -> DataFrame:
    """(id, pack): header chunks and body chunks in order, with labels.

    Body chunks of the lowest score, and of equal ones the last, are left out until the pack has PACK_CHARS characters;
    what is longer without any is cut.  A label has the same width for all (at most nine) chunks of a kind, so lengths add
    up, and what is kept is the longest run of the best that fits.  At most eight rows of a document meet.
    """
    row = F.struct("idx", "chunk", F.col("score").alias("score"))
    of = lambda part: F.collect_list(F.when(F.col("part") == part, row))
    d = chosen.groupBy(id_column).agg(F.array_sort(of("header")).alias("heads"), of("body").alias("bodies"))
    size = lambda x: F.length(x["chunk"]) + 6
    used = F.aggregate("heads", F.lit(V.PACK_FRAME) + F.length(title), lambda a, x: a + size(x))
    best = F.array_sort(F.transform("bodies", lambda x: F.struct((-x["score"]).alias("order"), x["idx"].alias("idx"), x["chunk"].alias("chunk"))))
    state = F.struct(used.alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(a: Column, x: Column) -> Column:
        fits = a["open"] & (a["used"] + size(x) <= V.PACK_CHARS)
        return F.struct(F.when(fits, a["used"] + size(x)).otherwise(a["used"]).alias("used"), F.when(fits, a["n"] + 1).otherwise(a["n"]).alias("n"), fits.alias("open"))

    d = d.withColumn("best", best).withColumn("n", F.aggregate("best", state, step)["n"])
    kept = F.array_sort(F.transform(F.slice("best", F.lit(1), F.col("n")), lambda x: F.struct(x["idx"].alias("idx"), x["chunk"].alias("chunk"))))
    shown = lambda rows, label: F.array_join(F.transform(rows, lambda x, i: F.concat(F.lit(f"\n[{label}"), (i + 1).cast("string"), F.lit("] "), x["chunk"])), "")
    pack = F.concat(F.lit("TITLE: "), title, F.lit("\n\n" + V.PACK_HEADS), shown("heads", "H"), F.lit("\n\n" + V.PACK_BODIES), shown(kept, "B"), F.lit("\n\n" + V.PACK_END))
    return d.select(id_column, F.substring(pack, 1, V.PACK_CHARS).alias("pack"))
