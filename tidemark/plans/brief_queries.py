"""Queries of briefs: findings, scores, validation, ranges, regions, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import collapse, texts
from tidemark.operators import briefs as B
from tidemark.operators import maintenance as M
from tidemark.operators.records import _list

from .catalog import query, table
from .record_queries import _BRIEFS, AS_OF, _briefs

_LF = "regexp_replace(trim(coalesce(text, '')), '[ \\t\\r\\n\\f]+', ' ', 'g')"
_LINES = f"""WITH c AS (SELECT conv_id, turn, conv_id // 5 AS brief_id, conv_id * 1000 + turn AS line_no, length(coalesce(text, '')) AS n, trim({_LF}) AS body, {_list(V.KNOWN_SECTIONS)}[((conv_id * 3 + conv_id // 5) % {len(V.KNOWN_SECTIONS)}) + 1] AS h FROM conversations),
 lines AS (SELECT brief_id, line_no, CASE WHEN turn = 0 THEN CASE n % 3 WHEN 0 THEN '## ' || h WHEN 1 THEN '<summary>' || h || '</summary> ' || body ELSE '**' || h || ':**' END
   WHEN n % 13 = 0 THEN '- **Regulatory & Safety:**' WHEN n % 13 = 1 THEN '<details>' WHEN n % 13 = 2 THEN 'None observed' WHEN n % 13 = 3 THEN 'Period: ' || n || ' days'
   ELSE CASE WHEN n % 7 = 0 THEN '' ELSE '- ' END || CASE WHEN n % 3 = 0 THEN 'Tidemark: ' ELSE '' END || body || CASE WHEN n % 11 < 3 THEN ' The board decided on the report next week' ELSE '' END
     || CASE n % 5 WHEN 0 THEN '' WHEN 1 THEN ' REC:r' || (conv_id // 5) WHEN 2 THEN ' (rec # r' || (conv_id // 5) || ', REC:x1)' WHEN 3 THEN ' REC:1' ELSE ' REC:r' || (conv_id // 5) || ' REC:s' || (conv_id // 5) END END AS line FROM c),
 selected AS (SELECT DISTINCT brief_id, ['r' || brief_id, 's' || brief_id] AS ids FROM lines),
 recs AS (SELECT brief_id, CASE WHEN brief_id % 3 = 0 THEN 'Low' ELSE 'High' END AS confidence, CASE WHEN brief_id % 2 = 0 THEN 'it could slip' ELSE 'it is firm' END AS said FROM selected),
 hl AS (SELECT *, CASE WHEN list_contains({_list(V.KNOWN_SECTIONS)}, trim(regexp_extract(trim(line), '{B.TITLE}', 1))) THEN trim(regexp_extract(trim(line), '{B.TITLE}', 1)) WHEN list_contains({_list(V.KNOWN_SECTIONS)}, upper(regexp_extract(line, '{B.SUMMARY}', 1))) THEN upper(regexp_extract(line, '{B.SUMMARY}', 1)) END AS heading FROM lines),
 sl AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY brief_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS section, trim(regexp_replace(line, '(?i)^.*</summary>', '')) AS behind FROM hl),
 sec AS (SELECT * FROM (SELECT brief_id, line_no, section, CASE WHEN heading IS NULL THEN line WHEN regexp_matches(line, '{B.SUMMARY}') AND behind <> '' THEN behind END AS line FROM sl) WHERE line IS NOT NULL AND NOT regexp_matches(trim(line), '{B.DETAILS}')),
 cites AS (SELECT brief_id, max(len(regexp_extract_all(line, '{B.REFERENCE}', 1))) > 0 AS cites FROM lines GROUP BY 1),
 f0 AS (SELECT sec.brief_id, line_no, section, trim(line) AS claim, ids, regexp_extract_all(trim(line), '{B.REFERENCE}', 1) AS raw FROM sec JOIN selected ON selected.brief_id = sec.brief_id),
 f1 AS (SELECT *, list_transform(raw, lambda r: CASE WHEN list_contains(ids, r) THEN r WHEN regexp_matches(r, '^[0-9]{{1,9}}$') AND TRY_CAST(r AS INTEGER) BETWEEN 1 AND len(ids) THEN ids[TRY_CAST(r AS INTEGER)] ELSE r END) AS refs,
   regexp_matches(ltrim(claim), '^[-*•]') AS bullet, lower(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(claim, '^[ \\t]*[-*•][ \\t]*', '')), '[*_`]', '', 'g')), ':$', ''))) AS bare FROM f0),
 f2 AS (SELECT *, section = 'KEY DEVELOPMENTS BY TOPIC' AND bullet AND list_contains({_list([t.lower() for t in V.TOPICS])}, bare) AS label FROM f1),
 f3 AS (SELECT *, CASE WHEN len(list_filter(refs, lambda r: NOT list_contains(ids, r))) > 0 THEN 'rec_mismatch' WHEN len(refs) = 0 AND list_contains({_list(V.CLAIM_SECTIONS)}, section) AND bullet AND NOT label THEN 'ungrounded_claim' END AS issue FROM f2 WHERE claim <> '' AND brief_id IN (SELECT brief_id FROM cites WHERE cites)),
 found AS (SELECT brief_id, line_no, section, claim, issue FROM f3 WHERE issue IS NOT NULL),
 need AS (SELECT brief_id, bool_or(confidence IN ('Medium', 'Low') OR regexp_matches(said, '{B.UNCERTAIN}')) AS uncertain, bool_or(regexp_matches(said, '{B.UNCERTAIN}')) AS soft FROM recs GROUP BY 1),
 per AS (SELECT s.brief_id, count(*) FILTER (list_contains({_list(V.CROSS_RECORD_SECTIONS)}, section) AND regexp_matches(ltrim(line), '^[-*•]') AND len(list_intersect(regexp_extract_all(line, '{B.REFERENCE}', 1), ids)) >= 2) AS b4,
   bool_or(section = 'CONFLICTS & UNCERTAINTY' AND trim(line) <> '') AS said, bool_or(section = 'CONFLICTS & UNCERTAINTY' AND regexp_matches(line, '{B.NONE}')) AS nothing, {", ".join(f"CAST(bool_or(section = 'RECOMMENDED ACTIONS' AND regexp_matches(line, '(?i)(^|[^A-Za-z0-9_])({p})($|[^A-Za-z0-9_])')) AS INTEGER) AS a{k}" for k, p in enumerate(V.ACTION_CHECKS))} FROM sec s JOIN selected ON selected.brief_id = s.brief_id GROUP BY 1),
 ov AS (SELECT brief_id, sum(len(regexp_extract_all(line, '{B.OVERREACH}'))) AS n FROM lines GROUP BY 1),
 fc AS (SELECT brief_id, count(*) FILTER (issue = 'rec_mismatch') AS mismatch, count(*) FILTER (issue = 'ungrounded_claim') AS ungrounded FROM found GROUP BY 1),
 m AS (SELECT s.brief_id, coalesce(ungrounded, 0) + coalesce(mismatch, 0) AS kpi_b1, CAST(CASE WHEN uncertain AND soft THEN least(coalesce(ov.n, 0), {B.MOST_OVERREACH}) ELSE 0 END AS BIGINT) AS kpi_b2, CASE WHEN NOT uncertain OR (coalesce(said, false) AND NOT coalesce(nothing, false)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS kpi_b3,
   coalesce(b4, 0) AS kpi_b4, CAST(greatest(1, least(5, coalesce(a0 + a1 + a2 + a3 + a4, 0))) AS INTEGER) AS kpi_b5, coalesce(mismatch, 0) AS mismatch FROM selected s LEFT JOIN per ON per.brief_id = s.brief_id LEFT JOIN ov ON ov.brief_id = s.brief_id LEFT JOIN fc ON fc.brief_id = s.brief_id LEFT JOIN need ON need.brief_id = s.brief_id),
 scored AS (SELECT brief_id, kpi_b1, kpi_b2, kpi_b3, kpi_b4, kpi_b5, greatest(0, 100 - 25 * kpi_b1 - 20 * mismatch - 10 * kpi_b2 - CASE WHEN kpi_b3 = 0 THEN 20 ELSE 0 END - CASE WHEN kpi_b4 < 2 THEN 15 ELSE 0 END) AS score FROM m) """


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Briefs made of five conversations each: a first turn is a heading of some form, the others are lines with citations of every kind."""
    c = table(spark, sf_dir, "conversations")
    n, conv = F.length(F.coalesce("text", F.lit(""))), F.col("conv_id")
    body, own = F.trim(collapse(F.coalesce("text", F.lit("")))), F.floor(conv / 5).cast("string")
    h = F.element_at(texts(V.KNOWN_SECTIONS), ((conv * 3 + F.floor(conv / 5)) % len(V.KNOWN_SECTIONS) + 1).cast("int"))
    cite = F.when(n % 5 == 0, "").when(n % 5 == 1, F.concat(F.lit(" REC:r"), own)).when(n % 5 == 2, F.concat(F.lit(" (rec # r"), own, F.lit(", REC:x1)"))).when(n % 5 == 3, " REC:1").otherwise(F.concat(F.lit(" REC:r"), own, F.lit(" REC:s"), own))
    head = F.when(n % 3 == 0, F.concat(F.lit("## "), h)).when(n % 3 == 1, F.concat(F.lit("<summary>"), h, F.lit("</summary> "), body)).otherwise(F.concat(F.lit("**"), h, F.lit(":**")))
    line = F.concat(F.when(n % 7 == 0, "").otherwise("- "), F.when(n % 3 == 0, "Tidemark: ").otherwise(""), body, F.when(n % 11 < 3, " The board decided on the report next week").otherwise(""), cite)
    line = F.when(F.col("turn") == 0, head).when(n % 13 == 0, "- **Regulatory & Safety:**").when(n % 13 == 1, "<details>").when(n % 13 == 2, "None observed").when(n % 13 == 3, F.concat(F.lit("Period: "), n.cast("string"), F.lit(" days"))).otherwise(line)
    return c.select(F.floor(conv / 5).alias("brief_id"), (conv * 1000 + F.col("turn")).alias("line_no"), line.alias("line"))


def _selected(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    b = F.col("brief_id")
    ids = lines.select("brief_id").distinct()
    records = ids.select("brief_id", F.when(b % 3 == 0, "Low").otherwise("High").alias("confidence"), F.when(b % 2 == 0, "it could slip").otherwise("it is firm").alias("said"))
    return ids.select("brief_id", F.array(F.concat(F.lit("r"), b.cast("string")), F.concat(F.lit("s"), b.cast("string"))).alias("ids")), records


@query("T26, W9, F-s13, F-s15, F-s17, J8", _LINES + f""", ks AS (SELECT brief_id, line_no, trim(line) AS claim, unnest(range(1, len(regexp_extract_all(line, '{B.OVERREACH}')) + 1)) AS k FROM lines WHERE brief_id IN (SELECT brief_id FROM m WHERE kpi_b2 > 0)), o AS (SELECT *, row_number() OVER (PARTITION BY brief_id ORDER BY line_no, k) AS rn FROM ks)
 SELECT brief_id, line_no, section, md5(claim) AS claim_md5, issue, 'High' AS severity FROM found UNION ALL SELECT brief_id, NULL, 'CONFLICTS & UNCERTAINTY', md5(''), 'missing_uncertainty', 'High' FROM m WHERE kpi_b3 = 0 UNION ALL SELECT brief_id, line_no, 'EXECUTIVE SUMMARY', md5(claim), 'overreach', 'Medium' FROM o WHERE rn <= {B.MOST_OVERREACH}""")
def brief_lines_qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of briefs and their lines."""
    lines = _lines(spark, sf_dir)
    return B.brief_findings(lines, *_selected(lines)).select("brief_id", "line_no", "section", F.md5("claim").alias("claim_md5"), "issue", "severity")


@query("A13, A15, A26, F-s28", _LINES + "SELECT * FROM scored")
def brief_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brief KPIs B1 to B5 and the score."""
    lines = _lines(spark, sf_dir)
    return B.metrics(lines, *_selected(lines))


_LOOSE = f"upper(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(CASE WHEN regexp_extract(line, '{B.SUMMARY}', 1) <> '' THEN regexp_extract(line, '{B.SUMMARY}', 1) ELSE line END), '^#+[ \\t]*', '')), '\\*\\*|__', '', 'g')), '[:：][ \\t]*$', '')))"


@query("T23, F-s16", _LINES + f""", vh AS (SELECT *, CASE WHEN list_contains({_list(V.KNOWN_SECTIONS)}, {_LOOSE}) THEN {_LOOSE} WHEN list_contains({_list(V.KNOWN_SECTIONS)}, trim(regexp_extract(line, '{B.TITLE}', 1))) THEN trim(regexp_extract(line, '{B.TITLE}', 1)) END AS heading FROM lines),
 vs AS (SELECT *, last_value(heading IGNORE NULLS) OVER (PARTITION BY brief_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS section FROM vh),
 v0 AS (SELECT vs.brief_id, section, trim(line) AS text, ids, cites, regexp_extract_all(trim(line), '{B.REFERENCE}', 1) AS refs FROM vs JOIN selected ON selected.brief_id = vs.brief_id JOIN cites ON cites.brief_id = vs.brief_id WHERE heading IS NULL AND section IS NOT NULL AND trim(line) <> ''),
 v1 AS (SELECT *, section = 'EXECUTIVE SUMMARY' AS summary, regexp_matches(ltrim(text), '^[-*•]') AS bullet, lower(trim(regexp_replace(trim(regexp_replace(text, '^[ \\t]*[-*•][ \\t]*', '')), '[*_`]', '', 'g'))) AS plain FROM v0),
 v2 AS (SELECT *, section = 'KEY DEVELOPMENTS BY TOPIC' AND bullet AND list_contains({_list([t.lower() for t in V.TOPICS])}, trim(regexp_replace(plain, ':$', ''))) AS label FROM v1),
 v3 AS (SELECT brief_id, count(*) FILTER (summary AND NOT bullet) AS prose_in_summary, count(*) FILTER (NOT (summary AND NOT bullet) AND len(refs) > 0 AND len(list_filter(refs, lambda r: NOT list_contains(ids, r))) > 0) AS invalid_reference,
   count(*) FILTER (NOT (summary AND NOT bullet) AND len(refs) = 0 AND cites AND list_contains({_list(V.CLAIM_SECTIONS)}, section) AND bullet AND NOT label) AS uncited_claim, CAST(count(*) FILTER (summary AND bullet AND starts_with(plain, 'tidemark')) > 1 AS BIGINT) AS opener_repeated, CAST(bool_or(summary) AND NOT bool_or(summary AND bullet) AS BIGINT) AS summary_without_bullets FROM v2 GROUP BY 1)
 SELECT brief_id, error, n FROM (UNPIVOT v3 ON prose_in_summary, invalid_reference, uncited_claim, opener_repeated, summary_without_bullets INTO NAME error VALUE n) WHERE n > 0""")
def brief_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What drafts of briefs do against the rules."""
    lines = _lines(spark, sf_dir)
    return B.validation(lines, _selected(lines)[0], "Tidemark")


@query("F-s33", _LINES + r"SELECT brief_id, arg_min(trim(regexp_extract(line, '(?i)^[ \t]*period:[ \t]*(.*)$', 1)), line_no) AS period FROM lines WHERE regexp_matches(line, '(?i)^[ \t]*period:') GROUP BY 1")
def brief_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.period(_lines(spark, sf_dir))


_LABELLED = "line"
for _r, _l in (("r", "first"), ("s", "second")):
    _LABELLED = f"regexp_replace({_LABELLED}, '(?i)(^|[^A-Za-z0-9_])REC[ \\t]*[:#][ \\t]*{_r}([0-9]+)($|[^A-Za-z0-9_-])', '\\1[{_l} \\2]\\3', 'g')"


@query("F-s14, F-s20", _LINES + f"""SELECT line_no, md5({_LABELLED}) AS labelled_md5, md5(regexp_replace(array_to_string(list_transform(string_split(line || ' $1 `$2` $3', '`'), lambda x, i: CASE WHEN i % 2 = 1 THEN replace(x, '$', '\\$') ELSE x END), '`'), '^[ ]{{2,}}([A-Z][A-Za-z ]*:)', '> \\1')) AS escaped_md5 FROM lines""")
def brief_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with citations as source labels, and with dollar signs escaped outside of code."""
    lines = _lines(spark, sf_dir)
    own = F.col("brief_id").cast("string")
    labels = F.create_map(F.concat(F.lit("r"), own), F.concat(F.lit("first "), own), F.concat(F.lit("s"), own), F.concat(F.lit("second "), own))
    return lines.select("line_no", F.md5(B.labelled(F.col("line"), labels)).alias("labelled_md5"), F.md5(B.escaped(F.concat("line", F.lit(" $1 `$2` $3")))).alias("escaped_md5"))


_CASES = " ".join(f"OR (region = '{w}' AND len(list_intersect(there, {_list(n)})) > 0)" for w, n in V.WIDER_REGIONS.items()) + " ".join(f" OR (list_contains({_list(b)}, region) AND len(list_intersect(there, {_list(c)})) > 0)" for c, b in V.BUCKETS_BY_COUNTRY)


@query("A30", f"""WITH c AS (SELECT source_type, region, count(*) AS n FROM (SELECT source_type, unnest(regions) AS region FROM records) WHERE list_contains({_list(V.REGIONS)}, region) GROUP BY ALL), t AS (SELECT source_type, list(region) AS there FROM c GROUP BY 1),
 k AS (SELECT c.*, row_number() OVER (PARTITION BY c.source_type ORDER BY n DESC, region) AS rn FROM c JOIN t ON t.source_type = c.source_type WHERE NOT (false {_CASES})) SELECT source_type, region, n, CAST(rn AS INTEGER) AS place FROM k WHERE rn <= 8""", on_records=True)
def focused_regions(r: DataFrame) -> DataFrame:
    """The regions that a brief of each publisher would speak of."""
    return B.focused_regions(r, "source_type")


_LABELS = ["", "2024-01-01 to 2024-01-07", "last 14 days by created_at", "Last 3 days", "last 900 days by publish date", "custom", "last 0 days"]
_LABEL = f"{_list(_LABELS)}[(n % {len(_LABELS)}) + 1]"
_FORM = "(?i)^last[ \\t]+([0-9]{1,6})[ \\t]+days([ \\t]+by[ \\t]+([a-z_ ]+))?$"
_BY = f"lower(trim(regexp_extract(label, '{_FORM}', 3)))"
_SPAN = lambda d: f"CAST(DATE '{AS_OF}' - CAST({d} AS INTEGER) AS VARCHAR) || ' to {AS_OF}'"


@query("F-d9, P18", f"""WITH l AS (SELECT record_id, {_LABEL} AS label FROM records)
 SELECT record_id, CASE WHEN label = '' THEN {_SPAN(30)} || ' (Publish date)' WHEN contains(label, ' to ') AND regexp_matches(label, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN label WHEN regexp_extract(label, '{_FORM}', 1) <> '' THEN {_SPAN(f"greatest(CAST(nullif(regexp_extract(label, '{_FORM}', 1), '') AS INTEGER), 1)")} || CASE WHEN {_BY} IN ('created_at', 'upload date', 'upload_date', 'created') THEN ' (Upload date)' WHEN {_BY} IN ('publish_date', 'publish date', 'published', 'publication date') THEN ' (Publish date)' ELSE '' END ELSE label END AS week_range,
  CAST(CASE WHEN regexp_extract(label, '(?i)(^|[^A-Za-z0-9_])last[ \\t]+([0-9]{{1,6}})[ \\t]+days($|[^A-Za-z0-9_])', 2) = '' THEN 7 ELSE least(greatest(CAST(nullif(regexp_extract(label, '(?i)(^|[^A-Za-z0-9_])last[ \\t]+([0-9]{{1,6}})[ \\t]+days($|[^A-Za-z0-9_])', 2), '') AS INTEGER), 1), 365) END AS INTEGER) AS days FROM l""", on_records=True)
def week_ranges(r: DataFrame) -> DataFrame:
    """Labels of ranges with their dates, and the days they stand for."""
    label = F.element_at(texts(_LABELS), (F.col("n") % len(_LABELS) + 1).cast("int"))
    return r.select("record_id", B.week_range(label, AS_OF).alias("week_range"), B.days_of(label).alias("days"))


@query("T22", f"""WITH {_BRIEFS}, g AS (SELECT brief_id, count(*) AS n FROM b GROUP BY 1), d AS (SELECT 'brief-' || source_type AS brief_id, min(publish_date) AS a, max(publish_date) AS z FROM records GROUP BY 1)
 SELECT g.brief_id, n, CASE WHEN n <= 1 THEN 'single' WHEN n <= 4 THEN 'compact' ELSE 'standard' END AS mode, CASE WHEN a IS NOT NULL THEN a || ' to ' || z || ' (Publish date)' ELSE 'Publish date unavailable' END AS week_range FROM g LEFT JOIN d ON d.brief_id = g.brief_id""", on_records=True)
def brief_modes(r: DataFrame) -> DataFrame:
    """How long a brief of so many records may be, and the range of its publisher's dates."""
    n = _briefs(r).groupBy("brief_id").agg(F.count(F.lit(1)).alias("n"))
    ranges = B.publish_range(r, "source_type").select(F.concat(F.lit("brief-"), "source_type").alias("brief_id"), "week_range")
    return n.join(ranges, "brief_id", "left").select("brief_id", "n", B.mode(F.col("n")).alias("mode"), F.coalesce("week_range", F.lit("Publish date unavailable")).alias("week_range"))


#: Index rows of a publisher's briefs, one for each level of priority; sidecars repeat some and add those of the confidence levels.
_HISTORY = """idx AS (SELECT source_type || '-' || priority || '.md' AS file, 'brief_' || source_type AS family, CAST(count(*) AS INTEGER) AS version, max(created_at) AS created_at FROM records GROUP BY source_type, priority),
 side AS (SELECT file, family, version + 100 AS version, created_at FROM idx WHERE file LIKE '%High%' UNION ALL SELECT source_type || '-' || confidence || '-c.md', 'brief_' || source_type, CAST(count(*) AS INTEGER), max(created_at) FROM records GROUP BY source_type, confidence),
 hist AS (SELECT * FROM idx UNION ALL SELECT * FROM side s WHERE NOT EXISTS (SELECT 1 FROM idx i WHERE i.file = s.file AND i.created_at = s.created_at)) """


def _history(r: DataFrame) -> DataFrame:
    one = lambda c, end: r.groupBy("source_type", c).agg(F.count(F.lit(1)).cast("int").alias("version"), F.max("created_at").alias("created_at")).select(F.concat("source_type", F.lit("-"), c, F.lit(end)).alias("file"), F.concat(F.lit("brief_"), "source_type").alias("family"), "version", "created_at")
    index = one("priority", ".md")
    sidecars = index.where(F.col("file").contains("High")).withColumn("version", F.col("version") + 100).unionByName(one("confidence", "-c.md"))
    return M.merge_history(index, sidecars)


@query("U3", "WITH " + _HISTORY + "SELECT file, version, CAST(created_at AS VARCHAR) AS created_at FROM hist", on_records=True)
def brief_history(r: DataFrame) -> DataFrame:
    """Index and sidecars as one history; a file's index row counts where both have it."""
    return _history(r).select("file", "version", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("T31, O6", "WITH " + _HISTORY + """, ids AS (SELECT source_type || '-' || priority || '.md' AS file, doc_id AS pos, record_id, topics FROM records UNION ALL SELECT source_type || '-' || confidence || '-c.md', doc_id, CASE WHEN n % 5 = 0 THEN 'gone-' || record_id ELSE record_id END, CASE WHEN n % 5 = 0 THEN NULL ELSE topics END FROM records),
 codes AS (SELECT family, 'BRIEF-' || lpad(CAST(row_number() OVER (ORDER BY min(created_at), family) AS VARCHAR), 3, '0') AS code FROM hist GROUP BY 1), newest AS (SELECT * FROM hist ORDER BY created_at DESC, file DESC LIMIT 5),
 tp AS (SELECT file, topic, min({'pos': pos, 'nth': nth}) AS first FROM (SELECT file, pos, unnest(topics) AS topic, generate_subscripts(topics, 1) AS nth FROM ids WHERE file IN (SELECT file FROM newest)) GROUP BY ALL), t3 AS (SELECT file, topic, row_number() OVER (PARTITION BY file ORDER BY first) AS rn FROM tp),
 tt AS (SELECT file, string_agg(topic, '; ' ORDER BY rn) AS topics FROM t3 WHERE rn <= 3 GROUP BY 1), cn AS (SELECT file, count(*) AS n_ids, count(*) FILTER (starts_with(record_id, 'gone-')) AS n_missing FROM ids GROUP BY 1)
 SELECT n.file, c.code, n.version, cn.n_ids, cn.n_missing, coalesce(tt.topics, '') AS topics FROM newest n JOIN codes c ON c.family = n.family LEFT JOIN cn ON cn.file = n.file LEFT JOIN tt ON tt.file = n.file""", on_records=True)
def saved_briefs(r: DataFrame) -> DataFrame:
    """The five newest briefs with their codes, ids and first topics."""
    one = lambda c, end, name: r.select(F.concat("source_type", F.lit("-"), c, F.lit(end)).alias("file"), F.col("doc_id").alias("pos"), name.alias("record_id"))
    lost = F.when(F.col("n") % 5 == 0, F.concat(F.lit("gone-"), "record_id")).otherwise(F.col("record_id"))
    chosen = one("priority", ".md", F.col("record_id")).unionByName(one("confidence", "-c.md", lost))
    return B.listing(_history(r), chosen, r)


@query("S19", _LINES + f""", x AS (SELECT brief_id, section, trim(string_agg(line, chr(10) ORDER BY line_no)) AS body FROM sec WHERE section <> 'UNKNOWN' GROUP BY ALL)
 SELECT brief_id, section, md5(CASE WHEN list_contains({_list(V.OPEN_SECTIONS)}, section) THEN section || CASE WHEN body = '' THEN '' ELSE chr(10) || body END ELSE '<details>' || chr(10) || '<summary>' || section || '</summary>' || chr(10) || chr(10) || CASE WHEN body = '' THEN '_No content in this section._' ELSE body END || chr(10) || chr(10) || '</details>' END) AS block_md5 FROM x""")
def brief_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of briefs as they are saved."""
    return B.collapsible(_lines(spark, sf_dir)).select("brief_id", "section", F.md5("block").alias("block_md5"))


@query("M11, M12", "WITH " + _HISTORY + """, doomed AS (SELECT file FROM hist WHERE version < 3), f AS (SELECT file AS name FROM hist UNION SELECT replace(file, '.md', '.meta.json') FROM hist)
 SELECT 'left' AS what, file AS name, CASE WHEN version % 2 = 0 THEN 'superseded' ELSE 'final' END AS status FROM hist WHERE file NOT IN (SELECT file FROM doomed) UNION ALL SELECT 'removed', name, NULL FROM f WHERE name IN (SELECT file FROM doomed UNION SELECT replace(file, '.md', '.meta.json') FROM doomed)""", on_records=True)
def brief_cascade(r: DataFrame) -> DataFrame:
    """What is left of the index after small briefs went with their files, with the sidecars' status set from it."""
    h = _history(r)
    names = h.select("file").distinct()
    files = names.select(F.explode(F.array("file", F.regexp_replace("file", r"\.md$", ".meta.json"))).alias("name"))
    left, gone = M.cascade(h, files, h.where("version < 3"))
    status = left.select("file", "version", F.when(F.col("version") % 2 == 0, "superseded").otherwise("final").alias("status"))
    synced = M.sync_sidecar(left.select("file", F.lit("draft").alias("status"), F.lit(None).cast("int").alias("version")), status)
    return synced.select(F.lit("left").alias("what"), F.col("file").alias("name"), "status").unionByName(gone.select(F.lit("removed").alias("what"), "name", F.lit(None).cast("string").alias("status")))
