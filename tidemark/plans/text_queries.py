"""Queries over text: cleaning, routing, chunks, dates, fuzzy titles, briefs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import bounded, plain_text, title_fingerprint
from tidemark.operators import chunking as K
from tidemark.operators import cleaning as C
from tidemark.operators import fuzzy as Z
from tidemark.operators.dedupe import dedupe_key
from tidemark.operators.records import _list
from tidemark.sources.stores import materialised

from .catalog import query, table


def _q(pattern: str) -> str:
    return pattern.replace("'", "''")


def _reasons_sql(source: str) -> str:
    groups = " ".join(f"WHEN {' OR '.join(f'''regexp_matches(line, '{_q(bounded(p))}')''' for p in ps)} THEN '{g}'" for g, ps in V.JUNK_PATTERNS.items())
    return rf"""WITH src AS ({source}),
 l AS (SELECT doc_id, length(coalesce(text, '')) AS raw, list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '([A-Za-z])-[ \t\r\n\f]*\n[ \t\r\n\f]*([A-Za-z])', '\1\2', 'g'), '\r\n?', chr(10), 'g'), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\n\f]+', ' ', 'g'))), lambda x: x <> '') AS ls FROM src),
 e AS (SELECT doc_id, raw, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS idx FROM l),
 c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n_lines, count(*) OVER (PARTITION BY doc_id, line) AS n_same, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS words, replace(line, ' ', '') AS solid, regexp_replace(line, '[^A-Za-z]+', ' ', 'g') AS letters FROM e),
 r AS (SELECT *, CASE WHEN n_same >= greatest(3, floor(n_lines * 0.015)) AND words <= 12 THEN 'repeated_header_footer' WHEN regexp_matches(line, '{_q(V.PAGE_NUMBER)}') THEN 'page_number'
   WHEN len(regexp_extract_all(line, '{_q(V.URL_MARK)}')) >= 2 THEN 'link_heavy' WHEN idx > 10 AND regexp_matches(line, '{_q(V.BARE_URL)}') THEN 'link_heavy'
   WHEN length(regexp_replace(solid, '\p{{L}}', '', 'g')) / greatest(length(solid), 1)::DOUBLE > 0.35 AND NOT (regexp_matches(line, '[0-9]') AND contains(line, '|')) AND NOT regexp_matches(line, '{_q(V.STAMP)}') THEN 'symbol_heavy'
   {groups} WHEN regexp_matches(line, '{_q(V.CREDIT)}') AND words < 8 THEN 'image_credit_short' END AS early FROM c),
 m AS (SELECT *, early IS NULL AND len(list_filter(string_split(letters, ' '), lambda w: w <> '')) BETWEEN 1 AND 6 AND length(line) <= 60 AND upper(letters) = letters AS menu FROM r),
 f AS (SELECT *, min(CASE WHEN menu AND idx < 20 THEN idx END) OVER (PARTITION BY doc_id) AS first_menu FROM m),
 reasons AS (SELECT doc_id, raw, idx, line, coalesce(early, CASE WHEN menu AND NOT coalesce(idx = first_menu, false) THEN 'short_allcaps_menu' WHEN regexp_matches(line, '{_q(V.BYLINE)}') AND words <= 8 THEN 'byline' END) AS reason FROM f),
 meta AS (SELECT doc_id, count(*) AS n_lines, count(reason) AS n_removed, CAST(max(raw) AS BIGINT) AS raw_chars,
   coalesce(array_to_string(list_sort(list(DISTINCT reason) FILTER (reason IS NOT NULL)), ','), '') AS reasons, coalesce(string_agg(line, chr(10) ORDER BY idx) FILTER (reason IS NULL), '') AS clean_text FROM reasons GROUP BY 1),
 cleaned AS (SELECT *, greatest(0, raw_chars - length(clean_text)) AS removed_chars, removed_chars / greatest(raw_chars, 1)::DOUBLE AS ratio FROM meta) """


_DOCS = _reasons_sql("SELECT doc_id, text FROM documents")
_PAGES = _reasons_sql(r"SELECT page_id AS doc_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', chr(10), 'g') AS text FROM pages")


def page_text(pages: DataFrame) -> DataFrame:
    """doc_id and text of pages: scripts and styles gone, tags as line ends."""
    t = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", "\n")
    return pages.select(F.col("page_id").alias("doc_id"), t.alias("text"))


@query("T1, A24, A25, W12", _DOCS + "SELECT reason, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM reasons WHERE reason IS NOT NULL GROUP BY 1")
def line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.line_reasons(table(spark, sf_dir, "documents"))
    return r.where("reason IS NOT NULL").groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("T1", _DOCS + "SELECT doc_id, n_lines, n_removed, raw_chars, removed_chars, reasons, md5(clean_text) AS clean_md5 FROM cleaned")
def clean_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.clean_meta(C.line_reasons(table(spark, sf_dir, "documents")))
    return m.select("doc_id", "n_lines", "n_removed", "raw_chars", "removed_chars", "reasons", F.md5("clean_text").alias("clean_md5"))


@query("T1 on pages", _PAGES + "SELECT doc_id, n_lines, n_removed, raw_chars, removed_chars, reasons, md5(clean_text) AS clean_md5 FROM cleaned")
def page_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = C.clean_meta(C.line_reasons(page_text(table(spark, sf_dir, "pages"))))
    return m.select("doc_id", "n_lines", "n_removed", "raw_chars", "removed_chars", "reasons", F.md5("clean_text").alias("clean_md5"))


@query("A24", _PAGES + "SELECT line, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM reasons WHERE reason = 'repeated_header_footer' GROUP BY 1 ORDER BY n DESC, line LIMIT 20")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = C.line_reasons(page_text(table(spark, sf_dir, "pages"))).where("reason = 'repeated_header_footer'")
    return r.groupBy("line").agg(F.countDistinct("doc_id").alias("n_docs"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "line").limit(20)


_NOISY = " OR ".join(f"list_contains(string_split(reasons, ','), '{p}')" for p in V.NOISE["high_patterns"])
_LEVEL = f"""CASE WHEN ratio > {V.NOISE["high_ratio"]} OR n_removed > {V.NOISE["high_lines"]} OR {_NOISY} THEN 'high' WHEN ratio < {V.NOISE["low_ratio"]} AND n_removed < {V.NOISE["low_lines"]} THEN 'low' ELSE 'normal' END"""


@query("T7, F-m1", _PAGES + f"""SELECT doc_id, round(ratio, 3) AS removed_ratio, {_LEVEL} AS noise_level, CASE WHEN {_LEVEL} = 'high' THEN 'strong' ELSE 'lite' END AS model, CAST(clean_text <> '' AS INTEGER) AS n_chunks, false AS chunked FROM cleaned""")
def route_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.route(C.clean_meta(C.line_reasons(page_text(table(spark, sf_dir, "pages"))))).select("doc_id", "removed_ratio", "noise_level", "model", "n_chunks", "chunked")


@query("T2", _PAGES + f"""SELECT c.doc_id, md5(CASE WHEN length(trim(clean_text)) = 0 OR (length(clean_text) < {V.SHORT_CLEAN} AND length(text) >= {V.SHORT_CLEAN}) THEN text ELSE clean_text END) AS text_md5, clean_text = '' OR (length(clean_text) < {V.SHORT_CLEAN} AND length(text) >= {V.SHORT_CLEAN}) AS fell_back FROM cleaned c JOIN src ON src.doc_id = c.doc_id""")
def clean_or_original(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned pages, or the original where cleaning left too little."""
    pages = page_text(table(spark, sf_dir, "pages"))
    both = C.clean_meta(C.line_reasons(pages)).select("doc_id", "clean_text").join(pages, "doc_id")
    chosen = C.with_fallback(F.col("clean_text"), F.col("text"))
    little = (F.col("clean_text") == "") | ((F.length("clean_text") < V.SHORT_CLEAN) & (F.length("text") >= V.SHORT_CLEAN))
    return both.select("doc_id", F.md5(chosen).alias("text_md5"), little.alias("fell_back"))


_TITLES = r"""WITH l AS (SELECT doc_id, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))[1:40] AS ls FROM documents), e AS (SELECT doc_id, trim(regexp_replace(unnest(ls), '[ \t\r\n\f]+', ' ', 'g')) AS line, generate_subscripts(ls, 1) AS idx FROM l),
 w AS (SELECT *, regexp_extract_all(line, '[A-Za-z][A-Za-z''-]*') AS ws, len(list_filter(string_split(line, ' '), lambda w: w <> '')) AS parts FROM e), k AS (SELECT *, len(ws) AS n, len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z]'))) AS up, len(list_filter(ws, lambda w: regexp_matches(w, '^[A-Z''-]+$'))) AS shout FROM w)
 SELECT doc_id, arg_min(line, idx) AS title FROM k WHERE line <> '' AND NOT regexp_matches(line, '(?i)https?://|www\.') AND ((contains(line, ' - ') AND parts BETWEEN 6 AND 30) OR (n BETWEEN 6 AND 20 AND up >= 0.55 * n AND shout < 0.7 * n)) GROUP BY 1"""


@query("T3", _TITLES)
def detect_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.title_line(table(spark, sf_dir, "documents"))


BROADCAST_WORDS = 200_000
WATCH, TERMS = ["tionble", "lowe"], ["erst", "keit"]
_ANY = lambda c, parts: "(" + " OR ".join(f"contains({c}, '{p}')" for p in parts) + ")"
_MONTH = "(Jan|January|Feb|February|Mar|March|Apr|April|May|Jun|June|Jul|July|Aug|August|Sep|Sept|September|Oct|October|Nov|November|Dec|December)"
_CHUNKS = rf"""WITH p AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS cs FROM documents), ch AS (SELECT doc_id, unnest(cs) AS chunk, generate_subscripts(cs, 1) - 1 AS idx FROM p),
 x AS (SELECT *, lower(chunk) AS low, trim(chunk) AS tl, list_filter(string_split(regexp_replace(trim(chunk), '[^A-Za-z]+', ' ', 'g'), ' '), lambda t: t <> '') AS ws FROM ch),
 g AS (SELECT *, regexp_matches(chunk, '(?i)(^|[^A-Za-z0-9_])(20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}\s+{_MONTH}\s+20[0-9]{{2}}|{_MONTH}\.?\s+[0-9]{{1,2}},\s+20[0-9]{{2}})($|[^A-Za-z0-9_])') AS f1, {_ANY("low", V.PUBLISHER_MARKERS)} AS f2, {_ANY("low", V.COPYRIGHT_MARKERS)} AS f3,
   {_ANY("low", WATCH)} AS f4, {_ANY("low", TERMS)} AS f5, {_ANY("low", V.NUMERIC_MARKERS)} AS f6, {_ANY("low", V.NOISE_MARKERS)} AS f7, len(regexp_extract_all(low, 'https?://')) >= 2 AS f8,
   length(tl) > 0 AND (length(tl) < 25 OR (len(ws) BETWEEN 1 AND 5 AND len(list_filter(ws, lambda t: NOT (list_contains({_list(V.NAV_WORDS)}, lower(t)) OR regexp_matches(t, '^[A-Z][a-z]*$')))) = 0)) AS f9 FROM x),
 s AS (SELECT *, 5 * f1::INT + 5 * f2::INT + 3 * f3::INT + 3 * f4::INT + 2 * f5::INT + f6::INT - 5 * f7::INT - 3 * f8::INT - 3 * f9::INT AS score, f1 OR f2 OR f3 AS is_header FROM g) """


def _line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return C.chunk_scores(table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("idx", "chunk")), WATCH, TERMS)


@query("T5, F-s23, F-s24", _CHUNKS + "SELECT doc_id, CAST(idx AS INTEGER) AS idx, CAST(score AS INTEGER) AS score FROM s")
def chunk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line_chunks(spark, sf_dir).select("doc_id", "idx", "score")


@query("W10, T6", _CHUNKS + """, h AS (SELECT *, is_header AND row_number() OVER (PARTITION BY doc_id, is_header ORDER BY score DESC, idx) <= 2 AS taken FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, taken ORDER BY score DESC, idx) AS rn FROM h)
 SELECT doc_id, CAST(idx AS INTEGER) AS idx, CASE WHEN taken THEN 'header' ELSE 'body' END AS part FROM b WHERE taken OR rn <= 6""")
def context_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.select_chunks(_line_chunks(spark, sf_dir)).select("doc_id", "idx", "part")


@query("A19, A21, A22", """WITH v AS (SELECT conv_id, turn, role, text, CASE length(text) % 4 WHEN 0 THEN 'Other' WHEN 1 THEN 'Reuters' ELSE 'S&P' END AS source FROM conversations),
 k AS (SELECT conv_id, source, count(*) AS n, min(turn) AS first FROM v GROUP BY ALL), b AS (SELECT conv_id, source, row_number() OVER (PARTITION BY conv_id ORDER BY (source = 'Other'), n DESC, first) AS rn FROM k),
 t AS (SELECT conv_id, arg_min(text, turn) FILTER (trim(text) <> '') AS title, count(*) AS n_chunks, bool_or(role = 'system') AS has_system, max(struct_pack(r := length(text) % 3, d := turn)).d AS best_turn FROM v GROUP BY 1)
 SELECT t.conv_id, b.source, md5(t.title) AS title_md5, t.n_chunks, t.has_system, t.best_turn FROM t JOIN b ON b.conv_id = t.conv_id AND rn = 1""")
def chunk_merge_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    v = table(spark, sf_dir, "conversations").withColumn("source", F.when(n % 4 == 0, "Other").when(n % 4 == 1, "Reuters").otherwise("S&P"))
    votes = v.groupBy("conv_id", "source").agg(F.count(F.lit(1)).alias("n"), F.min("turn").alias("first"))
    choice = votes.groupBy("conv_id").agg(F.max_by("source", F.struct((F.col("source") != "Other").alias("named"), "n", (-F.col("first")).alias("early"))).alias("source"))
    rest = v.groupBy("conv_id").agg(F.min_by(F.when(F.trim("text") != "", F.col("text")), F.when(F.trim("text") != "", F.col("turn"))).alias("title"), F.count(F.lit(1)).alias("n_chunks"), F.bool_or(F.col("role") == "system").alias("has_system"), F.max(F.struct((n % 3).alias("r"), F.col("turn").alias("d"))).alias("best"))
    return rest.join(choice, "conv_id").select("conv_id", "source", F.md5("title").alias("title_md5"), "n_chunks", "has_system", F.col("best.d").alias("best_turn"))


@query("W4, W5, W13, F-s21", """WITH n AS (SELECT doc_id, 'brief_' || (doc_id % 12) || CASE WHEN doc_id % 3 = 0 THEN '' ELSE '-v' || (doc_id % 7 + 2) END AS name FROM documents),
 p AS (SELECT doc_id, regexp_extract(name, '^(.+?)(-v([0-9]+))?$', 1) AS family, CAST(coalesce(nullif(regexp_extract(name, '^(.+?)(-v([0-9]+))?$', 3), ''), '1') AS INTEGER) AS version FROM n),
 f AS (SELECT family, min(doc_id) AS first, max(version) AS latest FROM p GROUP BY 1), c AS (SELECT family, latest, 'BRIEF-' || lpad(CAST(row_number() OVER (ORDER BY first) AS VARCHAR), 3, '0') AS code FROM f)
 SELECT p.doc_id, c.code, p.version, CASE WHEN p.version < c.latest THEN 'superseded' ELSE 'final' END AS status, CAST(greatest(2, c.latest + 1) AS INTEGER) AS next_version FROM p JOIN c ON c.family = p.family""")
def brief_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.lit("brief_"), (d % 12).cast("string"), F.when(d % 3 == 0, "").otherwise(F.concat(F.lit("-v"), (d % 7 + 2).cast("string"))))
    pattern = "^(.+?)(-v([0-9]+))?$"
    p = table(spark, sf_dir, "documents").select("doc_id", F.regexp_extract(name, pattern, 1).alias("family"), F.coalesce(F.nullif(F.regexp_extract(name, pattern, 3), F.lit("")), F.lit("1")).cast("int").alias("version"))
    f = p.groupBy("family").agg(F.min("doc_id").alias("first"), F.max("version").alias("latest"))
    # a row for each family of briefs
    c = f.select("family", "latest", F.concat(F.lit("BRIEF-"), F.lpad(F.row_number().over(Window.orderBy("first")).cast("string"), 3, "0")).alias("code"))
    return p.join(c, "family").select("doc_id", "code", "version", F.when(F.col("version") < F.col("latest"), "superseded").otherwise("final").alias("status"), F.greatest(F.lit(2), F.col("latest") + 1).alias("next_version"))




def _fingerprints(r: DataFrame) -> DataFrame:
    """A row for each title fingerprint, named by its first record; key: the least dedupe key."""
    fp = title_fingerprint(F.coalesce("title", F.lit("")), V.TITLE_STOPWORDS)
    return r.groupBy(fp.alias("title")).agg(F.min("record_id").alias("id"), F.min(dedupe_key()).alias("key")).where("title <> ''")


@query("J10, F-s9", on_records=True)
def fuzzy_self_join(r: DataFrame) -> DataFrame:
    """Pairs of similar title fingerprints (0.85) of different stories, each named by its first record."""
    t = materialised(_fingerprints(r), "fingerprints")
    pairs = Z.fuzzy_pairs(t.select("id", "title"), 0.85)
    keys = t.select("id", "key")
    return pairs.join(keys.toDF("a", "key_a"), "a").join(keys.toDF("b", "key_b"), "b").where("key_a <> key_b").select("a", "b", "ratio")


@query("J9", on_records=True)
def fuzzy_titles(r: DataFrame) -> DataFrame:
    """For each title fingerprint of pending records, the most similar (0.88) among the others."""
    t = _fingerprints(r.where("review_status = 'Pending'")).select("id", "title")
    return Z.best_match(t, _fingerprints(r.where("review_status <> 'Pending'")).select("id", "title"), 0.88)


@query("J11", on_records=True)
def relink_ids(r: DataFrame) -> DataFrame:
    """Ids of disapproved records to those of others: by URL, else by title, else by similar title (0.93)."""
    url = F.rtrim(F.regexp_replace(F.lower(F.trim("url")), "#.*$", ""), F.lit("/"))
    keyed = r.select(F.col("record_id").alias("id"), plain_text(F.coalesce("title", F.lit(""))).alias("title_key"), F.when(F.col("priority") != "Low", url).alias("url_key"), F.lower(F.trim("source_type")).alias("source"), F.col("publish_date").alias("day"), F.col("created_at").alias("created"), "review_status")
    keyed = materialised(keyed, "keyed")
    old = keyed.where("review_status = 'Disapproved'").withColumn("id", F.concat(F.lit("old-"), "id"))
    return Z.relinked(old, keyed.where("review_status <> 'Disapproved'"))


_WS = r"[ \t\n\x0B\f\r]"
_PARAGRAPHS = rf"list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '\n{_WS}*\n+'), lambda p: regexp_replace(p, '^{_WS}+|{_WS}+$', '', 'g')), lambda p: p <> '')"
_SENTENCES = rf"list_filter(list_transform(string_split(regexp_replace(p, '([.!?]){_WS}+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"
_GROWN = "CASE WHEN a.open = '' THEN x.open ELSE a.open || ' ' || x.open END"
#: A fold over sentences: chunks that are done, and the one that is open.
_FOLD = f"""list_reduce(list_concat([{{'done': []::VARCHAR[], 'open': ''}}], list_transform({_SENTENCES}, lambda s: {{'done': []::VARCHAR[], 'open': s}})),
  lambda a, x: CASE WHEN a.open <> '' AND length({_GROWN}) > 1200 THEN {{'done': list_append(a.done, a.open), 'open': x.open}} WHEN length({_GROWN}) >= 800 THEN {{'done': list_append(a.done, {_GROWN}), 'open': ''}} ELSE {{'done': a.done, 'open': {_GROWN}}} END)"""


@query("T4, W8", f"""WITH p AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM (SELECT doc_id, {_PARAGRAPHS} AS ps FROM documents)),
 r AS (SELECT doc_id, k, CASE WHEN length(p) <= 1200 THEN {{'done': [p], 'open': ''}} ELSE {_FOLD} END AS r FROM p),
 c AS (SELECT doc_id, k, unnest(chunks) AS chunk, generate_subscripts(chunks, 1) AS j FROM (SELECT doc_id, k, CASE WHEN r.open = '' THEN r.done ELSE list_append(r.done, r.open) END AS chunks FROM r))
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS INTEGER) AS idx, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS chunk_md5 FROM c""")
def pack_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentence-bounded chunks of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(K.sentence_chunks(F.col("text"))).alias("idx", "chunk"))
    return d.select("doc_id", "idx", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


_MOST, _OVERLAP = 1500, 200
_FRAME = V.CHUNK_HEADER.split("{i}")[0], V.CHUNK_HEADER.split("{i}")[1].split("{n}")[0], V.CHUNK_HEADER.split("{n}")[1].split("{t}")[0], V.CHUNK_HEADER.split("{t}")[1]
_TAIL_END = rf"""regexp_replace(CASE WHEN length(a[-1]) > {_OVERLAP} AND regexp_matches(substring(a[-1], length(a[-1]) - {_OVERLAP}, 2), '^[\p{{L}}\p{{N}}]{{2}}$') THEN regexp_replace(right(a[-1], {_OVERLAP}), '^[\p{{L}}\p{{N}}]+', '') ELSE right(a[-1], {_OVERLAP}) END, '^{_WS}+|{_WS}+$', '', 'g')"""
_LF2 = "chr(10) || chr(10)"


def _plain(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


@query("W7, T1", f"""WITH titles AS ({_TITLES}), d AS (SELECT d.doc_id, replace(d.text, chr(10), {_LF2}) AS text, coalesce(t.title, '') AS title FROM documents d LEFT JOIN titles t ON t.doc_id = d.doc_id),
 p AS (SELECT doc_id, title, greatest({V.CHUNK_LEAST}, {_MOST - V.CHUNK_SPARE - sum(map(len, _FRAME)) - 2} - length(title)) AS room, {_PARAGRAPHS} AS ps FROM d),
 k AS (SELECT doc_id, title, list_reduce(list_transform(ps, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + 2 + length(x[1]) <= room THEN list_append(a[1:len(a) - 1], a[-1] || {_LF2} || x[1]) ELSE list_append(a, x[1]) END) AS packed FROM p WHERE len(ps) > 0),
 l AS (SELECT doc_id, title, list_reduce(list_transform(packed, lambda x: [x]), lambda a, x: list_append(a, CASE WHEN {_TAIL_END} = '' THEN x[1] ELSE {_TAIL_END} || {_LF2} || x[1] END)) AS led FROM k),
 c AS (SELECT doc_id, title, len(led) AS n, unnest(led) AS body, generate_subscripts(led, 1) AS i FROM l),
 o AS (SELECT doc_id, i, {_plain(_FRAME[0])} || i || {_plain(_FRAME[1])} || n || {_plain(_FRAME[2])} || title || {_plain(_FRAME[3])} || body AS chunk FROM c)
 SELECT doc_id, CAST(i - 1 AS INTEGER) AS idx, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS chunk_md5 FROM o""")
def overlap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a header that begin with the tail of the chunk before; lines are taken for paragraphs."""
    docs = table(spark, sf_dir, "documents")
    titled = docs.select("doc_id", "text").join(C.title_line(docs), "doc_id", "left")
    d = titled.select("doc_id", F.posexplode(K.overlap_chunks(F.replace("text", F.lit("\n"), F.lit("\n\n")), F.coalesce("title", F.lit("")), _MOST, _OVERLAP)).alias("idx", "chunk"))
    return d.select("doc_id", "idx", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


_HEAD, _TAIL = "'TITLE: ' || chr(10) || chr(10) || 'DOC_HEADER_CHUNKS:'", "chr(10) || 'CONSTRAINTS:' || chr(10) || 'Use only these chunks. Ignore ads/sidebars/navigation.'"


@query("T6", _CHUNKS + f""", h AS (SELECT *, is_header AND row_number() OVER (PARTITION BY doc_id, is_header ORDER BY score DESC, idx) <= 2 AS taken FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, taken ORDER BY score DESC, idx) AS rn FROM h),
 c AS (SELECT *, sum(length(chunk) + 6) OVER (PARTITION BY doc_id, taken ORDER BY score DESC, idx) AS used FROM b WHERE taken OR rn <= 6),
 hg AS (SELECT doc_id, coalesce(sum(length(chunk) + 6) FILTER (taken), 0) AS heads FROM c GROUP BY 1),
 k AS (SELECT c.*, row_number() OVER (PARTITION BY c.doc_id, taken ORDER BY idx) AS place FROM c JOIN hg ON hg.doc_id = c.doc_id WHERE taken OR heads + used + {V.PACK_FRAME} <= {V.PACK_CHARS}),
 o AS (SELECT hg.doc_id, {_HEAD} || coalesce(string_agg(chr(10) || '[H' || place || '] ' || chunk, '' ORDER BY place) FILTER (taken), '') || chr(10) || chr(10) || 'DOC_BODY_CHUNKS:' || coalesce(string_agg(chr(10) || '[B' || place || '] ' || chunk, '' ORDER BY place) FILTER (NOT taken), '') || chr(10) || {_TAIL} AS pack FROM hg LEFT JOIN k ON k.doc_id = hg.doc_id GROUP BY 1)
 SELECT doc_id, CAST(length(substr(pack, 1, {V.PACK_CHARS})) AS INTEGER) AS n_chars, md5(substr(pack, 1, {V.PACK_CHARS})) AS pack_md5 FROM o""")
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen chunks of a document, rendered in order; body chunks of the lowest score (ties: the later) go until it has 12,000 characters."""
    return C.render_pack(C.select_chunks(_line_chunks(spark, sf_dir)), F.lit("")).select("doc_id", F.length("pack").alias("n_chars"), F.md5("pack").alias("pack_md5"))


@query("U8")
def text_diff_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines added and removed between each document and the one whose doc_id is one less."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id") - 1).toDF("doc_id", "text", "before")
    pairs = d.alias("b").join(d.alias("a"), F.col("b.before") == F.col("a.doc_id")).select(F.col("b.doc_id").alias("doc_id"), K.line_diff("a.text", "b.text").alias("d"))
    return pairs.select("doc_id", "d.added", "d.removed")


@query("F-s25, F-s31", """SELECT record_id, md5('# ' || title || chr(10) || 'Source: ' || source_type || coalesce(' (' || CAST(publish_date AS VARCHAR) || ')', '') || coalesce(chr(10) || '- ' || array_to_string(nullif(evidence, []), chr(10) || '- '), '')) AS brief_md5 FROM records""", on_records=True)
def record_brief(r: DataFrame) -> DataFrame:
    bullets = F.when(F.size("evidence") > 0, F.concat(F.lit("\n- "), F.array_join("evidence", "\n- "))).otherwise("")
    date = F.coalesce(F.concat(F.lit(" ("), F.col("publish_date").cast("string"), F.lit(")")), F.lit(""))
    return r.select("record_id", F.md5(F.concat(F.lit("# "), "title", F.lit("\nSource: "), "source_type", date, bullets)).alias("brief_md5"))


@query("J16", """WITH w AS (SELECT item_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 4)) AS ws FROM benchmark), d AS (SELECT doc_id, list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' '), lambda t: length(t) >= 4)) AS ws FROM documents)
 SELECT item_id, count(*) AS n_docs FROM w JOIN d ON len(list_intersect(w.ws, d.ws)) >= 0.60 * len(w.ws) AND len(w.ws) > 0 GROUP BY 1""")
def evidence_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 0.60 of an item's words: an equi-join on words and counts, not a product of the tables."""
    from tidemark.functions.columns import keyword_set

    w = table(spark, sf_dir, "benchmark").select("item_id", keyword_set(F.col("text"), []).alias("ws")).where(F.size("ws") > 0)
    items = w.select("item_id", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    # few words of items go to the documents, which then give hits only; many meet them in a shuffle
    small = items.count() <= BROADCAST_WORDS
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(keyword_set(F.col("text"), [])).alias("word"))
    hits = d.join(F.broadcast(items) if small else items, "word").groupBy("doc_id", "item_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return hits.where(F.col("shared") >= 0.60 * F.col("n")).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))
