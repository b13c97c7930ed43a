"""Queries of the dashboard: counts, momentum, matrices, trends, usage, and their event-table counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import company_name
from tidemark.operators import analytics as A

from .catalog import query, table
from .record_queries import _map


@query("A1, O4", "SELECT topic, count(DISTINCT record_id) AS n_records FROM (SELECT record_id, unnest(list_distinct(topics)) AS topic FROM records) GROUP BY 1 ORDER BY n_records DESC, topic LIMIT 8", on_records=True)
def topic_counts(r: DataFrame) -> DataFrame:
    return A.top(A.distinct_per(r, "topics", "topic"), 8, "n_records", "topic")


@query("A2, O4", """WITH c AS (SELECT region, count(DISTINCT record_id) AS n_records FROM (SELECT record_id, unnest(list_distinct(regions)) AS region FROM records) GROUP BY 1 ORDER BY n_records DESC, region LIMIT 6)
 SELECT region, n_records, round(100.0 * n_records / greatest(sum(n_records) OVER (), 1), 1) AS share_pct FROM c""", on_records=True)
def region_share(r: DataFrame) -> DataFrame:
    return A.share(A.top(A.distinct_per(r, "regions", "region"), 6, "n_records", "region"), "n_records")


_ENDINGS = "|".join(s.replace(".", r"\.") for s in sorted(V.LEGAL_SUFFIXES, key=lambda s: (-len(s), s)))


@query("A3, F-s8, O4", f"""WITH e AS (SELECT record_id, unnest(companies) AS c FROM records), b AS (SELECT record_id, c, regexp_replace(c, '(?i)( ({_ENDINGS}))+$', '') AS bare FROM e),
 n AS (SELECT record_id, coalesce({_map(V.COMPANY_NAMES)}[lower(c)], {_map(V.COMPANY_NAMES)}[lower(bare)], bare) AS company FROM b), k AS (SELECT company, count(DISTINCT record_id) AS n_records FROM n GROUP BY 1)
 SELECT company, n_records, CAST(row_number() OVER (ORDER BY n_records DESC, company) AS INTEGER) AS place FROM k ORDER BY n_records DESC, company LIMIT 7""", on_records=True)
def company_rank(r: DataFrame) -> DataFrame:
    named = r.withColumn("companies", F.transform("companies", lambda c: company_name(c, V.COMPANY_NAMES, V.LEGAL_SUFFIXES)))
    best = A.top(A.distinct_per(named, "companies", "company"), 7, "n_records", "company")
    return best.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_records"), "company")))  # seven rows


@query("A4", "SELECT CAST(CAST(date_trunc('week', publish_date) AS DATE) AS VARCHAR) AS week, coalesce(source_type, 'Unknown') AS source, count(*) AS n FROM records WHERE publish_date IS NOT NULL GROUP BY ALL", on_records=True)
def weekly_volume(r: DataFrame) -> DataFrame:
    return r.where("publish_date IS NOT NULL").groupBy(F.date_trunc("week", "publish_date").cast("date").cast("string").alias("week"), F.coalesce("source_type", F.lit("Unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("A4", "SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def weekly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("week", "ts").cast("date").cast("string").alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("n_users"), F.round(F.sum("value"), 4).alias("value"))


@query("A5", "SELECT topic, round(sum(w), 6) AS weight FROM (SELECT unnest(topics) AS topic, 1.0::DOUBLE / len(topics) AS w FROM records WHERE len(topics) > 0) GROUP BY 1", on_records=True)
def weighted_topics(r: DataFrame) -> DataFrame:
    return A.weighted(r, "topics", "topic").groupBy("topic").agg(F.round(F.sum("weight"), 6).alias("weight"))


_MOMENTUM = """WITH ends AS (SELECT min(publish_date) AS a, max(publish_date) AS b FROM records WHERE publish_date IS NOT NULL),
 w AS (SELECT unnest(topics) AS topic, 1.0::DOUBLE / len(topics) AS w, 2 * (publish_date - a) >= b - a AS late FROM records, ends WHERE len(topics) > 0 AND publish_date IS NOT NULL),
 m AS (SELECT topic, round_even(sum(CASE WHEN late THEN 0 ELSE w END), 2) AS prior, round_even(sum(CASE WHEN late THEN w ELSE 0 END), 2) AS recent FROM w GROUP BY 1),
 k AS (SELECT topic, prior, recent, round_even(recent - prior, 2) + 0.0 AS delta, round_even((recent - prior) / greatest(prior, 1e-9), 1) + 0.0 AS pct_change,
  CASE WHEN prior < 2 AND recent >= 2 THEN 'Emerging' WHEN prior >= 2 AND recent - prior > 0 THEN 'Expanding' WHEN recent - prior < 0 THEN 'Fading' ELSE 'Stable' END AS class, CASE WHEN recent > prior THEN 'Rising' WHEN recent < prior THEN 'Falling' ELSE 'Flat' END AS trend FROM m) """


@query("A6, F-m1, F-d11", _MOMENTUM + "SELECT * FROM k", on_records=True)
def topic_momentum(r: DataFrame) -> DataFrame:
    return A.momentum(r)


@query("A9", _MOMENTUM + "SELECT topic, delta, recent FROM k ORDER BY delta DESC, recent DESC, topic DESC LIMIT 1", on_records=True)
def top_mover(r: DataFrame) -> DataFrame:
    return A.momentum(r).agg(F.max(F.struct("delta", "recent", "topic")).alias("x")).select("x.topic", "x.delta", "x.recent")


@query("A7", """WITH m AS (SELECT region, topic, count(DISTINCT record_id) AS n_records, round(sum(w), 4) AS weight FROM (SELECT record_id, region, unnest(topics) AS topic, w FROM (SELECT record_id, unnest(regions) AS region, topics, 1.0::DOUBLE / (len(regions) * len(topics)) AS w FROM records WHERE len(regions) > 0 AND len(topics) > 0)) GROUP BY ALL),
 a AS (SELECT region FROM m GROUP BY 1 ORDER BY round(sum(weight), 4) DESC, region LIMIT 6), b AS (SELECT topic FROM m GROUP BY 1 ORDER BY round(sum(weight), 4) DESC, topic LIMIT 8), x AS (SELECT * FROM m WHERE region IN (SELECT region FROM a) AND topic IN (SELECT topic FROM b))
 SELECT *, round(100.0::DOUBLE * weight / greatest((SELECT sum(weight) FROM x), 1e-9), 1) AS share_pct FROM x""", on_records=True)
def region_topic_matrix(r: DataFrame) -> DataFrame:
    return A.region_topic_matrix(r)


@query("A8", """WITH f AS (SELECT count(*) FILTER (publish_date BETWEEN DATE '2024-02-16' AND DATE '2024-02-22') AS n_now, count(*) FILTER (publish_date BETWEEN DATE '2024-02-09' AND DATE '2024-02-15') AS n_before,
  count(*) FILTER (priority = 'High' AND publish_date BETWEEN DATE '2024-02-16' AND DATE '2024-02-22') AS high_now, count(*) FILTER (priority = 'High' AND publish_date BETWEEN DATE '2024-02-09' AND DATE '2024-02-15') AS high_before FROM records)
 SELECT n_now, n_before, high_now, high_before, CASE WHEN n_now - n_before > 0 THEN '+' ELSE '' END || (n_now - n_before) AS change FROM f""", on_records=True)
def snapshot_windows(r: DataFrame) -> DataFrame:
    now, before = F.col("publish_date").between("2024-02-16", "2024-02-22"), F.col("publish_date").between("2024-02-09", "2024-02-15")
    high = F.col("priority") == "High"
    s = r.agg(F.count_if(now).alias("n_now"), F.count_if(before).alias("n_before"), F.count_if(now & high).alias("high_now"), F.count_if(before & high).alias("high_before"))
    d = F.col("n_now") - F.col("n_before")
    return s.withColumn("change", F.concat(F.when(d > 0, "+").otherwise(""), d.cast("string")))


@query("A8", "SELECT 'topic' AS kind, topic AS item, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM records) GROUP BY ALL UNION ALL SELECT 'region', region, count(*) FROM (SELECT unnest(regions) AS region FROM records) GROUP BY ALL UNION ALL SELECT 'priority', priority, count(*) FROM records GROUP BY ALL", on_records=True)
def mention_counts(r: DataFrame) -> DataFrame:
    one = lambda kind, c: r.select(F.lit(kind).alias("kind"), c.alias("item"))
    return one("topic", F.explode("topics")).unionByName(one("region", F.explode("regions"))).unionByName(one("priority", F.col("priority"))).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n"))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality runs from events: a run is a day, findings are events; long form (run_version, kpi, value)."""
    e = table(spark, sf_dir, "events").withColumn("day", F.col("ts").cast("date"))
    n = F.greatest(F.countDistinct("user_id"), F.lit(1))
    days = e.groupBy("day").agg(F.round(F.count_if(F.col("event_type") == "error") / n, 6).alias("KPI-R1"), F.round(F.count_if(F.col("event_type") == "click") / n, 6).alias("KPI-R2"), F.round(F.avg((F.col("value") > 50).cast("double")), 6).alias("KPI-R3"), F.count(F.lit(1)).cast("double").alias("KPI-B4"))
    v = F.date_diff("day", F.lit("2024-01-01").cast("date")) + 1
    return days.select(v.alias("run_version"), "day", "KPI-R1", "KPI-R2", "KPI-R3", "KPI-B4").unpivot(["run_version", "day"], ["KPI-R1", "KPI-R2", "KPI-R3", "KPI-B4"], "kpi", "value")


_RUNS = """WITH d AS (SELECT CAST(ts AS DATE) AS day, round(count(*) FILTER (event_type = 'error') / greatest(count(DISTINCT user_id), 1)::DOUBLE, 6) AS r1, round(count(*) FILTER (event_type = 'click') / greatest(count(DISTINCT user_id), 1)::DOUBLE, 6) AS r2,
  round(avg(CASE WHEN value > 50 THEN 1.0::DOUBLE ELSE 0 END), 6) AS r3, count(*)::DOUBLE AS b4 FROM events GROUP BY 1),
 runs AS (SELECT CAST(day - DATE '2024-01-01' + 1 AS INTEGER) AS run_version, day, unnest(['KPI-R1', 'KPI-R2', 'KPI-R3', 'KPI-B4']) AS kpi, unnest([r1, r2, r3, b4]) AS value FROM d) """


@query("W2, T28, A31, F-s27", _RUNS + """, p AS (SELECT kpi, run_version, value, avg(value) OVER w AS pa, last_value(value IGNORE NULLS) OVER w AS pl FROM runs WINDOW w AS (PARTITION BY kpi ORDER BY run_version ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))
 SELECT kpi, run_version, round(value, 4) AS value, round(pa, 4) AS prior_avg, round(pl, 4) AS prior_last, round(value - pa, 4) AS delta,
  CASE WHEN pa IS NULL THEN 'no_history' WHEN abs(value - pa) < 1e-9 THEN 'flat' WHEN (kpi IN ('KPI-R1', 'KPI-R2') AND value > pa) OR (kpi NOT IN ('KPI-R1', 'KPI-R2') AND value < pa) THEN 'declined' ELSE 'improved' END AS direction,
  coalesce(((kpi IN ('KPI-R1', 'KPI-R2') AND value > pa) OR (kpi NOT IN ('KPI-R1', 'KPI-R2') AND value < pa)) AND abs(value - pa) >= CASE WHEN kpi = 'KPI-B4' THEN 2 ELSE 0.05 END, false) AS alert FROM p""")
def kpi_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.trend(_runs(spark, sf_dir))


@query("W3", _RUNS + "SELECT kpi, run_version, value, lag(value) OVER (PARTITION BY kpi ORDER BY run_version) AS previous, round(avg(value) OVER (PARTITION BY kpi), 4) AS mean FROM runs WHERE value IS NOT NULL")
def kpi_prev(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("kpi").orderBy("run_version")
    return _runs(spark, sf_dir).where("value IS NOT NULL").select("kpi", "run_version", "value", F.lag("value").over(w).alias("previous"), F.round(F.avg("value").over(Window.partitionBy("kpi")), 4).alias("mean"))


@query("A17, F-d10", """WITH x AS (SELECT *, 'hour' AS unit, CAST(date_trunc('hour', ts) AS VARCHAR) AS bucket FROM events UNION ALL SELECT *, 'day', CAST(CAST(ts AS DATE) AS VARCHAR) FROM events UNION ALL SELECT *, 'week', CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) FROM events UNION ALL SELECT *, 'version', CAST(1 + CAST(ts AS DATE) - DATE '2024-01-01' AS VARCHAR) FROM events)
 SELECT unit, bucket, event_type AS score, round(avg(value), 6) AS mean, count(value) AS n FROM x GROUP BY ALL""")
def qc_trend_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score by hour, day, week and version of the run."""
    day = F.col("ts").cast("date")
    buckets = {"hour": F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd HH:mm:ss"), "day": day.cast("string"), "week": F.date_trunc("week", "ts").cast("date").cast("string"), "version": (F.date_diff(day, F.lit("2024-01-01").cast("date")) + 1).cast("string")}
    units = F.explode(F.array(*(F.struct(F.lit(u).alias("unit"), b.alias("bucket")) for u, b in buckets.items())))
    rows = table(spark, sf_dir, "events").select(units.alias("u"), F.col("event_type").alias("score"), "value")
    return rows.groupBy("u.unit", "u.bucket", "score").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


SUGGESTIONS = {"error": "Check the extraction of failing sources.", "click": "Tighten the click rules."}
NOTE_CHARS, NOTES = 120, 3


@query("A18, T29", f"""WITH e AS (SELECT CAST(ts AS DATE) AS day, event_type, event_id, props FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) FROM events) - 10),
 c AS (SELECT event_type AS finding, count(DISTINCT day) AS n_runs FROM e GROUP BY 1 HAVING count(DISTINCT day) >= 5), n AS (SELECT event_type, substr(props, 1, {NOTE_CHARS}) AS note, row_number() OVER (PARTITION BY event_type ORDER BY day, event_id) AS rn FROM e WHERE props IS NOT NULL)
 SELECT c.finding, c.n_runs, coalesce({_map(SUGGESTIONS)}[c.finding], 'Review the rule of this finding.') AS suggestion, coalesce(string_agg(note, ' | ' ORDER BY rn), '') AS notes FROM c LEFT JOIN n ON n.event_type = c.finding AND rn <= {NOTES} GROUP BY ALL""")
def chronic_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in at least half of the last ten runs, with a suggestion and their first three notes."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("day"), "event_type", "event_id", "props")
    last = e.agg(F.max("day").alias("last"))  # one row
    e = e.join(F.broadcast(last), F.col("day") > F.date_sub("last", 10))
    chronic = e.groupBy(F.col("event_type").alias("finding")).agg(F.countDistinct("day").alias("n_runs")).where("n_runs >= 5")
    first = Window.partitionBy("event_type").orderBy("day", "event_id")
    notes = e.where("props IS NOT NULL").withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= NOTES)
    notes = notes.groupBy(F.col("event_type").alias("finding")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", F.substring("props", 1, NOTE_CHARS).alias("note")))), lambda x: x["note"]), " | ").alias("notes"))
    from tidemark.functions.columns import mapping

    suggestion = F.coalesce(F.try_element_at(mapping(SUGGESTIONS), F.col("finding")), F.lit("Review the rule of this finding."))
    return chronic.join(notes, "finding", "left").select("finding", "n_runs", suggestion.alias("suggestion"), F.coalesce("notes", F.lit("")).alias("notes"))


@query("A23, F-d8, S23", "SELECT CAST(CAST(ts - INTERVAL 8 HOUR AS DATE) AS VARCHAR) AS day, event_type AS model, count(*) AS calls, round(sum(value), 4) AS tokens FROM events GROUP BY ALL")
def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy((F.col("ts") - F.expr("INTERVAL '8' HOUR")).cast("date").cast("string").alias("day"), F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("tokens"))


QUOTAS = {"click": 100, "purchase": 20, "spare": 5}


@query("J17", f"""WITH u AS (SELECT event_type AS model, count(*) AS used FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1), q AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in QUOTAS.items())}) AS t(model, quota))
 SELECT coalesce(u.model, q.model) AS model, coalesce(used, 0) AS used, CAST(coalesce(quota, 0) AS INTEGER) AS quota, greatest(coalesce(quota, 0) - coalesce(used, 0), 0) AS remaining FROM u FULL JOIN q ON u.model = q.model""")
def quota_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "events").where(F.col("ts").cast("date") == "2024-01-10").groupBy(F.col("event_type").alias("model")).agg(F.count(F.lit(1)).alias("used"))
    quota = spark.createDataFrame(list(QUOTAS.items()), "model string, quota int")
    return used.join(quota, "model", "full_outer").select("model", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("quota", F.lit(0)).alias("quota"), F.greatest(F.coalesce("quota", F.lit(0)) - F.coalesce("used", F.lit(0)), F.lit(0)).cast("long").alias("remaining"))


@query("A31", "SELECT event_type, count(*) FILTER (value >= 80) AS high, count(*) FILTER (value >= 40 AND value < 80) AS medium, count(*) FILTER (value < 40) AS low FROM events GROUP BY 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(v >= 80).alias("high"), F.count_if((v >= 40) & (v < 80)).alias("medium"), F.count_if(v < 40).alias("low"))


