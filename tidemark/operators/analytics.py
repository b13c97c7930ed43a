"""Analytics over records: counts, shares, weighted topics, momentum, matrices and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import vocab as V
from tidemark.functions.columns import word


def distinct_per(records: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct records of each element of a list column."""
    return records.select("record_id", F.explode(F.array_distinct(column)).alias(name)).where(F.trim(name) != "").groupBy(name).agg(F.countDistinct("record_id").alias("n_records"))


def top(df: DataFrame, k: int, by: str, name: str) -> DataFrame:
    """The k rows with the most; ties by name."""
    return df.orderBy(F.desc(by), name).limit(k)


def share(df: DataFrame, by: str) -> DataFrame:
    """Share in per cent of the rows shown (a bounded table), round 1."""
    total = df.agg(F.sum(by).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn("share_pct", F.round(100.0 * F.col(by) / F.greatest(F.col("_total"), F.lit(1)), 1)).drop("_total")


def weighted(records: DataFrame, column: str, name: str) -> DataFrame:
    """Each record's weight of 1 goes to the elements of its list in equal parts."""
    return records.where(F.size(column) > 0).select("*", F.explode(column).alias(name), (F.lit(1.0) / F.size(column)).alias("weight"))


def momentum_class(prior: Column, recent: Column) -> Column:
    delta = recent - prior
    return F.when((prior < 2) & (recent >= 2), "Emerging").when((prior >= 2) & (delta > 0), "Expanding").when(delta < 0, "Fading").otherwise("Stable")


def halves(records: DataFrame) -> DataFrame:
    """Adds late: the day is in the second half of the range of days, whose middle may be at noon."""
    ends = records.agg(F.min("publish_date").alias("_first"), F.max("publish_date").alias("_last"))  # one row
    rows = records.crossJoin(F.broadcast(ends))
    return rows.withColumn("late", 2 * F.date_diff("publish_date", "_first") >= F.date_diff("_last", "_first")).drop("_first", "_last")


def momentum(records: DataFrame) -> DataFrame:
    """Weighted topic sums of the two halves of the days that dated records span."""
    rows = weighted(halves(records.where("publish_date IS NOT NULL")), "topics", "topic")
    part = lambda late: F.bround(F.sum(F.when(F.col("late") == late, F.col("weight")).otherwise(0.0)), 2)
    m = rows.groupBy("topic").agg(part(False).alias("prior"), part(True).alias("recent"))
    delta = F.bround(F.col("recent") - F.col("prior"), 2) + F.lit(0.0)
    change = F.bround((F.col("recent") - F.col("prior")) / F.greatest(F.col("prior"), F.lit(1e-9)), 1) + F.lit(0.0)  # no -0.0
    m = m.withColumns({"delta": delta, "pct_change": change, "class": momentum_class(F.col("prior"), F.col("recent"))})
    return m.withColumn("trend", F.when(F.col("delta") > 0, "Rising").when(F.col("delta") < 0, "Falling").otherwise("Flat"))


def region_topic_matrix(records: DataFrame, regions: int = 6, topics: int = 8) -> DataFrame:
    """Distinct records and summed weight 1 / (regions x topics) of each pair of the heaviest regions and topics, with its share in per cent."""
    pairs = records.where((F.size("regions") > 0) & (F.size("topics") > 0)).select("record_id", (F.lit(1.0) / (F.size("regions") * F.size("topics"))).alias("w"), F.explode("regions").alias("region"), "topics").select("record_id", "w", "region", F.explode("topics").alias("topic"))
    matrix = pairs.groupBy("region", "topic").agg(F.countDistinct("record_id").alias("n_records"), F.round(F.sum("w"), 4).alias("weight"))
    # the matrix has a row for each pair of two vocabularies: windows over it rank both axes on the whole of it

    def place(axis: str) -> Column:
        return F.dense_rank().over(Window.orderBy(F.desc(f"_{axis}"), axis))

    sums = matrix.withColumns({f"_{axis}": F.round(F.sum("weight").over(Window.partitionBy(axis)), 4) for axis in ("region", "topic")})
    shown = sums.withColumns({"_r": place("region"), "_t": place("topic")}).where((F.col("_r") <= regions) & (F.col("_t") <= topics))
    share = F.round(100.0 * F.col("weight") / F.greatest(F.sum("weight").over(Window.partitionBy(F.lit(1))), F.lit(1e-9)), 1)
    return shown.select("region", "topic", "n_records", "weight", share.alias("share_pct"))


def trend(runs: DataFrame, frame: int = 5) -> DataFrame:
    """KPI values against the mean of up to `frame` runs before, in long form (run_id, run_version, kpi, value)."""
    w = Window.partitionBy("kpi").orderBy("run_version")
    prior = w.rowsBetween(-frame, -1)
    lower = F.col("kpi").isin(V.LOWER_IS_BETTER)
    delta = F.col("value") - F.col("prior_avg")
    worse = F.when(lower, delta > 0).otherwise(delta < 0)
    limit = F.when(F.col("kpi").isin(V.RATIO_KPIS), V.RATIO_ALERT).otherwise(V.COUNT_ALERT)
    out = runs.withColumns({"prior_avg": F.avg("value").over(prior), "prior_last": F.last("value", True).over(prior)})
    direction = F.when(delta.isNull(), "no_history").when(F.abs(delta) < 1e-9, "flat").when(worse, "declined").otherwise("improved")
    return out.select("kpi", "run_version", F.round("value", 4).alias("value"), F.round("prior_avg", 4).alias("prior_avg"), F.round("prior_last", 4).alias("prior_last"), F.round(delta, 4).alias("delta"), direction.alias("direction"), (F.coalesce(worse, F.lit(False)) & (F.abs(delta) >= limit)).alias("alert"))


def signed(n: Column) -> Column:
    return F.when(n > 0, F.concat(F.lit("Increase "), n.cast("string"))).when(n < 0, F.concat(F.lit("Decrease "), F.abs(n).cast("string"))).otherwise("No change")


def closure_signal() -> Column:
    text = F.concat_ws(" ", "title", *(F.array_join(c, " ") for c in ("keywords", "evidence", "insights", "topics")))
    return F.array_contains("topics", "Closure Technology & Innovation") | text.rlike(word(V.CLOSURE_PATTERN))


def snapshot(window: DataFrame) -> DataFrame:
    """(line_no, line): at most five lines on what the later half of a window (late) has more of."""
    rows = window.withColumn("closure", F.coalesce(closure_signal(), F.lit(False)))
    n = lambda c: F.count_if(c)
    topics = rows.select(F.explode("topics").alias("topic"), "late").groupBy("topic").agg(n(F.col("late")).alias("n"), n(~F.col("late")).alias("p"))  # a row for each topic
    two = topics.where("n > 0").orderBy(F.desc("n"), "topic").limit(2).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "topic", "n"))), lambda x: F.concat(x["topic"], F.lit(" ("), x["n"].cast("string"), F.lit(")"))), ", ").alias("t"))
    mover = topics.agg(F.max(F.struct((F.col("n") - F.col("p")).alias("d"), "n", "topic")).alias("m")).where("m.d > 0")
    closure = rows.where("closure").agg(n(F.col("late")).alias("n"), n(~F.col("late")).alias("p"))
    where = rows.where("closure AND late").select(F.explode("regions").alias("region")).groupBy("region").agg(F.count(F.lit(1)).alias("n")).agg(F.min_by(F.struct("region", "n"), F.struct(-F.col("n"), "region")).alias("r"))
    text = lambda k, df, line: df.select(F.lit(k).alias("line_no"), line.alias("line"))
    c = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    count = lambda x: F.col(x).cast("string")
    lines = text(1, two.where("t <> ''"), c("Market Shift: Top topic signals in the latest filtered window are ", F.col("t"), "."))
    lines = lines.unionByName(text(2, mover, c("Momentum Signal: Fastest-rising topic is ", F.col("m.topic"), " (", signed(F.col("m.d")), " mention(s) vs prior window).")))
    seen = c("Closure Signal: Closure-system mentions appear in ", count("n"), " record(s) (", signed(F.col("n") - F.col("p")), " vs prior window).")
    lines = lines.unionByName(text(3, closure, F.when(F.col("n") > 0, seen).otherwise("Closure Signal: No closure-system mention detected in the latest filtered window.")))
    spot = c("Regional Focus: Closure hotspot region is ", F.col("r.region"), " (", count("r.n"), " mention(s)).")
    none = F.lit("Regional Focus: Closure-system mentions are present, but no footprint region signal was detected.")
    return lines.unionByName(text(4, closure.where("n > 0").crossJoin(F.broadcast(where)), F.coalesce(spot, none)))
