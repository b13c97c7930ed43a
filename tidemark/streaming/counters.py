"""Counters by day and key that a stream of events keeps: a day begins at midnight of UTC-8, the whole year.

Each micro-batch is summed by day and key, added to the counters that the store has and committed with the batch's number, so
that a batch that comes again counts once.  Events of days that are further back than `late` days from the latest day seen
before the batch are left out, and their number is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.stores import materialised
from tidemark.sources.versions import VersionedStore

SCHEMA = "id string, day date, key string, calls long, amount double"


def pacific_day(ts: Column) -> Column:
    return (ts - F.expr("INTERVAL '8' HOUR")).cast("date")


class DailyCounters:
    def __init__(self, spark: SparkSession, path: str, late: int = 2):
        self.spark, self.path, self.late, self.store = spark, path.rstrip("/"), late, VersionedStore(spark, f"{path.rstrip('/')}/store")

    def counters(self) -> DataFrame:
        return self.store.read("counters") if self.store.version() else self.spark.createDataFrame([], SCHEMA)

    def take(self, batch: DataFrame, number: int) -> None:
        """Add events (ts, key, amount) of a micro-batch, unless that was done before; null times and keys are not counted."""
        last = self.store.manifest()
        if last["version"] and int(last["operation"].split()[1]) >= number:
            return
        have = self.counters()
        events = batch.where("ts IS NOT NULL AND key IS NOT NULL").select(pacific_day(F.col("ts")).alias("day"), "key", "amount")
        seen = have.agg(F.max("day").alias("seen"))  # one row
        judged = materialised(events.groupBy("day", "key").agg(F.count(F.lit(1)).alias("calls"), F.sum("amount").alias("amount")).crossJoin(F.broadcast(seen)), "counted")
        in_time = F.col("seen").isNull() | (F.col("day") >= F.date_sub("seen", self.late))
        new = judged.where(in_time).select(F.concat_ws("|", "day", "key").alias("id"), "day", "key", "calls", "amount")
        lost = judged.where(~in_time).agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("late"), F.lit(number).alias("batch"))
        if not last["version"]:
            self.store.commit(f"batch {number}", {"counters": new, "late": lost})
            return
        touched = self.store.holding("counters", lambda old: old.join(new.select("id"), "id", "left_semi"))
        both = self.store.of_files("counters", touched).unionByName(new)
        total = both.groupBy("id", "day", "key").agg(F.sum("calls").alias("calls"), F.sum("amount").alias("amount"))
        self.store.commit(f"batch {number}", {"counters": total, "late": lost}, {"counters": touched})

    def start(self, events: DataFrame) -> StreamingQuery:
        return events.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def today(self, now: Column, quotas: DataFrame) -> DataFrame:
        """(key, used, quota, remaining) of the day of `now`: a new day begins with nothing used; keys of either side."""
        used = self.counters().where(F.col("day") == pacific_day(now)).groupBy("key").agg(F.sum("calls").alias("used"))
        left = F.greatest(F.coalesce("quota", F.lit(0)) - F.coalesce("used", F.lit(0)), F.lit(0)).cast("long")
        return used.join(quotas, "key", "full_outer").select("key", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("quota", F.lit(0)).alias("quota"), left.alias("remaining"))
