"""Bulk ingest in order of arrival: a stream of files, of which an admitted one keeps out later ones with its title.

A file has the title that its name proposes and the one that was extracted.  It is skipped if the fingerprint of the
proposed title is that of an admitted file's extracted title, or if the extracted title is another one and its fingerprint
is; otherwise it is admitted, and its extracted title counts from then on.  So whether a file keeps out another depends on
whether it was kept out itself, by a file that came before.

A micro-batch is decided in rounds, not file by file: a file that nothing undecided or admitted before it could keep out is
admitted, one that an admitted file before it keeps out is skipped, and both are grouped minima by fingerprint.  Each round
decides the first undecided file of every chain; a title that a third of all files have takes two rounds.  The outcome of a
batch and the fingerprints that it adds are one commit of a versioned store under the batch's number, so that a batch that is
run again after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import vocab as V
from tidemark.functions.columns import title_fingerprint
from tidemark.sources.stores import materialised
from tidemark.sources.versions import VersionedStore

SAVED, SAME_NAME, SAME_TITLE = "Saved", "Skipped (duplicate title)", "Skipped (duplicate - same article already exists)"
FINGERPRINTS = "fingerprint string"


def marked(files: DataFrame) -> DataFrame:
    """file, at (order of arrival), p and e: fingerprints of the proposed and the extracted title, null for none; e is looked up only if the titles differ."""
    fp = lambda c: F.nullif(title_fingerprint(F.coalesce(c, F.lit("")), V.TITLE_STOPWORDS), F.lit(""))
    return files.select("file", F.struct("arrived_at", "file").alias("at"), fp(F.col("proposed")).alias("p"), fp(F.col("title")).alias("e"), (F.col("title").isNotNull() & ~F.col("title").eqNullSafe(F.col("proposed"))).alias("other"))


def decide(files: DataFrame, known: DataFrame) -> DataFrame:
    """(file, at, e, outcome) of files (file, arrived_at, proposed, title) after those with the known fingerprints."""
    rows = materialised(marked(files), "files")
    held = known.select("fingerprint").distinct()

    def looked_up(left: DataFrame, right: DataFrame, name: str) -> DataFrame:
        """left with what right (fingerprint, value) has for p and for e, as p_name and e_name."""
        for c in ("p", "e"):
            left = left.join(right.toDF(c, f"{c}_{name}"), c, "left")
        return left

    first = looked_up(rows, held.withColumn("known", F.lit(True)), "known")
    named = F.when(F.col("p_known").isNotNull(), SAME_NAME)
    # late: an admitted file has its extracted title; what to call that is known when nothing can have its proposed one any more
    first = materialised(first.select(*rows.columns, (F.col("other") & F.col("e_known").isNotNull()).alias("late"), named.alias("outcome")), "decided")
    done, rest = first.where("outcome IS NOT NULL"), first.where("outcome IS NULL").drop("outcome")
    admitted = None
    while not rest.isEmpty():
        could = rest.where("e IS NOT NULL AND NOT late").groupBy("e").agg(F.min("at").alias("least"))
        step = looked_up(rest, could, "least")
        free = lambda c: F.col(f"{c}_least").isNull() | (F.col(f"{c}_least") >= F.col("at"))
        before = lambda c: F.coalesce(F.col(f"{c}_in") < F.col("at"), F.lit(False))
        out, late = F.lit(None).cast("string"), F.col("late")
        if admitted is not None:
            step = looked_up(step, admitted, "in")
            out, late = F.when(before("p"), SAME_NAME), late | (F.col("other") & before("e"))
        result = F.coalesce(out, F.when(free("p") & late, SAME_TITLE).when(free("p") & ~late & (~F.col("other") | free("e")), SAVED))
        step = materialised(step.select(*rows.columns, late.alias("late"), result.alias("outcome")), "decided")
        new, rest = step.where("outcome IS NOT NULL"), step.where("outcome IS NULL").drop("outcome")
        done = done.unionByName(new)
        gained = new.where((F.col("outcome") == SAVED) & F.col("e").isNotNull()).groupBy("e").agg(F.min("at").alias("at"))
        admitted = gained if admitted is None else admitted.unionByName(gained).groupBy("e").agg(F.min("at").alias("at"))
    return done.select("file", "at", "e", "outcome")


class BulkIngest:
    """A store of outcomes that a stream of files fills, with the stream's checkpoint beside it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), VersionedStore(spark, f"{path.rstrip('/')}/store")

    def take(self, batch: DataFrame, number: int) -> None:
        """Decide a micro-batch and commit it, unless that was done before."""
        last = self.store.manifest()
        if last["version"] and int(last["operation"].split()[1]) >= number:
            return
        known = self.store.read("admitted") if last["version"] else batch.sparkSession.createDataFrame([], FINGERPRINTS)
        done = materialised(decide(batch, known), "outcomes")
        admitted = done.where((F.col("outcome") == SAVED) & F.col("e").isNotNull()).select(F.col("e").alias("fingerprint"))
        self.store.commit(f"batch {number}", {"outcomes": done.select("file", "outcome").withColumn("batch", F.lit(number)), "admitted": admitted})

    def start(self, files: DataFrame) -> StreamingQuery:
        """Take all files of a stream that are there, batch by batch, and end; the next start goes on from there."""
        return files.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def outcomes(self) -> DataFrame:
        return self.store.read("outcomes")
