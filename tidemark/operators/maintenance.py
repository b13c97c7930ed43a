"""Changes to stores: replace, delete, purge, briefs and their files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import mapping

IDENTITY = ("record_id", "created_at")


def replace_records(store: DataFrame, edited: DataFrame, keep: tuple[str, ...] = IDENTITY, blanks: bool = False) -> DataFrame:
    """Rows of the store with the edited row's fields where they are not null (blanks: where they are, too); fields in `keep` stay."""
    e = edited.select(F.col("record_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in edited.columns if c not in keep))
    joined = store.join(e, F.col("record_id") == F.col("_id"), "left")
    new = lambda c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) if blanks else F.coalesce(F.col(f"_{c}"), F.col(c))
    return joined.select(*(new(c).alias(c) if f"_{c}" in e.columns else F.col(c) for c in store.columns))


def delete_records(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("record_id"), "record_id", "left_anti")


def delete_days(store: DataFrame, days: list[str]) -> DataFrame:
    """The store without what was created on these days."""
    return store.where(~F.coalesce(F.col("created_at").cast("date").cast("string").isin(days), F.lit(False)))


def purge(store: DataFrame, doomed: Column) -> DataFrame:
    """The store without rows of which the condition is true; unknown is not true."""
    return store.where(~F.coalesce(doomed, F.lit(False)))


def migrate_log(store: DataFrame, column: str, names: dict[str, str]) -> DataFrame:
    """(record_id, old, new) of every value of a list column that the names change."""
    each = store.select("record_id", F.explode(column).alias("old")).withColumn("new", F.try_element_at(mapping(names), F.col("old")))
    return each.where("new IS NOT NULL AND new <> old")


def point_fix(store: DataFrame, which: Column, field: str, value: Column, reason: str) -> DataFrame:
    """The store with one field of some rows set, and a mutation (JSON) where that changed it."""
    new = F.when(F.coalesce(which, F.lit(False)), value).otherwise(F.col(field))
    log = F.when(~new.eqNullSafe(F.col(field)), F.to_json(F.struct(F.lit(field).alias("field"), F.col(field).alias("before"), new.alias("after"), F.lit(reason).alias("reason"))))
    return store.withColumns({"_new": new, "mutation": log}).withColumn(field, F.col("_new")).drop("_new")


def resolve_files(records: DataFrame, files: DataFrame, folder: str) -> DataFrame:
    """(record_id, path): the stored path if there is such a file, else one of the same name in the folder, else the newest that begins with the id.

    records: record_id, stored; files: path, created_at.
    """
    name = F.regexp_extract("stored", "([^/\\\\]+)$", 1)
    there = lambda as_: files.select(F.col("path").alias(as_)).distinct()
    r = records.withColumn("_same", F.concat(F.lit(f"{folder}/"), name)).join(there("_a"), F.col("stored") == F.col("_a"), "left").join(there("_b"), F.col("_same") == F.col("_b"), "left")
    owner = F.regexp_extract("path", f"^{folder}/([^_/]+)_", 1)
    newest = files.where(owner != "").groupBy(owner.alias("_id")).agg(F.max_by("path", F.struct("created_at", "path")).alias("_c"))
    return r.join(newest, F.col("record_id") == F.col("_id"), "left").select("record_id", F.coalesce("_a", "_b", "_c").alias("path"))


def cascade(index: DataFrame, files: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index rows left, files to remove): a brief's text and sidecar go with its index row."""
    names = doomed.select("file").distinct()
    left = index.join(names, "file", "left_anti")
    gone = files.join(names.select(F.explode(F.array("file", F.regexp_replace("file", r"\.md$", ".meta.json"))).alias("name")), "name", "left_semi")
    return left, gone


def orphans(index: DataFrame, texts_: DataFrame, sidecars: DataFrame) -> DataFrame:
    """(kind, file): index rows and sidecars without a text."""
    have = texts_.select("file").distinct()
    lost = lambda kind, df: df.select("file").distinct().join(have, "file", "left_anti").select(F.lit(kind).alias("kind"), "file")
    return lost("index_without_file", index).unionByName(lost("sidecar_without_file", sidecars))


def metadata_for(files: DataFrame, sidecars: DataFrame, index: DataFrame) -> DataFrame:
    """(file, source, run_id): a file's sidecar, else the last index row of its name, else the last index row.

    sidecars: file, run_id; index: pos, file, run_id.
    """
    own = index.groupBy("file").agg(F.max_by("run_id", "pos").alias("_own"))
    last = index.agg(F.max_by("run_id", "pos").alias("_last"))  # one row
    j = files.select("file").join(sidecars.select("file", F.col("run_id").alias("_side")), "file", "left").join(own, "file", "left").crossJoin(F.broadcast(last))
    source = F.when(F.col("_side").isNotNull(), "sidecar").when(F.col("_own").isNotNull(), "index").otherwise("last")
    return j.select("file", source.alias("source"), F.coalesce("_side", "_own", "_last").alias("run_id"))


def guard_dates(before: DataFrame, after: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Records whose valid publish date changed by a rule that may not change it (after: publish_date, rule)."""
    b = before.select("record_id", F.col("publish_date").alias("old"))
    return after.join(b, "record_id").where(F.try_to_date("old", "yyyy-MM-dd").isNotNull() & ~F.col("old").eqNullSafe(F.col("publish_date")) & ~F.coalesce(F.col("rule").isin(*allowed), F.lit(False)))


def merge_history(index: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Rows of both by (file, created_at); the index's counts."""
    both = index.withColumn("_from", F.lit(0)).unionByName(sidecars.withColumn("_from", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("file", "created_at").orderBy("_from")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_from")


def supersede(index: DataFrame) -> DataFrame:
    """Final versions before a family's last become superseded."""
    last = index.groupBy("family").agg(F.max("version").alias("_last"))
    status = F.when((F.col("status") == "final") & (F.col("version") < F.col("_last")), "superseded").otherwise(F.col("status"))
    return index.join(last, "family").withColumn("status", status).drop("_last")


def sync_sidecar(sidecar: DataFrame, index: DataFrame) -> DataFrame:
    """Status from the index; other fields only where the sidecar has none."""
    i = index.select("file", *(F.col(c).alias(f"_{c}") for c in index.columns if c != "file"))
    joined = sidecar.join(i, "file", "left")
    return joined.select("file", *(F.coalesce(F.col("_status"), F.col("status")).alias(c) if c == "status" else (F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) if f"_{c}" in i.columns else F.col(c)) for c in sidecar.columns if c != "file"))
