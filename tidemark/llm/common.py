"""Helpers that the operators share: scratch tables, code shipping and word handling."""

from __future__ import annotations

import os
import sys
import tempfile
import types
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir; where it is unset, a folder of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch").rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as a table in the shared folder and read again; this cuts lineage and survives lost executors.

    The write's shuffle files go as soon as it ends.  Left to the driver's garbage collection they outlive the step after,
    even if that is called between the two, as the last query's plan is still held then.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def sized(df: DataFrame, rows: int, per: int = 200_000, least: int = 12) -> DataFrame:
    """df in no more partitions than so many rows need: a table of few rows is not written as a file for each shuffle partition."""
    return df.coalesce(max(least, -(-rows // per)))


def apart(df: DataFrame, rows: int | None = None, most: int = 100_000) -> DataFrame:
    """df for a join that sorts both sides; with `rows`, only if these are more than `most`.

    Spark sizes a table by its compressed file, and what explode makes of it as if it were one row for each of it, so that
    it would broadcast, through the driver, tables that are far over its threshold.
    """
    return df.hint("merge") if rows is None or rows > most else df


def delete(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind a frame that stored() returned."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        delete(df.sparkSession, path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, and bound the bytes of a batch for Python."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    sc._tidemark_shipped = True
    if sc.getConf().get(BATCH_BYTES) is None:
        spark.conf.set(BATCH_BYTES, str(12 << 20))  # texts are long: batches for Python are bounded by bytes too
    root = Path(__file__).resolve().parents[1]
    out = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark_code.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(out))


def trim() -> None:
    """Give memory that a finished task has freed back to the system; Python workers live through many tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for mapInArrow that ends with trim()."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def worker_state() -> types.ModuleType:
    """A namespace that lives as long as a Python worker, for bounded memos between tasks."""
    return sys.modules.setdefault("_tidemark_worker_state", types.ModuleType("_tidemark_worker_state"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: What the operators call a space between words: 0x20 and 0x09 to 0x0D.  bytes.split() splits at just these.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def slices(batch, limit: int = 4_000_000, column: str = "text"):
    """Row ranges of an Arrow batch whose texts hold about `limit` bytes together (a longer text is a range of its own)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    first = total = 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n + 64
    if first < len(sizes):
        yield first, len(sizes)
