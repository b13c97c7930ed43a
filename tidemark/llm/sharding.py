"""Shards of documents by best-fit-decreasing bin packing; documents with equal texts stay together.

A group of equal texts is indivisible.  Groups enter bins by descending size, each one the open bin with the least room
that holds it; open bins are kept in a balanced tree by their room.  With a fixed capacity that gives few shards
(`pack_groups`).  For a fixed number of shards, `level` searches the least capacity for which as many bins are enough;
groups of more than an even share have a shard each first, so that they don't make the others' capacity greater.

The plan is made on the histogram of group sizes, not on groups: all groups of a size are placed in runs, a run going into
one bin.  So the driver holds an entry for each distinct size, at most sqrt(2 * bytes) of them, as their sum is at most the
bytes.  Groups sorted by size have a place in that order; a run of the plan is a range of places.
"""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, lean, ship, shuffle_partitions, stored, table

OVERHEAD = 16  # bytes that each document takes besides its text


class Rooms:
    """Bins by (room, number) in a treap: a balanced tree, whose depth grows with the logarithm of the bins."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, priority, left, right]
        self.draw = random.Random(13).random

    def _split(self, node: list | None, key: tuple[int, int]) -> tuple[list | None, list | None]:
        """Keys below `key`, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a: list | None, b: list | None) -> list | None:
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room: int, number: int) -> None:
        left, right = self._split(self.root, (room, number))
        self.root = self._merge(self._merge(left, [(room, number), self.draw(), None, None]), right)

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room that holds `size`, taken out; None if there is none."""
        node, best = self.root, None
        while node is not None:
            if node[0] >= (size, -1):
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            left, rest = self._split(self.root, best)
            self.root = self._merge(left, self._split(rest, (best[0], best[1] + 1))[1])
        return best


Run = tuple[int, int, int]  # size, number of groups, bin


def pack_groups(sizes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[Run], int] | None:
    """Runs in order and the number of bins; None if `most` bins aren't enough.

    sizes: (size, groups) by descending size, none above the capacity.  What is put into a bin at once is as many groups
    of a size as it holds, which is what best fit does with them one by one, as a bin gets tighter with each.
    """
    rooms, runs, bins = Rooms(), [], 0
    for size, left in sizes:
        while left:
            found = rooms.take(size)
            if found is None:
                if bins == most:
                    return None
                found, bins = (capacity, bins), bins + 1
            room, number = found
            some = min(left, room // size)
            left -= some
            runs.append((size, some, number))
            if room - some * size:
                rooms.add(room - some * size, number)
    return runs, bins


def level(sizes: list[tuple[int, int]], shards: int, fineness: int = 100_000) -> list[Run]:
    """Runs over `shards` bins by the least capacity that is enough, found to a part in `fineness` of a shard.

    A group that is larger than an even share of what is left for as many shards as are left has one for itself.
    """
    sizes = [s for s in sizes if s[1]]
    total, runs, used, at = sum(s * n for s, n in sizes), [], 0, 0
    while at < len(sizes) and shards - used > 1 and sizes[at][0] * (shards - used) >= total:
        size, n = sizes[at]
        total -= size
        runs.append((size, 1, used))
        used += 1
        sizes[at] = (size, n - 1)
        at += n == 1
    rest = sizes[at:]
    if rest:
        low = max(rest[0][0], -(-total // (shards - used)))
        high = low + rest[0][0]  # any fit is enough with that: a bin is left only when it is filled to over an even share
        best = pack_groups(rest, high, shards - used)
        while high - low > max(1, low // fineness):
            middle = (low + high) // 2
            found = pack_groups(rest, middle, shards - used)
            low, high, best = (low, middle, found) if found else (middle, high, best)
        found = pack_groups(rest, low, shards - used)
        runs += [(size, n, used + number) for size, n, number in (found or best)[0]]
    return runs


def text_digest() -> Column:
    """Equal for equal texts; a null is taken as the empty text."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def size_of() -> Column:
    return F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + OVERHEAD


def group_shards(rows: DataFrame, shards: int) -> DataFrame:
    """(digest, shard) for each group of rows (digest, size)."""
    groups = rows.groupBy("digest").agg((F.count(F.lit(1)) * F.first("size")).alias("bytes"))
    groups = groups.repartitionByRange(shuffle_partitions(rows.sparkSession), F.col("bytes").desc(), "digest").sortWithinPartitions(F.col("bytes").desc(), "digest")
    groups = stored(groups.withColumn("nth", F.monotonically_increasing_id()), "groups")
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by([("bytes", "descending")])
    runs = level(list(zip(sizes["bytes"].to_pylist(), sizes["n"].to_pylist(), strict=True)), shards)
    # places of groups in descending order of size: where each run begins, runs of one bin joined
    begin, into, place = [], [], 0
    for _, n, number in runs:
        if not into or into[-1] != number:
            begin.append(place)
            into.append(number)
        place += n
    begin, into = np.array(begin, np.int64), np.array(into, np.int64)
    counts = groups.groupBy(F.shiftrightunsigned("nth", 33).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before, done = {}, 0
    for r in sorted(counts.collect(), key=lambda r: r.part):  # a row for each partition
        before[r.part], done = done, done + r.n

    def run(batches):
        for batch in batches:
            nth = batch.column("nth").to_numpy()
            place = np.array([before[p] for p in (nth >> 33).tolist()], np.int64) + (nth & ((1 << 33) - 1))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(into[np.searchsorted(begin, place, "right") - 1].astype(np.int32))], names=["digest", "shard"])

    out = stored(groups.select("digest", "nth").mapInArrow(lean(run), "digest binary, shard int"), "group-shards")
    discard(groups)
    return out


def assign(docs: DataFrame, shards: int = 40, heavy: int = 1000, carry: list[Column] | None = None) -> DataFrame:
    """docs with size, shard (from 0) and slot (gapless from 0 in each shard); documents with equal texts share a shard.

    Sizes of shards are near equal: as equal as groups permit, as `level` says; a shard's size is the sum of its texts'
    UTF-8 bytes and 16 for each document.  Null and empty texts are one group of 16 bytes a document.  Repeated rows are
    rows of their own, null ids are kept; with fewer groups than shards, shards stay empty.  Columns named digest, size,
    shard or slot are replaced; others are carried on, whatever their names (or what `carry` lists, without the texts).  An
    empty table gives no rows.

    Groups of more than a `heavy`-th of all rows, at most `heavy` of them, are broadcast to find their shard; the rest
    join by digest, so that no key of the shuffle holds more than that.
    """
    spark = docs.sparkSession
    ship(spark)
    own = carry or [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("digest", "size", "shard", "slot")]
    rows = stored(docs.select(*own, size_of().alias("size"), text_digest().alias("digest")), "rows")
    where = group_shards(rows.select("digest", "size"), shards)
    crowded = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") * heavy > rows.count()).select("digest")
    hot = stored(where.join(F.broadcast(crowded), "digest").select("digest", F.col("shard").alias("_hot")).coalesce(1), "heavy")
    placed = rows.join(F.broadcast(hot), "digest", "left")
    cold = placed.where("_hot IS NULL").drop("_hot").join(where, "digest")
    placed = _numbered(placed.where("_hot IS NOT NULL").withColumnRenamed("_hot", "shard").unionByName(cold).drop("digest"))
    for old in (rows, where, hot):
        discard(old)
    return placed


def _numbered(placed: DataFrame) -> DataFrame:
    """placed with slot: a row's number among those of its shard in its task, behind those of the tasks before."""

    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for batch in batches:
            shard = batch.column("shard").to_numpy().astype(np.int64)
            if len(shard) and shard.max() >= len(seen):
                seen = np.concatenate([seen, np.zeros(int(shard.max()) + 1 - len(seen), np.int64)])
            order = np.argsort(shard, kind="stable")
            values, first, n = np.unique(shard[order], return_index=True, return_counts=True)
            nth = np.empty(len(shard), np.int64)
            nth[order] = np.arange(len(shard)) - np.repeat(first, n) + np.repeat(seen[values], n)
            seen[values] += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth), pa.array(np.full(len(nth), part, np.int32))], schema=batch.schema.append(pa.field("_nth", pa.int64())).append(pa.field("_part", pa.int32())))

    kinds = T.StructType([*placed.schema.fields, T.StructField("_nth", T.LongType()), T.StructField("_part", T.IntegerType())])
    done = stored(placed.mapInArrow(lean(run), kinds), "placed")
    counts = done.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    before = stored(counts.select("shard", "_part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before")), "offsets")
    before = F.broadcast(before) if before.count() <= 1_000_000 else before
    return done.join(before, ["shard", "_part"]).withColumn("slot", F.col("_nth") + F.col("_before")).drop("_nth", "_part", "_before")


def write_shards(docs: DataFrame, path: str, shards: int = 40) -> None:
    """Whole documents as Parquet, a folder for each shard, in the order of their slots within a file."""
    assign(docs, shards).repartition(shards * 4, "shard", F.pmod("slot", F.lit(4))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op13: all documents in 40 shards of near equal bytes, equal texts together."""
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = assign(table(spark, sf_dir, "documents"), 40, carry=[F.col("doc_id"), crc.alias("text_crc32")])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
