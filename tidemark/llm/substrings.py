"""Incremental substring deduplication over words, with a log-structured index of window fingerprints.

Each batch of documents is written once, as an immutable run of entries (anchor, document, first window, windows) in
the order of the anchors.  A new batch's run is merge-joined with those before it; anchors that meet another entry tell
which windows may stand elsewhere, and these windows are then compared as a whole, by 128 bits of two hashes that share
neither word hashes nor bases.  Runs are merged into one when there are more than `fan_in`.  An index lives in a folder,
with a manifest of its runs, and can be opened again for the next batch.  See windows.py for what an anchor is.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, discard, lean, new_path, ship, slices, stored, table, trim
from .windows import OTHER_BASE, covered, prefix, runs, span_hash, words

WORDS, GRAM = 35, 6
ENTRIES = "anchor long, doc_id long, mark long, start int, windows int, again boolean"


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text, so that rows which share a doc_id are told apart) and text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def entries(docs: DataFrame, n: int = WORDS, k: int = GRAM) -> DataFrame:
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch, 2_000_000):
                some = batch.slice(i, j - i)
                h, ends = words(some.column("text"))
                anchor, start, count, own, again = runs(h, ends, n, k)
                first = np.concatenate([[0], ends[:-1]])
                at = pa.array(own)
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), some.column("doc_id").take(at), some.column("mark").take(at), pa.array((start - first[own]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again)], names=[x.split()[0] for x in ENTRIES.split(", ")])

    return rows_of(docs).mapInArrow(lean(run), ENTRIES)


class FingerprintIndex:
    """Sorted immutable runs in a folder (default: a new one in the shared folder), with a manifest for each state."""

    def __init__(self, spark: SparkSession, fan_in: int = 4, n: int = WORDS, k: int = GRAM, path: str | None = None):
        self.spark, self.fan_in, self.n, self.k = spark, fan_in, n, k
        self.path, self.state = path or new_path(spark, "index"), 0
        self.runs: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index of a folder, as its last manifest describes it."""
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        names = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
        states = [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]
        if not states:
            raise ValueError(f"{path} has no manifest")
        x = json.loads("\n".join(r.value for r in spark.read.text(f"{path}/manifest-{max(states):06d}.json").collect()))
        out = cls(spark, x["fan_in"], x["n"], x["k"], path)
        out.runs, out.state = x["runs"], max(states)
        return out

    def _commit(self) -> None:
        """Write the next manifest: under another name first, so that none is ever seen in part."""
        self.state += 1
        jvm = self.spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest-{self.state:06d}.json")
        part = jvm.org.apache.hadoop.fs.Path(f"{self.path}/_{place.getName()}")
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(part, True)
        out.write(bytearray(json.dumps({"fan_in": self.fan_in, "n": self.n, "k": self.k, "runs": self.runs}).encode()))
        out.close()
        if not fs.rename(part, place):
            raise OSError(f"{place} can't be written")

    def _write(self, entries_: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        entries_.sortWithinPartitions("anchor").write.parquet(f"{self.path}/{name}")
        return name

    def _read(self, name: str) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(f"{self.path}/{name}")

    def add(self, batch: DataFrame) -> DataFrame:
        """Write the batch's run; returns the anchors (anchor) of the batch that have another entry, here or before."""
        name = self._write(entries(batch, self.n, self.k))
        new = self._read(name).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again"))
        met = new.where("n > 1 OR again").select("anchor")
        if self.runs:
            met = met.unionByName(new.where("n = 1 AND NOT again").select("anchor").join(self.entries(), "anchor", "left_semi"))
        met = stored(met, "met")
        self.runs.append(name)
        self._commit()
        if len(self.runs) > self.fan_in:
            self.compact()
        return met

    def entries(self) -> DataFrame:
        out = self._read(self.runs[0])
        for run in self.runs[1:]:
            out = out.unionByName(self._read(run))
        return out

    def compact(self) -> None:
        """Merge all runs into one; the old ones go when the manifest names the new one."""
        if len(self.runs) > 1:
            # entries are dealt by anchor and document, so that a common anchor is no single task
            old, self.runs = self.runs, [self._write(self.entries().repartition(F.col("anchor"), F.pmod(F.col("mark"), F.lit(16))))]
            self._commit()
            for run in old:
                delete(self.spark, f"{self.path}/{run}")

    def drop(self) -> None:
        """Delete the folder."""
        delete(self.spark, self.path)


def release(spark: SparkSession) -> None:
    """Give back what finished steps held of the driver's memory now, not when the driver happens to collect its garbage; stored() frees their shuffle files."""
    trim()
    spark.sparkContext._jvm.System.gc()


def two_hashes(texts: pa.Array, h: np.ndarray, at: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of stretches of the texts' words, whose hashes are h."""
    other = words(texts, seed=29)[0]
    return span_hash(prefix(h), at, size), span_hash(prefix(other, OTHER_BASE), at, size, OTHER_BASE)


def _flat(lists) -> tuple[np.ndarray, pa.StructArray]:
    """The row and the struct of each element of a list column."""
    return np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten()


def _on_document(rows: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    return rows.join(right, rows.doc_id.eqNullSafe(right.doc_id) & (rows.mark == right.mark), how).select(rows.doc_id, rows.mark, "text", column)


def repeated_windows(docs: DataFrame, batches: int = 3, n: int = WORDS, k: int = GRAM) -> DataFrame:
    """(doc_id, mark, runs array<struct<start, windows>>): windows whose word sequence also starts anywhere else.

    The table goes through the index in `batches` parts (by a hash of doc_id); the index compacts on the way.  A run whose words stand elsewhere as they
    are repeats as a whole; of the others, and one of each of those, single windows are compared if their anchor stands
    in more than one of them or twice in a document.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = rows_of(docs)
    index, met = FingerprintIndex(spark, fan_in=2, n=n, k=k), None
    for b in range(batches):
        part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == b) if batches > 1 else docs
        found = index.add(part)
        met = found if met is None else met.unionByName(found)
    # an anchor may be met in several batches
    marked = index.entries().join(met.distinct(), "anchor", "left_semi")
    marked = stored(marked.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("anchor", "start", "windows", "again")).alias("runs")), "marked")
    index.drop()
    release(spark)

    def describe(batches_):
        for batch in batches_:
            for i, j in slices(batch, 2_000_000):
                some = batch.slice(i, j - i)
                h, ends = words(some.column("text"))
                own, flat = _flat(some.column("runs"))
                start, count = flat.field("start"), flat.field("windows").to_numpy().astype(np.int64)
                at = start.to_numpy().astype(np.int64) + np.concatenate([[0], ends[:-1]])[own]
                to, whole, half = pa.array(own), *two_hashes(some.column("text"), h, at, count + n - 1)
                yield pa.RecordBatch.from_arrays([flat.field("anchor"), pa.array(whole.view(np.int64)), pa.array(half.view(np.int64)), some.column("doc_id").take(to), some.column("mark").take(to), start, flat.field("windows"), flat.field("again")], names=["anchor", "whole", "half", "doc_id", "mark", "start", "windows", "again"])

    stretches = stored(_on_document(rows, marked, "runs").mapInArrow(lean(describe), "anchor long, whole long, half long, doc_id long, mark long, start int, windows int, again boolean"), "stretches")
    discard(marked)
    release(spark)
    key = ["anchor", "whole", "half", "windows"]
    kinds = stored(stretches.groupBy(*key).agg(F.min(F.struct("doc_id", "mark", "start")).alias("first"), F.count(F.lit(1)).alias("n"), F.max("again").alias("again")), "kinds")
    full = stored(stretches.join(kinds.where("n > 1").select(*key), key, "left_semi").select("doc_id", "mark", "start", "windows"), "full")
    discard(stretches)
    crowd = kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd"))
    open_ = kinds.join(crowd, "anchor").where("crowd > 1 OR again").select("first.*", "windows", (F.col("n") == 1).alias("solo"))
    open_ = stored(open_.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "windows", "solo")).alias("runs")), "open")
    discard(kinds)
    release(spark)

    def single(batches_):
        for batch in batches_:
            for i, j in slices(batch, 2_000_000):
                some = batch.slice(i, j - i)
                h, ends = words(some.column("text"))
                first = np.concatenate([[0], ends[:-1]])
                own, flat = _flat(some.column("runs"))
                start, count = flat.field("start").to_numpy().astype(np.int64), flat.field("windows").to_numpy().astype(np.int64)
                at = np.repeat(first[own] + start, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                solo, own = np.repeat(flat.field("solo").to_numpy(zero_copy_only=False), count), np.repeat(own, count)
                to, whole, half = pa.array(own), *two_hashes(some.column("text"), h, at, n)
                yield pa.RecordBatch.from_arrays([pa.array(whole.view(np.int64)), pa.array(half.view(np.int64)), some.column("doc_id").take(to), some.column("mark").take(to), pa.array((at - first[own]).astype(np.int32)), pa.array(solo)], names=["whole", "half", "doc_id", "mark", "start", "solo"])

    windows = stored(_on_document(rows, open_, "runs").mapInArrow(lean(single), "whole long, half long, doc_id long, mark long, start int, solo boolean"), "windows")
    discard(open_)
    release(spark)
    # a table of its own: the rows of a window that stands in a third of all documents can then be split in the join
    twice = stored(windows.groupBy("whole", "half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("whole", "half"), "twice")
    again = windows.where("solo").join(twice, ["whole", "half"], "left_semi").select("doc_id", "mark", "start", F.lit(1).alias("windows"))
    out = stored(full.unionByName(again).groupBy("doc_id", "mark").agg(F.collect_set(F.struct("start", "windows")).alias("runs")), "repeats")
    for part in (windows, twice, full):
        discard(part)
    release(spark)
    return out


def _kept(w: list[bytes], runs_, n: int) -> list[bytes]:
    """Words that no repeated window covers."""
    v = runs_.values
    gone = covered(v.field("start").to_numpy().astype(np.int64), v.field("windows").to_numpy().astype(np.int64), n, len(w))
    return [x for x, cut in zip(w, gone.tolist(), strict=True) if not cut]


def cut_repeats(docs: DataFrame, batches: int = 3, n: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the words left, joined by one space) for every row.

    Null and empty texts have no words; a row whose text stands in another row loses all words if it has n or more;
    rows may share a doc_id or have none; other columns of docs are not read.  Windows are judged on the input.
    """
    found = repeated_windows(docs, batches, n)
    rows = rows_of(docs)

    def run(batches_):
        for batch in batches_:
            for i, j in slices(batch):
                some = batch.slice(i, j - i)
                out = []
                for text, runs_ in zip(some.column("text").to_pylist(), some.column("runs"), strict=True):
                    w = text.encode("utf-8", "surrogatepass").split()
                    kept = _kept(w, runs_, n) if runs_.is_valid else w
                    left = b" ".join(kept)
                    out.append((len(w), len(w) - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("mark"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], names=["doc_id", "mark", "n_words", "n_removed", "kept_sha256", "kept"])

    return _on_document(rows, found, "runs", "left").mapInArrow(lean(run), "doc_id long, mark long, n_words long, n_removed long, kept_sha256 string, kept string")


def drop_repeats(docs: DataFrame, batches: int = 3, n: int = WORDS) -> DataFrame:
    """docs with the words of repeated windows cut from text (and n_chars, if there, made anew); all columns are kept.

    A text in which nothing repeats is left as it is, null and empty ones too; one that loses all its words goes, with
    its row.  Rows that agree in doc_id and text are cut alike; a null doc_id is an id like any other; columns of docs may
    have any names; an empty table stays empty.
    """
    found = repeated_windows(docs, batches, n)
    names = docs.columns
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"))
    joined = rows.join(found, rows.doc_id.eqNullSafe(found.doc_id) & (rows.mark == found.mark), "left").select("row", "runs")

    def run(batches_):
        for batch in batches_:
            whole = pa.RecordBatch.from_arrays([batch.column("row").field(c) for c in names], names=names)
            for i, j in slices(whole):
                some, runs_of = whole.slice(i, j - i), batch.column("runs").slice(i, j - i)
                texts, keep = [], []
                for text_, runs_ in zip(some.column("text").to_pylist(), runs_of, strict=True):
                    if runs_.is_valid:
                        text_ = b" ".join(_kept(text_.encode("utf-8", "surrogatepass").split(), runs_, n)).decode("utf-8", "surrogatepass")
                    texts.append(text_)
                    keep.append(not runs_.is_valid or bool(text_))
                at = names.index("text")
                out = some.set_column(at, some.schema.field(at), pa.array(texts, some.schema.field(at).type))
                if "n_chars" in names:
                    k = names.index("n_chars")
                    old = some.column("n_chars").to_pylist()
                    out = out.set_column(k, some.schema.field(k), pa.array([len(t) if s.is_valid else o for t, s, o in zip(texts, runs_of, old, strict=True)], some.schema.field(k).type))
                yield out.filter(pa.array(keep))

    return joined.mapInArrow(lean(run), docs.schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op6: words of windows that stand elsewhere are removed."""
    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
