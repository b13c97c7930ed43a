"""Benchmark decontamination: short test items found inside long documents by MinHash containment search.

Items are partitioned by size: an item of q shingles is of the class of the least power of two s >= q (at least 8).
For each class the stretches of 2 s shingles that begin at every s-th shingle of a document are its search windows, so
an item that stands in a document lies within one window and makes up over a quarter of it: the Jaccard similarity is
bounded below whatever the document's length (items of under 5 distinct shingles, or of at most half their class, are
looked up by each of their shingles instead, and none is missed), where a signature of the whole long document would be swamped.  Windows
are unions of blocks of 8 shingles, so minima are taken once and merged upwards.  A window and an item of its class are
a candidate if they share a minimum under any permutation (bands of one row).  With p permutations a window that holds
the share c >= 0.8 of an item is missed with probability below (1 - 0.8 / 4.2) ** p, 4e-6 for 64.  Candidates are
verified on the shingles themselves, of the whole document: containment = distinct shared shingles / distinct shingles
of the item.

Words are what stands between white space and ASCII punctuation, lower-cased; an item with fewer words than a shingle is
one shingle of all its words and found by looking up a document's stretches of as many words.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, ship, slices, table

_BLANK = bytes.maketrans((string.punctuation + "\t\n\v\f\r").encode(), b" " * (len(string.punctuation) + 5))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FOUND = "doc_id long, item_id long, shared int, item_shingles int, containment double"


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split() if text else []


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, 9)


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = _hash(word)
        return h


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n consecutive word hashes; fewer words are one shingle."""
    if not len(h):
        return h
    k = min(n, len(h))
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + h[i : len(h) - k + 1 + i]
    return mix(out + np.uint64(k))


def shingles(w: list[bytes], n: int) -> frozenset[bytes]:
    """Distinct n consecutive words, joined; fewer words are one shingle."""
    return frozenset(b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def _by_hash(sets: list[np.ndarray], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the items of these numbers in order, and whose they are."""
    h, whose = np.concatenate([sets[n] for n in numbers]), np.repeat(numbers, [len(sets[n]) for n in numbers])
    order = np.argsort(h, kind="stable")
    return h[order], whose[order]


class ContainmentIndex:
    """Signatures of items by size class."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int = 5, threshold: float = 0.8, permutations: int = 64):
        self.shingle, self.threshold = shingle, threshold
        self.odd = mix(np.arange(1, permutations + 1, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)
        self.items: list[tuple[int | None, frozenset[bytes]]] = []
        sets: list[np.ndarray] = []
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by number of words: hashes in order, and whose they are
        self.words: list[int] = []
        self.few: tuple[np.ndarray, np.ndarray] = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        classes: dict[int, list[int]] = {}
        few: list[int] = []
        short: dict[int, list[int]] = {}
        for item_id, text in items:
            w = words_of(text)
            if not w:
                continue  # an item without words is nowhere
            s = np.unique(shingle_hashes(np.array([_hash(x) for x in w], np.uint64), shingle))
            number = len(self.items)
            self.items.append((item_id, shingles(w, shingle)))
            self.words.append(min(len(w), shingle))
            sets.append(s)
            if len(w) < shingle:
                short.setdefault(len(w), []).append(number)
            elif len(s) < 5 or 2 * len(s) <= 1 << (len(w) - shingle).bit_length():
                few.append(number)
            else:
                classes.setdefault(max(8, 1 << (len(w) - shingle).bit_length()), []).append(number)
        if few:
            # their shingles in order, and whose they are
            self.few = _by_hash(sets, few)
        self.short = {k: _by_hash(sets, numbers) for k, numbers in short.items()}
        # for each class and permutation: minima in order, and whose they are
        self.classes = {}
        for s, numbers in sorted(classes.items()):
            minima = np.array([[(sets[n] * o).min() for n in numbers] for o in self.odd], np.uint64)
            order = np.argsort(minima, axis=1, kind="stable")
            bits = np.zeros((len(self.odd), 1 << 16), bool)
            for p, row in enumerate(minima):
                bits[p, (row >> np.uint64(48)).astype(np.int64)] = True
            self.classes[s] = (np.take_along_axis(minima, order, axis=1), np.array(numbers)[order], bits)

    def candidates(self, h: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """(document, item) pairs; h: shingle hashes of documents one after another, each padded to whole blocks of 8."""
        found: set[tuple[int, int]] = set()
        if len(h) and len(self.few[0]):
            hashes, whose = self.few
            a, b = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            for k in np.flatnonzero(b > a):
                found.update((int(owner[k]), int(n)) for n in whose[a[k] : b[k]])
        if not len(h) or not self.classes:
            return found
        largest = max(self.classes)
        first_owner = owner[::8]
        for p, o in enumerate(self.odd):
            low, size, own = (h * o).reshape(-1, 8).min(axis=1), 8, first_owner
            while True:
                # windows of two neighbouring blocks of one document, and each block alone (the last of a document)
                if size in self.classes:
                    minima, numbers, bits = self.classes[size]
                    window = low.copy()
                    same = own[1:] == own[:-1]
                    window[:-1][same] = np.minimum(window[:-1][same], low[1:][same])
                    hit = np.flatnonzero(bits[p][(window >> np.uint64(48)).astype(np.int64)])
                    if len(hit):
                        a, b = np.searchsorted(minima[p], window[hit], "left"), np.searchsorted(minima[p], window[hit], "right")
                        for k in np.flatnonzero(b > a):
                            found.update((int(own[hit[k]]), int(n)) for n in numbers[p][a[k] : b[k]])
                if size >= largest:
                    break
                # blocks of twice the size begin at even blocks of their document
                start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                inside = np.arange(len(own)) - np.repeat(start, np.diff([*start, len(own)]))
                heads = np.flatnonzero(inside % 2 == 0)
                low, own, size = np.minimum.reduceat(low, heads), own[heads], size * 2
        return found

    def search(self, texts: list[str | None], memo: dict) -> list[tuple[int, int, int, int]]:
        """(text's number, item's number, shared, shingles) at or over the threshold."""
        split = [words_of(t) for t in texts]
        lists = [np.fromiter(map(memo.__getitem__, w), np.uint64, len(w)) for w in split]
        hashes = [shingle_hashes(x, self.shingle) for x in lists]
        parts, owners = [], []
        for n, x in enumerate(hashes):
            if len(x):
                pad = -len(x) % 8
                parts.append(np.concatenate([x, np.full(pad, x[-1], np.uint64)]) if pad else x)
                owners.append(np.full(len(x) + pad, n, np.int32))
        pairs = self.candidates(np.concatenate(parts), np.concatenate(owners)) if parts else set()
        for k, (known, whose) in self.short.items():
            for n, x in enumerate(lists):
                if len(x) >= k:
                    here = shingle_hashes(x, k)
                    a, b = np.searchsorted(known, here, "left"), np.searchsorted(known, here, "right")
                    for at in np.flatnonzero(b > a).tolist():
                        pairs.update((n, int(m)) for m in whose[a[at] : b[at]])
        out, shown = [], {}
        for n, m in sorted(pairs, key=lambda p: (p[0], self.words[p[1]], p[1])):
            k, own = self.words[m], self.items[m][1]
            if (n, k) not in shown:
                shown = {(n, k): shingles(split[n], k) if len(split[n]) >= k else frozenset()}
            shared = len(own & shown[n, k])
            if shared >= self.threshold * len(own):
                out.append((n, m, shared, len(own)))
        return out


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, permutations: int = 64, block: int = 10_000) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) of all pairs with containment >= threshold.

    Items go to the executors in blocks of `block` rows, so what is sent is bounded; each block is one pass over docs.
    Null and empty texts match nothing, on either side; repeated rows give repeated results; null ids are kept.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))

    def one(part: list[tuple]) -> DataFrame:
        index = spark.sparkContext.broadcast(ContainmentIndex(part, shingle, threshold, permutations))

        def run(batches):
            memo, ix = _Memo(), index.value
            for batch in batches:
                for i, j in slices(batch, 2_000_000):
                    some = batch.slice(i, j - i)
                    ids, got = some.column("doc_id"), ix.search(some.column("text").to_pylist(), memo)
                    if got:
                        n, m, shared, size = zip(*got, strict=True)
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(n)), pa.array([ix.items[k][0] for k in m], pa.int64()), pa.array(shared, pa.int32()), pa.array(size, pa.int32()), pa.array([a / b for a, b in zip(shared, size, strict=True)], pa.float64())], names=[x.split()[0] for x in FOUND.split(", ")])

        return rows.mapInArrow(lean(run), FOUND)

    out, part = None, []
    for row in items.toLocalIterator():
        part.append((row["item_id"], row["text"]))
        if len(part) == block:
            out, part = (one(part) if out is None else out.unionByName(one(part))), []
    if part or out is None:
        out = one(part) if out is None else out.unionByName(one(part))
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with each item's containment."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, shingle: int = 5, permutations: int = 64, block: int = 10_000) -> DataFrame:
    """docs without the rows that hold an item at or over the threshold; all columns are kept, whatever their names.

    Null and empty texts hold nothing and stay; rows with equal texts stay or go together; an empty table, or an empty
    benchmark, leaves docs as they are.
    """
    spark = docs.sparkSession
    ship(spark)

    def without(rows: DataFrame, part: list[tuple]) -> DataFrame:
        index = spark.sparkContext.broadcast(ContainmentIndex(part, shingle, threshold, permutations))

        def run(batches):
            memo, ix = _Memo(), index.value
            for batch in batches:
                for i, j in slices(batch, 2_000_000):
                    some = batch.slice(i, j - i)
                    keep = np.ones(j - i, bool)
                    keep[[n for n, *_ in ix.search(some.column("text").to_pylist(), memo)]] = False
                    yield some.filter(pa.array(keep))

        return rows.mapInArrow(lean(run), rows.schema)

    out, part = docs, []
    for row in benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        part.append((row["item_id"], row["text"]))
        if len(part) == block:
            out, part = without(out, part), []
    return without(out, part) if part else out
