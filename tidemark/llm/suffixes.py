"""Removal of repeated byte strings with suffix arrays.

Windows of n bytes that may repeat are found by their anchors (windows.py).  Every run of such windows, with the bytes
they cover, is a segment; equal segments are one, of which the earliest keeps its bytes.  Equal windows have their anchor at
one place, so they also have the bytes in common that every window with the anchor thereabouts has: a segment whose bytes
around the anchor no other has is left out.  The others are dealt to shards by
their anchor, so equal windows meet in one shard, and a shard's suffix array shows which windows also start earlier.  An
anchor with more segments than a shard may hold is dealt over several; each of these shards gives its first windows, and
those that stand in several shards are found by their bytes, in sorted order, with the ends of equal ones by binary search.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, ship, slices, stored, table
from .substrings import release, rows_of
from .windows import covered, mix, placed_runs

BYTES, GRAM = 100, 16
ENTRIES = "anchor long, doc_id long, mark long, start int, windows int, again boolean, at int"
ZONES = 3  # ranges of an anchor's place in a window
_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))


def suffix_array(data: np.ndarray, depth: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, words): places in the order of their suffixes' first `depth` bytes at least (None: all), by Larsson-Sadakane refinement.

    Groups start as those of equal first 8 bytes (words, zero behind the end); a group is split by its members' groups h
    places on, h = 8, 16, ..., and what has become single is left alone.  Of suffixes that end, the shorter comes first.
    """
    n = len(data)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words <<= np.uint64(8)
        words[: max(0, n - k)] |= data[k:]
    order = np.argsort(words)
    head = np.ones(n, bool)
    if n:
        head[1:] = words[order[1:]] != words[order[:-1]]
    start = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = start
    h = 8
    while depth is None or h < max(depth, 9):
        single = head & np.append(head[1:], True)
        at = np.flatnonzero(~single)
        if not len(at):
            break
        places = order[at]
        group = rank[places]
        on = places + h
        second = np.where(on < n, rank[np.minimum(on, n - 1)] + 1, n - on - 1)
        sort = np.argsort(group * (n + h + 1) + second + h)
        order[at] = places = places[sort]
        group, second = group[sort], second[sort]
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (second[1:] != second[:-1])
        head[at] = new
        rank[places] = np.maximum.accumulate(np.where(new, at, 0))
        h *= 2
    return order, words


def common_prefixes(data: np.ndarray, order: np.ndarray, words: np.ndarray, cap: int, stride: int = 32) -> np.ndarray:
    """Kasai's longest common prefixes of neighbours in the order, up to cap; the first is 0.

    Kasai's bound (a suffix shares at least one byte less with its neighbour than the suffix before it does) is used in
    strides: every stride-th place is compared in full, the places between start from the bound.  Where the full comparison
    ended at the cap, the order may go no deeper, and there is no bound.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)

    def extend(places: np.ndarray) -> None:
        places = places[before[places] >= 0]
        while len(places):
            a, b = places + shared[places], before[places] + shared[places]
            inside = (np.maximum(a, b) < n) & (shared[places] < cap)
            places, a, b = places[inside], a[inside], b[inside]
            differ = words[a] ^ words[b]
            high, low = (np.frexp((x & np.uint64(0xFFFFFFFF)).astype(np.float64))[1] for x in (differ >> np.uint64(32), differ))
            # equal leading bytes, not beyond the end
            equal = np.where(high > 0, (32 - high) // 8, 4 + (32 - low) // 8)
            equal = np.minimum(equal, n - np.maximum(a, b))
            shared[places] += equal
            places = places[equal == 8]

    extend(np.arange(0, n, stride))
    rest = np.arange(n)
    rest = rest[rest % stride > 0]
    bound = shared[rest - rest % stride]
    shared[rest] = np.where(bound < cap, np.maximum(bound - rest % stride, 0), 0)
    extend(rest)
    return np.minimum(shared, cap)[order]


def entries(docs: DataFrame, n: int, k: int, piece: int = 1 << 22) -> DataFrame:
    """Entries of all windows; a long text goes piece by piece, with n - 1 bytes of overlap."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch, 1_000_000):
                some = batch.slice(i, j - i)
                texts = some.column("text").cast(pa.binary())
                parts, owner, offset = [], [], []
                for d, t in enumerate(texts):
                    raw = np.frombuffer(t.as_buffer(), np.uint8) if len(t.as_buffer()) else np.zeros(0, np.uint8)
                    for x in range(0, max(1, len(raw) - n + 1), piece):
                        parts.append(raw[x : x + piece + n - 1])
                        owner.append(d)
                        offset.append(x)
                flat, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
                anchor, start, count, own, again, at = placed_runs(_SYMBOL[flat], ends, n, k)
                first = np.concatenate([[0], ends[:-1]])
                to = pa.array(np.array(owner)[own])
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), some.column("doc_id").take(to), some.column("mark").take(to), pa.array((start - first[own] + np.array(offset)[own]).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again), pa.array(at.astype(np.int32))], names=[x.split()[0] for x in ENTRIES.split(", ")])

    return rows_of(docs).mapInArrow(lean(run), ENTRIES)


def _join(rows: DataFrame, right: DataFrame, column: str, how: str = "inner") -> DataFrame:
    on = rows.doc_id.eqNullSafe(right.doc_id) & (rows.mark == right.mark)
    return rows.join(right, on, how).select(rows.doc_id, rows.mark, "text", column)


def _spans(batch) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Texts of a batch as bytes, and the starts and windows of their runs."""
    texts = [np.frombuffer(t.as_buffer(), np.uint8) if len(t.as_buffer()) else np.zeros(0, np.uint8) for t in batch.column("text").cast(pa.binary())]
    starts, counts = [], []
    for r in batch.column("runs"):
        v = r.values
        starts.append(v.field("start").to_numpy().astype(np.int64) if r.is_valid else np.zeros(0, np.int64))
        counts.append(v.field("windows").to_numpy().astype(np.int64) if r.is_valid else np.zeros(0, np.int64))
    return texts, starts, counts


def zones(n: int, k: int) -> list[tuple[int, int]]:
    """First and last place in a window of n bytes at which its anchor of k bytes stands, for each range of them."""
    edges = [(n - k + 1) * z // ZONES for z in range(ZONES + 1)]
    return [(a, b - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def shard_repeats(segments: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a shard start earlier in it too: (place in the concatenated windows, place of the first).

    segments stand in the order of their places in the corpus.
    """
    sizes = np.array(list(map(len, segments)), np.int64)
    data = np.frombuffer(b"".join(segments), np.uint8)
    order, words = suffix_array(data, n)
    shared = common_prefixes(data, order, words, n)
    group = np.cumsum(shared < n)
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(len(data)) - np.repeat(begin, sizes)
    valid = inside <= np.repeat(sizes - n, sizes)
    keep = valid[order]
    place, group = order[keep], group[keep]
    first = np.full(int(group.max(initial=0)) + 1, len(data), np.int64)
    np.minimum.at(first, group, place)
    return place, first[group]


def late_windows(docs: DataFrame, n: int = BYTES, k: int = GRAM, shard_segments: int = 20_000, shard_bytes: int = 3 << 20) -> DataFrame:
    """(doc_id, mark, runs array<struct<start, windows>>): windows of n bytes that also start earlier in the corpus."""
    spark = docs.sparkSession
    ship(spark)
    rows = rows_of(docs)
    index = stored(entries(docs, n, k), "run")
    met = index.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.max("again").alias("again")).where("n > 1 OR again").select("anchor")
    marked = index.join(met, "anchor", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set(F.struct("anchor", "start", "windows", "again", "at")).alias("runs"))
    marked = stored(marked, "marked")
    discard(index)
    release(spark)

    around = zones(n, k)
    tag_names = [f"tag{z}" for z in range(len(around))]

    def describe(batches):
        import xxhash

        for batch in batches:
            for i, j in slices(batch, 2_000_000):
                some = batch.slice(i, j - i)
                texts, starts, counts = _spans(some)
                text = np.repeat(np.arange(j - i), [len(s) for s in starts])
                to = pa.array(text)
                anchor = np.concatenate([r.values.field("anchor").to_numpy() for r in some.column("runs")])
                again = np.concatenate([r.values.field("again").to_numpy(zero_copy_only=False) for r in some.column("runs")])
                at = np.concatenate([r.values.field("at").to_numpy() for r in some.column("runs")]).astype(np.int64)
                start, count = np.concatenate(starts), np.concatenate(counts)
                # 128 bits of a segment's bytes, and 64 of those that its windows with the anchor in a zone have in common
                own: list[bytes] = []
                for t, s, c in zip(texts, starts, counts, strict=True):
                    raw = memoryview(t)
                    own += [xxhash.xxh3_128_digest(raw[x : x + y + n - 1]) for x, y in zip(s.tolist(), c.tolist(), strict=True)]
                views = [memoryview(t) for t in texts]
                tags = []
                for z, (lo, hi) in enumerate(around):
                    ok = (at >= lo) & (at - hi < count)
                    tag = np.zeros(len(at), np.uint64)
                    tag[ok] = [xxhash.xxh3_64_intdigest(views[d][x - lo : x - hi + n], z) for d, x in zip(text[ok].tolist(), (start + at)[ok].tolist(), strict=True)]
                    tags.append(pa.array(tag.view(np.int64), mask=~ok))
                whole, half = np.frombuffer(b"".join(own), np.int64).reshape(-1, 2).T.copy()
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(whole), pa.array(half), some.column("doc_id").take(to), some.column("mark").take(to), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(again), *tags], names=["anchor", "whole", "half", "doc_id", "mark", "start", "windows", "again", *tag_names])

    segments = stored(_join(rows, marked, "runs").mapInArrow(lean(describe), "anchor long, whole long, half long, doc_id long, mark long, start int, windows int, again boolean, " + ", ".join(f"{t} long" for t in tag_names)), "segments")
    discard(marked)
    release(spark)
    key = ["anchor", "whole", "half", "windows"]
    # equal segments have equal tags, but where the anchor stands twice
    first = stored(segments.groupBy(*key).agg(F.min(F.struct("doc_id", "mark", "start", *tag_names)).alias("first"), F.count(F.lit(1)).alias("n"), F.max("again").alias("again")), "first")
    release(spark)
    place = ["doc_id", "mark", "start"]
    earliest = F.struct(*(F.col(f"first.{c}").alias(c) for c in place))
    copies = stored(segments.select(*key, *place).join(first.where("n > 1").select(*key, earliest.alias("first")), key).where(~F.struct(*place).eqNullSafe(F.col("first"))).select(*place, "windows"), "copies")
    discard(segments)
    release(spark)
    # the earliest of equal segments; one that is alone under its anchor, which its document has once, repeats nothing
    crowd = first.groupBy("anchor").agg(F.count(F.lit(1)).alias("crowd"), F.max("again").alias("twice"))
    owners = first.select("anchor", *(f"first.{c}" for c in place), "windows", F.array(*(f"first.{t}" for t in tag_names)).alias("tags")).join(crowd, "anchor").where("crowd > 1 OR twice")
    owners = stored(owners.withColumn("salts", F.ceil(F.col("crowd") / shard_segments).cast("int")).drop("crowd"), "crowds")
    discard(first)
    release(spark)
    # nor does one whose tags no other has, unless the anchor's place is not certain
    tagged = owners.where("NOT twice").withColumn("tag", F.explode(F.filter("tags", lambda t: t.isNotNull()))).drop("tags")
    shared = tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tag")
    crowds, owners = owners, tagged.join(shared, "tag", "left_semi").drop("tag").unionByName(owners.where("twice").drop("tags"))
    owners = owners.groupBy("doc_id", "mark").agg(F.collect_set(F.struct("anchor", "start", "windows", "salts")).alias("runs"))
    owners = stored(owners, "owners")
    discard(crowds)
    release(spark)

    def cut(batches):
        for batch in batches:
            for i, j in slices(batch, 2_000_000):
                some = batch.slice(i, j - i)
                texts, starts, counts = _spans(some)
                for d, (t, s, c, r) in enumerate(zip(texts, starts, counts, some.column("runs"), strict=True)):
                    if not len(s):
                        continue
                    to = pa.array(np.full(len(s), d))
                    raw = t.tobytes()
                    yield pa.RecordBatch.from_arrays([r.values.field("anchor"), some.column("doc_id").take(to), some.column("mark").take(to), pa.array(s.astype(np.int32)), pa.array(c.astype(np.int32)), r.values.field("salts"), pa.array([raw[a : a + b + n - 1] for a, b in zip(s.tolist(), c.tolist(), strict=True)], pa.binary())], names=["anchor", "doc_id", "mark", "start", "windows", "salts", "segment"])

    parts = _join(rows, owners, "runs").mapInArrow(lean(cut), "anchor long, doc_id long, mark long, start int, windows int, salts int, segment binary")
    parts = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int")).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt")

    def shards(batches):
        names = ["doc_id", "mark", "start", "windows", "window"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

        def out(blocks: list[tuple]):
            """blocks: doc_id, mark, start, salts, segment."""
            blocks.sort(key=lambda b: (b[0] is not None, b[0] or 0, b[1], b[2]))
            segments = [b[4] for b in blocks]
            place, first_ = shard_repeats(segments, n)
            sizes = np.array(list(map(len, segments)), np.int64)
            begin = np.cumsum(sizes) - sizes
            late = np.sort(place[place != first_])
            block = np.searchsorted(begin, late, side="right") - 1
            result = []
            if len(late):
                edge = np.flatnonzero(np.append(True, (np.diff(late) != 1) | (np.diff(block) != 0)))
                inside = (late - begin[block])[edge].tolist()
                for k, at, size in zip(block[edge].tolist(), inside, np.diff(np.append(edge, len(late))).tolist(), strict=True):
                    b = blocks[k]
                    result.append((b[0], b[1], b[2] + at, size, None))
            # shards of one anchor: their first windows are compared with those of the others
            if any(b[3] > 1 for b in blocks):
                mine = np.sort(place[place == first_])
                block = np.searchsorted(begin, mine, side="right") - 1
                for at, k in zip((mine - begin[block]).tolist(), block.tolist(), strict=True):
                    b = blocks[k]
                    if b[3] > 1:
                        result.append((b[0], b[1], b[2] + at, 1, b[4][at : at + n]))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*result, strict=True) if result else [[]] * 5, kinds, strict=True)], names=names)

        blocks: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            column = lambda c: batch.column(c).to_pylist()  # noqa: B023, E731
            for now, block in zip(zip(column("anchor"), column("salt"), strict=True), zip(*map(column, ("doc_id", "mark", "start", "salts", "segment")), strict=True), strict=True):
                if size >= shard_bytes and now != last:
                    yield out(blocks)
                    blocks, size = [], 0
                blocks.append(block)
                size += len(block[4])
                last = now
        if blocks:
            yield out(blocks)

    found = stored(parts.mapInArrow(lean(shards), "doc_id long, mark long, start int, windows int, window binary"), "late")
    discard(owners)
    release(spark)
    late = found.where("window IS NULL").select("doc_id", "mark", "start", "windows")
    heads = found.where("window IS NOT NULL")

    def merge(batches):
        carried = None
        for batch in batches:
            if not batch.num_rows:
                continue
            w = np.frombuffer(b"".join(batch.column("window").to_pylist()), np.uint8).reshape(-1, n)
            # where a row's stretch of equal windows begins, by binary search in the edges
            edges = np.concatenate([[0], np.flatnonzero((w[1:] != w[:-1]).any(axis=1)) + 1])
            begin = edges[np.searchsorted(edges, np.arange(len(w)), side="right") - 1]
            again = begin != np.arange(len(w))
            if carried is not None and (w[0] == carried).all():
                again[: edges[1] if len(edges) > 1 else len(w)] = True
            carried = w[-1].copy()
            yield batch.select(["doc_id", "mark", "start", "windows"]).filter(pa.array(again))

    # a window comes once from each shard of its anchor, so equal ones are few
    merged = heads.repartition("window").sortWithinPartitions("window", F.col("doc_id").asc_nulls_first(), "mark", "start").mapInArrow(lean(merge), "doc_id long, mark long, start int, windows int")
    out = stored(late.unionByName(copies).unionByName(merged).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "windows")).alias("runs")), "repeats")
    for part in (found, copies):
        discard(part)
    return out


def cut_repeats(docs: DataFrame, n: int = BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (binary) for every row.

    A null text is empty; rows that agree in doc_id and text are one document; rows that share a doc_id only come in the
    order of a hash of their texts, and a null doc_id comes first.  Other columns of docs are not read.
    """
    found = late_windows(docs, n)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch):
                some = batch.slice(i, j - i)
                out = []
                for t, s, c in zip(*_spans(some), strict=True):
                    gone = covered(s, c, n, len(t))
                    left = t[~gone].tobytes()
                    out.append((len(t), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(left).hexdigest(), left))
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return _join(rows_of(docs), found, "runs", "left").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op7: bytes of 100-byte strings that also start earlier are removed."""
    return cut_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
