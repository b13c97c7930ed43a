"""Best-fit packing of document pieces into sequences, by a local search that swaps pieces between underfull bins.

The plan is made on the histogram of piece lengths, which has at most `capacity` entries however many documents there
are: pieces of equal length are interchangeable.  A bin type is a multiset of lengths with a multiplicity.  From a first
plan, the local search moves one piece or two, exchanges one for one, or two for one, between underfull types, whenever
the squared fill grows, until bins run empty.  It stops where no exchange is left, or where the number of bins is the
least that the sum of lengths allows.  Last, pieces get their places: a piece's rank among those of its
length (from counts of each input partition) decides its bin.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, ship, slices, stored, table
from .units import encoder

Bin = tuple[int, ...]  # lengths, longest first

SLICE = 12_000_000  # bytes of text that are encoded at once
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def bin_types(histogram: dict[int, int], capacity: int) -> Counter:
    """Bin types with multiplicities by best fit; lengths come in the order of a hash, as pieces of an unsorted corpus would.

    All pieces of a length go together into the open bins with the least room that holds one, then into new bins.
    """
    if any(not 0 < n <= capacity for n, c in histogram.items() if c):
        raise ValueError("a length is not between 1 and the capacity")
    plan: Counter = Counter()
    rooms: list[tuple[int, Bin]] = []
    for n in sorted((n for n, c in histogram.items() if c), key=lambda n: (zlib.crc32(b"%d" % n), n)):
        left = histogram[n]
        while left:
            k = bisect_left(rooms, (n, ()))
            if k == len(rooms):
                full, rest = divmod(left, capacity // n)
                made = {(n,) * (capacity // n): full, (n,) * rest: 1 if rest else 0}
                left = 0
            else:
                room, b = rooms[k]
                some = min(plan[b], left)
                plan[b] -= some
                if not plan[b]:
                    del plan[b], rooms[k]
                made, left = {tuple(sorted((*b, n), reverse=True)): some}, left - some
            for b, copies in made.items():
                if copies:
                    if b not in plan and sum(b) < capacity:
                        insort(rooms, (capacity - sum(b), b))
                    plan[b] += copies
    return plan


def least_bins(plan: Counter, capacity: int) -> int:
    return -(-sum(sum(b) * c for b, c in plan.items()) // capacity)


def improve(plan: Counter, capacity: int) -> Counter:
    """Local search over underfull bin types.

    Bins are taken from the emptiest on.  From a bin a goes what takes most out of it: a piece (or two) to a fuller bin b
    that has the room, or in exchange for a shorter piece of b, if the squared fill grows by it.  It goes on until a runs
    empty or nothing fits, and passes go on until one changes nothing, or no plan can have fewer bins.
    All copies of a type that take part in an exchange take part at once.
    """
    plan = Counter({b: c for b, c in plan.items() if c})
    rooms: list[tuple[int, Bin]] = []
    holding: list[list[tuple[int, Bin]]] = [rooms] + [[] for _ in range(capacity)]  # underfull types by a length they hold; 0: all
    most = np.full(capacity + 1, -capacity - 1, np.int64)  # the greatest room among these

    def enter(b: Bin) -> None:
        if sum(b) < capacity:
            for y in {0, *b}:
                insort(holding[y], (capacity - sum(b), b))
                most[y] = holding[y][-1][0]

    def leave(b: Bin) -> None:
        if sum(b) < capacity:
            for y in {0, *b}:
                of = holding[y]
                del of[bisect_left(of, (capacity - sum(b), b))]
                most[y] = of[-1][0] if of else -capacity - 1

    def option(a: Bin) -> tuple[Bin, Bin, Bin] | None:
        """(b, out of a, back from b) with the greatest amount out - back; b is the fullest type that offers it."""
        alone = plan[a] == 1
        if alone:
            leave(a)  # a bin doesn't trade with itself
        try:
            x = np.array(a, np.int64)
            i, j = np.triu_indices(len(x), 1)
            sums = np.concatenate([x, x[i] + x[j]])
            # the least y that some type gives for so much
            y = np.searchsorted(np.maximum.accumulate(most + np.arange(capacity + 1)), sums)
            gain = np.where(y < sums, sums - y, 0)
            for k in np.argsort(-gain, kind="stable").tolist():
                if gain[k] <= 0:
                    break
                of = holding[int(y[k])]
                room, b = of[bisect_left(of, (int(gain[k]), ()))]
                if capacity - room + gain[k] > sum(a):  # else the squared fill wouldn't grow
                    out = (a[k],) if k < len(a) else (a[i[k - len(a)]], a[j[k - len(a)]])
                    return b, out, (int(y[k]),) if y[k] else ()
            return None
        finally:
            if alone:
                enter(a)

    def traded(b: Bin, out: Bin, back: Bin) -> Bin:
        rest = list(b)
        for x in out:
            rest.remove(x)
        return tuple(sorted((*rest, *back), reverse=True))

    for b in plan:
        enter(b)
    least, again = least_bins(plan, capacity), True
    while again and sum(plan.values()) > least:
        again = False
        for _, a in reversed(rooms.copy()):
            while a and a in plan and (found := option(a)):
                b, out, back = found
                copies = plan[a] // 2 if a == b else min(plan[a], plan[b])
                emptier = traded(a, out, back)
                for x, sign in ((a, -1), (b, -1), (emptier, 1), (traded(b, back, out), 1)):
                    if x:
                        had = plan[x]
                        plan[x] += sign * copies
                        if not plan[x]:
                            del plan[x]
                            leave(x)
                        elif not had:
                            enter(x)
                a, again = emptier, True
            if sum(plan.values()) <= least:
                break
    return plan


def longest_first(histogram: dict[int, int], capacity: int) -> Counter:
    """Bin types of the greedy plan: the longest piece left, then again and again the longest that fits."""
    left = {n: c for n, c in histogram.items() if c}
    order, plan = sorted(left), Counter()
    while order:
        used: Counter = Counter()
        room, at = capacity, len(order) - 1
        while at >= 0:
            n = order[at]
            take = min(left[n] - used[n], room // n)
            if take:
                used[n] += take
                room -= n * take
            at = min(at, bisect_right(order, room)) - 1
        copies = min(left[n] // k for n, k in used.items())
        plan[tuple(sorted(used.elements(), reverse=True))] += copies
        for n, k in used.items():
            left[n] -= k * copies
            if not left[n]:
                order.remove(n)
    return plan


def plan_bins(histogram: dict[int, int], capacity: int) -> Counter:
    """The search from the greedy plan and, unless no plan can have fewer bins, from the best-fit plan too: the better of both."""
    plan = improve(longest_first(histogram, capacity), capacity)
    if sum(plan.values()) > least_bins(plan, capacity):
        plan = min(plan, improve(bin_types(histogram, capacity), capacity), key=lambda p: sum(p.values()))
    return plan


def places(plan: Counter) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, bins' first number, pieces of this length in a bin, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: Counter = Counter()
    base = 0
    for b, copies in sorted(plan.items(), key=lambda x: (-sum(x[0]), x[0])):
        offset = 0
        for n, k in sorted(Counter(b).items(), reverse=True):
            out.setdefault(n, []).append((seen[n], base, k, offset))
            seen[n] += k * copies
            offset += n * k
        base += copies
    return {n: np.array(rows, np.int64) for n, rows in out.items()}


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int, drops_space: bool) -> DataFrame:
    """Pieces of at most `capacity` ids of every document, numbered (part, nth) among those of their length.

    A null or empty text is the end id alone.  Rows with equal or null doc_id are pieces like any others.
    """
    ship(docs.sparkSession)

    def cut(batches):
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(tokenizer_path, drops_space), int(end_id).to_bytes(4, "little")
        nth: Counter = Counter()
        for batch in batches:
            for i, j in slices(batch, SLICE):
                some = batch.slice(i, j - i)
                ids, ends = enc.encode(some.column("text"))
                raw, rows = memoryview(ids).cast("B"), []
                for doc, a, b in zip(some.column("doc_id").to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    size = b - a + 1  # with the end id
                    for k, at in enumerate(range(0, size, capacity)):
                        n = min(capacity, size - at)
                        crc = zlib.crc32(raw[4 * (a + at) : 4 * min(b, a + at + n)])
                        if at + n == size:
                            crc = zlib.crc32(end, crc)
                        rows.append((doc, k, at, n, crc, part, nth[n]))
                        nth[n] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(cut), PIECES)


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to stored pieces (part, nth, length and any other columns).

    Needs (part, nth) unique among pieces of a length; columns named sequence_id and offset are replaced, any other
    stays as it is.  Every piece gets one place; sequences are gapless from 0 and
    hold at most `capacity` ids; an empty table gives no sequence.  The driver sees the histogram of lengths only.
    """
    spark = pieces.sparkSession
    ship(spark)
    counts = pieces.groupBy(F.col("part").alias("p"), F.col("length").alias("n")).agg(F.count(F.lit(1)).alias("c"))
    by_part = Window.partitionBy("n").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("p", "n", F.coalesce(F.sum("c").over(by_part), F.lit(0)).alias("before"))
    histogram = {int(r["n"]): int(r["c"]) for r in pieces.groupBy(F.col("length").alias("n")).agg(F.count(F.lit(1)).alias("c")).collect()}
    runs = spark.sparkContext.broadcast(places(plan_bins(histogram, capacity)))
    # the columns of pieces go in one struct, so none of their names is in the way
    rows = pieces.select(F.struct(*(F.col(f"`{c}`") for c in pieces.columns)).alias("piece"))
    ranked = rows.join(before, (F.col("piece.part") == F.col("p")) & (F.col("piece.length") == F.col("n")))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length, rank):
        import pandas as pd

        n, r = length.to_numpy(), rank.to_numpy()
        seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for one in np.unique(n):
            at = np.flatnonzero(n == one)
            rows = runs.value[int(one)]
            row = rows[np.searchsorted(rows[:, 0], r[at], side="right") - 1]
            seq[at] = row[:, 1] + (r[at] - row[:, 0]) // row[:, 2]
            off[at] = row[:, 3] + (r[at] - row[:, 0]) % row[:, 2] * one
        return pd.DataFrame({"sequence_id": seq, "offset": off})

    placed = ranked.select("piece", place(F.col("piece.length"), F.col("before") + F.col("piece.nth")).alias("place"))
    others = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    return placed.select(*(F.col(f"piece.`{c}`") for c in others), "place.sequence_id", "place.offset")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op1: all documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    pieces = stored(cut_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 4096, 1, True), "pieces")
    return pack(pieces, 4096).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
