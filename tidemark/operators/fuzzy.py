"""Similar titles: pairs with a Ratcliff-Obershelp ratio over a threshold, by blocks of all pairs under bounds of grams.

A match of two texts of n and m characters that reaches the ratio r has M >= r (n + m) / 2 common characters, in order, so
D = n + m - 2 M are left over, and the match has at most D + 1 stretches.  Grams of q characters that lie within a stretch
stand in both texts: K = M - (q - 1) (D + 1) of them at least, and a gram's two places differ by no more than the characters
that are left over in one text.  So of the grams of one text, each with its place, all but (grams of the text) - K stand in
the other at a place that is near enough.

Titles of a bounded alphabet have no rare grams: an index of them gives more pairs than there are.  So titles are dealt into
parts, a task meets one part with another, each sorted by length, and the bound is a product of two matrices of bits: a
row for a title, a column for a hash of gram and place, in one of the two with all places that are near enough.  What it
leaves is held against a bitmap of longer grams, counts of characters and of their pairs, and the longest common
subsequence; the exact ratio decides on the rest, and no pair is missed.  The work is quadratic with a small constant; a
task's memory is that of its two parts, and a title goes out once for each part, of which there are PARTS at most.
"""

from __future__ import annotations

import math
import sys
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.stores import materialised

CHARS, PAIRS = 64, 256  # bins of a title's counts
CROWDED = 2_000  # titles of a part, until there are PARTS
PARTS = 32
BLOCK = 1_024  # titles that meet as many at once
GRAMS = ((2, 1_024), (3, 2_048))  # characters of a gram and bits for a title: of the product, of the bitmap
PLACES = 8  # places that count as one


def _room(a: np.ndarray, b: np.ndarray, shared: np.ndarray, both: np.ndarray) -> np.ndarray:
    """Which pairs of counts have as many common characters, and pairs of them, as so many shared characters bring."""
    common = np.minimum(a, b)
    return (common[:, :CHARS].sum(axis=1, dtype=np.int64) >= shared) & (common[:, CHARS:].sum(axis=1, dtype=np.int64) >= 3 * shared - both - 1)


@F.pandas_udf(T.DoubleType())
def ratio_of(a: pd.Series, b: pd.Series) -> pd.Series:
    """The Ratcliff-Obershelp ratio of two titles; it depends on their order."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def counts(titles: list[str]) -> np.ndarray:
    """How often characters and pairs of neighbours stand in each title, in a fixed number of bins."""
    sizes = np.fromiter(map(len, titles), np.int64, len(titles))
    c = np.frombuffer("".join(titles).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    own = np.repeat(np.arange(len(titles)), sizes) * (CHARS + PAIRS)
    inside = own[1:] == own[:-1]
    bins = np.concatenate([own + c % CHARS, (own[:-1] + CHARS + (c[:-1] * 31 + c[1:]) % PAIRS)[inside]])
    return np.minimum(np.bincount(bins, minlength=len(titles) * (CHARS + PAIRS)), 65_535).astype(np.uint16).reshape(-1, CHARS + PAIRS)


def common_length(masks: dict[str, int], n: int, other: str) -> int:
    """Length of the longest common subsequence of two titles, the first as its n characters' bits; no match is longer."""
    left = ones = (1 << n) - 1
    for c in other:
        if m := left & masks.get(c, 0):
            left = (left + m | left - m) & ones
    return n - left.bit_count()


def _with_room(titles: pa.Array, n: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of rows those whose counts, and then longest common subsequences, leave room for the ratio."""
    rows, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    per, found = 20_000, []
    of = place.reshape(2, -1)
    blocks = [counts(titles.take(pa.array(rows[k : k + per])).to_pylist()) for k in range(0, len(rows), per)]
    c = np.concatenate(blocks) if blocks else np.zeros((0, CHARS + PAIRS), np.uint16)
    for k in range(0, len(x), 2_000):
        some = slice(k, k + 2_000)
        both = n[x[some]] + n[y[some]]
        # counts may not hold very great lengths
        found.append(_room(c[of[0, some]], c[of[1, some]], np.ceil(least * both / 2 - 1e-9).astype(np.int64), both) | (both > 60_000))
    ok = np.concatenate(found) if found else np.zeros(0, bool)
    x, y, of = x[ok], y[ok], of[:, ok]
    shared = np.ceil(least * (n[x] + n[y]) / 2 - 1e-9).astype(np.int64).tolist()
    texts, last = titles.take(pa.array(rows)).to_pylist(), -1
    ok = np.ones(len(x), bool)
    for k, (i, j, m) in enumerate(zip(*of.tolist(), shared, strict=True)):
        if i != last:
            masks, last = {}, i
            for at, c in enumerate(texts[i]):
                masks[c] = masks.get(c, 0) | 1 << at
        ok[k] = common_length(masks, len(texts[i]), texts[j]) >= m
    return x[ok], y[ok]


def least_common(n: int, m: int, ratio: float, q: int) -> int:
    """K for texts of n and m characters; 0 if they can't reach the ratio or only by being equal."""
    shared = math.ceil(ratio * (n + m) / 2 - 1e-9)
    over = n + m - 2 * shared
    return 0 if shared > min(n, m) or over < 1 else shared - (q - 1) * min(shared, over + 1)


def gram_size(ratio: float) -> int:
    """The greatest q up to 4 for which every pair that may reach the ratio has a common gram; 1 always does."""
    for q in (4, 3, 2):
        growing = ratio * (2 * q - 1) / 2 - (q - 1) > 0
        pairs = ((n, m) for n in range(1, 120) for m in range(n, int(n * (2 - ratio) / ratio) + 2))
        if growing and all(least_common(n, m, ratio, q) > 0 for n, m in pairs if math.ceil(ratio * (n + m) / 2 - 1e-9) <= n and n + m > 2 * math.ceil(ratio * (n + m) / 2 - 1e-9)):
            return q
    return 1


def signed(titles: DataFrame) -> DataFrame:
    """(id, title, n) of titles that are not empty, stored."""
    return materialised(titles.select("id", "title", F.length("title").alias("n")).where("n > 0"), "titles")


class Side:
    """Titles of one part by their length, and where they stand among the cell's rows."""

    def __init__(self, titles: pa.Array, rows: np.ndarray, n: np.ndarray):
        self.rows = rows[np.argsort(n[rows], kind="stable")]
        self.n = n[self.rows]
        self.start = np.concatenate([[0], np.cumsum(self.n)])
        self.codes = np.frombuffer("".join(titles.take(pa.array(self.rows)).to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)

    def marks(self, i: int, j: int, q: int, width: int, below: int = 0, above: int = 0) -> np.ndarray:
        """Bits of titles i to j: of each gram with its place, or with all places from so far below to so far above."""
        c, n = self.codes[self.start[i] : self.start[j]], self.n[i:j]
        own = np.repeat(np.arange(j - i), n)
        place = np.arange(len(c)) - np.repeat(self.start[i:j] - self.start[i], n)
        at = np.flatnonzero(place <= np.repeat(n, n) - q)
        gram = np.zeros(len(at), np.uint64)
        for k in range(q):
            gram = (gram << np.uint64(21)) + c[at + k]
        own, first, last = own[at], np.maximum(place[at] - below, 0) // PLACES, (place[at] + above) // PLACES
        out = np.zeros((j - i, width), np.uint8)
        for k in range((below + above) // PLACES + 2 if below or above else 1):
            h = gram * np.uint64(0x9E3779B97F4A7C15) + np.minimum(first + k, last).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
            out[own, ((h >> np.uint64(40)) % np.uint64(width)).astype(np.int64)] = 1
        return out


def _bits(marks: np.ndarray) -> np.ndarray:
    return np.packbits(marks, axis=1).view(np.uint64)


def _close(left: Side, right: Side, ratio: float):
    """Pairs of rows of two sides, or of one with itself (each once), that are near enough in length and whose grams leave room for a match."""
    (q, width), (longer, more) = GRAMS
    for i in range(0, len(left.n), BLOCK):
        j = min(i + BLOCK, len(left.n))
        n, a = left.n[i:j], left.marks(i, j, q, width)
        # of a's grams at most n + (q - 1) (n + m) - (2 q - 1) M may be missing
        spare = lambda k: n * (1 + (k - 1) - (2 * k - 1) * ratio / 2)  # noqa: B023, E731
        least = a.sum(axis=1, dtype=np.int64) - spare(q) - 0.01 - 1e-6 * n  # room for rounding
        rise = (q - 1) - (2 * q - 1) * ratio / 2
        a, long_a = a.astype(np.float32), None
        for k in range(i if right is left else 0, len(right.n), BLOCK):
            e = min(k + BLOCK, len(right.n))
            m = right.n[k:e]
            # what may be left over in one text: so far may a gram's places be apart
            above, below = (math.floor(most - ratio * (most + other) / 2 + 1e-9) for most, other in ((int(n[-1]), int(m[0])), (int(m[-1]), int(n[0]))))
            if above < 0 or below < 0:
                continue
            common = a @ right.marks(k, e, q, width, below, above).astype(np.float32).T
            x, y = np.divmod(np.flatnonzero(common + (rise * m).astype(np.float32) >= least.astype(np.float32)[:, None]), e - k)
            both = n[x] + m[y]
            ok = np.ceil(ratio * both / 2 - 1e-9) <= np.minimum(n[x], m[y])
            if right is left:
                ok &= x + i < y + k
            x, y = x[ok], y[ok]
            if len(x):
                if long_a is None:
                    long_a = _bits(left.marks(i, j, longer, more))
                    left_over = np.bitwise_count(long_a).sum(axis=1, dtype=np.int64) - spare(longer) - 0.01
                long_b = _bits(right.marks(k, e, longer, more, below, above))
                for s in range(0, len(x), 50_000):
                    u, v = x[s : s + 50_000], y[s : s + 50_000]
                    shared = np.bitwise_count(long_a[u] & long_b[v]).sum(axis=1, dtype=np.int64)
                    ok = shared + ((longer - 1) - (2 * longer - 1) * ratio / 2) * m[v] >= left_over[u]
                    yield left.rows[i + u[ok]], right.rows[k + v[ok]]


def _cell_pairs(cell: list[pa.RecordBatch], ratio: float):
    """(a, b) of the rows of a cell, in batches: left with right ones, or rows that are both with one another."""
    rows = pa.Table.from_batches(cell).combine_chunks()
    who, ids, titles, n = rows["who"].to_numpy(), rows["id"].combine_chunks(), rows["title"].combine_chunks(), rows["n"].to_numpy().astype(np.int64)
    left = Side(titles, np.flatnonzero(who != 1), n)
    right = left if (who == 2).any() else Side(titles, np.flatnonzero(who == 1), n)
    held, size = [], 0

    def out() -> pa.RecordBatch:
        x, y = (np.concatenate(side) for side in zip(*held, strict=True))
        by_left = np.argsort(x, kind="stable")
        x, y = _with_room(titles, n, x[by_left], y[by_left], ratio)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(y))], names=["a", "b"])

    for pair in _close(left, right, ratio):
        held.append(pair)
        size += len(pair[0])
        if size > 200_000:
            yield out()
            held, size = [], 0
    if size:
        yield out()


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows dealt over all shuffle partitions, however few their bytes: it is the work for a row that counts."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def meetings(left: DataFrame, right: DataFrame | None, ratio: float) -> DataFrame:
    """(a, b): ids of titles of left and right (of left among themselves, a < b, if right is None) that may be similar.

    A part is titles of about one length, so that places can't be far apart; a cell is two parts, or one with itself.  A task
    reads its cells one after another.
    """

    def dealt(rows: DataFrame, sizes: list, own: int, others: int, who) -> DataFrame:
        total, before, bounds = sum(size for _, size in sizes), 0, []
        for n, size in sizes:
            bounds.append((n, before / total * own, size / total * own))
            before += size
        of = rows.sparkSession.createDataFrame(bounds or [(0, 0.0, 0.0)], "n int, first double, width double")
        at = F.col("first") + F.col("width") * (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) / (1 << 20))
        rows = rows.join(F.broadcast(of), "n").select("id", "n", "title", F.least(F.floor(at), F.lit(own - 1)).cast("int").alias("own"))
        cells = F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda o: who(F.col("own"), o))
        return rows.select("id", "n", "title", F.explode(cells).alias("c")).select("c.cell", "c.who", "id", "n", "title")

    def place(i: Column, j: Column, who: Column) -> Column:
        return F.struct((i * PARTS + j).alias("cell"), who.cast("int").alias("who"))

    # a row for each length
    lengths = lambda rows: sorted((x["n"], x["count"]) for x in rows.groupBy("n").count().collect())
    parts = lambda sizes: max(1, min(PARTS, -(-sum(size for _, size in sizes) // CROWDED)))
    mine = lengths(left)
    p = parts(mine)
    if right is None:
        rows = dealt(left, mine, p, p, lambda own, o: place(F.least(own, o), F.greatest(own, o), F.when(own == o, 2).otherwise(F.when(own < o, 0).otherwise(1))))
    else:
        theirs = lengths(right)
        r = parts(theirs)
        rows = dealt(left, mine, p, r, lambda own, o: place(own, o, F.lit(0))).unionByName(dealt(right, theirs, r, p, lambda own, o: place(o, own, F.lit(1))))

    def run(batches):
        open_, last = [], None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            cuts = [0, *(np.flatnonzero(cells[1:] != cells[:-1]) + 1).tolist(), len(cells)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a:
                    if open_ and cells[a] != last:
                        yield from _cell_pairs(open_, ratio)
                        open_ = []
                    last = cells[a]
                    open_.append(batch.slice(a, b - a))
        if open_:
            yield from _cell_pairs(open_, ratio)

    met = spread(rows, "cell").sortWithinPartitions("cell").mapInArrow(run, "a string, b string")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) if right is None else met


def exact(pairs: DataFrame, left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """(a, b, ratio) of the pairs whose titles reach the ratio; left and right as signed() gives them."""
    side = lambda df, name: df.select(F.col("id").alias(name), F.col("title").alias(f"_{name}"))
    both = pairs.join(side(left, "a"), "a").join(side(right, "b"), "b")
    return spread(both, "a", "b").select("a", "b", ratio_of("_a", "_b").alias("ratio")).where(F.col("ratio") >= ratio)


def candidates(titles: DataFrame, ratio: float) -> DataFrame:
    """(a, b) of distinct titles that go to the exact ratio; titles as signed() gives them."""
    return materialised(meetings(titles, None, ratio), "candidates")


def fuzzy_pairs(titles: DataFrame, ratio: float) -> DataFrame:
    """(a, b, ratio) of distinct titles (columns id and title, a title once) with a ratio of at least `ratio`, a < b by id.

    No pair is missed, whatever the number of stretches of its match.  Null and empty titles have no pair.
    """
    t = signed(titles)
    return exact(candidates(t, ratio), t, t, ratio).withColumn("ratio", F.round("ratio", 6))


def similar_to(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """(a, b, ratio): for each left title (id, title) all right ones that are similar, equal ones too; titles stand once in each."""
    l, r = signed(left), signed(right)  # noqa: E741
    close = materialised(meetings(l, r, ratio), "candidates")
    equal = l.select(F.col("id").alias("a"), "title").join(r.select(F.col("id").alias("b"), "title"), "title").select("a", "b", F.lit(1.0).alias("ratio"))
    return exact(close, l, r, ratio).where("ratio < 1").unionByName(equal).withColumn("ratio", F.round("ratio", 6))


def best_match(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """For each left title (id, title) the right one with the greatest ratio, ties by the least id."""
    best = F.min(F.struct((-F.col("ratio")).alias("r"), F.col("b").alias("match"))).alias("m")
    return similar_to(left, right, ratio).groupBy(F.col("a").alias("id")).agg(best).select("id", "m.match", (-F.col("m.r")).alias("ratio"))


def relinked(old: DataFrame, new: DataFrame, ratio: float = 0.93) -> DataFrame:
    """(id, new_id, stage) for each old record: the new one with its URL, else with its title, else with a similar title.

    old, new: id, title_key, url_key (null or empty: none), source, day, created.  Of several the one with the same source
    (4) and day (3) is taken, then the latest, then the greatest id.  The best for each choice of equal source and day are
    grouped maxima, so that old and new records of a common URL are never paired.
    """

    def best(rows: DataFrame, old: DataFrame, key: str) -> DataFrame:
        """(id, best) of old records whose key some of rows has; best: score, created, id."""
        rows = rows.where(f"{key} <> ''")
        out = old.where(f"{key} <> ''").select("id", key, "source", "day")
        for score, same in ((7, ["source", "day"]), (4, ["source"]), (3, ["day"]), (0, [])):
            top = rows.groupBy(key, *same).agg(F.max(F.struct(F.lit(score).alias("score"), "created", "id")).alias(f"_{score}"))
            out = out.join(top, [key, *same], "left")
        return out.select("id", F.coalesce("_7", "_4", "_3", "_0").alias("best")).where("best IS NOT NULL")

    def without(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, "id", "left_anti")

    by_url = materialised(best(new, old, "url_key"), "by-url")
    rest = without(old, by_url)
    by_title = materialised(best(new, rest, "title_key"), "by-title")
    rest = materialised(without(rest, by_title), "rest")
    titles = lambda df: df.where("title_key <> ''").groupBy(F.col("title_key").alias("title")).agg(F.min("id").alias("id")).select("id", "title")
    mine, theirs = materialised(titles(rest), "titles"), materialised(titles(new), "titles")
    close = similar_to(mine, theirs, ratio).join(mine.toDF("a", "old_title"), "a").join(theirs.toDF("b", "title_key"), "b")
    # an old record has a row for each title that is like its own
    each = rest.withColumnRenamed("title_key", "old_title").join(close.select("old_title", "title_key"), "old_title")
    wanted = each.select(F.concat_ws("\u0001", "id", "title_key").alias("id"), "title_key", "source", "day")
    similar = best(new, wanted, "title_key").groupBy(F.substring_index("id", "\u0001", 1).alias("id")).agg(F.max("best").alias("best"))
    stages = [df.select("id", F.col("best.id").alias("new_id"), F.lit(name).alias("stage")) for df, name in ((by_url, "url"), (by_title, "title"), (similar, "similar"))]
    found = stages[0].unionByName(stages[1]).unionByName(stages[2])
    return old.select("id").join(found, "id", "left").withColumn("stage", F.coalesce("stage", F.lit("none")))


# the functions above travel to executors by value, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
