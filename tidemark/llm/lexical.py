"""Ranked lexical search: WAND over an inverted index of each shard of documents.

The documents of a slice of a task's input are a shard.  Its index, a row of a stored table, has the distinct terms and for
each one the documents that hold it, in ascending order, with the numbers of occurrences.  Statistics (documents, terms,
documents that hold a query's term) are summed over all shards' rows before any score is taken.

A search reads the shards one after another and keeps a heap of the best documents for each query.  For a query, each of
its terms has the greatest impact that it has on a document of the shard; the top-th greatest is a score that the heap's
least one can't be below.  The pivot is the first document that the lists up to it, in the order of their next documents,
can lift to the heap's least score by their greatest impacts; everything before it is skipped in all lists.  From the
pivot on, a window of documents is judged at once: those whose own terms' greatest impacts reach the heap's least score
are scored in full, all others are not.  Heaps live as long as their task, so that each shard starts with what the ones
before it have reached; the tasks' heaps are merged in two steps.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, lean, ship, slices, stored, table

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
INDEX = "n_docs long, n_terms long, doc_ids array<long>, lengths array<int>, terms array<string>, counts array<int>, docs binary, tfs binary"
# A row is a shard: a row group, which its writer and a task's reader hold whole, is ended after a few of them, not after 100.
FEW_ROWS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: behind all others among equal scores
LONG = 256  # bytes from which the rest of a term is compared as a whole
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts (8 zeros behind them), and for each term where it begins and ends and whose it is."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)
    n = int(at[-1] - at[0])
    data = np.zeros(n + 8, np.uint8)
    if n:
        data[:n] = _FOLD[np.frombuffer(texts.buffers()[2], np.uint8, n, int(at[0]))]
    at -= at[0]
    inside = _INSIDE[data[:n]]
    before, behind = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], behind[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < n]] = False  # a term ends with its text
    behind[at[1:][at[1:] > 0] - 1] = False
    first, stop = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~behind) + 1
    return data, first, stop, np.searchsorted(at[1:], first, "right")


def numbered(data: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A number for each term; equal terms, and only they, have equal numbers.  Terms are told apart 8 bytes at a time."""
    size = stop - first
    lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    heads, number = np.unique(lanes[first] & _MASK[np.minimum(size, 8)], return_inverse=True)
    number, used, done = number.astype(np.int64), len(heads), 8
    rest = np.flatnonzero(size > done)
    while len(rest) and done < LONG:
        lane = lanes[first[rest] + done] & _MASK[np.minimum(size[rest] - done, 8)]
        order = np.lexsort((lane, number[rest]))
        known, lane = number[rest][order], lane[order]
        new = np.ones(len(rest), bool)
        new[1:] = (known[1:] != known[:-1]) | (lane[1:] != lane[:-1])
        number[rest[order]] = used + np.cumsum(new) - 1
        used, done = used + int(new.sum()), done + 8
        rest = rest[size[rest] > done]
    ends: dict[tuple[int, bytes], int] = {}
    for k in rest.tolist():
        number[k] = ends.setdefault((int(number[k]), data[first[k] + done : stop[k]].tobytes()), used + len(ends))
    return number


def shard_index(doc_ids: pa.Array, texts: pa.Array) -> list:
    """The values of an INDEX row; documents without terms are left out."""
    data, first, stop, owner = terms_of(texts)
    lengths = np.bincount(owner, minlength=len(texts))
    with_terms = np.flatnonzero(lengths)
    place = np.zeros(len(texts), np.int64)
    # by ascending doc_id, so that of equal scores the first comes first
    ids = pc.fill_null(doc_ids, LAST).to_numpy(zero_copy_only=False)
    with_terms = with_terms[np.argsort(ids[with_terms], kind="stable")]
    place[with_terms] = np.arange(len(with_terms))
    number = numbered(data, first, stop)
    of_number = np.zeros(int(number.max()) + 1 if len(number) else 0, np.int64)
    of_number[number] = np.arange(len(number))  # one place of each term
    pair, tf = np.unique(number * max(len(with_terms), 1) + place[owner], return_counts=True)
    which, doc = np.divmod(pair, max(len(with_terms), 1))
    begin = np.flatnonzero(np.diff(which, prepend=-1))
    some = of_number[which[begin]]
    sizes = stop[some] - first[some]
    at = np.concatenate([[0], np.cumsum(sizes)])
    spelled = data[np.repeat(first[some] - at[:-1], sizes) + np.arange(at[-1])]
    names = pa.LargeStringArray.from_buffers(len(some), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(spelled)).cast(pa.string())
    counts = np.diff(np.append(begin, len(which))).astype(np.int32)
    return [len(with_terms), int(lengths.sum()), doc_ids.take(pa.array(with_terms)), lengths[with_terms].astype(np.int32), names, counts, doc.astype("<i4").tobytes(), tf.astype("<i4").tobytes()]


def build_index(docs: DataFrame, shard_bytes: int = 12_000_000) -> DataFrame:
    """An INDEX row for each shard of about so many bytes of text; a longer text is a shard of its own, never cut."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for i, j in slices(batch, shard_bytes):
                some = batch.slice(i, j - i)
                n_docs, n_terms, ids, lengths, names, counts, doc, tf = shard_index(some.column("doc_id"), some.column("text"))
                if n_docs:
                    one = [pa.array([n_docs]), pa.array([n_terms]), *(pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if isinstance(x, pa.Array) else pa.array(x)) for x in (ids, lengths, names, counts)), pa.array([doc], pa.binary()), pa.array([tf], pa.binary())]
                    yield pa.RecordBatch.from_arrays(one, names=["n_docs", "n_terms", "doc_ids", "lengths", "terms", "counts", "docs", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), INDEX)


class Best:
    """The best documents of a query so far, by score and then by doc_id."""

    def __init__(self, top: int):
        self.top, self.least = top, 1
        self.scores = self.ids = np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.top]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.top:
            self.least = max(self.least, int(self.scores[-1]))


def search(lists: list[tuple[np.ndarray, np.ndarray, int, int, int]], ids: np.ndarray, best: Best, window: int) -> int:
    """WAND over a shard's lists (documents, impacts, greatest and top-th greatest impact, times in the query); how many were scored."""
    lists = [x for x in lists if x[2] * x[4] > 0]
    best.least = max([best.least, *(x[3] * x[4] for x in lists)])  # so many documents reach that by this term alone
    reach, place, scored = np.array([x[2] * x[4] for x in lists], np.int64), [0] * len(lists), 0
    live = np.arange(len(lists))
    head = np.array([docs[0] for docs, *_ in lists], np.int64)
    while len(live):
        order = live[np.argsort(head[live], kind="stable")]
        k = int(np.searchsorted(np.cumsum(reach[order]), best.least))
        if k == len(order):
            break  # not even a document with all the terms that are left
        pivot = int(head[order[k]])
        bound, parts = np.zeros(window, np.int64), []
        for t in live.tolist():
            docs, impacts, _, _, times = lists[t]
            a = place[t] + int(np.searchsorted(docs[place[t] :], pivot))
            b = a + int(np.searchsorted(docs[a:], pivot + window))
            if b > a:
                near = docs[a:b] - pivot
                bound[near] += reach[t]
                parts.append((near, impacts[a:b], times))
            place[t] = b
            head[t] = docs[b] if b < len(docs) else -1
        live = live[head[live] >= 0]
        some = np.flatnonzero(bound >= best.least)
        if len(some):
            score = np.zeros(len(some), np.int64)
            for near, impacts, times in parts:
                at = np.minimum(np.searchsorted(near, some), len(near) - 1)
                score += np.where(near[at] == some, impacts[at], 0) * times
            scored += len(some)
            keep = score >= best.least
            best.add(score[keep], ids[some[keep] + pivot])
    return scored


def lookup(row: dict, names: pa.Array, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> dict[int, tuple[np.ndarray, np.ndarray, int, int]]:
    """The lists of a shard for those of the terms that it holds: documents, impacts, greatest and top-th greatest impact."""
    at = pc.index_in(names, value_set=row["terms"]).to_numpy(zero_copy_only=False)
    have = np.flatnonzero(~np.isnan(at)) if at.dtype.kind == "f" else np.arange(len(at))
    if not len(have):
        return {}
    counts = row["counts"].to_numpy().astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(counts)])
    at = at[have].astype(np.int64)
    size = counts[at]
    stop = np.cumsum(size)
    take = np.repeat(begin[at] - (stop - size), size) + np.arange(stop[-1])
    docs, tf = np.frombuffer(row["docs"], "<i4")[take].astype(np.int64), np.frombuffer(row["tfs"], "<i4")[take].astype(np.int64)
    damp = 75 + 25 * row["lengths"].to_numpy().astype(np.int64) * n_docs // n_terms
    impacts = np.repeat(weights[have], size) * (1_000_000_000 * tf // (1000 * tf + 12 * damp[docs]))
    greatest = np.maximum.reduceat(impacts, stop - size)
    enough = [int(np.partition(impacts[b - n : b], n - top)[n - top]) if n >= top else 0 for b, n in zip(stop.tolist(), size.tolist(), strict=True)]
    return {int(v): (docs[b - n : b], impacts[b - n : b], int(m), e) for v, b, n, m, e in zip(have, stop.tolist(), size.tolist(), greatest.tolist(), enough, strict=True)}


def rank_documents(docs: DataFrame, items: DataFrame, top: int = 20, block: int = 200_000, window: int = 2048) -> DataFrame:
    """item_id, rank, doc_id, score: the `top` best documents of each item (item_id, text), with a score above 0.

    Terms, statistics and scores are as contract op11 says.  Every row of items is a query of its own, also where item_id
    is null or repeated, and every row of docs a document; among equal scores a null doc_id comes last, and rows that agree
    in doc_id and score come in any order.  Null texts have no terms; an item without terms, or whose terms no document
    holds, gives no row, nor do empty tables.  Columns besides doc_id, item_id and text are not read.

    Queries go out in blocks of about `block` (item, term) rows, each one pass over the index; what a task or the driver
    holds of the queries is bounded by that (and by the longest item).
    """
    spark = docs.sparkSession
    index = stored(build_index(docs), "index", **FEW_ROWS)
    sums = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n_docs, n_terms = sums[0] or 0, sums[1] or 0
    words = F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(TERM), 0)
    asked = stored(items.select(F.monotonically_increasing_id().alias("q"), "item_id", words.alias("terms")), "items")
    wanted = asked.select("q", F.explode("terms").alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = stored(wanted, "wanted")
    blocks = -(-wanted.count() // block) if n_docs else 0
    found = spark.createDataFrame([], "q long, doc_id long, score long, chunk int")
    for k in range(blocks):
        mine = wanted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k)
        names = mine.select("term").distinct()
        held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.counts").alias("n"))
        frequent = {r.term: r.n for r in held.join(F.broadcast(names), "term").groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}
        asks: dict[int, list[tuple[str, int]]] = defaultdict(list)
        for r in mine.toLocalIterator():
            if r.term in frequent:
                asks[r.q].append((r.term, r.times))
        if asks:
            found = found.unionByName(_search_block(index, frequent, dict(asks), n_docs, n_terms, top, window))
    # the tasks' heaps: first within groups of tasks, then all
    for by in (["q", "chunk"], ["q"]):
        order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        found = stored(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top), "heaps")
        discard(index)  # nothing is left to delete the second time
    discard(wanted)
    return found.join(asked.select("q", "item_id"), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _search_block(index: DataFrame, frequent: dict[str, int], asks: dict[int, list[tuple[str, int]]], n_docs: int, n_terms: int, top: int, window: int) -> DataFrame:
    names = sorted(frequent)
    number = {t: k for k, t in enumerate(names)}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequent[t] + 1))) for t in names], np.int64)
    queries = [(q, [(number[t], times) for t, times in terms]) for q, terms in asks.items()]

    def run(batches):
        heaps = [Best(top) for _ in queries]
        terms = pa.array(names, pa.string())
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in batch.schema.names}
                row = {c: v.values if isinstance(v, pa.ListScalar) else v.as_buffer() for c, v in row.items()}
                lists = lookup(row, terms, weights, n_docs, n_terms, top)
                ids = pc.fill_null(row["doc_ids"], LAST).to_numpy(zero_copy_only=False)
                for (_, asked), best in zip(queries, heaps, strict=True):
                    mine = [(*lists[v], times) for v, times in asked if v in lists]
                    if mine:
                        search(mine, ids, best, window)
        for (q, _), best in zip(queries, heaps, strict=True):
            if len(best.scores):
                ids = pa.array(best.ids, mask=best.ids == LAST)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q)), ids, pa.array(best.scores)], names=["q", "doc_id", "score"])

    heaps = index.select("doc_ids", "lengths", "terms", "counts", "docs", "tfs").mapInArrow(lean(run), "q long, doc_id long, score long")
    return heaps.withColumn("chunk", F.pmod(F.spark_partition_id(), F.lit(64)))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op11: the 20 best documents for each item of benchmark."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
n AS (SELECT r, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM n),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM n) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
scores AS (
  SELECT item_id, r, n.doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * docs) // total))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN n USING (r), s GROUP BY item_id, r, n.doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""
