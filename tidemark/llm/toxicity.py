"""Toxicity: a convolutional text classifier, trained here in numpy.

Words (lower-cased, between white space and ASCII punctuation) are hashed into rows of an embedding table.  Filters of
widths 1, 2 and 3 run over the whole text, the maximum of each filter is taken, and a logistic layer gives p.  The first
component of an embedding starts as the class log-odds of its row, the rest at random; Adagrad does the rest.  The
language is guessed from a text's own function words, and p is stretched piecewise linearly so that 0.3 is the threshold
of that language.  Thresholds come from all labelled rows that are neither held out nor trained on, by one rule at every
size: a language's best cut is shrunk towards the best cut of all languages, that towards the cut that marks as many rows
as have label 1, and that towards a half, each the more the fewer rows it comes from.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, ship, slices, stored, table, trim
from .decontaminate import words_of
from .substrings import release

ROWS, DIM, WIDTHS, FILTERS = 1 << 17, 8, (1, 2, 3), 8
THRESHOLD = 0.3
BINS, PRIOR = 2000, 20  # classes of p in the counts that thresholds are taken from; how many rows of label 1 weigh as much as the cut that is shrunk to
ASIDE = 5  # one labelled row in so many is never trained on
FUNCTION_WORDS = {
    "de": "der die und das den von zu mit ist auf für im dem nicht ein eine als auch sich an werden aus er hat dass sie nach bei um noch wie über",
    "en": "the of and to in is was for that it on with as be by at this are from or an which not have has but were they you we",
    "es": "el los que y del las por un para con una su al lo como más pero sus se no es en de la",
    "fr": "le les des et est une du que dans qui pour pas sur ce il au sont avec plus ne par je la de un en",
}
LANGUAGES = sorted(FUNCTION_WORDS)


class Memo(dict):
    """word: row + ROWS * (bits of the languages whose function word it is); row 0 is for padding."""

    def __init__(self):
        self.marks = {}
        for k, lang in enumerate(LANGUAGES):
            for w in FUNCTION_WORDS[lang].split():
                self.marks[w.encode()] = self.marks.get(w.encode(), 0) | 1 << k

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        v = self[word] = 1 + xxhash.xxh64_intdigest(word, 5) % (ROWS - 1) + ROWS * self.marks.get(word, 0)
        return v


def encode(texts: list[str | None], memo: Memo) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows of all texts, each with two pads behind; starts and one more; guessed language or -1)."""
    lists = [words_of(t) for t in texts]
    sizes = np.array([len(x) + 2 for x in lists], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    rows = np.zeros(int(starts[-1]), np.int64)
    for w, at in zip(lists, starts.tolist(), strict=False):
        rows[at : at + len(w)] = np.fromiter(map(memo.__getitem__, w), np.int64, len(w))
    marks = rows >> 17
    votes = np.stack([np.add.reduceat((marks >> k & 1).astype(np.int32), starts[:-1]) for k in range(len(LANGUAGES))], axis=1) if len(lists) else np.zeros((0, len(LANGUAGES)), np.int32)
    lang = np.where(votes.max(axis=1, initial=0) > 0, votes.argmax(axis=1) if len(lists) else 0, -1)
    return (rows & (ROWS - 1)).astype(np.int32), starts, lang


class TextCNN:
    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        self.table = r.normal(0, 0.05, (ROWS, DIM)).astype(np.float32)
        self.table[0] = 0
        self.kernels = [r.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for k in self.kernels:
            k[0, 0, : FILTERS // 2] = 1  # some filters begin by looking at the log-odds
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = np.full(len(WIDTHS) * FILTERS, 0.1, np.float32)
        self.shift = np.float32(-2)
        self.cuts = dict.fromkeys([*range(len(LANGUAGES)), -1], THRESHOLD)

    def _pool(self, rows: np.ndarray, starts: np.ndarray, where: bool):
        """Maxima (texts, all filters), and their places if asked for."""
        e = self.table[rows]
        n, texts = len(rows), len(starts) - 1
        edges = np.stack([starts[:-1], starts[1:] - 2], axis=1).ravel()
        some = edges[1::2] > edges[::2]
        pooled, places = [], []
        for w, k, b in zip(WIDTHS, self.kernels, self.bias, strict=True):
            y = e @ k[0] + b
            for i in range(1, w):
                y[: n - i] += e[i:] @ k[i]
            top = np.maximum.reduceat(y, edges, axis=0)[::2] if n else np.zeros((texts, FILTERS), np.float32)
            top[~some] = b
            pooled.append(np.maximum(top, 0))
            if where:
                owner = np.repeat(np.arange(texts), np.diff(starts))
                at = np.zeros((texts, FILTERS), np.int64)
                for f in range(FILTERS):
                    hit = np.flatnonzero(y[:, f] == top[owner, f])
                    at[owner[hit[::-1]], f] = hit[::-1]
                places.append(at)
        return np.concatenate(pooled, axis=1), places

    def probability(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        z = self._pool(rows, starts, False)[0] @ self.out + self.shift
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def score(self, rows: np.ndarray, starts: np.ndarray, lang: np.ndarray) -> np.ndarray:
        p, cut = self.probability(rows, starts), np.array([self.cuts[int(x)] for x in lang])
        return np.where(p < cut, THRESHOLD * p / cut, THRESHOLD + (1 - THRESHOLD) * (p - cut) / (1 - cut))

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = 4, batch: int = 64, seed: int = 2) -> TextCNN:
        """texts: rows without pads."""
        train = np.arange(len(texts))
        seen = np.ones((2, ROWS))
        for n in train:
            seen[int(labels[n]), np.unique(texts[n])] += 1
        totals = np.bincount(labels[train], minlength=2) + 2
        self.table[:, 0] = np.clip(np.log(seen[1] / totals[1]) - np.log(seen[0] / totals[0]), -3, 3) * (seen.sum(axis=0) >= 5)
        self.table[0] = 0
        self.shift = np.float32(np.log(totals[1] / totals[0]) - 1)
        sums = {k: 1e-3 for k in ("out", "shift")}
        grown = [np.full_like(k, 1e-3) for k in self.kernels]
        grown_b, grown_e = np.full_like(self.bias, 1e-3), np.full(self.table.shape, 1e-3, np.float32)
        r = np.random.default_rng(seed)
        for epoch in range(epochs):
            rate = 0.05 / (1 + epoch)
            order = r.permutation(train)
            for i in range(0, len(order), batch):
                some = order[i : i + batch]
                starts = np.concatenate([[0], np.cumsum([len(texts[n]) + 2 for n in some])])
                rows = np.concatenate([np.concatenate([texts[n], [0, 0]]) for n in some]).astype(np.int32)
                x, places = self._pool(rows, starts, True)
                p = 1 / (1 + np.exp(-np.clip(x @ self.out + self.shift, -30, 30)))
                g = ((p - labels[some]) / len(some)).astype(np.float32)
                gx = g[:, None] * self.out[None] * (x > 0)
                for key, value in (("out", x.T @ g + 1e-4 * self.out), ("shift", g.sum())):
                    sums[key] = sums[key] + value**2
                    setattr(self, key, (getattr(self, key) - rate * value / np.sqrt(sums[key])).astype(np.float32))
                touched, grads = [], []
                for c, w in enumerate(WIDTHS):
                    gc = gx[:, c * FILTERS : (c + 1) * FILTERS]
                    gb = gc.sum(axis=0)
                    for k in range(w):
                        ids = rows[np.minimum(places[c] + k, len(rows) - 1)]
                        e = self.table[ids]
                        gk = np.einsum("nf,nfd->df", gc, e)
                        touched.append(ids.ravel())
                        grads.append((gc[:, :, None] * self.kernels[c][k].T[None]).reshape(-1, DIM))
                        grown[c][k] += gk**2
                        self.kernels[c][k] -= rate * gk / np.sqrt(grown[c][k])
                    grown_b[c] += gb**2
                    self.bias[c] -= rate * gb / np.sqrt(grown_b[c])
                ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                ge = np.zeros((len(ids), DIM), np.float32)
                np.add.at(ge, inverse, np.concatenate(grads))
                grown_e[ids] += ge**2
                self.table[ids] -= rate * ge / np.sqrt(grown_e[ids])
                self.table[0] = 0
        return self

    def calibrate(self, counts: dict[tuple[int, int], np.ndarray]) -> None:
        """Cuts from numbers of rows by (language, label) and class of p."""
        none = np.zeros(BINS, np.int64)

        def above(label: int, langs: list[int]) -> np.ndarray:
            """Rows at or over k / BINS, for k = 0 .. BINS."""
            total = sum((counts.get((x, label), none) for x in langs), none)
            return np.append(np.cumsum(total[::-1])[::-1], 0)

        def mixed(cut: float, to: float, rows: int, prior: int) -> float:
            """Both cuts, as log odds, weighted by the number of rows that the first comes from."""
            odds = [np.log(x / (1 - x)) for x in np.clip([cut, to], 0.01, 0.99)]
            return float(1 / (1 + np.exp(-(rows * odds[0] + prior * odds[1]) / (rows + prior))))

        def shrunk(langs: list[int], to: float) -> float:
            hits, others = above(1, langs), above(0, langs)
            f1 = 2 * hits / (hits + others + max(1, hits[0]))
            best = np.flatnonzero(f1 == f1.max())
            return mixed((best[0] + best[-1]) / 2 / BINS, to, int(hits[0]), PRIOR)

        langs = list(self.cuts)
        marked = above(1, langs) + above(0, langs)
        as_many = np.argmax(marked <= above(1, langs)[0]) / BINS
        everywhere = shrunk(langs, mixed(as_many, 0.5, int(marked[0]), 10 * PRIOR))
        self.cuts = {x: shrunk([x], everywhere) for x in langs}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2, F.lit(False))


def known_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic, place) of labelled documents that are not held out; place is their order for the sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return known.withColumn("place", F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id"))


def not_trained_on() -> Column:
    return F.pmod(F.xxhash64(F.lit(ASIDE), F.col("doc_id")), F.lit(ASIDE)) == 0


def fitted(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> tuple[TextCNN, DataFrame]:
    """(classifier, raw scores of all rows): see train() and raw_scores()."""
    ship(docs.sparkSession)
    known = known_labels(labels)
    chosen = known.where(~not_trained_on()).orderBy("place").limit(sample)
    last = chosen.agg(F.count(F.lit(1)).alias("n"), F.max("place").alias("place")).first()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id")  # at most `sample` rows
    rows = rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text for each label

    def run(batches):
        memo = Memo()
        for batch in batches:
            for i, j in slices(batch):
                some = batch.slice(i, j - i)
                ids, starts, _ = encode(some.column("text").to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("toxic"), pa.array([ids[a : b - 2].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)], pa.binary())], names=["doc_id", "toxic", "words"])

    got = rows.mapInArrow(lean(run), "doc_id long, toxic int, words binary").toArrow().sort_by("doc_id")
    model = TextCNN()
    if len(got):
        order = np.random.default_rng(3).permutation(len(got))
        texts = [np.frombuffer(got.column("words")[int(n)].as_buffer(), np.int32) for n in order]
        model.fit(texts, got.column("toxic").to_numpy()[order].astype(np.int64))
        del texts
    del got
    trim()  # the sample and the sums of the training, before the driver goes on
    raw = stored(raw_scores(docs, model), "raw-scores")
    free = not_trained_on()
    if last["n"] == sample:
        free |= F.col("place") > F.struct(F.lit(last["place"]["hash"]).alias("hash"), F.lit(last["place"]["doc_id"]).alias("doc_id"))
    judged = raw.join(known.where(free).select("doc_id", "toxic"), "doc_id")
    classes = judged.groupBy("lang", "toxic", F.least(F.floor(F.col("p") * BINS), F.lit(BINS - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    counts: dict[tuple[int, int], np.ndarray] = {}
    for r in classes.collect():  # at most languages x labels x BINS rows
        counts.setdefault((r["lang"], r["toxic"]), np.zeros(BINS, np.int64))[r["bin"]] = r["n"]
    model.calibrate(counts)
    return model, raw


def train(docs: DataFrame, labels: DataFrame, sample: int = 12_000) -> TextCNN:
    """A classifier from at most `sample` labelled rows that are not held out, taken in the order of a hash of doc_id.

    A fifth of the labelled rows is never trained on; with all rows beyond the sample it gives the thresholds.  Rows with
    a null id, label or text are not used; of texts that share a doc_id the least is; without any row the classifier
    scores by its start values and marks next to nothing.
    """
    model, raw = fitted(docs, labels, sample)
    discard(raw)
    release(docs.sparkSession)
    return model


def raw_scores(docs: DataFrame, model: TextCNN) -> DataFrame:
    """doc_id, p and guessed language (a number, or -1) of every row; null and empty texts are texts without words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        memo, m = Memo(), sent.value
        for batch in batches:
            for i, j in slices(batch, 1_000_000):
                some = batch.slice(i, j - i)
                ids, starts, lang = encode(some.column("text").to_pylist(), memo)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(m.probability(ids, starts)), pa.array(lang.astype(np.int32))], names=["doc_id", "p", "lang"])

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, p double, lang int")


def stretched(raw: DataFrame, model: TextCNN) -> DataFrame:
    """doc_id, score, predicted from raw scores: the language's cut becomes 0.3."""
    cut = F.create_map(*(F.lit(x) for pair in model.cuts.items() for x in pair))[F.col("lang")]
    rows = raw.withColumn("cut", cut)
    p, c = F.col("p"), F.col("cut")
    score = F.when(p < c, THRESHOLD * p / c).otherwise(THRESHOLD + (1 - THRESHOLD) * (p - c) / (1 - c))
    rows = rows.select("doc_id", F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def toxicity(docs: DataFrame, model: TextCNN) -> DataFrame:
    """doc_id, score, predicted for every row; null and empty texts get the score of a text without words."""
    return stretched(raw_scores(docs, model), model)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op5: a score for every document by a model of the labels that are not held out."""
    model, raw = fitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return stretched(raw, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: TextCNN, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows whose text scores at or over the threshold; all columns are kept, whatever their names.

    Null and empty texts are judged as texts without words; rows with equal texts stay or go together; an empty table
    stays empty.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        memo, m = Memo(), sent.value
        for batch in batches:
            for i, j in slices(batch, 1_000_000):
                some = batch.slice(i, j - i)
                yield some.filter(pa.array(m.score(*encode(some.column("text").to_pylist(), memo)) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)
