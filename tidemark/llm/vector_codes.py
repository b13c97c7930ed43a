"""Vector codes: each of 8 parts of a vector becomes the number of the nearest entry of the part's codebook.

Vectors are integers, floor(4096 * x), so that distances, sums and codebooks are exact and do not depend on the order of rows.
Codebooks are fitted by rounds of assignment and floored means; a round is one pass over the vectors, whose tasks give sums
and counts for each entry, added up by Spark.  The driver holds the codebooks only (16 numbers for each component).

The nearest entry is found by lower bounds.  A part is cut into one, two, four ... equal blocks.  With the sums S of its
blocks of b components and R, the square root of what is left of the squared norm (sum of x*x less sum of S*S / b), the
squared distance of x and y is at least sum((Sx - Sy) ** 2) / b + (Rx - Ry) ** 2.  Entries are filtered from the coarsest
blocks to the finest: whatever has a bound over the exact distance of the entry that had the least first bound is out; the
survivors get exact integer distances.  Bounds are made a little smaller than computed, so that rounding loses no entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, ship, stored, table

SCALE = 4096
LIMIT = 1 << 26  # so that sums of squared differences of up to 512 components stay within 64 bits
FAR = np.iinfo(np.int64).max


def integer_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, parts (array of long): kept rows with floor(scale * x) for each component x."""
    usable = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-float(LIMIT))), F.lit(float(LIMIT))))
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    return vectors.where(usable).select("vec_id", label.alias("label"), F.transform("embedding", whole).alias("parts"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones filled up with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def levels(width: int) -> list[int]:
    """Sizes of blocks, from the whole part down to the least over one that halving gives."""
    out = [width]
    while out[-1] % 2 == 0 and out[-1] > 2:
        out.append(out[-1] // 2)
    return out


def means(x: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of blocks of a part's components (last axis), and the norm of what is left when each block has its mean taken off."""
    sums = x.reshape(*x.shape[:-1], -1, block).sum(axis=-1)
    rest = block * (x * x).sum(axis=-1) - (sums * sums).sum(axis=-1)
    return sums.astype(np.float64), np.sqrt(rest.astype(np.float64) / block)


def lower_bound(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], block: int) -> np.ndarray:
    """No more than the squared distance, whatever the rounding."""
    apart = np.maximum(np.abs(x[1] - y[1]) - (x[1] + y[1]) * 2.0**-48, 0)
    return (((x[0] - y[0]) ** 2).sum(axis=-1) / block + apart * apart) * (1 - 2.0**-40) - 2.0**-20


def nearest(x: np.ndarray, entries: np.ndarray, tally: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest entry, squared distance) for each row; ties go to the lower number.

    tally: gets how many distances would be taken without bounds, and how many were.
    """
    n, width = x.shape
    if not n or not width:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    sizes = levels(width)
    bound = lower_bound(tuple(a[:, None] for a in means(x, sizes[0])), tuple(a[None] for a in means(entries, sizes[0])), sizes[0])
    distance = np.full((n, len(entries)), FAR, np.int64)
    some = np.arange(n)
    first = bound.argmin(axis=1)
    known = ((x - entries[first]) ** 2).sum(axis=1)
    distance[some, first] = known
    open_ = bound <= known[:, None]
    open_[some, first] = False
    row, entry = np.nonzero(open_)
    for block in sizes[1:]:
        mine, theirs = means(x, block), means(entries, block)
        keep = lower_bound(tuple(a[row] for a in mine), tuple(a[entry] for a in theirs), block) <= known[row]
        row, entry = row[keep], entry[keep]
    distance[row, entry] = ((x[row] - entries[entry]) ** 2).sum(axis=1)
    if tally is not None:
        tally[:] = [tally[0] + n * len(entries), tally[1] + n + len(row)]
    best = distance.argmin(axis=1)
    return best, distance[some, best]


def _assigned(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and squared distances, a column for each part; codebooks: part, entry, position."""
    parts, _, width = codebooks.shape
    pairs = [nearest(np.ascontiguousarray(x[:, p * width : (p + 1) * width]), codebooks[p]) for p in range(parts)]
    return np.stack([a for a, _ in pairs], axis=1), np.stack([d for _, d in pairs], axis=1)


def _pieces(batch: pa.RecordBatch, rows: int = 4096):
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def refined(vectors: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """One round: the floored mean of the parts that are nearest to each entry; entries without any stay."""
    parts, entries, width = codebooks.shape

    def run(batches):
        total, count = np.zeros(codebooks.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for some in _pieces(batch):
                x = matrix(some.column("parts"), parts * width)
                numbers, _ = _assigned(x, codebooks)
                for p in range(parts):
                    np.add.at(total[p], numbers[:, p], x[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(numbers[:, p], minlength=entries)
        part, entry = np.nonzero(count)
        if len(part):
            slot = np.repeat(part * entries + entry, width)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.tile(np.arange(width), len(part))), pa.array(total[part, entry].ravel()), pa.array(np.repeat(count[part, entry], width))], names=["slot", "place", "total", "n"])

    sums = vectors.select("parts").mapInArrow(lean(run), "slot long, place long, total long, n long").groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = codebooks.copy()
    for r in sums.collect():  # at most a row for each component of an entry
        out[r.slot // entries, r.slot % entries, r.place] = int(r.total) // r.n
    return out


def codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error of each kept row; the codebooks by part, entry and position).

    vectors: vec_id, embedding, label (may be missing); other columns are not read.  Rows whose vector is null or holds null
    or non-finite components are dropped.  Codebooks begin with the parts of the first vectors by vec_id (null last; rows
    that agree in vec_id by their vectors); with fewer kept rows than entries there are as many entries as rows.  Repeated
    rows are rows like others.  A vector that is shorter than the longest, or whose length the parts don't divide, counts as
    filled up with zeros; components of 16384 and more count as 16384 (the same below zero).  Empty tables give no rows.
    """
    ship(vectors.sparkSession)
    kept = stored(integer_vectors(vectors, scale), "vectors")
    longest = kept.agg(F.max(F.size("parts"))).first()[0]
    width = -(-(longest or 0) // parts)
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "parts").limit(entries).collect()  # a few rows
    begin = np.zeros((len(start), parts * width), np.int64)
    for k, r in enumerate(start):
        begin[k, : len(r.parts)] = r.parts
    codebooks = np.ascontiguousarray(begin.reshape(len(start), parts, width).transpose(1, 0, 2))
    for _ in range(rounds if start else 0):
        codebooks = refined(kept, codebooks)

    def run(batches):
        for batch in batches:
            for some in _pieces(batch):
                numbers, far = _assigned(matrix(some.column("parts"), parts * width), codebooks)
                code = [bytes(r).hex() for r in numbers.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(code, pa.string()), pa.array(far.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    types = dict(kept.dtypes)
    coded = stored(kept.mapInArrow(lean(run), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long"), "codes")
    discard(kept)
    return coded, codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame, small: int = 50_000, salts: int = 32) -> DataFrame:
    """coded with label_error, the sum of error over the rows of a label, nulls together.

    Sums are made before the shuffle.  Up to `small` labels they are broadcast; more are joined with a copy for each of
    `salts` parts of a label's rows, so that a label with a third of all rows is no single task.
    """
    sums = stored(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    if sums.count() <= small:
        return coded.join(F.broadcast(sums), F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    dealt = sums.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    mine = coded.withColumn("_mine", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    return mine.join(dealt, F.col("label").eqNullSafe(F.col("_label")) & (F.col("_mine") == F.col("_salt"))).drop("_label", "_salt", "_mine")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op12: codes, errors and the digest of the codebooks for all kept embeddings."""
    coded, codebooks = codes(table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds one after another, every part compared with every entry."""
    near = "SELECT r, part, arg_min(entry, d * {n} + entry) AS entry, min(d) AS d FROM (SELECT v.r, v.part, c.entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{k} AS c USING (part, place) GROUP BY v.r, v.part, c.entry) GROUP BY r, part"
    steps = []
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({near.format(n=entries, k=k)})")
        steps.append(f"m{k} AS (SELECT v.part, entry, place, sum(x)::BIGINT AS s, count(*) AS n FROM a{k} JOIN v USING (r, part) GROUP BY v.part, entry, place)")
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.place, CASE WHEN n IS NULL THEN c.x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{k} AS c LEFT JOIN m{k} USING (part, entry, place))")
    chain = ",\n".join(steps)
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label, embedding AS e, len(embedding) // {parts} AS width FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
u AS (SELECT r, width, generate_subscripts(e, 1) - 1 AS i, floor(unnest(e)::DOUBLE * {SCALE})::BIGINT AS x FROM kept),
v AS MATERIALIZED (SELECT r, i // width AS part, i % width AS place, x FROM u),
c0 AS MATERIALIZED (SELECT part, r AS entry, place, x FROM v WHERE r < {entries}),
{chain},
f AS ({near.format(n=entries, k=rounds)}),
s AS (SELECT r, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r),
h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN s USING (r), h
"""


ORACLE = _oracle()
