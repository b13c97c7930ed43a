"""Vector codes against a plain version and SQL; bounds against exact distances."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.queries import ORACLES
from tidemark.llm.vector_codes import codes, digest, levels, lower_bound, means, nearest, op12_vector_codes, with_label_errors


def plain(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label_error) and the codebooks' digest, vector by vector and entry by entry."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max((len(r[1]) for r in rows), default=0) // parts)
    ints = [[math.floor(4096 * x) for x in r[1]] + [0] * (parts * width - len(r[1])) for r in rows]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in ints[:entries]] for p in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [best(cut(v, p), book)[1] for v in ints]
            for k in set(of):
                mine = [cut(v, p) for v, o in zip(ints, of, strict=True) if o == k]
                book[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    found = [[best(cut(v, p), books[p]) for p in range(parts)] for v in ints]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]]) for r, f, e in zip(rows, found, errors, strict=True)), key=repr), sha


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error").collect()), key=repr)


def rows_of(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = np.where(rng.random((n, 1)) < 0.3, np.round(rng.normal(size=(1, d)), 2), rng.normal(size=(n, d)) * rng.choice([0.01, 1, 30], (n, 1)))
    return [(int(i), [float(np.float32(v)) for v in r], None if i % 7 == 0 else int(i % 3)) for i, r in enumerate(x)]


ODD = [(3, None, 1), (4, [], 1), (None, [0.5] * 16, None), (5, [float("nan")] * 16, 2), (6, [float("inf")] + [0.0] * 15, 2), (7, [None] + [0.0] * 15, 2), (8, [0.25] * 3, 9), (8, [0.25] * 3, 9), (-1, [-0.0001] * 16, 0)]


@pytest.mark.parametrize("rows", [rows_of(400, 16) + ODD, rows_of(9, 16), ODD, rows_of(60, 40, 2)], ids=["many", "fewer than entries", "odd rows", "five a part"])
def test_as_the_plain_version(spark, rows):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit("clash"), "error": F.lit("clash"), "_label": F.lit("clash")})
    coded, books = codes(vectors.repartition(5))
    want, sha = plain(rows)
    assert got(with_label_errors(coded)) == want and digest(books) == sha
    assert got(with_label_errors(coded, small=0)) == want, "labels dealt over salts give the same"


def test_no_rows(spark):
    for rows in ([], [(1, None, 1)]):
        coded, books = codes(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
        assert got(with_label_errors(coded)) == [] and digest(books) == hashlib.sha256(b"").hexdigest()
    assert codes(spark.createDataFrame([(1, [0.5] * 8)], "vec_id long, embedding array<float>"))[0].count() == 1, "label may be missing"


@pytest.mark.parametrize("top", [4, 5_000, 1 << 26])
def test_bounds_never_exceed_distances_and_spare_most_of_them(top):
    rng = np.random.default_rng(top)
    x, entries = rng.integers(-top, top + 1, (3_000, 8)), rng.integers(-top, top + 1, (16, 8))
    x[::3] = entries[rng.integers(0, 16, 1_000)] + rng.integers(-1, 2, (1_000, 8)) * (top > 4)
    exact = ((x[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    for block in levels(8):
        low = lower_bound(tuple(a[:, None] for a in means(x, block)), tuple(a[None] for a in means(entries, block)), block)
        assert (low <= exact.astype(np.float64)).all()
    tally = [0, 0]
    number, far = nearest(x, entries, tally)
    assert (number == [min(range(16), key=lambda k: (r[k], k)) for r in exact]).all() and (far == exact.min(axis=1).astype(np.int64)).all()
    assert tally[0] == 48_000 and tally[1] < 0.7 * tally[0]


def test_whole_table_as_sql(spark, sf_dir, duck):
    df = op12_vector_codes(spark, sf_dir)
    cursor = duck.execute(ORACLES["op12_vector_codes"])
    assert [d[0] for d in cursor.description] == df.columns
    want = sorted(cursor.fetchall(), key=repr)
    assert want and sorted((tuple(r) for r in df.collect()), key=repr) == want
