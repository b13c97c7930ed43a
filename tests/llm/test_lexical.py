"""Ranked search against a plain version on small tables, and against SQL."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm.lexical import LOWER, TERM, UPPER, Best, numbered, op11_ranked_search, rank_documents, search, terms_of
from tidemark.llm.queries import ORACLES

FOLD = str.maketrans(UPPER, LOWER)


def plain(docs, items, top=20):
    """(item_id, rank, doc_id, score) by scoring every document."""
    of = lambda text: re.findall(TERM, (text or "").translate(FOLD))
    docs = [(i, t) for i, text in docs if (t := of(text))]
    n, total = len(docs), sum(len(t) for _, t in docs)
    df = Counter(x for _, t in docs for x in set(t))
    out = []
    for item, text in items:
        scores = []
        for i, t in docs:
            tf, m = Counter(t), 75 + 25 * len(t) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m)) for x in of(text) if x in tf)
            if score > 0:
                scores.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores, key=lambda x: x[:2] + (x[2] or 0,))[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "lorem IPSUM dolor, again?"), (2, None), (3, ""), (4, "w7919 w1 tail; tail"), (5, "nothing-of-this stands-anywhere"), (None, "Ünïcödé 🙂 one two"), (7, "row twice row"), (7, "words before")]


def test_edge_rows_as_the_plain_version(spark, edge, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumns({"score": F.lit("clash"), "terms": F.lit("clash"), "doc_id": F.lit(5)})
    docs = [(r.doc_id, r.text) for r in edge.collect()]
    whole = got(rank_documents(edge.repartition(3), items))
    assert whole == plain(docs, ITEMS)
    assert whole == got(rank_documents(edge, items, block=5, window=2)), "blocks and windows change nothing"
    assert got(rank_documents(edge, items, top=2)) == plain(docs, ITEMS, 2)
    assert got(rank_documents(none, items)) == got(rank_documents(edge, items.limit(0))) == []


def test_ties_go_to_the_least_doc_id_over_many_shards(spark):
    docs = spark.range(500).select((500 - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "same words here").otherwise(F.concat(F.lit("other "), F.col("id"))).alias("text"))
    items = spark.createDataFrame([(1, "same words here")], "item_id long, text string")
    rows = got(rank_documents(docs.repartition(7), items))
    assert sorted(r[2] for r in rows) == sorted(500 - i for i in range(0, 500, 3))[:20] and len({r[3] for r in rows}) == 1


def test_terms_are_told_apart_by_all_their_bytes():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghi0", "x" * 300, "x" * 299 + "y", "x" * 300, "ab", "ü" * 200, "ü" * 199 + "v", "ABCDEFGH"]
    data, first, stop, owner = terms_of(pa.array([" ".join(words[:6]), None, "", "-".join(words[6:])]))
    assert [data[a:b].tobytes().decode() for a, b in zip(first, stop, strict=True)] == [w.translate(FOLD) for w in words]
    assert owner.tolist() == [0] * 6 + [3] * 6
    number = numbered(data, first, stop).tolist()
    assert len(set(number)) == len({w.translate(FOLD) for w in words})
    assert {w.translate(FOLD): n for w, n in zip(words, number, strict=True)} == dict(zip((w.translate(FOLD) for w in words), number, strict=True))


def test_documents_that_cannot_reach_the_heap_are_skipped():
    rng = np.random.default_rng(3)
    ids = np.arange(20_000)
    common = (ids, rng.integers(1, 4, len(ids)), 3, 1, 1)
    rare_docs = np.sort(rng.choice(ids, 60, replace=False))
    impacts = rng.integers(50, 90, 60)
    rare = (rare_docs, impacts, 90, int(np.sort(impacts)[-20]), 1)
    best = Best(20)
    scored = search([common, rare], ids, best, 256)
    full = common[1].copy()
    full[rare_docs] += rare[1]
    want = np.lexsort((ids, -full))[:20]
    assert best.ids.tolist() == want.tolist() and best.scores.tolist() == full[want].tolist()
    assert scored <= 60, "most documents hold the common term only"


def test_whole_tables_as_sql(spark, sf_dir, duck):
    want = sorted(duck.execute(f"SELECT item_id, rank, doc_id, score FROM ({ORACLES['op11_ranked_search']})").fetchall(), key=repr)
    assert want and got(op11_ranked_search(spark, sf_dir)) == want


@pytest.mark.parametrize("text", [None, "", " .,;"])
def test_tables_without_a_term(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert got(rank_documents(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))) == []


def test_a_row_group_of_the_index_has_few_shards(spark):
    import glob

    from tidemark.llm import lexical
    from tidemark.llm.common import stored

    words = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.lit(250_000).cast("long")), lambda i: F.hex(i * 104_729 + F.col("id"))), " ")
    docs = spark.range(0, 12, 1, 1).select(F.col("id").alias("doc_id"), words.alias("text"))
    path = stored(lexical.build_index(docs, 1_000_000), "index", **lexical.FEW_ROWS)._tidemark_path.replace("file://", "")
    import pyarrow.parquet as pq

    groups = [pq.ParquetFile(f).metadata for f in glob.glob(f"{path}/*.parquet")]
    assert sum(m.num_rows for m in groups) == 12 and sum(m.num_row_groups for m in groups) > 1
