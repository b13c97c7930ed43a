"""Every query with SQL gives the rows that DuckDB gives; every other one gives rows of a stable schema."""

import pytest

from tidemark.plans.queries import COVERS, ORACLES, QUERIES


def _norm(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(_norm(r[c]) for c in columns)) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = sorted(repr(tuple(_norm(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert sorted(names) == columns
    assert got == want
    assert got, "the query gives no rows here, so that it would prove nothing"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_every_query_says_what_it_covers():
    assert set(COVERS) == set(QUERIES) and all(COVERS.values())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["topic", "n_stories"] and df.count() == 9
    assert set(e.oracle_sql()) <= set(e.queries())
