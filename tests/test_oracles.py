"""Every query with SQL against DuckDB on the small tables."""

import glob
import os

import duckdb
import pytest

from shelfmark.plans import general_queries, library_queries, record_queries

QUERIES = {**library_queries.QUERIES, **record_queries.QUERIES, **general_queries.QUERIES}
SQL = {**library_queries.SQL, **record_queries.SQL, **general_queries.SQL}


def _norm(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(_norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, spark, data, duck):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    ours = sorted((tuple(map(_norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()), key=repr)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(_norm(r[names.index(c)]) for c in cols) for r in result.fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, data):
    assert QUERIES[name](spark, data).limit(5).count() >= 0


def test_entry(spark, data, monkeypatch):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert QUERIES["search_all_terms"](spark, data).count() > 0
