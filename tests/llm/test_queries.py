import pytest

from shelfmark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(name, spark, data):
    df = queries.QUERIES[name](spark, data)
    rows = df.collect()
    assert len({repr(r) for r in rows}) == len(rows)


def test_entry_adds_them():
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries())
