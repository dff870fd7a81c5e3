"""Every query with SQL equals it; the others run and have rows."""

import pytest

from concord import queries

from .compare import rows_of, rows_of_sql

QUERIES, SQL = queries.queries(), queries.oracle_sql()


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir):
    cols, rows = rows_of(QUERIES[name](spark, sf_dir))
    if name not in SQL:
        assert rows
        return
    expected_cols, expected = rows_of_sql(SQL[name], sf_dir)
    assert cols == expected_cols
    assert rows == expected
