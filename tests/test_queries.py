"""Every core query beside its SQL on the smallest tables, and on empty ones."""

import pytest

from riskweave.plans import core
from tests.helpers.compare import SMALL, connect, rows_of, rows_of_sql

SQL = core.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    df = core.queries()[name](spark, SMALL)
    assert rows_of(df) == rows_of_sql(con, SQL[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = core.queries()[name](spark, SMALL)
    assert df.columns
    df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3
    assert set(entry.oracle_sql()) <= set(entry.queries())
