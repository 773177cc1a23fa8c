"""The subpackage's queries beside their SQL, and the contract of the rest."""

import pytest

from riskweave.llm import queries
from tests.helpers.compare import SMALL, connect, rows_of, rows_of_sql

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    df = queries.queries()[name](spark, SMALL)
    assert rows_of(df) == rows_of_sql(connect(), SQL[name], df.columns)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.queries()[name](spark, SMALL).limit(3).collect() is not None


def test_columns(spark):
    want = {"p2_found": ["capacity_id", "id"], "p4_found": ["key_a", "key_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["source_name"], "p8_found": ["doc_id"]}
    assert {n: queries.queries()[n](spark, SMALL).columns for n in want} == want
