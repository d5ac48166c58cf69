"""Every registered query against its DuckDB counterpart over the smallest tables."""

import pytest
from compare import differences
from conftest import SMALL

import __spark_entry__ as entry_points

QUERIES = entry_points.queries()
SQL = entry_points.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_duckdb(spark, duck, name):
    result = QUERIES[name](spark, SMALL)
    if name in SQL:
        assert differences(result, duck, SQL[name]) == []
    else:
        assert result.collect()


def test_sql_belongs_to_queries():
    assert SQL.keys() <= QUERIES.keys()


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.count() == 10
    assert result.columns[0] == "url"
