"""Every registered query with SQL, beside DuckDB, at the smallest scale."""

import pytest
from compare import compare

import __spark_entry__ as entry

DIRECTORY = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, DIRECTORY, name, QUERIES[name], ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1
