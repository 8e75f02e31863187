"""Spark-vs-DuckDB parity of every registered query that has an oracle, on
the smallest test-data directory."""

import os

import pytest

from tests.harness import compare, duck_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck_connection(SF)


def _keys():
    from __spark_entry__ import oracle_sql

    return sorted(oracle_sql())


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
@pytest.mark.parametrize("key", _keys())
def test_parity(spark, con, key):
    from __spark_entry__ import oracle_sql, queries

    ok, n, _, _, detail = compare(spark, con, key, queries()[key], oracle_sql()[key], SF)
    assert ok, detail
