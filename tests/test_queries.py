"""Every registered query against its DuckDB SQL on the smallest data."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import check
from opslens.plans import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check.TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracles())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    message, ok = check.compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF_DIR)
    assert ok, message
