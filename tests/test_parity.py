"""Every registered query against its plain-SQL twin, whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from feedlake.plans.queries import CATALOGUE

SF = "/root/testdata/sf0.01"
QUERIES, CHECKS = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in ("pages", "documents", "conversations", "benchmark", "embeddings", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_every_query_has_a_check():
    assert CATALOGUE.keys() <= CHECKS.keys() <= QUERIES.keys()


@pytest.mark.parametrize("name", CHECKS)
def test_parity(spark, database, name):
    got = QUERIES[name](spark, SF)
    want = database.sql(CHECKS[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = [want.columns.index(c) for c in columns]
    left = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=str)
    right = sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=str)
    assert left == right and left


def test_entry(spark):
    assert entry.entry(spark).count() > 0
