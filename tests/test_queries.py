"""Every query with SQL gives what the SQL gives, at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import worked

SF = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    value = value.tolist() if hasattr(value, "tolist") else value
    return None if isinstance(value, float) and value != value else value


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def compare(frame, sql, statement):
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(v) for v in r) for r in frame.select(columns).collect()), key=str)
    found = sql.execute(statement)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=str)
    assert got == want


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, sql, name):
    compare(entry.queries()[name](spark, SF), sql, entry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(worked.QUERIES))
def test_worked(spark, sql, name):
    """The page operators over small made-up pages, against rows that were worked out by hand."""
    compare(worked.QUERIES[name](spark, SF), sql, worked.ORACLES[name])
