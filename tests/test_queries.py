"""Every registered query against its SQL, on the smallest generated tables."""

import datetime as dt
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from workload import oracle, queries

from conftest import SF_DIR

SQL = oracle.oracle_sql()
QUERIES = queries.queries()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def in_order(rows, names):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(r[i] for i in at) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got = in_order([tuple(r) for r in df.collect()], df.columns)
    want = in_order(cursor.fetchall(), names)
    assert len(got) > 0
    assert got == want


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert isinstance(df.select("DATE").first()[0], dt.date)
