"""Every named query against its SQL, and the shape of the entry points."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from tickledger.plans import registry

QUERIES = registry.queries()
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    return round(value, 9) if isinstance(value, float) else value


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = Counter(tuple(_cell(v) for v in row) for row in df.select(*columns).collect())
    cursor = duck.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    order = [names.index(c) for c in columns]
    assert sorted(names) == columns
    expected = Counter(tuple(_cell(row[i]) for i in order) for row in cursor.fetchall())
    assert got == expected


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
