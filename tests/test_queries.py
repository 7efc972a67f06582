"""Every query that has SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted([tuple(r[i] for i in order) for r in rows], key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    want = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    got = ordered([tuple(r) for r in df.collect()], df.columns)
    assert got == ordered(want.fetchall(), want.columns)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
