"""Every query with a SQL twin against DuckDB, and the contract of the entry module."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, rows

DATA = "/root/testdata/sf0.001"
#: Queries of what should not be there.
MAY_BE_EMPTY = {"n6_invariants", "p4_pieces", "p6_found", "p6_groups", "p10_found", "p10_residue"}
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got = entry.queries()[name](spark, DATA).toArrow()
    want = duck.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    got = entry.queries()[name](spark, DATA)
    assert got.toArrow().num_rows >= (name not in MAY_BE_EMPTY) and len(set(got.columns)) == len(got.columns)


def test_every_sql_has_its_query(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
