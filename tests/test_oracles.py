"""Every query that has SQL gives what DuckDB gives on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from attestor.plans.catalog import ORACLE_SQL, QUERIES

DIR = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")


def plain(value):
    if value is None or isinstance(value, (bool, str)):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        return repr(round(float(value), 6))
    return str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DIR}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    frame, relation = QUERIES[name](spark, DIR), duck.sql(ORACLE_SQL[name])
    columns = sorted(frame.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    got = sorted(tuple(map(plain, r)) for r in frame.select(*columns).collect())
    assert got == sorted(tuple(plain(r[k]) for k in at) for r in relation.fetchall())
    assert got


def test_every_oracle_has_a_query():
    assert set(ORACLE_SQL) <= set(QUERIES)
