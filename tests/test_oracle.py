"""Every registered query with a SQL twin must equal DuckDB on sf0.001."""

import hashlib
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from freightlens.sources.fixtures import TABLES

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
QUERIES = entry.queries()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted("|".join(_norm(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_every_oracle_key_is_registered():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_oracle(spark, duck, key):
    sdf = QUERIES[key](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    cur = duck.execute(SQL[key])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    assert sorted(sdf.columns) == sorted(dcols)
    assert _digest(sdf.columns, srows) == _digest(dcols, drows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() >= 0 and "route_id" in df.columns
