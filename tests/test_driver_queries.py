"""Every driver query that SQL can express, on the driver's smallest tables, against DuckDB."""

import glob
import math
import os

import pytest

from threadloom.plans import driver_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no driver tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "null" if math.isnan(value) else f"{value:.9g}"
    return "null" if value is None else str(value)


@pytest.mark.parametrize("name", sorted(driver_queries.oracle_sql()))
def test_equals_sql(spark, duck, name):
    got = driver_queries.queries()[name](spark, SF_DIR)
    want = duck.execute(driver_queries.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(tuple(plain(v) for v in r) for r in got.select(*names).collect())
    assert rows == sorted(tuple(plain(v) for v in r) for r in want.fetchall())


def test_every_query_runs(spark):
    for name in set(driver_queries.queries()) - set(driver_queries.oracle_sql()):
        assert driver_queries.queries()[name](spark, SF_DIR).columns, name
