"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import math
import os

import duckdb
import pytest

from lumenspark.plans import catalog

DATA = "/root/testdata/sf0.001"


def tables(data=DATA):
    con = duckdb.connect()
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-6)
    return a == b


def key(row):
    return tuple((x is None, str(round(x, 4)) if isinstance(x, float) else str(x)) for x in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = tables().sql(catalog.oracle_sql()[name])
    assert columns == sorted(want.columns)
    rows = sorted([tuple(r) for r in got.select(*columns).collect()], key=key)
    expected = sorted(tables().sql(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall(), key=key)
    assert len(rows) == len(expected) > 0
    assert all(same(x, y) for r, e in zip(rows, expected) for x, y in zip(r, e)), (rows[:3], expected[:3])
