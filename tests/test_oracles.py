"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os
from pathlib import Path

import duckdb
import pytest

from screenlake import plans

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def canon(v):
    if isinstance(v, float):
        return round(v, 5)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_its_sql(spark, con, name):
    df = plans.QUERIES[name](spark, str(DATA))
    want = con.sql(plans.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    got = sorted((tuple(map(canon, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    expected = sorted((tuple(map(canon, r)) for r in con.sql(plans.SQL[name]).project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got == expected
