"""Every query runs on the smallest tables; where there is SQL, the rows are the same."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        c.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def canon(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "[" + ",".join(map(canon, v)) + "]" if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(canon(r[c]) for c in names) for r in df.collect())
    if name in SQL:
        r = con.sql(SQL[name])
        at = [r.columns.index(c) for c in names]
        assert sorted(r.columns) == names
        assert got == sorted(tuple(canon(row[i]) for i in at) for row in r.fetchall())
    if name.endswith("_found"):
        assert len(got) == len(set(got))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
