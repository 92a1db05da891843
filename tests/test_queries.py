"""Every core query with SQL gives what DuckDB gives on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from quire.plans.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, name):
    df = queries()[name](spark, DATA)
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    res = c.execute(oracle_sql()[name])
    cols = [x[0] for x in res.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(r[cols.index(k)]) for k in sorted(cols)) for r in res.fetchall()), key=str)
    got = sorted((tuple(plain(r[k]) for k in sorted(cols)) for r in df.collect()), key=str)
    assert got == want


