"""Every query runs on the smallest data and has the result of its SQL."""

import math
import os

import duckdb
import pytest

from folio.plans import load

SF = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return c


def norm(v):
    return ("nan" if math.isnan(v) else repr(round(v, 6))) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(norm, r)) for r in df.select(*cols).collect())
    if name in SQL:
        q = con.execute(SQL[name])
        names = [x[0] for x in q.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(tuple(norm(r[i]) for i in at) for r in q.fetchall())
