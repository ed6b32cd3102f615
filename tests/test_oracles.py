"""Every registered query with an oracle gives the oracle's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

from tessella.plans import ORACLES, QUERIES
from tessella.plans.registry import TABLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


def rows(values, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    show = lambda x: None if x is None or isinstance(x, float) and math.isnan(x) else repr(round(float(x), 6) + 0.0) if isinstance(x, float) else repr(x)
    return sorted((tuple(show(v[i]) for i in order) for v in values), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    want = duck.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(got, df.columns) == rows(want.fetchall(), names)
