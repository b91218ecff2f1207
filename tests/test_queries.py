"""Every registered query against its SQL, at the smallest scale."""

import math
import os

import duckdb
import pytest

from lodeflow.plans.registry import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def shown(v):
    if v is None:
        return ""
    return ("nan" if math.isnan(v) else repr(round(v, 6))) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = lambda rows, names: sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in rows)
    assert order(got, df.columns) == order(want.fetchall(), list(want.columns))


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns == ["label", "total"] and out.count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
