"""Every registered query runs on the smallest tables, and gives the rows of its SQL twin where it has one."""

import os

import duckdb
import numpy as np
import pytest

from graphloom.plans import registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for name in os.listdir(DATA):
        c.sql(f"create view {name.removesuffix('.parquet')} as select * from '{DATA}/{name}'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return [str(x) for x in v]
    if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool):
        return float(v) + 0.0
    return str(v)


def rows(pdf, cols):
    data = pdf[cols].astype(object).where(pdf[cols].notna(), None).values.tolist()
    return sorted(str([plain(v) for v in r]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    assert len(got.columns) == len(set(got.columns))
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry_and_contract():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert set(registry.QUERIES) <= set(e.queries())
