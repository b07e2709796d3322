"""Registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from vitals import catalog

DATA = "/root/testdata/sf0.001"


def rows(frame):
    show = lambda v: "" if pd.isna(v) else f"{v + 0.0:.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(show(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{DATA}/{t}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
@pytest.mark.parametrize("name", sorted(n for n in catalog.ORACLE_SQL))
def test_same_as_sql(spark, con, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert rows(got) == rows(con.execute(catalog.ORACLE_SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
