"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from archivolt.plans.catalog import ORACLES, QUERIES


def plain(v):
    if v is None or v is pd.NA or isinstance(v, float | np.floating) and math.isnan(v):
        return None
    if isinstance(v, list | np.ndarray):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, int | np.integer):
        return int(v)
    if isinstance(v, float | np.floating):  # pandas has whole numbers with nulls as floats
        return int(v) if float(v).is_integer() else round(float(v), 7)
    return v


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(plain(v) for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    found = QUERIES[name](spark, sf).toPandas()
    if name in ORACLES:
        expected = duck.execute(ORACLES[name]).df()
        assert sorted(found.columns) == sorted(expected.columns)
        assert rows(found) == rows(expected)
    else:
        assert len(found)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "id", "score"]
