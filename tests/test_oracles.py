"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import decimal
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return int(v) if math.isfinite(v) and v == int(v) else round(v, 6)
    return v


def table_of(df):
    df = df.astype(object)
    names = sorted(df.columns)
    return names, sorted(tuple(repr(plain(v)) for v in r) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_its_sql(spark, small, duck, name):
    assert table_of(entry.queries()[name](spark, small).toPandas()) == table_of(duck.execute(entry.oracle_sql()[name]).df())
