"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from weftline.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        if isinstance(v, float) and v == int(v):
            return str(int(v))  # an integer column with nulls
        return round(float(v), 5) if isinstance(v, float) else str(v).replace("+00:00", "")

    return sorted(repr(tuple(plain(v) for v in r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    a = core.queries()[name](spark, SF).toPandas()
    b = duck.execute(core.oracle_sql()[name]).fetch_df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
