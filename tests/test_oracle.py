"""Every query of the library against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pandas as pd
import pytest

from folio.plans import registry
from folio.plans.fixtures import BASE

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in BASE:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or getattr(getattr(v, "dtype", None), "kind", "") in "iuf" and hasattr(v, "dtype"):
        return repr(round(float(v), 6) + 0.0)
    return str(v).removesuffix(" 00:00:00")


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE:
        want = duck.execute(registry.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
