"""Every query of the subpackage against its SQL on the smallest tables; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from brindle.llm.oracle import oracle_sql
from brindle.llm.queries import queries

QUERIES, SQL = queries(), oracle_sql()


def is_null(x):
    return pd.api.types.is_scalar(x) and pd.isna(x)


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("N" if is_null(x) else f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in os.listdir(data):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{data}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
    assert len(got.columns)
