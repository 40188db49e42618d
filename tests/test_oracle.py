"""Every core query with SQL gives the same rows as DuckDB on the smallest tables; the others run."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from loomstore.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def values(df):
    def text(x):
        if not isinstance(x, (list, dict)) and pd.isna(x):
            return "null"
        return f"{x:.9g}" if isinstance(x, float) else str(x)

    return sorted(tuple(text(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_rows(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)


def test_every_sql_has_a_query():
    assert set(registry.SQL) <= set(registry.QUERIES)
