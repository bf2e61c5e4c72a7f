"""Every query that has SQL gives the rows of that SQL."""

import duckdb
import pandas as pd
import pytest

from vigil import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NA or x != x:
        return None
    if hasattr(x, "item"):
        x = x.item()
    return round(x, 6) if isinstance(x, float) else x


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(str(tuple(plain(v) for v in r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(catalogue.SQL))
def test_matches_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
