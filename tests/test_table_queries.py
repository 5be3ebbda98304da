"""Each table query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from quillmesh.plans import source_queries, table_queries

QUERIES, SQL = table_queries.QUERIES | source_queries.QUERIES, table_queries.SQL | source_queries.SQL
DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(None if pd.isna(v) else round(v, 6) if isinstance(v, float) else v for v in r) for r in df.itertuples(index=False, name=None)) if len(df) else []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    clean = lambda d: sorted([tuple(None if pd.isna(v) else v for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)], key=key)
    assert clean(got) == clean(want)
    assert len(want)
