"""The operators' queries against their SQL."""

import duckdb
import pandas as pd
import pytest

from quillmesh.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda d: sorted([tuple(None if pd.isna(v) else v for v in r) for r in d[sorted(d.columns)].astype(object).itertuples(index=False, name=None)], key=str)
    assert clean(got) == clean(want) and len(want)
