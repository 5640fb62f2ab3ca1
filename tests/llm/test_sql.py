"""Corpus queries against their SQL."""

import duckdb
import pandas as pd
import pytest

from tables import SF
from vellumspark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {view} as select * from '{SF}/{view}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    key = [c for c in got.columns if c not in ("target", "position")]
    left, right = (f.sort_values(key)[sorted(f.columns)].reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(left, right, check_dtype=False)
