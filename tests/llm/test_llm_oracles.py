"""The training-data queries that have SQL, against DuckDB on the small tables."""

import duckdb
import pytest

from lumensift.llm import queries as q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_equal(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = q.queries()[name](spark, SF), con.sql(q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(str(tuple(r[c] for c in want.columns)) for r in df.collect()) == sorted(map(str, want.fetchall()))
