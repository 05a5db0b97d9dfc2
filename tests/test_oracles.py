"""Every registered search query against its SQL in DuckDB, on the small tables."""

import duckdb
import pytest

from lumensift.plans import queries, surface_queries

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "nation", "part", "benchmark", "conversations", "pages", "labels")
# The codec report has its own tests; its SQL takes long for a test run.
QUERIES, SQL = queries.queries() | surface_queries.queries(), queries.oracle_sql() | surface_queries.oracle_sql()
NAMES = sorted(set(QUERIES) - {"codec_size_report"})


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_equal(spark, duck, name):
    df = QUERIES[name](spark, SF)
    want = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert sorted(str(tuple(r[c] for c in want.columns)) for r in df.collect()) == sorted(map(str, want.fetchall()))
