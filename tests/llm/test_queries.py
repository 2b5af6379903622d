"""The registered queries with SQL, held against DuckDB over whole tables."""

import os

import duckdb
import pytest

from quarry.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "conversations"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    want = duck.sql(queries.oracle_sql()[name])
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
