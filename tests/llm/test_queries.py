"""Queries with SQL against DuckDB on small tables."""

import duckdb
import pytest

from indicatrix.llm.queries import ORACLE, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "benchmark", "labels", "conversations", "pages", "embeddings"]


@pytest.mark.parametrize("name", ORACLE)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLE[name]})").fetchall()
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(map(str, want)) != []
