"""Every registered query against its SQL restatement on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from indicatrix.plans.oracle import ORACLE
from indicatrix.plans.queries import QUERIES
from indicatrix.plans.tables import TABLES
from tests.conftest import SMALL


def test_entry_lists_all():
    assert QUERIES.items() <= entry.queries().items() and ORACLE.items() <= entry.oracle_sql().items()


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return connection


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    rows = QUERIES[name](spark, SMALL)
    columns = sorted(rows.columns)
    got = sorted(str(tuple(r[c] for c in columns)) for r in rows.collect())
    result = con.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    want = sorted(str(tuple(r[i] for i in places)) for r in result.fetchall())
    assert got and got == want


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["type", "value", "confidence", "source", "note"] and rows.take(1)


def test_streams_read_tables_in_folders(spark, tmp_path):
    """Larger tables are folders of files; a stream over one finds what the file gives."""
    def texts(name):
        return spark.range(40).selectExpr("id AS doc_id", "'see evil' || CAST(id AS STRING) || '.com at 10.0.0.' || CAST(id AS STRING) AS text")

    rows = texts("documents")
    one, many = tmp_path / "one", tmp_path / "many"
    rows.coalesce(1).write.parquet(str(one / "parts"))
    (part,) = (one / "parts").glob("part-*.parquet")
    part.rename(one / "documents.parquet")
    rows.repartition(3).write.parquet(str(many / "documents.parquet"))
    found = [sorted(map(tuple, QUERIES["stream_extract"](spark, str(d)).collect())) for d in (one, many)]
    assert found[0] == found[1] and len(found[0]) == 80


def test_pages_are_landed_by_several_tasks(spark):
    """The table is one row group; one task alone would write a file for each page."""
    import re

    from indicatrix.plans.queries import land_pages

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(land_pages(spark, "/root/testdata/sf0.001"))
    names = [re.search(r"page_id=(\d+)/part-(\d+)", r.path).groups() for r in files.select("path").collect()]
    assert len({page for page, _ in names}) == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count() == len(names)
    assert len({task for _, task in names}) > 8
