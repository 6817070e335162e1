"""Exact duplicates against a plain count, with and without frequent digests."""

import hashlib
from collections import defaultdict

import pytest

from indicatrix.llm import exact_dedup

SCHEMA = "doc_id long, text string, kept string, row int"


def plain(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[hashlib.sha256((text or "").encode()).hexdigest()].append(doc_id)
    return sorted((d, max(g), len(g), key) for key, g in groups.items() for d in g)


@pytest.mark.parametrize("frequent", [2, 50, 10_000])
def test_groups(spark, frequent):
    rows = [(i, f"copy {i % 7}" if i % 3 else "the hot text", "clash", 1) for i in range(400)] + [(1000, None, None, 0), (1001, "", None, 0), (1002, "ß́" * 30_000, None, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_dedup.exact_dedup(docs, frequent=frequent).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == plain(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a", "x", 1), (5, "a", "x", 1), (None, "a", "x", 1), (None, "b", "x", 1), (None, "b", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for frequent in (2, 100):
        got = exact_dedup.exact_dedup(docs, frequent=frequent).collect()
        assert sorted((str(r.keep_id), r.group_size, r.kept) for r in got) == [
            ("5", 3, False), ("5", 3, False), ("5", 3, True), ("None", 2, False), ("None", 2, True),
        ]
    stays = exact_dedup.drop_copies(docs).collect()
    assert sorted((str(r.doc_id), r.text, r.kept, r.row) for r in stays) == [("5", "a", "x", 1), ("None", "b", "x", 1)]


def test_no_group_has_to_fit_a_task(spark, monkeypatch):
    """Also where the sketch names nothing, no window gathers the rows of a digest."""
    monkeypatch.setattr(exact_dedup, "MAX_WINNERS", 1)
    rows = [(i, f"text {i % 3}", "x", 1) for i in range(600)] + [(1000 + i, f"own {i}", "x", 1) for i in range(50)]
    found = exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(5), frequent=2)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found.collect()) == plain(rows)


def test_clashing_columns(spark):
    schema = "doc_id long, text string, kept_id long, kept_sha256 string, indicatrix_text_sha256 string, indicatrix_id string, text_sha256 string"
    rows = [(i, f"t{i % 3}", 7, "s", "own", "r", "b") for i in range(30)]
    docs = spark.createDataFrame(rows, schema).repartition(4)
    stays = exact_dedup.drop_copies(docs)
    assert stays.columns == docs.columns and sorted(map(tuple, stays.collect())) == rows[27:]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(docs).count() == 0 and exact_dedup.drop_copies(docs).count() == 0
