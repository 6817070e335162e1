"""Repeated passages against brute force over all windows."""

import random
import re

import numpy as np
import pytest

from indicatrix.llm import substring_dedup
from indicatrix.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
WIDTH = 13


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, width=WIDTH):
    first = {}
    for doc_id, text in rows:
        parts, known = split(text), doc_id if doc_id is not None else float("inf")
        for i in range(len(parts) - width + 1):
            window = tuple(parts[i : i + width])
            first[window] = min(first.get(window, known), known)
    out = []
    for doc_id, text in rows:
        parts, known = split(text), doc_id if doc_id is not None else float("inf")
        gone = set()
        for i in range(len(parts) - width + 1):
            if first[tuple(parts[i : i + width])] < known:
                gone.update(range(i, i + width))
        out.append((doc_id, len(parts), len(gone), " ".join(w for i, w in enumerate(parts) if i not in gone)))
    return sorted(out, key=str)


def found(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted((tuple(r) for r in substring_dedup.without_repeats(docs, **more).collect()), key=str)


def corpus(draw, n, letters=3000):
    """Texts with shared passages of 9 to 60 words, some of them cut or put twice into a text."""
    passages = [[f"p{draw.randrange(10**6)}" for _ in range(draw.randint(9, 60))] for _ in range(12)]
    rows = []
    for i in draw.sample(range(10**6), n):
        parts = []
        for _ in range(draw.randint(0, 4)):
            parts += [f"w{draw.randrange(letters)}" for _ in range(draw.randint(0, 25))]
            if draw.random() < 0.6:
                passage = draw.choice(passages)
                low = draw.choice((0, 0, draw.randrange(len(passage))))
                parts += passage[low : low + draw.randint(5, 60)] * draw.choice((1, 1, 2))
        rows.append((i, draw.choice(" \t\n\x0b") .join(parts)))
    return rows


@pytest.mark.parametrize("cells", [1 << 28, 1])
def test_shared_passages(spark, monkeypatch, cells):
    """Also with a sketch that is full and rules nothing out."""
    monkeypatch.setattr(substring_dedup, "LEAST_CELLS", 1 << 16 if cells > 1 else 8)
    monkeypatch.setattr(substring_dedup, "HELD", 1 << 21 if cells > 1 else 100)
    draw = random.Random(31)
    rows = corpus(draw, 150)
    rows += [(2_000_000 + i, text + " tail") for i, (_, text) in enumerate(rows[:40])]
    assert found(spark, rows, most_cells=cells) == brute(rows)


@pytest.mark.parametrize("width", [3, 5, 6, 20])
def test_widths(spark, width):
    draw = random.Random(32)
    rows = [(i, " ".join(draw.choices("abc", k=draw.randint(0, 40)))) for i in range(60)]
    assert found(spark, rows, width=width) == brute(rows, width)


def test_odd_rows(spark):
    passage = " ".join(f"v{i}" for i in range(20))
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(5, passage), (3, "a " + passage), (3, passage + " b"), (3, passage + " b"), (None, passage), (None, passage + " c " + long), (9, long), (1, None), (2, ""), (4, " \n"), (6, passage.upper()), (7, "one two")]
    rows += [(10, " ".join(passage.split()[:12])), (11, " ".join(passage.split()[:13])), (12, "y" * 300_000)]
    assert found(spark, rows) == brute(rows)
    schema = "doc_id long, text string, key string, doc int, spans string, anchor string"
    docs = spark.createDataFrame([(1, passage, "k", 1, "s", "a"), (2, passage, "k", 1, "s", "a")], schema)
    assert sorted(tuple(r) for r in substring_dedup.without_repeats(docs).collect()) == [(1, 20, 0, passage), (2, 20, 20, "")]
    assert substring_dedup.without_repeats(docs.where("false")).count() == 0


def test_sketch_never_counts_too_little(spark):
    """Every anchor of two documents has all its cells set, and few others have."""
    draw = random.Random(33)
    rows = corpus(draw, 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bits = substring_dedup.repeated_cells(docs, 1 << 16, WIDTH)
    owners = {}
    for doc_id, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        for anchor in substring_dedup.stretches(data, np.array([0, len(data)]), WIDTH)[3].tolist():
            owners.setdefault(anchor, set()).add(doc_id)
    anchors = np.array(list(owners), np.uint64)
    at = substring_dedup.cells_of(anchors, 1 << 16)
    may = np.all((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1, axis=0)
    twice = np.array([len(o) > 1 for o in owners.values()])
    assert may[twice].all() and twice.any() and may[~twice].mean() < 0.05


def test_sketch_rows_grow_with_tasks(spark):
    """A task hands on one row for each shard, however many texts it has."""
    draw = random.Random(34)
    rows = corpus(draw, 120)
    for copies in (1, 4):
        docs = spark.createDataFrame([r for r in rows for _ in range(copies)], "doc_id long, text string").coalesce(2)
        parts = substring_dedup.sketched(docs, 1 << 16, WIDTH)
        assert 0 < parts.count() <= 2 * substring_dedup.SHARDS
        assert parts.select("shard").distinct().count() <= parts.count()


def test_query(spark):
    """The registered query against plain Python over the whole table."""
    import hashlib

    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute(rows)}
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op13_substring_dedup"](spark, FOLDER).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 100
