"""Periodic runs against brute force over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from indicatrix.llm import periodic_runs, words
from indicatrix.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def brute(parts):
    """All (start, length, period): every stretch of every period, of equal stretches the smallest period."""
    found = {}
    n = len(parts)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            k = i
            while k + q < n and parts[k] == parts[k + q]:
                k += 1
            if k > i and k - i + q >= max(6, 4 * q):
                found.setdefault((i, k - i + q), q)
            i = max(k, i) + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapse(parts, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(parts) if i not in gone)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def results(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = {r.doc_id: r for r in periodic_runs.periodic_runs(docs).collect()}
    return [(r.n_words, [tuple(x) for x in r.runs], r.collapsed) for _, r in sorted(rows.items())]


def expected(texts):
    out = []
    for text in texts:
        parts = split(text)
        found = brute(parts)
        out.append((len(parts), found, collapse(parts, found)))
    return out


def periodic(draw, size):
    """Words in which stretches repeat, also stretches of stretches."""
    parts = []
    while len(parts) < size:
        unit = draw.choices("abc", k=draw.choice((1, 1, 2, 3, 5, 9)))
        parts += (unit * draw.randint(1, 9))[: draw.randint(1, 60)]
        if draw.random() < 0.2:
            parts += parts[-draw.randint(1, 30) :] * draw.randint(1, 6)
    return parts[:size]


def test_random_texts(spark):
    draw = random.Random(7)
    texts = [" ".join(draw.choices("ab" if i % 2 else "abcd", k=draw.randint(0, 40))) for i in range(400)]
    texts += [" ".join(periodic(draw, draw.randint(1, 300))) for _ in range(300)]
    assert results(spark, texts) == expected(texts)


@pytest.mark.parametrize("places", [32, 1 << 20])
def test_grid_in_parts(monkeypatch, places):
    monkeypatch.setattr(periodic_runs, "AT_ONCE", places)
    draw = random.Random(8)
    for _ in range(30):
        parts = periodic(draw, 120)
        _, *found = periodic_runs.runs(np.array([ord(p) for p in parts], np.uint64), np.array([len(parts)]))
        assert list(zip(*(x.tolist() for x in found))) == brute(parts)


def test_grammar_compares_any_two_places():
    draw = random.Random(9)
    for _ in range(40):
        parts = [100, *(ord(p) for p in periodic(draw, 80)), 101]
        levels = periodic_runs.grammar(np.array(parts))
        i, j = np.triu_indices(len(parts), 1)
        ahead, back = (periodic_runs.common(levels, i, j, way) for way in (True, False))
        for a, b, x, y in zip(i, j, ahead, back):
            assert x == next((k for k in range(len(parts) - b) if parts[a + k] != parts[b + k]), len(parts) - b)
            assert y == next((k for k in range(a + 1) if parts[a - k] != parts[b - k]), a + 1)


def test_odd_rows(spark):
    long_text = "x " * 50_000 + " ".join(f"w{i % 999}" for i in range(20_000))
    texts = [None, "", " \t\n", "a", "A a A a A a A a", "a\x0ba\x0ca a\na\ta", "a a a a " * 4, "é é " * 9, long_text, "y" * 400_000, "a a a a a", "a a a a a a"]
    got = results(spark, texts)
    assert got[:8] + got[9:] == expected(texts[:8] + texts[9:])
    assert got[8][1] == [(0, 50_000, 1), (50_000, 20_000, 999)] and got[8][2].startswith("x w0 w1 ") and len(got[8][2].split()) == 1000
    schema = "doc_id long, text string, runs string, n_words int"
    docs = spark.createDataFrame([(None, "b " * 7, "z", 1), (3, "b " * 7, "z", 1), (3, "b " * 7, "z", 1)], schema)
    assert [(r.n_words, len(r.runs), r.collapsed) for r in periodic_runs.periodic_runs(docs).collect()] == [(7, 1, "b")] * 3
    assert periodic_runs.periodic_runs(docs.where("false")).count() == 0


def test_query(spark):
    """The registered query with its planted periods, against plain Python over the whole table."""
    want = {}
    for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        parts = split(row.text)
        h, n = zlib.crc32(str(row.doc_id).encode()), len(parts)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            parts = [w if i < a else parts[a + (i - a) % p] for i, w in enumerate(parts)]
        found = brute(parts)
        best = min(((-length, s, q) for s, length, q in found), default=None)
        top = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
        want[row.doc_id] = (len(found), *top, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapse(parts, found).encode()).hexdigest())
    rows = QUERIES["op11_periodic_runs"](spark, FOLDER).collect()
    got = {r.doc_id: (r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in rows}
    assert got == want and len(rows) == len(want) and sum(w[0] for w in want.values()) > 10


def test_words_are_exact():
    data = np.frombuffer(b"The the THE the", np.uint8)
    hashes, _ = words.words(data, np.array([0, len(data)]), values=words.EXACT)
    assert len(set(hashes.tolist())) == 3 and hashes[1] == hashes[3]
