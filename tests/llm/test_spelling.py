"""Spelling variants against brute force over all pairs of words."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from indicatrix.llm import spelling
from indicatrix.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def one_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) != len(b) + 1:
        return False
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(counts, ratio=5):
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(counts, 2):
        if abs(len(a) - len(b)) < 2 and one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda w: (-counts[w], w), default=None)
        if best is not None and counts[best] >= ratio * n:
            form[word] = best
    out = []
    for word, n in counts.items():
        root = word
        while root in form:
            root = form[root]
        out.append((word, form.get(word), root, n, len(near[word]), counts[form[word]] if word in form else None))
    return sorted(out)


def found(spark, counts, **more):
    rows = spark.createDataFrame([(w, n) for w, n in counts.items()], "w string, n long").repartition(4)
    rows = rows.selectExpr("w AS word", "explode(sequence(1, n)) AS i")
    return sorted(tuple(r) for r in spelling.variants(rows, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())


def vocabulary(draw, bases, letters):
    out = {}
    for _ in range(bases):
        word, n = "".join(draw.choices(letters, k=draw.randint(6, 12))), draw.choice((5, 30, 700))
        for _ in range(draw.randint(1, 6)):
            out[word] = max(5, n)
            at, n = draw.randrange(len(word)), n // draw.choice((1, 4, 5, 6))
            word = word[:at] + "".join(draw.choices(letters, k=draw.randint(0, 2))) + word[at + 1 :]
    return {w: n for w, n in out.items() if len(w) >= 6}


@pytest.mark.parametrize("size", [16 << 20, 2048])
def test_random_vocabulary(spark, monkeypatch, size):
    """Also with filters cut into slices."""
    monkeypatch.setattr(spelling, "FILTER_BYTES", size)
    draw = random.Random(21)
    counts = vocabulary(draw, 150, "abcdé") | vocabulary(draw, 40, "ab") | {"abcdef": 9, "abcdeg": 9}
    want = brute(counts)
    assert found(spark, counts) == want
    assert any(w[2] != (w[1] or w[0]) for w in want)  # some forms lead on


def test_edits_reach_every_neighbour():
    """Whatever the filters say, each pair of near words is an edit of one of the two."""
    draw = random.Random(22)
    names = sorted(vocabulary(draw, 120, "abc"))
    letters, sizes = spelling.letters_of(spelling.pa.array(names))
    rows = [spelling.letters_of(spelling.pa.array([w])) for w in names]
    keys = {}
    for name, (own, size) in zip(names, rows):
        sums = spelling.terms(own, np.arange(len(own))).sum(dtype=np.uint64)
        keys[int(spelling.key(np.array([sums]), size)[0])] = name
    made = set()
    for owner, key, size, _ in spelling.edits(letters, sizes, np.unique(letters)):
        for o, k, s in zip(owner.tolist(), key.tolist(), size.tolist()):
            if k in keys and len(keys[k]) == s:
                made.add(frozenset((names[o], keys[k])))
    assert made == {frozenset(p) for p in itertools.combinations(names, 2) if one_edit(*p)}


def test_odd_rows(spark):
    long = "x" * 60_000
    counts = {long: 40, long[:-1] + "y": 5, long + "x": 6, "aaaaaa": 5, "aaaaaaa": 30, "bbbbbb": 4, "short": 100, "日本語日本語": 5, "日本語日本人": 25}
    kept = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    assert found(spark, counts) == brute(kept)
    schema = "word string, key string, n int"
    rows = spark.createDataFrame([("abcdef", "a", 1)] * 5 + [(None, "a", 1)] * 9 + [("", "a", 1)] * 9, schema)
    assert [tuple(r) for r in spelling.variants(rows).collect()] == [("abcdef", None, "abcdef", 5, 0, None)]
    assert spelling.variants(rows.where("false")).count() == 0
    with pytest.raises(ValueError):
        spelling.variants(rows, ratio=1)


def test_ties(spark):
    """Of equally frequent near words the first counts; exactly five times as often is enough."""
    counts = {"abcdef": 5, "abcdeg": 25, "abcdea": 25, "zzzzzz": 5, "zzzzzy": 24}
    assert found(spark, counts) == brute(counts)
    got = {r[0]: r[1] for r in found(spark, counts)}
    assert got["abcdef"] == "abcdea" and got["zzzzzz"] is None


def planted(doc_id, text):
    lower = {i: i + 32 for i in range(65, 91)}
    for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
        run = run.translate(lower)
        h = zlib.crc32(f"{doc_id}:{run}".encode())
        if h % 199 == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        yield run


def test_query(spark):
    """The registered query against plain Python over the whole table."""
    counts = collections.Counter()
    for row in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        counts.update(planted(row.doc_id, row.text))
    want = brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    rows = QUERIES["op12_spelling_variants"](spark, FOLDER).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in rows) == want != []


def test_query_on_odd_documents(spark, tmp_path):
    rows = [(i, "Überall ÜBERALL überall caféteria mañana×÷ " * 5) for i in range(300)] + [(None, "Überall " * 9), (300, None), (301, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = collections.Counter()
    for doc_id, text in rows:
        counts.update(planted(doc_id, text) if doc_id is not None else re.findall("[^ ]+", text))
    counts["Überall"], counts["überall"] = counts.pop("Überall", 0), counts["überall"]
    want = brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = QUERIES["op12_spelling_variants"](spark, str(tmp_path)).collect()
    assert sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got) == want
