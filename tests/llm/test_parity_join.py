"""The parity join against brute force over all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

from indicatrix.llm import parity_join, words
from indicatrix.llm.parity_join import CROWD


def shingle_set(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    parts = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if len(parts) < 5:
        return {tuple(parts)} if parts else set()
    return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)}


def brute(rows):
    """(doc_id, size, component) by comparing all pairs."""
    sets = [shingle_set(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j]:
            shared = len(sets[i] & sets[j])
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def joined(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return sorted(tuple(r) for r in parity_join.parity_join(docs).collect())


def edited(draw, parts, edits):
    parts = list(parts)
    for _ in range(edits):
        at = draw.randrange(len(parts))
        parts[at : at + draw.choice((0, 1, 1))] = [f"w{draw.random()}"] * draw.choice((0, 1, 1))
    return parts


def corpus(draw, groups, members, passage=(), size=(5, 120)):
    rows, ids = [], iter(draw.sample(range(10**6), 10**5))
    for _ in range(groups):
        base = [f"v{draw.randrange(10**6)}" for _ in range(draw.randint(*size))]
        for _ in range(draw.randint(1, members)):
            text = edited(draw, base, draw.choice((0, 0, 1, 2, 3, 5)) * len(base) // 60)
            at = draw.randrange(len(text) + 1)
            rows.append((next(ids), " ".join(text[:at] + list(passage) + text[at:])))
    return rows


def test_edited_copies(spark):
    draw = random.Random(3)
    rows = corpus(draw, 60, 6) + corpus(draw, 8, 4, size=(300, 900))
    assert joined(spark, rows) == brute(rows)


def test_common_passage_and_large_groups(spark):
    draw = random.Random(4)
    passage = [f"law{i}" for i in range(60)]
    rows = corpus(draw, 150, 3, passage, (8, 60)) + corpus(draw, 2, 3 * CROWD, size=(60, 90)) + corpus(draw, 1, 1, size=(40, 40))
    rows += [(2 * 10**6 + i, " ".join(edited(draw, passage, i % 7))) for i in range(2 * CROWD)]
    assert joined(spark, rows) == brute(rows)


def test_short_texts(spark):
    draw = random.Random(5)
    rows = [(i, " ".join(draw.choices("abc", k=draw.randint(0, 9)))) for i in range(250)]
    assert joined(spark, rows) == brute(rows)


def test_odd_rows(spark):
    long_text = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B "), (5, "a B "), (6, "Ä b"), (7, "ä b"), (8, long_text), (9, long_text + " end"), (10, "x" * 300_000)]
    docs = spark.createDataFrame([(d, t, "z", "q") for d, t in rows], "doc_id long, text string, class string, key string")
    got = sorted(tuple(r) for r in parity_join.parity_join(docs).collect())
    assert got == brute(rows)
    assert parity_join.parity_join(docs.where("false")).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), (3, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(map(str, parity_join.parity_join(nulls).collect())) == sorted(
        ["Row(doc_id=None, n_shingles=1, component_id=3)", "Row(doc_id=3, n_shingles=1, component_id=3)", "Row(doc_id=None, n_shingles=1, component_id=None)"]
    )


def test_bands_hold_all_partners():
    sizes = np.arange(1, 20_000)
    largest = sizes * 5 // 4
    assert (parity_join.band_of(largest) - parity_join.band_of(sizes) <= 1).all()
    assert (2 * largest // 9 >= 0).all()
    band = parity_join.band_of(largest)
    assert ((sizes + largest) // 9 <= parity_join.most_different(band)).all()


def test_sketch_distance_is_a_lower_bound():
    draw = np.random.default_rng(1)
    for size in (3, 300, 300, 2000):
        a = np.unique(draw.integers(0, 2**64, size, np.uint64))
        for share in (1, 2, 3, 10):
            b = np.unique(np.concatenate([a[: size // share], draw.integers(0, 2**64, 40, np.uint64)]))
            x, y = parity_join.dense_sketch(a), parity_join.dense_sketch(b)
            assert parity_join.distance(x, y) == parity_join.distance(y, x) <= len(np.setxor1d(a, b))
            assert parity_join.distance(x, x) == 0


@pytest.mark.parametrize("block", [8, 1 << 18])
def test_word_hashes(monkeypatch, block):
    monkeypatch.setattr(words, "BLOCK", block)
    import pyarrow as pa

    texts = ["The quick", None, "", "quick THE", "  the\tquick\n", "ß ẞ É é", "x" * 100 + " the"]
    (_, _, data, offsets), = words.chunks(pa.array(texts))
    hashes, counts = words.words(data, offsets)
    assert counts.tolist() == [2, 0, 0, 2, 2, 4, 2]
    h = hashes.tolist()
    assert h[0] == h[3] == h[4] == h[11] and h[1] == h[2] == h[5] and len(set(h[6:10])) == 4
