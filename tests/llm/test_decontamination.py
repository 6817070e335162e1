"""Item-sized windows against brute force over all windows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from indicatrix.llm import decontamination
from indicatrix.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def split(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", lowered)


def shingles(parts):
    return Counter(tuple(parts[i : i + 5]) for i in range(len(parts) - 4))


def brute(docs, items):
    """(doc_id, item_id) -> (similarity, start) of the best window."""
    out = {}
    for item_id, text in items:
        parts = split(text)
        want = shingles(parts)
        if not want:
            continue
        for doc_id, body in docs:
            body = split(body)
            if not want.keys() & shingles(body).keys():
                continue
            for start in range(len(body) - len(parts) + 1):
                have = shingles(body[start : start + len(parts)])
                score = (want & have).total() / (want | have).total()
                if score >= 0.8 and score > out.get((doc_id, item_id), (0, 0))[0]:
                    out[doc_id, item_id] = (score, start)
    return out


def found(spark, docs, items):
    left = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    right = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.similarity, r.start) for r in decontamination.contaminated(left, right).collect()}


def test_edited_passages(spark):
    draw = random.Random(2)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(draw.choices(vocabulary, k=draw.randint(5, 60)))) for i in range(40)]
    items += [(100, "la " * 30), (101, "too short text"), (102, None), (103, items[0][1])]
    docs = [(0, None), (1, ""), (2, "la " * 200), (3, items[0][1].upper() + "!"), (4, items[1][1] + " " + items[1][1])]
    for i in range(300):
        parts = items[draw.randrange(40)][1].split()
        for _ in range(draw.choice((0, 0, 1, 1, 2))):
            parts[draw.randrange(len(parts)) if draw.random() < 0.4 else draw.choice((0, -1, 1, -2))] = draw.choice(vocabulary)
        around = [draw.choices(vocabulary, k=draw.randint(0, 40)) for _ in range(2)]
        docs.append((10 + i, " ".join(around[0] + [p.title() + draw.choice(("", ",", "***")) for p in parts] + around[1])))
    want = brute(docs, items)
    assert len(want) > 200
    assert found(spark, docs, items) == want


def brute_shorter(docs, items):
    """(doc_id, item_id) -> (similarity, 0) of the texts with fewer words than an item, as a whole."""
    out = {}
    for item_id, text in items:
        want = shingles(split(text))
        for doc_id, body in docs:
            have = shingles(split(body))
            if have and len(split(body)) < len(split(text)) and (want & have).total() >= 0.8 * (want | have).total():
                out[doc_id, item_id] = ((want & have).total() / (want | have).total(), 0)
    return out


def test_texts_shorter_than_an_item(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(size))) for i, size in enumerate((5, 6, 9, 10, 14, 30, 60))]
    items.append((50, items[5][1] + " and more"))
    docs = [(0, None), (1, "one"), (2, "one two three four five")]
    for i, text in items:
        parts = text.split()
        for gone in range(1, len(parts) // 4 + 2):
            docs += [(1000 * i + 10 * gone + 3, " ".join(parts[gone:])), (1000 * i + 10 * gone + 4, " ".join(parts[:-gone]))]
            docs.append((1000 * i + 10 * gone + 5, " ".join(parts[gone:-1] + ["other"])))
    shorter = brute_shorter(docs, items)
    assert {score for score, _ in shorter.values()} >= {0.8} and len(shorter) > 20
    assert found(spark, docs, items) == brute(docs, items) | shorter


def test_repeated_tails(spark):
    """Where the differing part repeats one shingle, at a similarity of exactly 0.8."""
    items, docs = [], []
    for i in range(60):
        span = (36, 54, 90)[i % 3]
        parts = [f"w{i}x{k}" for k in range(span + 4)]
        items.append((i, " ".join(parts)))
        docs.append((i, " ".join(parts[: -(span // 9)] + ["la"] * (span // 9))))
    want = brute(docs, items)
    assert want == {(i, i): (0.8, 0) for i in range(60)}
    assert found(spark, docs, items) == want


def test_occurrences_have_bits_of_their_own():
    """Weighted similarity 0.8 stays within the radius however often the differing shingles occur."""
    draw = np.random.default_rng(8)
    far = 0
    for _ in range(2000):
        same, own = draw.integers(0, 2**64, 80, np.uint64), draw.integers(0, 2**64, 10, np.uint64)
        other = np.repeat(draw.integers(0, 2**64, 1, np.uint64), 10)
        left, right = (decontamination.fingerprint(np.sort(np.concatenate([same, part]))) for part in (own, other))
        far += ((left ^ right) % 2**64).bit_count() > decontamination.RADIUS
    assert far <= 4


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    got = {(r.doc_id, r.item_id): (r.similarity, r.start) for r in QUERIES["op7_decontamination"](spark, FOLDER).collect()}
    assert got == brute(docs, items) and got


def test_fingerprints_within_the_radius_share_a_block(spark):
    draw = np.random.default_rng(5)
    base = int(draw.integers(-(2**63), 2**63))
    rows = [(0, base)]
    for i in range(1, 60):
        flips = draw.choice(64, decontamination.RADIUS, replace=False)
        mask = int(sum(1 << int(f) for f in flips))
        rows.append((i, (base ^ mask if mask < 2**63 else base ^ (mask - 2**64))))
    cut = decontamination.blocks(spark.createDataFrame(rows, "id long, print long"))
    other = cut.where("id = 0").select("block", "bits")
    assert cut.join(other, ["block", "bits"]).select("id").distinct().count() == 60


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(None, text, "x", 1), (1, text, None, 1), (1, text, None, 1), (2, "z " * 50_000 + text, None, 1)], "doc_id long, text string, item_id string, size int")
    items = spark.createDataFrame([(7, text, "y")], "item_id long, text string, doc_id string")
    rows = decontamination.contaminated(docs, items).collect()
    assert sorted((str(r.doc_id), r.item_id, r.similarity, r.start) for r in rows) == [("1", 7, 1.0, 0), ("1", 7, 1.0, 0), ("2", 7, 1.0, 50_000), ("None", 7, 1.0, 0)]
    assert decontamination.contaminated(docs.where("false"), items).count() == 0
    assert decontamination.contaminated(docs, items.where("false")).count() == 0
    with pytest.raises(ValueError):
        decontamination.contaminated(docs, items, threshold=0.5)
