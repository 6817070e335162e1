"""Personal data: base spans against Python's regular expressions, and what the patterns add."""

import hashlib
import random
import re

from indicatrix.llm import personal_data
from indicatrix.llm.common import Scratch
from indicatrix.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(m):
    return re.sub("[^0-9]", "", m)


PLAIN = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 9 <= len(digits(m)) <= 15),
}


def plain(text):
    spans = [(m.start(), rank, f"{kind}:{m.start()}:{m.end()}") for rank, (kind, (pattern, good)) in enumerate(PLAIN.items()) for m in pattern.finditer(text or "") if good(m[0])]
    kinds = [s[2].split(":")[0] for s in spans]
    line = ",".join(s[2] for s in sorted(spans))
    return (*(kinds.count(k) for k in PLAIN), hashlib.sha256(line.encode()).hexdigest()), line


PIECES = ["a", "ab.c", "@", "x.org", ".", "-", "_", "%", " ", "+", "1", "25", "255", "256", "0300", "192.168.0.1", "4111111111111111", "4111 1111 1111 1111", "(", ")", "555", "é", "😀", "\u0001", "\n", "٣", "b@c.d", "+1 (555) 010-9999"]


def same(rows, texts):
    for r in rows:
        want, line = plain(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) == want, (texts[r.doc_id] or "")[:300]
        assert set(line.split(",")) - {""} <= set(r.spans.split(","))


def test_random_texts(spark):
    draw = random.Random(11)
    texts = ["".join(draw.choices(PIECES, k=draw.randint(0, 22))) for _ in range(2500)]
    texts += [None, "", "a" * 8_000, "1." * 60_000, "a@b." * 30_000, "1 " * 60_000, "+1" * 50_000, "1.1.1.1 " * 5_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    rows = personal_data.personal_data(docs).collect()
    assert len(rows) == len(texts)
    same(rows, texts)


def test_a_long_run_takes_one_pass(spark):
    """A run that the plain pattern would try from each of its characters."""
    docs = spark.createDataFrame([(1, "a" * 2_000_000 + " a@b.cc")], "doc_id long, text string")
    assert personal_data.personal_data(docs).first().spans == "email:2000001:2000007"


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    rows = QUERIES["op1_personal_data"](spark, FOLDER).collect()
    assert len(rows) == len(texts) and min(sum(getattr(r, f"n_{k}") for r in rows) for k in ("email", "card", "phone")) > 0
    same(rows, texts)


def test_patterns_find_unseen_identifiers(spark):
    texts = [f"please call me +1 555 010 {1000 + i} soon" for i in range(8)]
    texts += ["please call me 555-0109-77 soon", "it cost us 555-0109-88 soon", "please call me 20 times", "mail goes to joe (at) site.org now"]
    texts += [f"mail goes to user{i}@site.org now" for i in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.n_added) for r in personal_data.personal_data(docs).collect()}
    assert got[8] == ("phone:15:26", 1) and got[9] == ("", 0) and got[10] == ("", 0)
    assert got[11] == ("email:13:30", 1)


def test_look_alikes_are_whole(spark):
    texts = [f"please call me +1 555 010 {1000 + i} soon" for i in range(60)]
    texts += [f"mail goes to user{i}@site.org now" for i in range(5)]
    numbers = {
        "4111 - 1111 - 1111 - 1111": "4111 - 1111 - 1111 - 1111",
        "0049 (0) 30 / 1234 - 5678 - 90": "0049 (0) 30 / 1234 - 5678 - 90",
        "(030)      123      45      67": "(030)      123      45      67",
        "555-0109-77 4111111111111": "555-0109-77",
        "4111 1111 1111 1112 2nd": "4111 1111 1111 1112",
        "4111 - 1111 - 1111 - 1111 - 1111": "",
        "12345678901234567890": "",
        "1-" * 19 + "1": "",
        "555-0109-77a": "",
        "555-0109-77@x": "",
    }
    first = len(texts)
    texts += [f"please call me {n} soon" for n in numbers]
    local = "l" * 65
    texts += [f"mail goes to {local} (at) site.org now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in personal_data.personal_data(docs).collect()}
    for i, found in enumerate(numbers.values()):
        assert got[first + i] == (f"phone:15:{15 + len(found)}" if found else ""), texts[first + i]
    assert got[len(texts) - 1] == f"email:13:{13 + len(local) + len(' (at) site.org')}"


def test_look_alikes_in_long_runs_take_one_pass(spark):
    texts = ["(" * 200_000, "1" + "-1" * 200_000 + "a", "1 " * 200_000 + "1a", "1" + " " * 200_000 + "a", "a" * 200_000 + " (at) "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_added for r in personal_data.personal_data(docs).collect()] == [0] * len(texts)


def rounds(edges):
    """(pattern, kind) -> score, by plain loops."""
    instances, kinds, like = {}, {}, {}
    for pattern, instance, kind in edges:
        instances.setdefault(pattern, set()).add(instance)
        if kind:
            kinds.setdefault(instance, set()).add(kind)
    for pattern, instance, kind in edges:
        if not kind and instance not in kinds:
            like.setdefault(instance, set()).add(pattern)
    good = {(i, k): 1.0 for i, ks in kinds.items() for k in ks}
    before = None
    while True:
        scores = {}
        for pattern, held in instances.items():
            for kind in personal_data.KINDS:
                weight = sum(good.get((i, kind), 0.0) for i in held)
                if weight >= personal_data.MIN_SEEDS and weight / (len(held) + 1) >= personal_data.CONFIDENT:
                    scores[pattern, kind] = weight / (len(held) + 1)
        if not scores or before and scores.keys() == before.keys() and all(abs(scores[k] - before[k]) < 1e-9 for k in scores):
            return scores
        before = scores
        for instance, patterns in like.items():
            for kind in personal_data.KINDS:
                wrong = 1.0
                for pattern in patterns:
                    wrong *= 1 - scores.get((pattern, kind), 0.0)
                if wrong < 1:
                    good[instance, kind] = 1 - wrong


def test_scores_against_plain_rounds(spark):
    """Patterns that only become confident by what others reached, over random graphs."""
    draw = random.Random(51)
    edges = set()
    for p in range(60):
        kind = draw.choice(personal_data.KINDS)
        for _ in range(draw.randint(1, 8)):
            edges.add((f"p{p}", f"{kind}{draw.randrange(25)}", kind))
        for _ in range(draw.randint(0, 3)):
            edges.add((f"p{p}", f"like{draw.randrange(40)}", None))
    chain = [("a", f"s{i}", "phone") for i in range(9)] + [("a", "x1", None)] + [("b", f"t{i}", "phone") for i in range(3)] + [("b", "x1", None), ("b", "x2", None)]
    edges |= set(chain)
    rows = spark.createDataFrame(sorted(edges, key=str), "pattern string, instance string, kind string").repartition(4)
    with Scratch(spark) as scratch:
        got = {(r.pattern, r.kind): r.score for r in personal_data.confident_patterns(rows, scratch).collect()}
    want = rounds(sorted(edges, key=str))
    assert got.keys() == want.keys() and len(want) > 10
    assert all(abs(got[k] - want[k]) < 1e-5 for k in want)


def test_contexts_are_whole_words(spark):
    """Long words with equal ends are different patterns."""
    ends = "x" * 100
    texts = [f"{c}{ends} me +1 555 010 {1000 + i}" for i, c in enumerate("abcdefgh")] + [f"z{ends} me 555-0109-77"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.n_added for r in personal_data.personal_data(docs).collect()}[8] == 0


def test_few_seeds_say_nothing(spark):
    texts = ["ring the number +1 555 010 1000", "ring the number 555-0109-77", "ring the number 555-0109-78"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.n_added for r in personal_data.personal_data(docs).collect()] == [0, 0, 0]


def test_odd_rows(spark):
    schema = "doc_id long, text string, row string, base int"
    docs = spark.createDataFrame([(None, "a@b.cc", "x", 1), (1, None, "y", 2), (2, "ip 1.2.3.4", "y", 2), (2, "ip 1.2.3.4", "y", 2)], schema)
    rows = personal_data.personal_data(docs).collect()
    assert sorted((str(r.doc_id), r.spans) for r in rows) == [("1", ""), ("2", "ip:3:10"), ("2", "ip:3:10"), ("None", "email:0:6")]
    assert personal_data.personal_data(docs.where("false")).count() == 0
