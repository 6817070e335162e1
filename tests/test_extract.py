"""Extraction: single cases, then whole results against the restated rules."""

import random

import pytest
from pyspark.sql import functions as F

from indicatrix.functions.constants import ALL_TYPES, LIST_KEY
from indicatrix.operators.extract import extract_custom, extract_indicators, extract_wide, indicator_set, resolve_types
from tests import restated

SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
MD5 = "d41d8cd98f00b204e9800998ecf8427e"

# text, type, values
CASES = [
    ("gelen trafik 8.8.8.8 adresinden", "ipv4", ["8.8.8.8"]),
    ("not an address 999.999.999.999 at all", "ipv4", []),
    ("just beyond 256.1.1.1", "ipv4", []),
    ("256.1.1.1.1 and 08.8.8.8", "ipv4", []),
    ("resolvers (1.1.1.1; 8.8.8.8; 9.9.9.9)", "ipv4", ["1.1.1.1", "8.8.8.8", "9.9.9.9"]),
    ("gateway=192.168.1.1", "ipv4", ["192.168.1.1"]),
    ("1.2.3.4.5.6.7.8", "ipv4", ["1.2.3.4", "5.6.7.8"]),
    ("é8.8.8.8 ²9.9.9.9", "ipv4", []),
    ("beacon to 8[.]8[.]8[.]8 seen", "ipv4", ["8.8.8.8"]),
    ("from 2001:0db8:85a3:0000:0000:8a2e:0370:7334 port 53", "ipv6", ["2001:0db8:85a3:0000:0000:8a2e:0370:7334"]),
    ("2001:db8::1", "ipv6", ["2001:db8::"]),
    ("resolves evil.com twice", "domain", ["evil.com"]),
    ("polls c2.malware.example.org hourly", "domain", ["c2.malware.example.org"]),
    ("ekte malware_payload.exe vardı", "domain", []),
    ("tested on Python.3 builds", "domain", []),
    ("see example.com", "domain", []),
    ("www.example.com", "domain", ["www.example.com"]),
    ("evil.com.1.2 evil.co-op.1x", "domain", ["evil.com", "evil.co"]),
    ("john.me@evil.com", "domain", ["john.me", "evil.com"]),
    ("a" * 70 + "-bbb.com", "domain", ["bbb.com"]),
    ("1.2.com 1-2.co.uk", "domain", ["1-2.co.uk"]),
    ("http://user:pw@Host.Evil.CO.UK:80/x", "domain", ["Host.Evil.CO.UK", "host.evil.co.uk"]),
    ("http://evil[.com/ http://[::1]/", "domain", []),
    ("http://a_b.com/ http://évil.com/", "domain", ["a_b.com", "évil.com"]),
    ("fetched http://evil.com/malware.exe today", "url", ["http://evil.com/malware.exe"]),
    ("posts to https://c2server.com/beacon", "url", ["https://c2server.com/beacon"]),
    ("dropper at hxxp://evil[.]com/payload.exe", "url", ["http://evil.com/payload.exe"]),
    ("hxxps://evil[.]com/payload", "url", ["https://evil.com/payload"]),
    ("hxxp[://]x.com", "url", ["hxxp://x.com"]),
    ("http://a.com/ b ftp://f.com/x).", "url", ["http://a.com/", "ftp://f.com/x)."]),
    ("sent by attacker@evil.com", "email", ["attacker@evil.com"]),
    ("reply-to attacker[@]evil[.]com", "email", ["attacker@evil.com"]),
    ("attacker[AT]evil[dot]com", "email", ["attacker@evil.com"]),
    ("a[@]mail[.]evil[.]com", "email", ["a@mail.evil"]),
    ("a@b.com.x@y.com", "email", ["a@b.com", ".x@y.com"]),
    ("éab.c@x.com ..foo@x.org", "email", [".c@x.com", "foo@x.org"]),
    ("patched CVE-2024-12345 late", "cve", ["CVE-2024-12345"]),
    ("cve-2023-9999", "cve", ["cve-2023-9999"]),
    ("CVE-2024-123 xCVE-2024-1234 CVE-2024-12345678", "cve", []),
    ("maps to T1071.001", "mitre", ["T1071.001"]),
    ("model t1000", "mitre", []),
    ("uses S0001 and T1059.0012", "mitre", ["S0001", "T1059"]),
    (f"digest {MD5.upper()}", "hash_md5", [MD5]),
    (f"sample {SHA256} was new", "hash_sha256", [SHA256]),
    (f"sample {SHA256} was new", "hash_md5", []),
    (f"x{MD5}z {MD5}a", "hash_md5", [MD5]),
    (SHA256 + SHA256, "hash_sha512", [SHA256 + SHA256]),
    ("", "ipv4", []),
    ("nothing to report this week", "url", []),
]


def by_type(rows):
    """(doc_id, type) -> values in list order."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.type, r.derived, r.pos)):
        out.setdefault((r.doc_id, r.type), []).append(r.value)
    return out


@pytest.fixture(scope="module")
def case_results(docs):
    return by_type(extract_indicators(docs(*[c[0] for c in CASES])).collect())


@pytest.mark.parametrize("i", range(len(CASES)), ids=[f"{c[1]}-{c[0][:25]}" for c in CASES])
def test_case(case_results, i):
    _, type_, values = CASES[i]
    assert case_results.get((i, type_), []) == values


def test_cases_agree_with_restated_rules():
    for text, type_, values in CASES:
        assert restated.extract(text)[type_] == values, text


SAMPLE = """Night shift, sensor 4
10:02 outbound to 203.0.113.9 and 198.51.100.77, then 2001:0db8:85a3:0000:0000:8a2e:0370:7334
10:05 lookups for shop.evil.com and cdn.bad-host.net
10:06 GET http://evil.com/a/b.bin, POST https://c2.bad-host.net/in?k=1
10:07 mail from boss@evil.com, later boss[@]evil[.]com and boss[at]evil[dot]com
10:11 stage two da39a3ee5e6b4b0d3255bfef95601890afd80709 abuses CVE-2023-9999 (T1059, T1071.001, S0001)
10:12 analyst writes 203[.]0[.]113[.]9, evil(.)com and hxxp://evil[.]com/a/b.bin
10:15 build 1.2.3.4 of agent.exe wrote notes.txt; 300.300.300.300 is no address
"""


def test_sample_document(docs):
    got = by_type(extract_indicators(docs(SAMPLE)).collect())
    want = restated.extract(SAMPLE)
    assert {t: got.get((0, t), []) for t in ALL_TYPES} == want


def test_lines_and_whole_text_give_the_same(docs):
    lines = by_type(extract_indicators(docs(*SAMPLE.split("\n"))).collect())
    whole = by_type(extract_indicators(docs(SAMPLE)).collect())
    for type_ in ALL_TYPES:
        joined = [v for (_, t), values in sorted(lines.items()) if t == type_ for v in values]
        assert sorted(joined) == sorted(whole.get((0, type_), []))


PIECES = [
    "evil", "com", ".", ".", "@", "[.]", "(.)", "[@]", "[at]", "[dot]", "(dot)", "://", "http", "hxxps", "HXXP", "ftp",
    " ", "\n", ":", "::", "-", "_", "é", "ı", "ſ", "K", "²", "9", "8.8.8.8", "256", "fe80", "co.uk", "T1059", "S0", "CVE-2024-",
    "1234", "/", "?", "#", "%41", "<", '"', "[", "]", "x", "a" * 33, "abc123" * 5, MD5, MD5[:8], "́", " ", "+", "٣", "exe",
]


def test_random_texts_match_restated_rules(docs):
    rng = random.Random(7)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    # A combining mark in front of an indicator is a documented difference.
    texts = [t.replace("́", "") if i % 2 else t.replace("́", " ") for i, t in enumerate(texts)]
    for do_refang in (True, False):
        got = by_type(extract_indicators(docs(*texts), do_refang=do_refang).collect())
        for i, text in enumerate(texts):
            want = restated.extract(text, do_refang)
            assert {t: got.get((i, t), []) for t in ALL_TYPES} == want, repr(text)


def test_hostile_texts_finish(docs):
    """Long runs neither overflow the matcher's stack nor take quadratic time."""
    texts = ["1.1." * 250_000, "a.a@" * 250_000, "%20%3D" * 170_000 + "@", "x-" * 500_000 + ".com", "a:" * 500_000,
             "a@" + "a." * 500_000, "http://" + "a.b-" * 250_000]
    types = [t for t in ALL_TYPES if not t.startswith("hash")]
    rows = extract_indicators(docs(*texts), types).groupBy("doc_id", "type").count().collect()
    assert {(r.doc_id, r.type): r["count"] for r in rows}[(0, "ipv4")] == 125_000
    indicator_set(docs(*texts), "url").count()


def test_only_wanted_types_enter_the_plan(docs):
    plan = extract_indicators(docs("x"), ["cve"])._jdf.queryExecution().optimizedPlan().toString()
    assert "CVE" in plan and plan.count("regexp_extract_all") == 1
    assert "Python" not in plan


def test_refang_runs_once(docs):
    plan = extract_indicators(docs("x"), ["cve", "mitre", "url"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("hxxps?") + plan.count("[hH][xX][xX][pP][sS\\x{17f}]?") == 1 + 1  # the URL pattern and one refang


def test_resolve_types():
    assert resolve_types("ip,hash") == ["ipv4", "ipv6", "hash_md5", "hash_sha1", "hash_sha256", "hash_sha512"]
    assert resolve_types(" SHA1 ,nonsense") == ["hash_sha1"]
    assert resolve_types("") == []


def test_no_types_gives_no_rows(docs):
    assert extract_indicators(docs(SAMPLE), []).count() == 0


def test_wide(docs):
    row = extract_wide(docs("8.8.8.8 and 8.8.8.8 at http://evil.com/", "nothing")).orderBy("doc_id").collect()
    assert row[0].ipv4 == ["8.8.8.8"] and row[0].domains == ["evil.com"] and row[0].extracted_at
    assert all(row[1][LIST_KEY[t]] == [] for t in ALL_TYPES)
    repeated = extract_wide(docs("8.8.8.8 and 8.8.8.8"), unique=False, types=["ipv4"]).collect()[0]
    assert repeated.ipv4 == ["8.8.8.8"] * 2 and repeated.urls == []


def test_sets(docs):
    texts = docs("CVE-2024-1234 cve-2024-1234 Evil.COM evil.com 1.2.com a[at]b.com HTTP://x.com http://x.com:80/p " + MD5)
    assert {r.value for r in indicator_set(texts, "cve").collect()} == {"CVE-2024-1234"}
    assert {r.value for r in indicator_set(texts, "domain").collect()} == {"evil.com", "1.2.com", "b.com", "x.com"}
    assert {r.value for r in indicator_set(texts, "url").collect()} == {"http://x.com:80/p"}
    assert {r.value for r in indicator_set(texts, "email").collect()} == {"a[at]b.com"}
    assert {(r.type, r.value) for r in indicator_set(texts, "hash").collect()} == {("hash_md5", MD5)}


def test_custom_types(docs):
    spec = {"type": "asn", "pattern": r"\bAS\d+\b", "validator": "length(value) > 3", "normaliser": "lower(value)"}
    rows = extract_custom(docs("AS1 AS12345"), [spec]).collect()
    assert [(r.type, r.value) for r in rows] == [("asn", "as12345")]


def test_extra_columns_pass_through(docs):
    rows = extract_indicators(docs("8.8.8.8").withColumn("ts", F.lit("now"))).collect()
    assert rows[0].ts == "now"
