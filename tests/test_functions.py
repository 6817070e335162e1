"""Normalisation and validation."""

import ipaddress
import random

import pytest

from indicatrix.functions import sqlfuncs
from indicatrix.functions import validate as V
from indicatrix.functions import normalize
from indicatrix.functions.normalize import defang, lookup, refang, strip
from tests import restated


def evaluate(spark, values, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.out for r in rows.selectExpr("i", f"{expression} AS out").orderBy("i").collect()]


REFANG = {
    "hxxp://evil.com": "http://evil.com",
    "hxxps://evil.com": "https://evil.com",
    "HXXPS://evil.com": "https://evil.com",
    "evil[.]com": "evil.com",
    "evil(.)com": "evil.com",
    "evil{.}com": "evil.com",
    "user[@]evil.com": "user@evil.com",
    "user[at]evil.com": "user@evil.com",
    "user(AT)evil.com": "user@evil.com",
    "evil[dot]com": "evil.com",
    "evil(Dot)com": "evil.com",
    "hxxps://evil[.]com/path": "https://evil.com/path",
    "attacker[@]evil[.]com": "attacker@evil.com",
    "https://example.com": "https://example.com",
    "hxxp[://]x": "hxxp://x",
    "([.])": ".",
    "[(.)]": "[.]",
    "": "",
}


def test_refang(spark):
    assert evaluate(spark, REFANG, refang("v")) == list(REFANG.values())


def test_refang_random(spark):
    rng = random.Random(3)
    marks = ["[", "]", "(", ")", "{", "}", ".", "@", "at", "DOT", "dot", "://", "hxxp", "hxxpſ", "S", "a", " "]
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    assert evaluate(spark, texts, refang("v")) == [restated.refang(t) for t in texts]


DEFANG = {
    "http://evil.com/a.b@c": "hxxp://evil[.]com/a[.]b[@]c",
    "https://evil.com": "hxxps://evil[.]com",
    "ftp://evil.com": "fxp://evil[.]com",
    "192.168.1.1": "192[.]168[.]1[.]1",
    "user@evil.com": "user[@]evil[.]com",
    "a.b://c.d://e.f": "a.b://c[.]d://e[.]f",
    "HTTP://x.y": "HTTP://x[.]y",
}


def test_defang(spark):
    assert evaluate(spark, DEFANG, defang("v")) == list(DEFANG.values())


@pytest.mark.parametrize("value", ["8.8.8.8", "evil.com", "a@b.org", "http://evil.com/x"])
def test_round_trip(spark, value):
    safe = evaluate(spark, [value], defang("v"))[0]
    assert safe != value and evaluate(spark, [safe], refang("v")) == [value]


def test_strip(spark):
    values = ["  a ", "\t\x1c\u00a0b\u3000", "c", ""]
    assert evaluate(spark, values, strip("v")) == [v.strip() for v in values]


def test_lookup(spark):
    assert evaluate(spark, ["a", "z"], lookup("v", {"a": 1})) == [1, None]
    assert evaluate(spark, ["a", "z"], lookup("v", {"a": "it's"}, "no")) == ["it's", "no"]


def python_says(kind, value):
    try:
        kind(value)
        return True
    except ValueError:
        return False


IPS = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "999.1.1.1", "256.0.0.1", "abc.def", "01.2.3.4", "1.2.3.4\n", "", "1.2.3"]
IPV6S = ["2001:db8::1", "::1", "::", "not", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1::2::3", ":1:2:3:4:5:6:7", "fe80::1%eth0",
         "fe80::1%", "fe80::1%a%b", "fe80::1%a/b", "::ffff:1.2.3.4", "::ffff:1.2.3.400", "1:2:3:4:5:6:1.2.3.4", "12345::", "::1/64"]


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(5)
    parts = [":", "::", "1", "abcd", "12345", "g", ".", "1.2.3.4", "%", "eth0", "0", "ffff", "255", "256", "01"]
    values = IPS + IPV6S + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 16))) for _ in range(4000)]
    v4 = evaluate(spark, values, V.is_ipv4("v"))
    v6 = evaluate(spark, values, V.is_ipv6("v"))
    for i, value in enumerate(values):
        assert v4[i] == python_says(ipaddress.IPv4Address, value), repr(value)
        assert v6[i] == python_says(ipaddress.IPv6Address, value), repr(value)


def test_other_checks(spark):
    md5, sha = "d41d8cd98f00b204e9800998ecf8427e", "E3B0C44298FC1C149AFBF4C8996FB92427AE41E4649B934CA495991B7852B855"
    assert evaluate(spark, [md5, f" {sha}\n", md5 * 4, md5 + "00000000", "not-a-hash", "abc"], V.hash_type("v")) == [
        "md5", "sha256", "sha512", "sha1", None, None]
    assert evaluate(spark, ["CVE-2024-12345", "cve-2024-1234\n", "CVE-12345", " CVE-2024-1234"], V.is_cve("v")) == [
        True, True, False, False]
    assert evaluate(spark, ["evil.com", "", "noextension", "a.b", "a.c0m", "a.éé"], V.is_domain_name("v")) == [
        True, False, False, False, False, True]
    assert evaluate(spark, ["test@evil.com", "no-at-sign", "a@b.c", "a@b.com\n"], V.is_email("v")) == [True, False, False, True]
    assert evaluate(spark, ["http://x", "FTP://x", "hxxp://x", " http://x"], V.is_url("v")) == [True, True, False, False]


def test_indicator_domains(spark):
    values = ["evil.com", "Evil.CO.UK", "1.2.net", "1.co.uk", "x.exe", "localhost", "example.com", "www.example.com", "a.unknown", ".com", "-.com", "٣.com"]
    assert evaluate(spark, values, V.is_indicator_domain("v")) == [restated.accepted_domain(v) for v in values]


def test_sql_functions(spark):
    names = sqlfuncs.register(spark)
    assert {"refang", "defang", "ipv4_in", "domain_in"} <= set(names)
    row = spark.sql(
        "SELECT defang(url_host('http://Evil.com:80/x')) AS d, hash_type(md5('x')) AS h, is_ipv6('::1') AS v6, "
        "is_indicator_domain('a.exe') AS dom"
    ).collect()[0]
    assert (row.d, row.h, row.v6, row.dom) == ("evil[.]com", "md5", True, False)
    rows = spark.sql("SELECT m.* FROM (SELECT 'a 8.8.8.8 999.1.1.1 evil.com' AS t) d, LATERAL ipv4_in(d.t) m").collect()
    assert [(r.pos, r.value) for r in rows] == [(0, "8.8.8.8")]


def test_table_functions_do_not_join_texts(spark, docs):
    """behind LATERAL the matches are made where the text is; a WHERE in a function made it a join by the whole text."""
    sqlfuncs.register(spark)
    texts = docs("8.8.8.8 and 999.1.1.1, evil.com, a.exe", "8.8.8.8 and 999.1.1.1, evil.com, a.exe", "MD5 D41D8CD98F00B204E9800998ECF8427E", None)
    got = []
    for name in sqlfuncs.TABLE_FUNCTIONS:
        rows = spark.sql(f"SELECT d.doc_id, m.pos, m.value FROM {{docs}} d, LATERAL {name}(d.text) m", docs=texts)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan
        got += [(name, *r) for r in rows.collect()]
    twice = [(name, i, pos, value) for name, pos, value in (("ipv4_in", 0, "8.8.8.8"), ("domain_in", 0, "evil.com")) for i in (0, 1)]
    assert sorted(got) == sorted([*twice, ("hash_in", 2, 0, "d41d8cd98f00b204e9800998ecf8427e")])


def test_refang_in_fewer_passes(spark):
    """Nested and adjoining brackets give what the rules give one after another."""
    import itertools
    import random
    import re

    def one_after_another(text):
        for mark, live, is_regex in normalize.REFANG_RULES:
            text = re.sub(mark.replace(r"\x{17f}", "ſ"), live, text) if is_regex else text.replace(mark, live)
        return text

    draw = random.Random(61)
    marks = ["[", "]", "(", ")", "{", "}", ".", "@", "at", "DOT", "dot", "://", "hxxp", "hXXps", "hxxpſ", "a"]
    texts = ["".join(t) for t in itertools.product("[({", "[({.", "[(.", ".])", "])}", "])}")]
    texts += ["".join(draw.choices(marks, k=draw.randint(1, 14))) for _ in range(4000)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", f"{normalize.refang('t')} AS r").collect()
    assert [r.r for r in rows] == [one_after_another(r.t) for r in rows]


def test_classes_tried_at_each_character_hold_no_ascii_ranges():
    """Ranges are asked one after another; a class of single characters is one table."""
    import re

    from indicatrix.functions import patterns as P

    for pattern in (P.IPV6, P.HASH, P.URL, P.DOMAIN_CHAIN):
        assert not re.search(r"\[[^\]]*(?:0-9|a-f|a-z|\\x\{[0-7]?[0-9a-f]\}-)", pattern), pattern


def test_refang_schemes_with_any_s_are_those_of_the_rules(spark):
    from indicatrix.functions.normalize import REFANG_RULES, literal, refang

    texts = [
        "hxxps://a hXXpS://b HXXP://c hxxp[://]d httpS://e hxxp\u017f://f",
        "hxxps://a[.]b hxxp://c(.)d{.}e {[.]}f ([.])g [(.)]h",
        "httpS://live hxxp://x[at]y(AT)z[@]w [Dot] (dOt) {dot} [.)",
        "S://only", "hxxhxxps://x", "[hxxp://]", "",
    ]
    one_by_one = "text"
    for mark, live, is_regex in REFANG_RULES:
        call = "regexp_replace" if is_regex else "replace"
        one_by_one = f"{call}({one_by_one}, {literal(mark)}, {literal(live)})"
    rows = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr(f"{refang('text')} AS got", f"{one_by_one} AS want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
