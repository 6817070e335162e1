"""Text -> array of matches, one SQL expression per indicator type."""

from __future__ import annotations

from indicatrix.functions import patterns as P
from indicatrix.functions.normalize import literal

NO_STRINGS = "CAST(array() AS ARRAY<STRING>)"


def find_all(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {literal(pattern)}, {group})"


def _guarded(test: str, matches: str) -> str:
    """Run the expression only on texts that can hold a match."""
    return f"CASE WHEN {test} THEN {matches} ELSE {NO_STRINGS} END"


def ipv4_matches(text: str) -> str:
    """Dotted quads as written; octets are checked later."""
    return _guarded(f"rlike({text}, {literal(P.IPV4_HINT)})", find_all(text, P.IPV4))


def ipv6_matches(text: str) -> str:
    return _guarded(f"contains({text}, '::') OR rlike({text}, ':[0-9a-fA-F]+:')", find_all(text, P.IPV6))


def domain_matches(text: str, any_case: bool = False) -> str:
    """Dotted names ending on an alphabetic label; endings are checked later."""
    chains = find_all(text, P.DOMAIN_CHAIN_ANY_CASE if any_case else P.DOMAIN_CHAIN)
    inner = literal(P.DOMAIN_IN_CHAIN_ANY_CASE if any_case else P.DOMAIN_IN_CHAIN)
    name = f"CASE WHEN endswith(c, '.') THEN regexp_extract(c, {inner}, 1) ELSE c END"
    names = f"array_remove(transform({chains}, c -> {name}), '')"
    return names if any_case else _guarded(f"rlike({text}, {literal(P.DOMAIN_HINT)})", names)


def url_matches(text: str) -> str:
    return _guarded(f"contains({text}, '://')", find_all(text, P.URL))


def strict_url_matches(text: str) -> str:
    return _guarded(f"contains({text}, '://')", find_all(text, P.URL_STRICT))


def url_host(url: str) -> str:
    """Lower-cased host of a URL; empty where it has none.

    ``parse_url`` is no help here: it raises on the malformed URLs that threat
    reports are full of, and its lenient form gives null for hosts with an
    underscore or a letter outside ASCII.
    """
    host = f"regexp_extract({url}, {literal(P.HOST)}, 1)"
    name = f"substring_index({host}, '%', 1)"
    # The part behind a percent sign keeps its case.
    zoned = f"concat(lower({name}), substr({host}, length({name}) + 1))"
    return f"CASE WHEN contains({url}, '%') THEN {zoned} ELSE lower({host}) END"


def email_matches(text: str) -> str:
    """Mail addresses, plain or defanged, on text that was *not* refanged."""
    test = f"contains({text}, '@') OR rlike({text}, {literal(P.WORD_AT)})"
    folded = " OR ".join(f"contains({text}, {literal(letter)})" for letter in P.FOLDED)
    found = (
        f"CASE WHEN {folded} THEN {find_all(text, P.EMAIL_FOLDED, 1)} "
        f"ELSE {find_all(text, P.EMAIL, 1)} END"
    )
    return _guarded(test, found)


def cve_matches(text: str) -> str:
    return find_all(text, P.CVE)


def mitre_matches(text: str) -> str:
    return find_all(text, P.MITRE)


def hash_matches(text: str) -> str:
    """Hex runs with the length of a known digest, in text order."""
    return find_all(text, P.HASH)
