"""Indicator checks as boolean SQL expressions."""

from __future__ import annotations

from indicatrix.functions import patterns as P
from indicatrix.functions.constants import (
    HASH_LENGTHS,
    LITE_TLDS,
    RESERVED_DOMAINS,
    TLDS,
    TWO_PART_TLDS,
)
from indicatrix.functions.normalize import in_list, literal, lookup, strip


def matches(x: str, pattern: str) -> str:
    return f"rlike({x}, {literal(pattern)})"


def is_ipv4(x: str) -> str:
    """Four decimal octets of at most 255 without leading zeros."""
    return matches(x, P.IS_IPV4)


def is_ipv6(x: str) -> str:
    """The full IPv6 text form: compressed, with an IPv4 tail, with a scope id."""
    address = f"substring_index({x}, '%', 1)"
    scope = f"substr({x}, length({address}) + 2)"
    scope_ok = f"(NOT contains({x}, '%') OR {matches(scope, P.IS_SCOPE)})"
    # An IPv4 tail stands for two groups.
    groups = f"regexp_replace({address}, {literal(P.IPV4_TAIL)}, '0:0')"
    count = f"size(array_remove(split({groups}, ':'), ''))"
    body_ok = (
        f"({matches(groups, P.IS_IPV6_FULL)} OR ({matches(groups, P.IS_IPV6_COMPRESSED)} AND {count} <= 7))"
    )
    return f"({scope_ok} AND {body_ok})"


def hash_type(x: str) -> str:
    """``md5``, ``sha1``, ``sha256``, ``sha512``, or null for anything else."""
    value = f"lower({strip(x)})"
    names = {length: name.removeprefix("hash_") for length, name in HASH_LENGTHS.items()}
    return f"CASE WHEN {matches(value, P.IS_HEX)} THEN {lookup(f'length({value})', names)} END"


def is_cve(x: str) -> str:
    return matches(x, P.IS_CVE)


def is_domain_name(x: str) -> str:
    """The basic check: a dot, then a purely alphabetic last label."""
    return matches(x, P.IS_DOTTED_NAME)


def is_email(x: str) -> str:
    return matches(x, P.IS_EMAIL)


def is_url(x: str) -> str:
    return matches(x, P.IS_URL)


def is_indicator_domain(x: str) -> str:
    """Accept a domain as an indicator; see :func:`is_indicator_name`."""
    return is_indicator_name(f"lower({strip(x)})")


def is_indicator_name(name: str) -> str:
    """The same for a name that is lower-case and stripped.

    File names, reserved names and unknown endings are out; so is a name whose
    part before the ending is a mere number, such as a version.
    """
    ending = f"substring_index({name}, '.', -1)"
    front = f"substr({name}, 1, length({name}) - length({ending}) - 1)"
    numeric = matches(f"translate({front}, '.-', '')", P.ALL_DIGITS)
    two_part = f"substring_index({name}, '.', -2) IN {in_list(TWO_PART_TLDS)} AND substring_index({name}, '.', -3) <> substring_index({name}, '.', -2)"
    return (
        f"(contains({name}, '.') AND ({two_part} OR ({ending} IN {in_list(TLDS)} AND NOT {numeric})) "
        f"AND {name} NOT IN {in_list(RESERVED_DOMAINS)} AND NOT {matches(name, P.HAS_FILE_SUFFIX)})"
    )


def is_lite_domain(x: str) -> str:
    """The acceptance rule of the single-type domain set."""
    name = f"lower({strip(x)})"
    return (
        f"(contains({name}, '.') AND substring_index({name}, '.', -1) IN {in_list(LITE_TLDS)} "
        f"AND {name} NOT IN {in_list(RESERVED_DOMAINS)} AND NOT {matches(name, P.HAS_LITE_FILE_SUFFIX)})"
    )
