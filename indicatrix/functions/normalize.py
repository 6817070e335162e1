"""Refang, defang and trimming as SQL expressions.

The functions in this package take the SQL text of an argument, usually a
column name, and return the SQL text of the result, for ``selectExpr``,
``F.expr`` and SQL functions alike.  One expression is one call into the JVM, so
building a plan stays fast however many rules it holds.
"""

from __future__ import annotations

from indicatrix.functions import patterns as P
from indicatrix.functions.constants import WHITESPACE

# The refang rules in the order in which they apply.  Rules with
# letters ignore case and are regular expressions; the others are plain text.
REFANG_RULES = [
    (r"[hH][xX][xX][pP][sS\x{17f}]://", "https://", True),
    (r"[hH][xX][xX][pP]://", "http://", True),
    ("[://]", "://", False),
    ("[.]", ".", False),
    ("(.)", ".", False),
    ("{.}", ".", False),
    ("[@]", "@", False),
    (r"\[[aA][tT]\]", "@", True),
    (r"\([aA][tT]\)", "@", True),
    (r"\[[dD][oO][tT]\]", ".", True),
    (r"\([dD][oO][tT]\)", ".", True),
]

# The same with fewer passes. The rules for a dot apply one after another, so a dot in square brackets
# within round ones, and either within curly ones, is a dot; other nestings leave the outer pair.
# A mark that opens one comes first, so that other characters cost one test.
_DOT = (
    r"[\[({](?:(?<=\[)(?:\.|[dD][oO][tT])\]|(?<=\()(?:\.|\[\.\]|[dD][oO][tT])\)"
    r"|(?<=\{)(?:\.|\(\.\)|\[\.\]|\(\[\.\]\))\})"
)
_AT = r"[\[(](?:(?<=\[)(?:@|[aA][tT])\]|(?<=\()[aA][tT]\))"
_PASSES = [("[://]", "://", False), (_DOT, ".", True), (_AT, "@", True)]
# Both schemes at once, where none is written with another "s" than the live one has.
_SCHEMES = r"[hH][xX][xX][pP](?=s?://)"
_OTHER_S = ["S://", "\u017f://"]

# The schemes that defanging disarms, in order, case-sensitive.
DEFANG_SCHEMES = [("https://", "hxxps://"), ("http://", "hxxp://"), ("ftp://", "fxp://")]


def literal(value: str | int | bool | None) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


def lookup(key: str, table: dict, default: str | int | None = None) -> str:
    """Value of a small constant table, else ``default``."""
    entries = ", ".join(f"{literal(k)}, {literal(v)}" for k, v in table.items())
    found = f"try_element_at(map({entries}), {key})"
    return found if default is None else f"coalesce({found}, {literal(default)})"


def strip(x: str) -> str:
    """Remove surrounding whitespace, Unicode spaces included."""
    return f"btrim({x}, {literal(WHITESPACE)})"


def refang(x: str) -> str:
    """Turn defanged notation back into live indicators.

    One regular expression decides whether any rule can apply at all, so plain
    text pays for a single pass and not for four; a text without any of the
    marks that open a rule does not even pay for that one.
    """
    one_by_one = x
    for mark, live, _ in REFANG_RULES[:2]:
        one_by_one = f"regexp_replace({one_by_one}, {literal(mark)}, {literal(live)})"
    other = " OR ".join(f"contains({x}, {literal(mark)})" for mark in _OTHER_S)
    out = f"CASE WHEN {other} THEN {one_by_one} ELSE regexp_replace({x}, {literal(_SCHEMES)}, 'http') END"
    for mark, live, is_regex in _PASSES:
        if is_regex:
            out = f"regexp_replace({out}, {literal(mark)}, {literal(live)})"
        else:
            out = f"replace({out}, {literal(mark)}, {literal(live)})"
    opens = " OR ".join(f"contains({x}, {literal(mark)})" for mark in P.FANGED_MARKS)
    return f"CASE WHEN ({opens}) AND rlike({x}, {literal(P.FANGED)}) THEN {out} ELSE {x} END"


def defang(x: str) -> str:
    """Disarm one indicator value for sharing.

    Dots and at-signs are bracketed everywhere behind the first ``://``, or in
    the whole value where there is none.
    """
    armed = x
    for live, safe in DEFANG_SCHEMES:
        armed = f"replace({armed}, {literal(live)}, {literal(safe)})"

    def bracket(part: str) -> str:
        return f"replace(replace({part}, '.', '[.]'), '@', '[@]')"

    scheme = f"substring_index({armed}, '://', 1)"
    rest = f"substr({armed}, length({scheme}) + 4)"
    return (
        f"CASE WHEN contains({x}, '://') THEN concat({scheme}, '://', {bracket(rest)}) "
        f"ELSE {bracket(armed)} END"
    )
