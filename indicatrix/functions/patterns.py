"""Regular expressions for Spark's (Java) matcher.

Four properties are kept on purpose:

* **Word boundaries** count all letters, numbers and the underscore.  Java's own
  ``\\b`` differs between releases outside ASCII; it only serves as the quick
  test in front of the exact one.
* **Whole texts are safe.**  A repeated group of variable length makes the Java
  matcher recurse once per repetition, and a long ``1.1.1.1...`` line then ends
  the task with a stack overflow.  Such groups are possessive, hence iterative.
* **Classes are tables.**  A class of ranges asks its ranges one after another,
  through calls that the matcher cannot inline once it serves many patterns.
  Classes that are tried at each character name their ASCII characters one by
  one, which Java keeps as one table, or use one of its own, such as ``\\p{XDigit}``.
* **Time is linear.**  A run of label or mailbox characters is consumed once,
  not once per position at which it could start.  Tests that fail fast come
  first, look-behinds run only where the rest already fits.
"""

from __future__ import annotations

from string import ascii_letters, digits

from indicatrix.functions.constants import (
    AMBIGUOUS_HOST_CHARS,
    FILE_SUFFIXES,
    LITE_FILE_SUFFIXES,
    WHITESPACE,
)


def _one_of(chars: str) -> str:
    """A class of some ASCII characters, one by one."""
    return "[" + "".join(ch if ch.isalnum() else rf"\x{ord(ch):02x}" for ch in sorted(set(chars))) + "]"


def _all_but(excluded: str) -> str:
    """A class of all characters except ``excluded``: ASCII ones one by one, then others as ranges.

    Java's matcher evaluates a negated class of ranges through type checks whose
    cache the threads of an executor share, and then eight cores match no faster
    than one.  Ranges do not have that cost.
    """
    out, start = [], 0x80
    for code in [*sorted({ord(ch) for ch in excluded if ord(ch) >= 0x80}), 0x110000]:
        if code > start:
            out.append(rf"\x{{{start:x}}}-\x{{{code - 1:x}}}")
        start = code + 1
    return "[" + _one_of("".join(chr(code) for code in range(0x80) if chr(code) not in excluded)) + "[" + "".join(out) + "]]"


WORD = r"[\p{L}\p{N}_]"
_START = rf"\b(?<!{WORD})"  # in front of a word character
_END = rf"(?!{WORD})"  # behind a word character
_EDGE = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"  # either
_DIGIT = r"\p{Nd}"
_HEX = r"\p{XDigit}"
_HEXTET = rf"{_HEX}{{1,4}}"
_ALNUM = _one_of(ascii_letters + digits)
_LABEL = _one_of(ascii_letters + digits + "-")
# A label of at most 63 characters and its dot.
_LABEL_DOT = rf"(?={_LABEL}{{1,63}}+\.){_ALNUM}++(?:-++{_ALNUM}++)*+\."
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# The line breaks but the usual one; plain searches for them cost less than the pattern.
RARE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]

# --- extraction --------------------------------------------------------------
IPV4 = rf"\b(?={_DIGIT}{{1,3}}\.)(?<!{WORD})(?:{_DIGIT}{{1,3}}\.){{3}}{_DIGIT}{{1,3}}{_END}"
# Eight groups; or a compressed address up to its "::"; or "::" after a word.
IPV6 = (
    rf"\b(?={_HEXTET}:)(?<!{WORD})(?:(?:{_HEXTET}:){{7}}{_HEXTET}{_END}|(?:{_HEXTET}:){{1,7}}:)"
    rf"|::(?<={WORD}::)(?:{_HEXTET}:){{0,5}}{_HEXTET}{_END}"
)
# What a text with a quad, or with a domain, holds; each is tested in one plain pass.
IPV4_HINT = rf"{_DIGIT}\.{_DIGIT}"
DOMAIN_HINT = r"\.[a-zA-Z]"
# A maximal chain of dotted labels, with its top-level label where one follows.
DOMAIN_CHAIN = rf"\b(?={_LABEL}{{1,63}}+\.)(?<!{WORD})(?:{_LABEL_DOT})++(?:\p{{Alpha}}{{2,}}+{_END})?+"
# Ranges here: ignoring case, they hold letters beyond ASCII, which tables do not.
_LABEL_DOT_ANY_CASE = r"(?=[a-zA-Z0-9\-]{1,63}\.)[a-zA-Z0-9]++(?:-++[a-zA-Z0-9]++)*+\."
DOMAIN_CHAIN_ANY_CASE = rf"(?iu){_START}(?:{_LABEL_DOT_ANY_CASE})++(?:[a-zA-Z]{{2,}}{_END})?+"
# In a chain that ends on a dot: up to the last label that can close a domain.
DOMAIN_IN_CHAIN = r"^(.*\.[a-zA-Z]{2,})[.\-]"
DOMAIN_IN_CHAIN_ANY_CASE = "(?iu)" + DOMAIN_IN_CHAIN
URL = rf"\b(?=[hHfF])(?<!{WORD})(?iu:https?|hxxps?|ftp)://{_all_but(WHITESPACE + '<>' + chr(34) + chr(39))}++"


def _email(extra: str) -> str:
    """From the end of the previous match, skip what is no address; then group 1.

    An address begins at the first boundary within a run of mailbox characters.
    """
    box = rf"[{_one_of(ascii_letters + digits + '._%+-')[1:-1]}{extra}]"
    host = rf"[{_one_of(ascii_letters + digits + '.-')[1:-1]}{extra}]"
    address = (
        rf"{box}++(?:@|\[@\]|\[[aA][tT]\]){host}+"
        rf"(?:\.|\[\.\]|\[[dD][oO][tT]\])[a-zA-Z{extra}]{{2,}}{_END}"
    )
    other = _all_but(ascii_letters + digits + "._%+-@[" + extra)
    skip = rf"{box}*+{other}++|(?!(?>{box}*?{_EDGE}){address}){box}*+[@\[]"
    return rf"\G(?:{skip})*+(?>{box}*?{_EDGE})({address})"


# Four letters beyond ASCII equal ASCII letters when case is ignored.  Texts
# that hold one of them need the wider classes, which are slower.
FOLDED = ["\u0130", "\u0131", "\u017f", "\u212a"]
EMAIL = _email("")
EMAIL_FOLDED = _email("".join(FOLDED))
WORD_AT = r"\[[aA][tT]\]"
CVE = rf"(?iu)CVE(?<!{WORD}CVE)-{_DIGIT}{{4}}-{_DIGIT}{{4,7}}{_END}"
MITRE = rf"[TS]{_DIGIT}{{4}}(?<!{WORD}[TS]{_DIGIT}{{4}})(?:\.{_DIGIT}{{3}})?{_END}"
# 32, 40, 64 or 128 hexadecimal digits that no further digit touches.
HASH = (
    rf"{_HEX}{{32}}(?<!{_HEX}{_HEX}{{32}})"
    rf"(?:{_HEX}{{8}}|{_HEX}{{32}}|{_HEX}{{96}})?(?!{_HEX})"
)
# The stricter single-type URL form: dotted host, port, path.
URL_STRICT = (
    r"(?=[hHfF])(?iu:https?|hxxps?|ftp)://[\p{L}\p{N}_\-]++(?:\.[\p{L}\p{N}_\-]++)++"
    rf"(?::{_DIGIT}+)?(?:/{_all_but(WHITESPACE)}*)?"
)
URL_STRICT_SCHEME = r"\A(?:https?|hxxps?|ftp)://"

# --- URL parts ---------------------------------------------------------------
# Group 1 is the host: behind the last "@", before a port.  A host in brackets
# or with an ambiguous character does not match.
_AUTHORITY = _all_but("/?#[]" + AMBIGUOUS_HOST_CHARS)
HOST = (
    rf"^[a-zA-Z][a-zA-Z0-9+.\-]*+://(?:{_AUTHORITY}*@)?"
    rf"({_all_but('/?#[]@:' + AMBIGUOUS_HOST_CHARS)}*+)(?::{_AUTHORITY}*+)?(?:[/?#]|\z)"
)

# --- refang ------------------------------------------------------------------
# One test that any of the refang rules can apply.
FANGED = (
    r"(?=[hH\[({])(?:[hH][xX][xX][pP][sS\x{17f}]?://|\[(?:://|\.|@|[aA][tT]|[dD][oO][tT])\]"
    r"|\((?:\.|[aA][tT]|[dD][oO][tT])\)|\{\.\})"
)

# Every match of it holds one of these.
FANGED_MARKS = ["[", "(", "{", "xx", "xX", "Xx", "XX"]

# --- validation --------------------------------------------------------------
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4_BODY = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
IS_IPV4 = rf"\A{_IPV4_BODY}\z"
IPV4_TAIL = rf"(?<=:){_IPV4_BODY}\z"
IS_IPV6_FULL = rf"\A(?:{_HEXTET}:){{7}}{_HEXTET}\z"
IS_IPV6_COMPRESSED = (
    rf"\A(?:{_HEXTET}(?::{_HEXTET}){{0,6}})?::(?:{_HEXTET}(?::{_HEXTET}){{0,6}})?\z"
)
IS_SCOPE = r"\A[^%/]+\z"
IS_HEX = r"\A[a-f0-9]+\z"
IS_CVE = rf"(?iu)\ACVE-{_DIGIT}{{4}}-{_DIGIT}{{4,7}}\n?\z"
IS_CVE_PARTS = rf"\ACVE-{_DIGIT}+-{_DIGIT}+\z"
IS_DOTTED_NAME = r"(?s)\A.*\.\p{L}{2,}\z"
IS_EMAIL = r"\A[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\n?\z"
IS_URL = r"(?iu)\A(?:https?|ftp)://"
HAS_FILE_SUFFIX = r"\.(?:" + "|".join(FILE_SUFFIXES) + r")\z"
HAS_LITE_FILE_SUFFIX = r"\.(?:" + "|".join(LITE_FILE_SUFFIXES) + r")\z"
ALL_DIGITS = rf"\A{_DIGIT}+\z"
