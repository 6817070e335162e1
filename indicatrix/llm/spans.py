"""Pattern matches with their places, as SQL expressions: no code runs outside the engine's functions."""

from __future__ import annotations

from typing import NamedTuple

MARK = "\u0001"  # stands around matches while a text is split
SPAN = "struct<start: int, end: int, value: string, before: string>"
BLOCK = 256  # gaps and matches walked together; even, so each block begins with a gap
# The last two words of a text, read backwards: one step over what they take, however long the text is.
LAST_WORDS = r"reverse(regexp_extract(reverse({p}), r'^\s*+(\S++\s++\S++)', 1))"


class Rule(NamedTuple):
    """A kind of match.

    ``guard`` is a cheap condition on the text ``{t}`` that holds wherever the pattern matches;
    ``keep`` is a condition on a match ``{m}``. A match that fails it is dropped and not tried again
    from a later start, so ``pattern`` alone decides where the next one begins.
    """

    kind: str
    pattern: str
    guard: str
    keep: str = "true"
    version: int = 1


def raw(pattern: str) -> str:
    """A pattern as a raw SQL literal; quotes in patterns are written as hexadecimal escapes."""
    if "'" in pattern:
        raise ValueError("write a quote in a pattern as \\x27")
    return f"r'{pattern}'"


def found(rule: Rule, text: str) -> str:
    """All matches in a text, leftmost and non-overlapping, as ``array<SPAN>`` in code points, ends exclusive.

    ``before`` has the two words before a match, whole, if there are two since the match before.

    The mark in a text counts as another control character, which no pattern names.
    """
    clean = f"translate({text}, '{MARK}', '\u0002')"
    parts = f"split(regexp_replace({clean}, {raw(f'({rule.pattern})')}, '{MARK}$1{MARK}'), '{MARK}', -1)"
    # Gaps and matches take turns. They are walked in blocks, each from its own start, as appending to
    # one array would copy it for every match.
    block = f"slice(q, c * {BLOCK} + 1, {BLOCK})"
    blocks = f"sequence(0, (size(q) - 1) DIV {BLOCK})"
    sizes = f"transform({blocks}, c -> aggregate({block}, 0, (s, p) -> s + length(p)))"
    starts = f"aggregate({sizes}, array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    span = "named_struct('start', s.at, 'end', s.at + length(p), 'value', p, 'before', s.before)"
    walk = (
        f"aggregate({block},"
        f" named_struct('at', b[c], 'inside', false, 'before', '', 'out', CAST(array() AS array<{SPAN}>)),"
        f" (s, p) -> named_struct('at', s.at + length(p), 'inside', NOT s.inside,"
        f" 'before', IF(s.inside, s.before, {LAST_WORDS.format(p='p')}),"
        f" 'out', IF(s.inside AND ({rule.keep.format(m='p')}), concat(s.out, array({span})), s.out)),"
        f" s -> s.out)"
    )
    spans = f"transform(array({parts}), q -> transform(array({starts}), b -> flatten(transform({blocks}, c -> {walk})))[0])[0]"
    return f"CASE WHEN {rule.guard.format(t=text)} THEN {spans} ELSE CAST(array() AS array<{SPAN}>) END"


def joined(spans: str, kinds: list[str]) -> str:
    """Spans ``struct<start, rank, end>`` as ``kind:start:end``, by start, then kind as listed, comma-joined."""
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"array_join(transform(array_sort({spans}), s -> concat(element_at(array({names}), s.rank + 1), ':', s.start, ':', s.end)), ',')"


def ranked(spans: str, rank: int) -> str:
    """``array<SPAN>`` as ``array<struct<start, rank, end>>``."""
    return f"transform({spans}, s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end))"
