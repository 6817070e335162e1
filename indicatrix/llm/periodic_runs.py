"""Periodic runs of words, by recompression.

Texts of a batch form one sequence of word numbers with a symbol of its own between them. Two steps take
turns until one symbol is left: blocks of equal symbols become one, then pairs of a left and a right
symbol do, where sides are drawn anew for each level. Equal stretches become equal symbols but for their
ends, so the levels are a run-length grammar in which two places are compared in a step or two a level:
up while both begin a symbol of the next level, down again from the first difference. That answers how
far the words from two places on, or before them, are the same.

A run of period q and four periods or more has a place of the grid 0, 3q, 6q, ... before its last period.
There are n log n such places for all q. Those whose word comes again q later are extended both ways
exactly; what is long enough is a run, and of equal stretches the smallest period counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm import words

LEAST, REPEATS = 6, 4  # words, and periods, that a run has at least
STEP = REPEATS - 1  # periods between two places of the grid
AT_ONCE = 1 << 20  # places of the grid that are looked at together


class Level(NamedTuple):
    """A sequence of symbols, and how the next level groups them."""

    symbols: np.ndarray
    group: np.ndarray  # the place of each symbol's group in the next level
    first: np.ndarray  # where each group begins, and the end
    blocks: bool  # groups are blocks of equal symbols, else pairs and single symbols


def _named(symbols: np.ndarray, begins: np.ndarray, joined: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The next level's symbols: new ones for the groups that are ``joined``, one for each of their ``keys``."""
    out = symbols[begins].astype(np.int64)
    out[joined] = int(symbols.max()) + 1 + np.unique(keys, return_inverse=True)[1]
    if out.max() >= 1 << 31:
        out = np.unique(out, return_inverse=True)[1]
    return out


def grammar(symbols: np.ndarray) -> list[Level]:
    """The levels of a sequence up to the one with a single symbol, which is left out."""
    levels, turn = [], 0
    while len(symbols) > 1:
        new = np.ones(len(symbols), bool)
        new[1:] = symbols[1:] != symbols[:-1]
        begins = np.flatnonzero(new)
        if len(begins) < len(symbols):
            sizes = np.diff(np.append(begins, len(symbols)))
            joined = sizes > 1
            keys = symbols[begins[joined]].astype(np.int64) * (int(sizes.max()) + 1) + sizes[joined]
            levels.append(_level(symbols, new, begins, True))
            symbols = _named(symbols, begins, joined, keys)
            continue
        turn += 1
        right = (words.mix(symbols.astype(np.uint64) ^ words.mix(np.full(1, turn, np.uint64))) & np.uint64(1)).astype(bool)
        pairs = [~right[:-1] & right[1:], right[:-1] & ~right[1:]]
        pair = max(pairs, key=np.count_nonzero)
        if not pair.any():
            continue
        new[1:] = ~pair
        begins = np.flatnonzero(new)
        joined = np.append(pair, False)[begins]
        left = begins[joined]
        levels.append(_level(symbols, new, begins, False))
        symbols = _named(symbols, begins, joined, symbols[left].astype(np.int64) * (int(symbols.max()) + 1) + symbols[left + 1])
    return levels


def _level(symbols: np.ndarray, new: np.ndarray, begins: np.ndarray, blocks: bool) -> Level:
    group = np.cumsum(new, dtype=np.int32)
    group -= 1
    return Level(symbols.astype(np.int32), group, np.append(begins, len(symbols)).astype(np.int32), blocks)


def common(levels: list[Level], i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
    """How many symbols are the same from the places ``i`` and ``j`` on, or from there backwards.

    The two places of a pair differ, and symbols that occur once stand on both sides of what they reach.
    """
    sign = 1 if forward else -1
    start, i, j = i, i.copy(), j.copy()
    differs = np.zeros(len(i), np.int16)  # the level where a pair's symbols are found to differ
    active = np.arange(len(i))
    for number, level in enumerate(levels):
        if not len(active):
            break
        a, b = i[active], j[active]
        left, right = _remaining(level, a, forward), _remaining(level, b, forward)
        size_a, size_b = _size(level, a), _size(level, b)
        free = (left == size_a) & (right == size_b)
        same = level.symbols[a] == level.symbols[b]
        step = np.where(~free & same, np.minimum(left, right) if level.blocks else 1, 0) * sign
        a, b = a + step, b + step
        over = ~free & (~same | ((left != right) if level.blocks else False))
        i[active], j[active] = a, b
        differs[active[over]] = number
        up = active[~over]
        i[up], j[up] = level.group[a[~over]], level.group[b[~over]]
        active = up
    order = np.argsort(-differs, kind="stable")
    above = np.cumsum(np.bincount(differs, minlength=len(levels) + 1)[:0:-1])[::-1]  # pairs that differ above a level
    for number in range(len(levels) - 1, -1, -1):
        down = order[: above[number]]
        if not len(down):
            continue
        level = levels[number]
        a, b = (level.first[i[down]], level.first[j[down]]) if forward else (level.first[i[down] + 1] - 1, level.first[j[down] + 1] - 1)
        same = level.symbols[a] == level.symbols[b]
        step = np.where(same, np.minimum(_size(level, a), _size(level, b)) if level.blocks else 1, 0) * sign
        i[down], j[down] = a + step, b + step
    return (i - start) * sign


def _remaining(level: Level, at: np.ndarray, forward: bool) -> np.ndarray:
    """Symbols of the group of each place from there on, in the direction of the walk."""
    group = level.group[at]
    return level.first[group + 1] - at if forward else at - level.first[group] + 1


def _size(level: Level, at: np.ndarray) -> np.ndarray:
    group = level.group[at]
    return level.first[group + 1] - level.first[group]


def grid(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(text, place, period)`` of the grid of some texts' words, at most about ``AT_ONCE`` at a time."""
    periods = counts // REPEATS
    pairs = int(periods.sum())
    ends = np.cumsum(periods)
    at = 0
    while at < pairs:
        number = np.arange(at, min(at + AT_ONCE // 8, pairs))
        text = np.searchsorted(ends, number, "right")
        period = number - (ends - periods)[text] + 1
        places = -(-(counts[text] - period) // (STEP * period))
        upto = max(1, int(np.searchsorted(np.cumsum(places), AT_ONCE, "right")))
        text, period, places = text[:upto], period[:upto], places[:upto]
        turn = np.arange(int(places.sum())) - np.repeat(np.cumsum(places) - places, places)
        period = np.repeat(period, places)
        yield np.repeat(text, places), turn * period * STEP, period
        at += upto


def runs(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(text, start, length, period)`` of all runs of some texts' words, by text, start and period."""
    found = [np.zeros((4, 0), np.int64)]
    names, number = np.unique(hashes, return_inverse=True)
    text = np.repeat(np.arange(len(counts)), counts)
    begins = np.cumsum(counts) - counts + np.arange(len(counts)) + 1
    symbols = len(names) + np.arange(len(hashes) + len(counts) + 1)
    symbols[np.arange(len(hashes)) + text + 1] = number
    levels = grammar(symbols)
    for owner, place, period in grid(counts):
        i = begins[owner] + place
        again = symbols[i] == symbols[i + period]
        owner, i, period = owner[again], i[again], period[again]
        after = common(levels, i, i + period, True)
        before = common(levels, i - 1, i - 1 + period, False)
        length = period + after + before
        good = length >= np.maximum(LEAST, REPEATS * period)
        start = (i - before - begins[owner])[good]
        found.append(np.stack([owner[good], start, length[good], period[good]]))
    owner, start, length, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, length, start, owner))
    owner, start, length, period = owner[order], start[order], length[order], period[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    owner, start, length, period = owner[new], start[new], length[new], period[new]
    order = np.lexsort((period, start, owner))
    return owner[order], start[order], length[order], period[order]


def repeated(counts: np.ndarray, owner: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words a run holds after its first period."""
    begin = np.cumsum(counts) - counts
    depth = np.zeros(int(counts.sum()) + 1, np.int64)
    np.add.at(depth, begin[owner] + start + period, 1)
    np.add.at(depth, begin[owner] + start + length, -1)
    return np.cumsum(depth)[:-1] > 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of every row of ``docs``.

    Words are runs of characters other than ASCII white space, as they stand, numbered from 0. ``runs`` has
    ``start, length, period`` of every stretch of words that has ``period`` as its smallest period, at least
    ``LEAST`` words and ``REPEATS`` periods, and that no neighbouring word extends; by start, then period.
    ``collapsed`` holds the words that no run contains after its first period, joined by one space. A null
    text counts as empty; a text without words has no runs and an empty ``collapsed``. Rows are looked at one
    by one, so repeated rows give repeated results, and a null ``doc_id`` stays null; other columns are not
    looked at; an empty table gives an empty result. Words are compared as 64-bit hashes.
    """

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            for first, last, data, offsets in words.chunks(texts):
                hashes, counts = words.words(data, offsets, values=words.EXACT)
                owner, *run = runs(hashes, counts)
                drop = repeated(counts, owner, *run)
                ends, out = np.cumsum(counts), []
                raw, has = data.tobytes(), np.bincount(owner, minlength=last - first) > 0
                for k in range(last - first):
                    parts = raw[offsets[k] : offsets[k + 1]].split()
                    if has[k]:
                        gone = drop[ends[k] - counts[k] : ends[k]]
                        parts = [part for part, away in zip(parts, gone) if not away]
                    out.append(b" ".join(parts))
                edges = np.searchsorted(owner, np.arange(last - first + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(column.astype(np.int64)) for column in run], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[first:last],
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(edges), values),
                        pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "n_words", "runs", "collapsed"],
                )

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, schema)
