"""Words and word shingles of whole Arrow columns of text, as 64-bit hashes, without a Python loop over words.

A word's hash is a polynomial in its bytes, read off prefix sums of the whole buffer; a shingle's hash
is a polynomial in the hashes of its words. Both are mixed at the end. Two different shingles share a
hash with a probability of about 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20  # bytes of text hashed together; a longer text is a chunk of its own
BLOCK = 1 << 18  # bytes whose prefix sums are held at once; a longer word is a block of its own

_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(20).integers(0, 2**64, 256, np.uint64)

SPACES = np.zeros(256, bool)  # ASCII white space
SPACES[[0x20, *range(0x09, 0x0E)]] = True
PUNCTUATION = SPACES.copy()  # all ASCII characters but letters and digits
PUNCTUATION[[i for i in range(128) if not chr(i).isalnum()]] = True


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, size: int) -> np.ndarray:
    out = np.full(size, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = {"up": np.zeros(0, np.uint64), "down": np.zeros(0, np.uint64)}


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, grown as needed."""
    if len(_POWERS["up"]) < size:
        _POWERS["up"] = _powers(_BASE, size)
        _POWERS["down"] = _powers(np.uint64(pow(int(_BASE), -1, 2**64)), size)
    return _POWERS["up"], _POWERS["down"]


def _lowered(table: np.ndarray) -> np.ndarray:
    """Byte values with A-Z as a-z."""
    out = table.copy()
    out[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    return out


LOWERED = _lowered(_BYTE)
EXACT = _BYTE


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first, last, bytes, offsets)`` of runs of texts; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES, values: np.ndarray = LOWERED) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and the number of words of each text; A-Z lowered unless ``values`` is ``EXACT``."""
    gap = separators[data]
    before, after = np.empty(len(gap), bool), np.empty(len(gap), bool)
    before[1:], after[:-1] = gap[:-1], gap[1:]
    inner = offsets[(offsets > 0) & (offsets < len(gap))]
    before[inner] = after[inner - 1] = True
    if len(gap):
        before[0] = after[-1] = True
    starts, ends = np.flatnonzero(~gap & before), np.flatnonzero(~gap & after) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        upto = max(at + 1, int(np.searchsorted(starts, starts[at] + BLOCK)))
        low, high = starts[at], ends[upto - 1]
        up, down = powers(high - low + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(values[data[low:high]] * up[: high - low], out=sums[1:])
        s, e = starts[at:upto] - low, ends[at:upto] - low
        hashes[at:upto] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _STEP)
        at = upto
    return hashes, np.diff(np.searchsorted(starts, offsets))


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words in order of position, and how many each text has.

    A text with fewer words, but at least one, has its whole sequence as its only shingle, or none
    if ``short`` is false.
    """
    ends = np.cumsum(counts)
    begins = ends - counts
    runs = np.maximum(counts - width + 1, 0)
    few = (counts > 0) & (counts < width) if short else np.zeros(len(counts), bool)
    sizes = np.where(few, 1, runs)
    out = np.empty(int(sizes.sum()), np.uint64)
    places = np.cumsum(sizes) - sizes
    total = max(len(hashes) - width + 1, 0)
    rolled = np.zeros(total, np.uint64)
    for k in range(width):
        rolled *= _STEP
        rolled += hashes[k : k + total]
    here = np.zeros(len(out), bool)
    here[places[few]] = True
    at = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(begins, runs)
    out[~here] = mix(rolled[at])
    for text in np.flatnonzero(few):
        value = counts[text : text + 1].astype(np.uint64)
        for word in hashes[begins[text] : ends[text]]:
            value = value * _BASE + word
        out[places[text]] = mix(value)[0]
    return out, sizes
