"""Spelling variants: words that differ by one edit, found by Bloom filters and settled by a join.

The words of a vocabulary go into blocked Bloom filters, one for each length, which are broadcast. Every
word probes its own edits there: each letter left out, and each letter replaced by a later one of the
alphabet. The other edits are the same pairs seen from the other word. Only hits are shuffled, as two 64-bit
keys and a place; a join with the vocabulary and a comparison of the letters removes what the filters let
through by chance. A filter takes at most ``FILTER_BYTES``; a larger vocabulary is cut by key into slices,
each with filters of its own, so the share of chance hits is the same for any vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm import words
from indicatrix.llm.common import Scratch, cut

FILTER_BYTES = 16 << 20  # of all filters that are broadcast together
LENGTHS = 64  # filters; the last one holds all longer words
PER_BLOCK = 4  # words for each block of 64 bits, at most, with as many bits set for each
LEAST_BLOCKS = 64  # of a filter
AT_ONCE = 1 << 20  # edits that are probed together
_STEP = np.uint64(0xD6E8FEB86659FD93)


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The code points of some words, and how many each has."""
    values = [word.encode("utf-32-le", "surrogatepass") for word in texts.to_pylist()]
    return np.frombuffer(b"".join(values), np.uint32), np.array([len(v) // 4 for v in values], np.int64)


def key(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A word's hash, from its size and the sum of its letters' terms."""
    return words.mix(sums + sizes.astype(np.uint64) * _STEP)


def terms(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """What a letter at a place adds to the sum of its word."""
    powers = words.powers(int(places.max(initial=0)) + 1)[0]
    return words.mix(letters.astype(np.uint64) ^ _STEP) * powers[places]


def keyed(vocabulary: DataFrame) -> DataFrame:
    """``word, n, size, key`` for ``vocabulary(word, n)``."""

    def run(batches):
        for batch in batches:
            letters, sizes = letters_of(batch.column("word"))
            ends = np.cumsum(sizes)
            places = np.arange(len(letters)) - np.repeat(ends - sizes, sizes)
            before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms(letters, places), dtype=np.uint64)])
            keys = key(before[ends] - before[ends - sizes], sizes)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), pa.array(sizes), pa.array(keys.view(np.int64))], ["word", "n", "size", "key"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, size long, key long")


class Filters:
    """Where the filters of all lengths have the bits of a word."""

    def __init__(self, counts: dict[int, int]):
        wanted = np.array([max(LEAST_BLOCKS, -(-counts.get(i, 0) // PER_BLOCK)) for i in range(LENGTHS)], np.int64)
        self.slices = max(1, -(-int(wanted.sum()) * 8 // FILTER_BYTES))
        self.blocks = -(-wanted // self.slices)
        self.first = np.cumsum(self.blocks) - self.blocks
        self.total = int(self.blocks.sum())

    def slice_of(self, keys: np.ndarray) -> np.ndarray:
        return words.mix(keys) % np.uint64(self.slices)

    def place(self, keys: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The block of each word and its bits there."""
        length = np.minimum(sizes, LENGTHS - 1)
        block = ((keys >> np.uint64(32)) * self.blocks[length].astype(np.uint64)) >> np.uint64(32)
        bits = np.zeros(len(keys), np.uint64)
        for turn in range(PER_BLOCK):
            bits |= np.uint64(1) << ((keys >> np.uint64(6 * turn)) & np.uint64(63))
        return self.first[length] + block.astype(np.int64), bits


def filled(vocabulary: DataFrame, filters: Filters, number: int) -> np.ndarray:
    """The filters of one slice of ``vocabulary(size, key)``. At most ``FILTER_BYTES / 8`` rows reach the driver."""

    def run(batches):
        for batch in batches:
            keys = batch.column("key").to_numpy().view(np.uint64)
            mine = filters.slice_of(keys) == number
            block, bits = filters.place(keys[mine], batch.column("size").to_numpy()[mine])
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(bits.view(np.int64))], ["block", "bits"])

    rows = vocabulary.select("size", "key").mapInArrow(run, "block long, bits long")
    out = np.zeros(filters.total, np.uint64)
    for batch in rows.groupBy("block").agg(F.expr("bit_or(bits)").alias("bits")).toArrow().to_batches():
        out[batch.column("block").to_numpy()] = batch.column("bits").to_numpy().view(np.uint64)
    return out


def edits(letters: np.ndarray, sizes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``(word, key, size, place)`` of the edits of some words, at most about ``AT_ONCE`` at a time.

    Of equal letters in a row only the first is left out, which gives the same.
    """
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(letters)) - (ends - sizes)[owner]
    term = terms(letters, places)
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
    whole = (before[ends] - before[ends - sizes])[owner]
    prefix = before[:-1] - before[ends - sizes][owner]
    shift = words.powers(2)[1][1]
    new = np.ones(len(letters), bool)
    new[1:] = (letters[1:] != letters[:-1]) | (owner[1:] != owner[:-1])
    new &= sizes[owner] > 1
    rest = sizes[owner[new]] - 1
    yield owner[new], key(prefix[new] + (whole - prefix - term)[new] * shift, rest), rest, places[new]
    step = max(1, AT_ONCE // max(len(alphabet), 1))
    drawn = words.mix(alphabet.astype(np.uint64) ^ _STEP)
    for low in range(0, len(letters), step):
        at = slice(low, low + step)
        row, column = np.nonzero(alphabet > letters[at, None])
        power = words.powers(int(places[at].max()) + 1)[0][places[at]]
        sums = (whole[at] - term[at])[row] + drawn[column] * power[row]
        size = sizes[owner[at]][row]
        yield owner[at][row], key(sums, size), size, places[at][row]


def alphabet_of(vocabulary: DataFrame) -> np.ndarray:
    """The sorted code points of all words; there are at most as many as Unicode has."""

    def run(batches):
        seen = np.zeros(0, np.uint32)
        for batch in batches:
            seen = np.union1d(seen, letters_of(batch.column("word"))[0])
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64))], ["letter"])

    rows = vocabulary.select("word").mapInArrow(run, "letter long").distinct().toArrow()
    return np.sort(rows.column("letter").to_numpy()).astype(np.uint32)


def hits(vocabulary: DataFrame, filters: Filters, number: int, alphabet: np.ndarray) -> DataFrame:
    """``key, other, other_size, place`` of the edits that a slice's filters hold."""
    kept = vocabulary.sparkSession.sparkContext.broadcast(filled(vocabulary, filters, number))

    def run(batches):
        for batch in batches:
            letters, sizes = letters_of(batch.column("word"))
            own = batch.column("key").to_numpy()
            for owner, keys, size, place in edits(letters, sizes, alphabet):
                if filters.slices > 1:
                    mine = filters.slice_of(keys) == number
                    owner, keys, size, place = owner[mine], keys[mine], size[mine], place[mine]
                block, bits = filters.place(keys, size)
                hit = (kept.value[block] & bits) == bits
                columns = [own[owner[hit]], keys[hit].view(np.int64), size[hit], place[hit]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "other", "other_size", "place"])

    return vocabulary.select("word", "key").mapInArrow(run, "key long, other long, other_size long, place long")


def near(vocabulary: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, other, other_n``: every word of ``vocabulary(word, n, size, key)`` with each that one edit makes of it."""
    short = F.least("size", F.lit(LENGTHS - 1)).alias("length")
    filters = Filters({r.length: r["count"] for r in vocabulary.groupBy(short).count().collect()})
    alphabet = alphabet_of(vocabulary)
    found = [scratch.keep(hits(vocabulary, filters, number, alphabet)) for number in range(filters.slices)]
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    others = vocabulary.select(F.col("key").alias("other"), F.col("size").alias("other_size"), F.col("word").alias("other_word"), F.col("n").alias("other_n"))
    pairs = every.join(others, ["other", "other_size"]).join(vocabulary.select("key", "word", "n", "size"), "key")
    # Both words agree before and behind the place; one of them has a letter less there, or another one.
    agree = "left(word, int(place)) = left(other_word, int(place)) AND substring(word, int(place) + 2) = substring(other_word, int(place) + 1 + IF(size = other_size, 1, 0))"
    pairs = scratch.keep(pairs.where(agree).where("word <> other_word AND size - other_size IN (0, 1)").select("word", "n", "other_word", "other_n").distinct())
    return pairs.select("word", F.col("other_word").alias("other"), "other_n").unionAll(pairs.select(F.col("other_word").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """``word, root`` for ``forms(word, form)``, which hold no circle: where forms lead to, by doubling the steps."""
    steps = scratch.keep(forms.select("word", F.col("form").alias("root")))
    while True:
        after = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = scratch.keep(steps.join(after, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if not steps.agg(F.max("moved")).first()[0]:
            return steps.select("word", "root")
        steps = steps.select("word", "root")


def variants(occurrences: DataFrame, word: str = "word", least: int = 5, shortest: int = 6, ratio: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word with ``shortest`` code points that occurs ``least`` times.

    ``occurrences`` has a row for each occurrence of a ``word``; null ones do not count, repeated rows do,
    other columns are not looked at, and an empty table gives an empty result. ``n_near`` is the number of
    listed words that differ by exactly one code point inserted, deleted or replaced. The ``form`` is the
    one of them that occurs most often (of equals the first in code-point order) if it does so at least
    ``ratio`` times as often as the word, else null; ``form_n`` is how often. ``root`` is the last of the
    forms that lead on from each other, the word itself if it has none. ``ratio`` must be above 1.
    """
    if ratio <= 1:
        raise ValueError("forms lead to more frequent words only if the ratio is above 1")
    counts = occurrences.select(F.col(word).alias("word")).where(f"length(word) >= {int(shortest)}").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    with Scratch(occurrences.sparkSession) as scratch:
        vocabulary = scratch.keep(keyed(counts.where(F.col("n") >= least)))
        best = near(vocabulary, scratch).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("back"), "other")).alias("best"))
        often = F.expr(f"-best.back >= {int(ratio)} * n")
        formed = vocabulary.select("word", "n").join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(often, F.col("best.other")).alias("form"),
            F.when(often, -F.col("best.back")).alias("form_n"),
        )
        formed = scratch.keep(formed)
        ends = roots(formed.where("form IS NOT NULL"), scratch)
        return cut(formed.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
