"""Byte-level BPE: greedy longest matches with backtracking, linear in the length of the text.

Bytes are read as Latin-1 characters, so a pyahocorasick automaton over the vocabulary finds every
token that begins at a position. The encoder takes the longest one whose meeting with the token
before it could also come from the merges; if none fits, it takes the token before back and goes on
with its next shorter prefix. Whether two adjacent tokens are compatible is decided by undoing merges
at their seam and is remembered. This gives what merging by rank gives, without a merge loop.
"""

from __future__ import annotations

import base64
import functools
from array import array
from typing import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import release, whole

REMEMBERED = 64 << 20  # bytes of pieces, and of pairs of tokens, held by a task; beyond it memory starts anew
ENTRY = 200  # bytes that the interpreter takes for an entry besides a piece and its ids
SHORT = 48  # characters of the longest piece that is remembered
AT_ONCE = 1 << 16  # ids that are decoded at once


class Memo(dict):
    """A dictionary that fills itself and starts anew when its entries take ``REMEMBERED`` bytes."""

    def __init__(self, make, cost=lambda key, value: ENTRY, worth=lambda key: True):
        self.make, self.cost, self.worth, self.held = make, cost, worth, 0

    def __missing__(self, key):
        value = self.make(key)
        if self.worth(key):
            self.held += self.cost(key, value)
            if self.held > REMEMBERED:
                self.clear()
                self.held = self.cost(key, value)
            self[key] = value
        return value


class Codec:
    """The encoder for the ranks of one vocabulary file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.lengths: dict[int, int] = {}  # of the tokens that merges lead to
        self.shorter: dict[int, int | None] = {}  # the longest of them that a token begins with
        self.compatible = Memo(lambda pair: self.seam_holds(*pair))
        self.words = ahocorasick.Automaton()
        for rank in sorted(self.bytes_of):
            token = self.bytes_of[rank]
            if len(token) > 1:
                pair = self.last_merge(token, rank)
                if pair is None:  # no merges lead to it: only a piece that equals it becomes it
                    continue
                self.halves[rank], self.joined[pair] = pair, rank
            self.words.add_word(token.decode("latin-1"), rank)
            self.lengths[rank] = len(token)
        for rank, size in self.lengths.items():
            prefixes = (self.ranks.get(self.bytes_of[rank][:end]) for end in range(size - 1, 0, -1))
            self.shorter[rank] = next((prefix for prefix in prefixes if prefix in self.lengths), None)
        self.words.make_automaton()
        self.pieces = Memo(lambda piece: self.encode_piece(piece.encode()), lambda piece, ids: ENTRY + 4 * len(piece) + len(ids), lambda piece: len(piece) <= SHORT)

    def last_merge(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives ``token``: what lower ranks make of its bytes."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            merges = [(self.ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))]
            lowest, at = min(merges)
            if lowest >= rank:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def seam_holds(self, left: int, right: int) -> bool:
        """Whether merging by rank can leave ``left`` and ``right`` side by side.

        Merges are undone from the latest to the earliest. At each point the two tokens at the seam
        must not merge with each other before the merge that was undone last takes one of them away;
        of equal ranks the merge further left comes first.
        """
        bound = float("inf")
        while True:
            if self.joined.get((left, right), bound) < bound:
                return False
            undo_left = left in self.halves and (left > right or right not in self.halves)
            if undo_left:
                bound, left = left, self.halves[left][1]
            elif right in self.halves:
                bound, right = right + 1, self.halves[right][0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> bytes:
        """The ids of one piece as 32-bit integers."""
        if piece in self.ranks:
            return array("i", [self.ranks[piece]]).tobytes()
        letters = piece.decode("latin-1")
        greedy = [token for _, token in self.words.iter_long(letters)]
        compatible = self.compatible
        for place, pair in enumerate(zip(greedy, greedy[1:])):
            if not compatible[pair]:
                return self.backtracked(letters, greedy, place + 1)
        return array("i", greedy).tobytes()

    def backtracked(self, letters: str, greedy: list[int], fits: int) -> bytes:
        """The ids of a piece whose longest matches do not all fit; the first ``fits`` of them do."""
        lengths, shorter, compatible = self.lengths, self.shorter, self.compatible
        tokens, size = greedy[:fits], len(letters)
        at = sum(map(lengths.__getitem__, tokens))
        taken_back = bytearray(size + 1)  # ends from which no way on was found
        token = shorter[greedy[fits]]
        while at < size:
            if token is None:
                taken_back[at] = 1
                token = tokens.pop()
                at -= lengths[token]
            after = at + lengths[token]
            if not taken_back[after] and (not tokens or compatible[tokens[-1], token]):
                tokens.append(token)
                at = after
                token = self.longest(letters, at) if at < size else None
            else:
                token = shorter[token]
        return array("i", tokens).tobytes()

    def longest(self, letters: str, at: int) -> int:
        """The longest token that begins at a place."""
        return next(self.words.iter_long(letters, at))[1]

    def forget(self) -> None:
        """Free what was remembered: a worker that idles, or goes on with another stage, holds the vocabulary alone."""
        for memo in (self.pieces, self.compatible):
            memo.clear()
            memo.held = 0
        release()

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.split(text)))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@functools.lru_cache(maxsize=2)
def tokens_of(path: str) -> dict[int, bytes]:
    """The bytes of each token: all that decoding needs."""
    return {rank: token for token, rank in read_ranks(path).items()}


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One encoder for each Python worker and vocabulary."""
    return Codec(read_ranks(path), pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column ``ids`` of type array<int>: the token ids of each whole text.

    A null text counts as empty; an empty text has no ids; of repeated rows each has its ids; an empty
    table stays empty. All other columns stay; a column of the name ``ids`` is replaced. ``path`` must
    name the vocabulary file on every executor.
    """

    @F.arrow_udf("array<int>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = codec(path, pattern)
        try:
            for texts in batches:
                parts = [known.encode(text.as_py()) for text in texts]
                ends = np.cumsum([0, *map(len, parts)]) // 4
                flat = np.frombuffer(b"".join(parts), np.int32)
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
        finally:
            known.forget()

    return docs.withColumn(ids, encoded(whole(text)))


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with what :func:`encode` and then :func:`decode` add, from one worker with one vocabulary.

    Null, empty and repeated texts, other columns and empty tables as there.
    """
    both = f"{ids}_and_{decoded}"
    while both in docs.columns:
        both += "_"

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = codec(path, pattern)
        token = known.bytes_of.__getitem__
        try:
            for texts in batches:
                lists, back = [], []
                for text in texts:
                    lists.append(known.encode(text.as_py()))
                    own = np.frombuffer(lists[-1], np.int32)
                    back.append(b"".join([b"".join(map(token, own[i : i + AT_ONCE].tolist())) for i in range(0, len(own), AT_ONCE)]))
                ends = np.cumsum([0, *map(len, lists)]) // 4
                flat = pa.array(np.frombuffer(b"".join(lists), np.int32), pa.int32())
                yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.array(back, pa.binary())], ["ids", "decoded"])
        finally:
            known.forget()

    rows = docs.withColumn(both, coded(whole(text)))
    return rows.withColumns({ids: F.col(both)["ids"], decoded: F.col(both)["decoded"]}).drop(both)


def decode(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``rows`` with a binary column ``decoded``: the bytes the ids stand for. Null ids give empty bytes."""

    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        token = tokens_of(path).__getitem__
        return pa.array([b"".join(map(token, one.as_py() or ())) for one in lists], pa.binary())

    return rows.withColumn(decoded, joined(F.col(ids)))
