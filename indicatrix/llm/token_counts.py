"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton enumerates every vocabulary match of a segment, ordered by its end and, for
one end, from the longest match to the shortest. A single pass carries, for each position, the best
score and the number of pieces of the path that has it. A later path replaces an earlier one only with
a strictly better score, so of equal paths the one whose last piece begins first stays, as in the
public unigram tokenizers. No piece of the vocabulary reaches from a non-space into a space, so the
best path of a text is that of its segments, and the counts of short segments are remembered.
"""

from __future__ import annotations

import functools

import ahocorasick
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import whole

SPACE = "▁"  # fixed value: stands for a space in the vocabulary
UNKNOWN_PENALTY = 10.0  # fixed value: an unknown character scores this much below the worst piece
REMEMBERED = 200_000  # segments held by a task; beyond it memory starts anew
SHORT = 48  # characters of the longest segment that is remembered


class Counter(dict):
    """Segment -> number of tokens, remembered for short segments."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        for piece in pieces:
            if SPACE in piece.lstrip(SPACE):
                raise ValueError("a piece has a space behind another character, so segments are not independent")
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.characters = {piece for piece in pieces if len(piece) == 1}
        self.matches = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.segments = regex.compile(f"{SPACE}+[^{SPACE}]*+|[^{SPACE}]++").findall

    def __missing__(self, segment: str) -> int:
        count = self.best_path(segment)
        if len(segment) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[segment] = count
        return count

    def best_path(self, segment: str) -> int:
        """The number of tokens on the best path through one segment."""
        score, count = [0.0] * (len(segment) + 1), [-1] * (len(segment) + 1)
        count[0] = 0
        done = 0  # positions up to here are final

        def close(upto: int) -> None:
            """Offer the unknown step at each position whose character is no piece, after all matches that end there."""
            for end in range(done + 1, upto + 1):
                character = segment[end - 1]
                if character not in self.characters:
                    offer = score[end - 1] + self.unknown
                    if count[end] < 0 or offer > score[end]:
                        score[end] = offer
                        count[end] = count[end - 1] + (len(character.encode()) if self.byte_fallback else 1)

        for last, (length, value) in self.matches.iter(segment):
            if last > done:
                close(last)
                done = last
            end = last + 1
            offer = score[end - length] + value
            if count[end] < 0 or offer > score[end]:
                score[end] = offer
                count[end] = count[end - length] + 1
        close(len(segment))
        return count[-1]

    def of(self, text: str) -> int:
        """Tokens of a whole text: spaces become the space mark, one mark is put in front; no text has no tokens."""
        if not text:
            return 0
        return sum(map(self.__getitem__, self.segments(SPACE + text.replace(" ", SPACE))))


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One counter for each Python worker and vocabulary; only ordinary pieces are matched."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    ordinary = (i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    pieces = {model.id_to_piece(i): model.get_score(i) for i in ordinary}
    return Counter(pieces, any(model.is_byte(i) for i in ids))


def count_tokens(docs: DataFrame, path: str, text: str = "text", count: str = "n_tokens") -> DataFrame:
    """``docs`` with a bigint column ``n_tokens``: the tokens of each whole text.

    The vocabulary file gives pieces and scores; a character that no piece covers counts as its UTF-8
    bytes where the vocabulary has byte pieces, else as one token. A null or empty text has no tokens;
    repeated rows are counted each, and an empty table stays empty. All other columns stay; a column of the name ``n_tokens`` is replaced.
    """

    @F.arrow_udf("bigint")
    def counted(texts: pa.Array) -> pa.Array:
        known = counter(path)
        return pa.array([known.of(one.as_py()) for one in texts], pa.int64())

    return docs.withColumn(count, counted(whole(text)))
