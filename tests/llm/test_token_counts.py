"""Count-only Viterbi against the unigram model of a public library and against all paths."""

import functools
import itertools

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models

from indicatrix.llm import token_counts
from indicatrix.llm.queries import QUERIES
from tests.conftest import SMALL

PATH = public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def unigram():
    """The public library's model with the same pieces and scores."""
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    vocabulary = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))


def theirs(text):
    return len(unigram().encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def test_library_on_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: theirs(r.text or "") for r in docs}
    got = {r.doc_id: r.n_tokens for r in QUERIES["op8_token_counts"](spark, SMALL).collect()}
    assert got == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_library_on_any_text(text):
    assert token_counts.counter(PATH).of(text) == theirs(text)


def paths(text, pieces, known):
    """Every path as (score, starts of its pieces, count), for short texts."""
    if not text:
        yield 0.0, (), 0
        return
    for cut in range(len(text)):
        last = text[cut:]
        step = pieces.get(last, known.unknown if len(last) == 1 else None)
        if step is not None:
            for score, starts, count in paths(text[:cut], pieces, known):
                yield score + step, (*starts, cut), count + 1


@pytest.mark.parametrize("scores", [(-1.0, -2.0, -2.0, -3.0), (-1.0, -1.0, -2.0, -2.0), (-1.0, -2.0, -3.0, -1.0)])
def test_ties(scores):
    pieces = dict(zip(("a", "b", "ab", "aba"), scores))
    known = token_counts.Counter(pieces, byte_fallback=False)
    for size in range(1, 8):
        for letters in itertools.product("abx", repeat=size):
            text = "".join(letters)
            # Of equal scores the last piece begins as early as it can, then the one before it, and so on.
            best = min(paths(text, pieces, known), key=lambda p: (-p[0], p[1][::-1]))
            assert known.best_path(text) == best[2]


def test_odd_rows(spark):
    rows = [(None, None, "x"), (1, "", "y"), (2, " ", None), (2, " ", None), (3, "a" * 50_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts.count_tokens(docs, PATH)
    assert got.columns == ["doc_id", "text", "n_tokens"]
    assert [r.n_tokens for r in got.collect()][:2] == [0, 0] and got.where("doc_id = 2").distinct().count() == 1
    assert token_counts.count_tokens(docs.where("false"), PATH).count() == 0


def test_dependent_pieces_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter({"a▁": -1.0}, False)
