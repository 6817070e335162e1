"""Byte-level BPE against the tiktoken library."""

import functools
import hashlib
import random
import sys

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from indicatrix.llm import byte_bpe
from indicatrix.llm.queries import QUERIES, RANKS
from tests.conftest import SMALL

NAMES = ["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"]


@functools.cache
def library(path):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    path = public_tokenizers.path(request.param)
    return byte_bpe.codec(path, public_tokenizers.PATTERN), library(path)


def ids(codec, text):
    raw = codec.encode(text)
    return [int.from_bytes(raw[i : i + 4], sys.byteorder) for i in range(0, len(raw), 4)]


def test_every_token_of_the_vocabulary(both):
    ours, theirs = both
    for token in ours.ranks:
        text = token.decode("utf-8", "replace")
        assert ids(ours, text) == theirs.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(text=st.text(max_size=80))
def test_any_text(text):
    path = public_tokenizers.path(NAMES[0])
    ours, theirs = byte_bpe.codec(path, public_tokenizers.PATTERN), library(path)
    assert ids(ours, text) == theirs.encode_ordinary(text)
    assert b"".join(ours.bytes_of[i] for i in ids(ours, text)) == text.encode()


def test_long_pieces_and_repeats(both):
    ours, theirs = both
    draw = random.Random(1)
    for alphabet in ("a", "ab", "aaab", "the", "abcdefghijklmnopqrstuvwxyz", "éèà", "日本語中文", " \n\t", "0123456789", "=-+/"):
        for size in (1, 7, 60, 500, 3000):
            text = "".join(draw.choice(alphabet) for _ in range(size))
            assert ids(ours, text) == theirs.encode_ordinary(text)


def test_a_very_long_piece_is_linear(both):
    ours, theirs = both
    text = "ab" * 100_000
    assert b"".join(ours.bytes_of[i] for i in ids(ours, text)) == text.encode()


def test_memory_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 2 * byte_bpe.ENTRY)
    memo = byte_bpe.Memo(str.upper)
    assert [memo[c] for c in "abcab"] == list("ABCAB") and len(memo) <= 2 and memo.held <= byte_bpe.REMEMBERED


def test_query(spark):
    theirs = library(RANKS)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op10_byte_bpe"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = theirs.encode_ordinary(texts[row.doc_id])
        digest = hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert (row.n_tokens, row.ids_sha256) == (len(want), digest)
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    rows = spark.createDataFrame([(1, None, "x", 5), (1, "", None, 6), (None, "a b", "y", 7), (None, "a b", "y", 7)], "doc_id long, text string, ids string, decoded int")
    encoded = byte_bpe.encode(rows, RANKS, public_tokenizers.PATTERN)
    got = byte_bpe.decode(encoded, RANKS).collect()
    assert [len(r.ids) for r in got] == [0, 0, 2, 2]
    assert [bytes(r.decoded) for r in got] == [b"", b"", b"a b", b"a b"]
    assert byte_bpe.encode(rows.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_round_trip_is_encode_and_decode(spark, monkeypatch):
    monkeypatch.setattr(byte_bpe, "AT_ONCE", 3)
    texts = [None, "", "a b", "a b", "日本語 " * 200, "x" * 5000, "\u0000 \r\n"]
    rows = spark.createDataFrame([(i, t, "x", 5, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded int, ids_and_decoded string")
    want = byte_bpe.decode(byte_bpe.encode(rows, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    got = byte_bpe.round_trip(rows, RANKS, public_tokenizers.PATTERN).collect()
    assert [(r.doc_id, r.ids, bytes(r.decoded), r.ids_and_decoded) for r in got] == [(r.doc_id, r.ids, bytes(r.decoded), "c") for r in want]
    assert byte_bpe.round_trip(rows.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0
