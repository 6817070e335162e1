"""Language profiles: bundling against plain loops, accuracy on rows never learnt from."""

import zlib

import numpy as np
import pyarrow as pa

from indicatrix.llm import language_id
from indicatrix.llm.queries import QUERIES


def plain(text):
    """The bundled vector of a text, one run at a time."""
    letters, gap = [], True
    letters.append(0)
    for c in text:
        if c.isalpha():
            letters.append(ord(c.lower()) if len(c.lower()) == 1 else ord(c))
            gap = False
        elif not gap:
            letters.append(0)
            gap = True
    if not gap:
        letters.append(0)
    out = np.zeros(language_id.DIMENSIONS)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        x, y, z = (language_id.letter_vectors(np.array([v]))[0].astype(int) for v in (a, b, c))
        out += np.roll(x, 2) * np.roll(y, 1) * z
    return out


def test_bundles(monkeypatch):
    texts = ["", "1 2 - 3", "a", "Éa b!", "the thick thé", "日本語 ab", "x" * 500]
    assert (language_id.bundles(texts) == np.stack([plain(t) for t in texts])).all()
    monkeypatch.setattr(language_id, "CELLS", 3)
    monkeypatch.setattr(language_id, "SLICE", 2)
    assert (language_id.bundles(texts) == np.stack([plain(t) for t in texts])).all()


def test_many_letters():
    texts = ["".join(chr(0x4E00 + i) for i in range(300)), "abc"]
    assert (language_id.bundles(texts) == np.stack([plain(t) for t in texts])).all()


def test_letter_vectors_are_nearly_orthogonal():
    vectors = language_id.letter_vectors(np.arange(97, 123)).astype(int)
    cosines = vectors @ vectors.T / language_id.DIMENSIONS - np.eye(26)
    assert abs(cosines).max() < 0.16 and set(np.unique(vectors)) == {-1, 1}


def test_chunks():
    texts = pa.array(["a" * 700_000, None, "b" * 700_000, "c"])
    assert [(first, len(held)) for first, held in language_id.chunked(texts)] == [(0, 2), (2, 2)]
    assert list(language_id.chunked(pa.array([], pa.string()))) == [(0, [])]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op4_language_id"](spark, folder).collect()
    assert len(rows) == len(langs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert len(judged) > 250
    assert sum(r.lang_pred == langs[r.doc_id] for r in judged) / len(judged) > 0.97


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, language int, value string"
    rows = [(0, "der die das und", "de", 1, "x"), (1, "the and that with", "en", 1, "x"), (2, "the that", None, 1, "x"), (None, None, "de", 1, "x"), (4, "123 !", "en", 1, "x"), (4, "", "en", 1, "x")]
    docs = spark.createDataFrame(rows, schema)
    got = language_id.predict(docs, language_id.learn(docs)).collect()
    assert [r.language.lang_pred for r in got] == ["de", "en", "en", "und", "und", "und"]
    assert [r.value for r in got] == ["x"] * 6
    nothing = language_id.predict(docs, language_id.learn(docs.where("false"))).collect()
    assert {tuple(r.language) for r in nothing} == {("und", 0.0)}
    assert language_id.identify(docs.where("false")).count() == 0
