"""Ordinal regression: gradient, order of offsets, held-out documents."""

import zlib

import numpy as np

from indicatrix.llm import toxicity
from indicatrix.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.1"


def chances(weights, offsets, rows, columns, n):
    total = np.bincount(rows, weights[columns], n)
    return 1 / (1 + np.exp(offsets[None, :] - total[:, None]))


def test_fit_recovers_an_ordered_model():
    draw = np.random.default_rng(3)
    n, features = 6000, 12
    present = draw.random((n, features)) < 0.4
    weights, offsets = draw.normal(0, 1.5, features), np.array([1.0, 2.5, 4.0])
    above = 1 / (1 + np.exp(offsets[None, :] - (present @ weights)[:, None]))
    grades = (draw.random(n)[:, None] < above).sum(axis=1)
    rows, columns = np.nonzero(present)
    got, edges = toxicity.fit(rows, columns, grades, features)
    assert (np.diff(edges) > 0).all()
    assert abs(got - weights).max() < 0.35 and abs(edges - offsets).max() < 0.4
    # The gradient of the penalised likelihood vanishes: moving any weight makes it worse.
    def value(w):
        p = np.concatenate([np.ones((n, 1)), chances(w, edges, rows, columns, n), np.zeros((n, 1))], axis=1)
        return -np.log(p[np.arange(n), grades] - p[np.arange(n), grades + 1]).sum() + toxicity.PENALTY * (w**2).sum() / 2
    for i in range(features):
        for delta in (0.05, -0.05):
            moved = got.copy()
            moved[i] += delta
            assert value(moved) > value(got)


def test_held_out_documents(spark):
    """Half the labels train; of the other half, texts with a planted insult are found and clean ones left alone."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    half = labels.where("crc32(CAST(doc_id AS STRING)) % 2 = 0")
    model = toxicity.train(docs, half)
    truth = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 2}
    rows = {r.doc_id: r for r in toxicity.grade(docs, model).collect() if r.doc_id in truth}
    insults = {"idiot", "moron", "trash", "scum", "worthless", "stupid", "clown", "loser", "disgusting", "pathetic"}
    clear = [d for d in truth if truth[d] and insults & toxicity.words_of(rows[d].text)]
    clean = [d for d in truth if not truth[d]]
    assert len(clear) > 100 and np.mean([rows[d].toxicity.toxic for d in clear]) > 0.95
    assert np.mean([rows[d].toxicity.toxic for d in clean]) < 0.01
    assert all(0 <= r.toxicity.severity <= 3 and r.toxicity.chances == sorted(r.toxicity.chances, reverse=True) for r in rows.values())


def test_query(spark):
    rows = QUERIES["op3_toxicity"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000 and all(abs(r.severity - sum(r.chances)) < 1e-9 for r in rows)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "bad", 1, "x"), (1, None, 1, "x"), (1, "", 1, "x"), (2, "Bad é " * 20_000, 1, "x")], "doc_id long, text string, toxicity int, grade string")
    labels = spark.createDataFrame([(1, 1, None), (1, 1, 1), (None, 1, 1), (2, None, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    for known in (labels, labels.where("false"), labels.where("toxic = 1"), labels.where("toxic = 0")):
        got = toxicity.grade(docs, toxicity.train(docs, known)).collect()
        assert len(got) == 4 and all(0 <= r.toxicity.severity <= 3 and r.grade == "x" for r in got)
    model = toxicity.Model(["bad"], np.array([3.0]), np.array([1.0, 2.0]))
    assert [r.toxicity.toxic for r in toxicity.grade(docs, model).collect()] == [True, False, False, True]
    assert toxicity.grade(docs.where("false"), model).count() == 0
