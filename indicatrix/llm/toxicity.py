"""Toxicity grades by cumulative-link ordinal regression.

Grades are ordered. For each threshold k, the chance of a grade above it is a logistic function of the
same weighted sum of features minus that threshold's own offset, so all thresholds share one weight
vector. Features are the presence of words, chosen by their association with the label. The result is
the expected grade.

Labels only say toxic or not. A training text that is not toxic has grade 0; a toxic one has grade 1,
and one more for each of ``STAGES`` that its number of different marks reaches. Marks are the words that
occur nearly only in toxic texts.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from indicatrix.llm.common import cut, whole

TRAIN_ROWS = 20_000  # the most labelled documents a model is fitted on: those with the least hash of their id
FEATURES = 2048  # the most words a model looks at
MIN_DOCS = 5  # different labelled texts of a grade above 0 that a word needs
MARK_SHARE = 0.8  # of the labelled texts with a word, from which it is a mark
STAGES = (2, 4)  # marks of a text from which its grade is 2 and 3
PENALTY = 0.1  # weight of the squared weights in the loss
STEPS = 1000  # the most of the optimiser
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """The different words of a text in lower case: runs of letters."""
    return set(WORD.findall(text.lower()))


class Model:
    """Weights of words and the offsets of the thresholds."""

    def __init__(self, words: list[str], weights: np.ndarray, offsets: np.ndarray):
        self.weights, self.offsets = dict(zip(words, weights.tolist())), offsets

    def above(self, total: float) -> np.ndarray:
        """The chance of a grade above each threshold."""
        return 1 / (1 + np.exp(np.clip(self.offsets - total, -500, 500)))

    def score(self, text: str) -> np.ndarray:
        return self.above(sum(self.weights[w] for w in self.weights.keys() & words_of(text)))


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets for documents given as places of their words, by accelerated gradient steps with backtracking.

    ``rows`` and ``columns`` are the document and the word of each entry. Offsets are kept in order by
    fitting the first one and the logarithms of the gaps. Each parameter is scaled by about its curvature.
    """
    levels = int(grades.max(initial=0))
    if not levels:
        return np.zeros(features), np.zeros(0)
    counts = np.array([(grades > k).mean() for k in range(levels)]).clip(1e-6, 1 - 1e-6)
    first = np.log((1 - counts) / counts)
    start = np.concatenate([np.zeros(features), first[:1], np.log(np.maximum(np.diff(first), 1e-3))])
    seen = np.concatenate([np.bincount(columns, minlength=features), [len(grades)], [(grades > 0).sum()] * (levels - 1)])
    scale = 1 / np.sqrt(seen / 4 + PENALTY)
    start /= scale

    def unpack(x):
        x = x * scale
        return x[:features], x[features] + np.concatenate([[0.0], np.cumsum(np.exp(x[features + 1 :]))])

    def loss(x):
        weights, offsets = unpack(x)
        total = np.bincount(rows, weights[columns], len(grades))
        edges = np.concatenate([[-np.inf], offsets, [np.inf]])
        low, high = edges[grades] - total, edges[grades + 1] - total
        below = [1 / (1 + np.exp(-np.clip(v, -40, 40))) * np.isfinite(v) + (v == np.inf) for v in (low, high)]
        chance = np.maximum(below[1] - below[0], 1e-12)
        slope = [b * (1 - b) / chance for b in below]
        by_total = slope[1] - slope[0]  # derivative of the loss by the weighted sum
        by_offset = np.array([(slope[0] * (grades == k + 1)).sum() - (slope[1] * (grades == k)).sum() for k in range(levels)])
        tail = np.cumsum(by_offset[::-1])[::-1]
        gradient = np.concatenate([
            np.bincount(columns, by_total[rows], features) + PENALTY * weights, tail[:1], tail[1:] * np.diff(offsets),
        ]) * scale
        return -np.log(chance).sum() + PENALTY * (weights**2).sum() / 2, gradient

    x, ahead, pace, step = start, start, 1.0, 1.0
    value = loss(x)[0]
    for _ in range(STEPS):
        at, gradient = loss(ahead)
        while True:
            to = ahead - step * gradient
            reached = loss(to)[0]
            if reached <= at - step * (gradient @ gradient) / 2 or step < 1e-12:
                break
            step /= 2
        faster = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        if reached > value:  # the momentum overshot
            ahead, pace = x, 1.0
            continue
        ahead, done = to + (pace - 1) / faster * (to - x), value - reached < 1e-9 * abs(value)
        x, pace, value, step = to, faster, reached, step * 1.5
        if done:
            break
    return unpack(x)


def train(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``, ``toxic`` being 0 or 1.

    At most ``TRAIN_ROWS`` labelled documents are used; they are few enough to broadcast their labels,
    so ``docs`` are not shuffled. Rows without id or label are not used; of several labels of one id or
    one text the larger counts, and equal texts count once. Words are counted in Spark; the driver gets the
    chosen words and, for each training document, the places of its chosen words. From empty tables, or labels
    that say the same of all, comes a model that says that of every text; of no label, that none is toxic.
    """
    sample = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = cut(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS))

    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([sorted(words_of(one.as_py())) for one in texts], pa.list_(pa.string()))

    rows = docs.select("doc_id", whole(text).alias("text")).join(F.broadcast(sample), "doc_id")
    rows = rows.select("toxic", F.sha2("text", 256).alias("text"), words("text").alias("words"))
    rows = cut(rows.groupBy("text").agg(F.max("toxic").alias("toxic"), F.first("words").alias("words")))  # copies count once
    total = rows.agg(F.count(F.lit(1)).alias("all"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    if not total.bad or total.bad == total["all"]:
        return Model([], np.zeros(0), np.full(1, -np.inf if total.bad else np.inf))
    counts = rows.select("toxic", F.explode("words").alias("word")).groupBy("word")
    counts = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    share = total.bad / total["all"]
    lift = F.expr(f"(bad - n * {share}D) / sqrt(n * {share * (1 - share)}D)")  # deviations above what chance gives
    chosen = counts.where(F.col("bad") >= MIN_DOCS).where(lift > 3).orderBy(lift.desc(), "word").limit(FEATURES)
    chosen = chosen.collect()
    known = [r.word for r in chosen]
    mark = np.array([r.bad >= MARK_SHARE * r.n for r in chosen], bool)
    place = {word: i for i, word in enumerate(known)}

    @F.arrow_udf("array<int>")
    def placed(lists: pa.Array) -> pa.Array:
        return pa.array([[place[w] for w in one.as_py() if w in place] for one in lists], pa.list_(pa.int32()))

    got = rows.select("text", "toxic", placed("words").alias("places")).orderBy("text").toArrow()
    places = got["places"].to_pylist()
    entry = np.repeat(np.arange(len(places)), [len(own) for own in places])
    columns = np.array([p for own in places for p in own], np.int64)
    marks = np.bincount(entry, mark[columns], len(places))
    grades = got["toxic"].to_numpy() * (1 + np.searchsorted(STAGES, marks, "right"))
    weights, offsets = fit(entry, columns, grades, len(known))
    return Model(known, weights, offsets)


def grade(docs: DataFrame, model: Model, text: str = "text", into: str = "toxicity") -> DataFrame:
    """``docs`` with a struct ``toxicity(severity double, toxic boolean, chances array<double>)``.

    ``severity`` is the expected grade, ``chances`` those of a grade above each threshold, ``toxic``
    whether grade 0 is the less likely side of the first one. Null texts are empty and have no words.
    Rows are graded one by one, so repeated rows are graded alike and an empty table stays empty. All other
    columns stay; a column of the name ``toxicity`` is replaced.
    """

    @F.arrow_udf("struct<severity: double, toxic: boolean, chances: array<double>>")
    def graded(texts: pa.Array) -> pa.Array:
        chances = [model.score(one.as_py()).tolist() for one in texts]
        return pa.array([{"severity": sum(c), "toxic": c[0] >= 0.5, "chances": c} for c in chances], kind)

    kind = pa.struct([("severity", pa.float64()), ("toxic", pa.bool_()), ("chances", pa.list_(pa.float64()))])
    return docs.withColumn(into, graded(whole(text)))
