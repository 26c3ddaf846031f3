"""Quality scores by Bradley-Terry pairwise ranking.

A document's score is linear in features of its text. The weights come from preference pairs, a document
labelled 1 before one labelled 0, by logistic loss on the differences of their features. The threshold is
a quantile of the training scores; it becomes 0.5 on the scale from 0 to 1.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import arrow_map

#: Labelled documents that the model is fitted on at most (the smallest by hash), preference pairs drawn, penalty, steps.
MAX_TRAIN, PAIRS, PENALTY, STEPS = 20_000, 60_000, 1e-4, 60
#: Held out: crc32 of the id as text leaves this remainder.
FOLDS, HELD_OUT = 3, 1

_PUNCTUATION = [ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]


def features(text: str | None) -> np.ndarray:
    """Features of a whole text: sizes, shares of kinds of characters, and how words and lines repeat. All 0 without text."""
    data = (text or "").encode()
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256).astype(np.float64)
    n = max(1, len(data))
    words, lines = data.split(), data.split(b"\n")
    w = max(1, len(words))
    letters, upper, digits, wide, newline = counts[97:123].sum(), counts[65:91].sum(), counts[48:58].sum(), counts[128:].sum(), counts[10]
    marks = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    seen = len(set(words))
    full = [x for x in lines if x.strip()]
    m = max(1, len(full))
    ends = b"".join([x[-1:] for x in words])
    shares = [letters, upper, digits, wide, newline, marks, counts[32], counts[:9].sum() + counts[11:32].sum(), *counts[_PUNCTUATION]]
    own = [
        math.log1p(len(data)),
        math.log1p(len(words)),
        math.log1p(len(lines)),
        len(data) / w / 10,
        seen / w,
        math.log1p(seen),
        len(set(full)) / m,
        math.log1p(len(data) / m),
        upper / max(1.0, letters + upper),
        sum(map(ends.count, (b".", b"!", b"?"))) / w,
        sum(map(ends.count, (b"%", b"&", b"*", b"#", b"$", b"|"))) / w,
        ends.count(b",") / w,
        float(not words),
    ]
    return np.concatenate([np.sqrt(np.array(shares) / n), own]) if words else np.zeros(len(shares) + len(own))


class Ranking:
    """A fitted scorer: score = sigmoid(weights . standardised features - threshold)."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, weights: np.ndarray, threshold: float):
        self.mean, self.spread, self.weights, self.threshold = mean, spread, weights, threshold

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.threshold, -50, 50)))


def fit(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, penalty: float = PENALTY, steps: int = STEPS) -> Ranking:
    """Weights from pairs (label 1 before label 0) by Newton steps; the threshold at the quantile of the scores that errs least.

    Without pairs (no rows, or one label alone) all weights are 0; every score is 0.5 then.
    """
    mean, spread = (x.mean(axis=0), x.std(axis=0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    spread = np.where(spread > 1e-9, spread, 1.0)
    z, good, bad = (x - mean) / spread, np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w = np.zeros(x.shape[1])
    if not len(good) or not len(bad):
        return Ranking(mean, spread, w, 0.0)
    draws = np.random.default_rng(1)
    d = z[draws.choice(good, pairs)] - z[draws.choice(bad, pairs)]
    for _ in range(steps):
        p = 1 / (1 + np.exp(np.clip(d @ w, -50, 50)))  # of the pair the wrong way round
        slope = d.T @ p / pairs - penalty * w
        curve = (d * (p * (1 - p))[:, None]).T @ d / pairs + (penalty + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ w
    share = len(bad) / (len(good) + len(bad))
    cuts = np.unique(np.r_[share, np.linspace(0.005, 0.995, 199)])
    levels = np.quantile(raw, cuts)
    order = np.sort(raw[label == 0]), np.sort(raw[label == 1])
    wrong = (len(order[0]) - np.searchsorted(order[0], levels)) / len(order[0]) + np.searchsorted(order[1], levels) / len(order[1])
    best = min(range(len(cuts)), key=lambda i: (round(float(wrong[i]), 9), abs(cuts[i] - share)))
    below, above = raw[raw < levels[best]], raw[raw >= levels[best]]
    threshold = (below.max() + above.min()) / 2 if len(below) and len(above) else float(levels[best])
    return Ranking(mean, spread, w, float(threshold))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Ranking:
    """Fit on the labelled documents that are not held out, max_train at most. Null ids and labels take no part; an id on several rows gives one, that of the least features."""
    known = labels.select(F.col("doc_id").cast("long").alias("of"), F.col("quality").cast("int").alias("y")).filter(F.col("of").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("of"))).distinct()
    some = known.orderBy(F.xxhash64("of"), "of", "y").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("of")).select("of", "y", "text")  # max_train rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([features(t).tobytes() for t in part.column(2).to_pylist()], pa.binary())], names=["of", "y", "x"])

    seen = arrow_map(rows, run, "of long, y int, x binary")
    found = seen.groupBy("of", "y").agg(F.min("x").alias("x")).select("y", "x").toArrow()  # max_train rows at most, however often an id stands in docs
    y = np.array(found.column("y").to_pylist(), np.int64)
    x = np.array([np.frombuffer(b) for b in found.column("x").to_pylist()]).reshape(len(y), len(features("")))
    order = np.lexsort((*x.T[::-1], y))  # the order of rows must not matter
    return fit(x[order], y[order])


def scorer(model: Ranking) -> Callable[[list], np.ndarray]:
    def score(texts: list) -> np.ndarray:
        return model.scores(np.array([features(t) for t in texts]).reshape(len(texts), -1)) if texts else np.zeros(0)

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, score, predicted (1 if score >= 0.5).

    Scores hang on the text alone; null counts as empty, and empty texts get the score of a text without
    words. Null ids are not held out. Without labels of both kinds every score is 0.5. Rows that repeat in
    docs are scored each; in the fit an id and label count once. An empty table gives an empty result; other columns are ignored.
    """
    score = scorer(train(docs, labels, max_train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score(part.column(2).to_pylist()), pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """docs, all columns, without the rows that are predicted 0.

    Null and empty texts count as texts without words and go or stay all alike; so do rows that repeat.
    Null ids are scored as others; without labels of both kinds all rows stay; an empty table stays empty; other columns,
    whatever their names, pass through; a text of any length is read whole.
    """
    score = scorer(train(docs, labels, max_train))
    at_text = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                yield part.filter(pa.array(score(part.column(at_text).to_pylist()) >= 0.5))

    return arrow_map(docs, run, docs.schema)
