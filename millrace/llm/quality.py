"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader.

Each text is the damped counts of its hashed word n-grams, scaled to unit length; a score is the logistic function
of a sparse dot product. Weights follow from the per-coordinate sums of gradients, with L1 and L2 penalties. The model
is fitted on a bounded sample (``SAMPLE`` labelled rows, by hash of the id); every row is scored on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean
from .langid import held_out
from .ngrams import word_ngrams

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 6000
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, x = features(text or "")
        return _logistic(self.bias + float(self.weights[at] @ x))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values, of unit length unless the text is empty."""
    at, n = word_ngrams(text, BITS)
    x = np.log1p(n).astype(np.float32)
    return at, x / (np.sqrt(x @ x) or 1.0)


def _logistic(x: float) -> float:
    return float(1 / (1 + np.exp(-min(35.0, max(-35.0, x)))))


class Ftrl:
    """Follow the regularised leader, proximal form, one coordinate for each bucket and one for the bias."""

    def __init__(self, size: int) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        x = np.append(x, 1.0)
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = (_logistic(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] += g * g


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """``docs``: doc_id, text. ``labels``: doc_id, quality (0 or 1; others are passed over). Of rows that repeat an id the
    one of least text is learned from, so the driver gets at most ``limit`` rows."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))
    picked = good.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    marks = {r[0]: r[1] for r in picked.collect()}  # at most ``limit``

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "") for t in batch.column(1).to_pylist()]
            cells, values = pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), cells, values], ["doc_id", "cells", "x"])

    machine = Ftrl(1 << BITS)
    if marks:
        rows = docs.where(F.col("doc_id").isin(*marks)).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
        found = rows.mapInArrow(lean(run), "doc_id long, cells array<int>, x array<float>").toArrow()
        texts = [(i, c.values.to_numpy(), x.values.to_numpy()) for i, c, x in zip(found.column(0).to_pylist(), found.column(1), found.column(2))]
        texts.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
        rng = np.random.default_rng(9)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(texts)).tolist():
                machine.learn(*texts[i][1:], marks[texts[i][0]])
    w = machine.weights(np.arange((1 << BITS) + 1))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of ``docs``; a null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: 2**BITS floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.score(t.as_py()) for t in batch.column(1)], pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, score, predicted. Learns from labels whose id is not held
    out (crc32 of the id modulo 3 is 1).

    Null and empty texts get the score of the bias alone; without labels every score is 0.5; of several labels of
    one id the smaller counts; rows without an id are scored but not learned from; repeated rows are scored alike and
    learned from once; very long texts are scored whole; other columns are ignored."""
    out = held_out(F.col("doc_id"), 3, 1)
    model = fit(docs.where(~out), labels.where(~out), **options)
    found = scores(docs, model)
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
