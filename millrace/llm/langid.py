"""Language identification by nearest centroid.

A text is the TF-IDF vector of its hashed letter n-grams, normalised. Each language has several centroids, found by
spherical k-means over its labelled texts; a text takes the language of the centroid of highest cosine. A text is
rejected where it has no letter or lies farther from its centroid than texts of its length did in training: beginnings of
the training texts show how far short texts lie.

The model is fitted on a bounded sample (``SAMPLE`` usable rows a language, by hash of the id); every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean
from .ngrams import char_ngrams, has_letter

#: Labelled rows with letters that a model is fitted on, at most, of each language.
SAMPLE = 500
BITS = 14
CENTROIDS = 4
UNKNOWN = "und"
#: A text is rejected below this share of the lowest cosine that texts of its language and length had in training.
SLACK = 0.6
#: Characters of the beginnings of texts from which the cosines of short texts are learned; one class of lengths each.
LENGTHS = (4, 8, 16, 32, 64, 128, 256)


@dataclass
class Model:
    """``centroids`` (row, bucket) of unit length, the language of each row, ``idf``, and by row and class of lengths the
    least cosine."""

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine (0 to 1), and whether the text is rejected. ``und`` only without a letter or a model."""
        if not text or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        at, n = char_ngrams(text, BITS)
        x = np.log1p(n) * self.idf[at]
        norm = np.sqrt((x * x).sum())
        cosines = self.centroids[:, at] @ x / (norm or 1.0)
        k = int(cosines.argmax())
        score = float(min(1.0, max(0.0, cosines[k])))
        return self.langs[k], score, bool(score < SLACK * self.least[k, length_class(int(n.sum()))])


def length_class(ngrams: int) -> int:
    """A text of so many n-grams (about three a letter) is as long as the beginnings of this class, or longer."""
    return int(np.searchsorted(3 * np.array(LENGTHS), ngrams, side="right"))


def _sample(labelled: DataFrame, limit: int) -> DataFrame:
    """doc_id of the ``limit`` usable rows of smallest id hash of each language."""
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").cast("string").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return usable.select("doc_id", "lang").withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit).select("doc_id").distinct()


def fit(labelled: DataFrame, limit: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """``labelled``: doc_id, text, lang. Rows without language or letters are passed over; of rows that repeat an id one
    is learned from. Languages are few: the driver holds at most ``limit`` texts' n-grams of each."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, classes, cells, values = [], [], [], []
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()):
                if lang is None or not text or not has_letter(text):
                    continue
                for k in (*LENGTHS, None):
                    part = text[:k]
                    if k is not None and (len(text) <= k or not has_letter(part)):
                        continue
                    at, n = char_ngrams(part, BITS)
                    langs.append(lang)
                    classes.append(-1 if k is None else length_class(int(n.sum())))
                    cells.append(at.astype(np.int32))
                    values.append(n.astype(np.float32))
            arrays = [pa.array(langs, pa.string()), pa.array(classes, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["lang", "class", "cells", "counts"])

    ids = sorted(r[0] for r in _sample(labelled, limit).collect())  # at most ``limit`` a language
    rows = labelled.where(F.col("lang").isNotNull() & F.col("doc_id").isin(*ids)) if ids else labelled.limit(0)
    one = rows.groupBy("doc_id").agg(F.min(F.struct(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))).alias("r"))
    found = one.select("r.text", "r.lang").mapInArrow(lean(features), "lang string, class int, cells array<int>, counts array<float>").toArrow()
    lang_of, class_of = found.column(0).to_pylist(), found.column(1).to_pylist()
    cells, counts = ([x.values.to_numpy(zero_copy_only=False) for x in found.column(c)] for c in (2, 3))
    order = sorted(range(len(lang_of)), key=lambda i: (lang_of[i], len(cells[i]), cells[i].tobytes(), counts[i].tobytes()))
    size, whole = 1 << BITS, [i for i in order if class_of[i] < 0]
    df = np.zeros(size)
    for i in whole:
        df[cells[i]] += 1
    idf = (np.log((1 + len(whole)) / (1 + df)) + 1).astype(np.float32)
    langs, rows_, least = [], [], []
    for lang in sorted(set(lang_of)):  # one language's rows are dense at a time
        own = [i for i in whole if lang_of[i] == lang]
        x = np.zeros((len(own), size), np.float32)
        for r, i in zip(x, own):
            r[cells[i]] = np.log1p(counts[i]) * idf[cells[i]]
            r /= np.linalg.norm(r)
        c = _spherical(x, centroids)
        floor = np.full(len(LENGTHS) + 1, np.inf)
        for i in (i for i in order if lang_of[i] == lang):
            v = np.log1p(counts[i]) * idf[cells[i]]
            k = length_class(int(counts[i].sum())) if class_of[i] < 0 else class_of[i]
            floor[k] = min(floor[k], float((c[:, cells[i]] @ v).max() / np.linalg.norm(v)))
        # a class without texts, or farther off than a shorter one, takes the shorter one's bound
        floor = np.minimum.accumulate(np.where(np.isinf(floor), 0.0 if np.isinf(floor).all() else floor[~np.isinf(floor)].max(), floor)[::-1])[::-1]
        langs += [lang] * len(c)
        rows_ += list(c)
        least += [floor] * len(c)
    return Model(langs, np.array(rows_, np.float32).reshape(len(langs), size), idf, np.array(least).reshape(len(langs), len(LENGTHS) + 1))


def _spherical(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centroids of unit length, each started from the row farthest from those before it."""
    mean = x.mean(axis=0)
    starts = [int((x @ mean).argmax())]
    while len(starts) < min(k, len(x)):
        starts.append(int((x @ x[starts].T).max(axis=1).argmin()))
    c = x[starts]
    for _ in range(rounds):
        nearest = (x @ c.T).argmax(axis=1)
        c = np.array([(nearest == i).astype(np.float32) @ x if (nearest == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("lang_pred", "score", "rejected")) -> DataFrame:
    """The columns ``keep`` with prediction, score and rejection added under ``names``, for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: centroids of 2**BITS floats each
    schema = docs.select(*keep).schema
    for name, kind in zip(names, ("string", "double", "boolean")):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            arrays = [*batch.columns[:-1], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *names])

    return docs.select(*keep, F.col("text").cast("string").alias("text_of_prediction")).mapInArrow(lean(run), schema)


def held_out(c: Column, parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of ``docs``: doc_id, held_out, lang_pred, score, rejected. Learns from the rows that are
    not held out (crc32 of the id modulo 4 is 2) and have a language.

    Null texts and texts without a letter are ``und`` with score 0; without any labelled row every text is; rows
    without an id are not held out and not learned from; repeated rows are scored alike and learned from once; very long
    texts are scored whole; other columns are ignored."""
    out = held_out(F.col("doc_id"), 4, 2)
    model = fit(docs.where(~out & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"), **options)
    found = predict(docs.select(F.col("doc_id").cast("long"), "text"), model)
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")
