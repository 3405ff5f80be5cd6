"""Near copies among whole texts: the SimHash near-duplicates, each link decided by exact Jaccard similarity.

Two texts of Jaccard similarity 0.8 differ in about ten bits of a 64-bit SimHash, and no grid of that radius is selective.
So the classes of SimHash near-duplicates (at most ``distance`` bits, by the grids) are one kind of candidate bucket, and
bands of minima, whose count follows from the recall wanted at the threshold, are another. Shingle sets decide each link
in a bucket before it enters the components. Texts of the same words are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import buckets, simhash
from .common import lean, materialize, text_or_empty
from .components import components
from .paragraphs import band_count, shingles, unit_hash, words

BAND_ROWS = 4
RECALL = 0.999
DISTANCE = 4


def band_keys(sh: np.ndarray, multiply: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One key a band; ``multiply`` and ``add`` have a row for each band."""
    bands, rows = multiply.shape
    minima = np.array([(sh * m + a).min() for m, a in zip(multiply.ravel(), add.ravel())], np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = (key ^ minima[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def classes(docs: DataFrame, shingle: int, threshold: float, distance: int = DISTANCE) -> DataFrame:
    """doc_id, raw (a hash of the text), root for each row of ``docs``: the components of the links of at least
    ``threshold`` between the sets of ``shingle``-word shingles. A null text counts as empty; texts without words are one
    node; texts of fewer words have their whole sequence as the one shingle; rows that repeat one another share a node."""
    bands = band_count(threshold, BAND_ROWS, RECALL)
    rng = np.random.default_rng(21)
    multiply = rng.integers(1, 2**63, (bands, BAND_ROWS), dtype=np.uint64) | np.uint64(1)
    add = rng.integers(0, 2**63, (bands, BAND_ROWS), dtype=np.uint64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys = [], [], []
            for text in batch.column(2).to_pylist():
                w = words(text)
                nodes.append(unit_hash(w))
                fps.append(simhash.fingerprint(text.encode("utf-8", "surrogatepass"), shingle))
                keys.append(band_keys(shingles(w, shingle), multiply, add).view(np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.array([], np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * bands), flat)
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(nodes, pa.int64()), fp, lists], ["doc_id", "raw", "node", "fp", "keys"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text_or_empty()).alias("raw"), text_or_empty().alias("text"))
    signed = materialize(rows.mapInArrow(lean(sign), "doc_id long, raw long, node long, fp long, keys array<long>"), "signed")
    # one row stands for each node; only nodes that share a bucket with another are compared
    lead = signed.groupBy("node").agg(F.min(F.struct("doc_id", "raw", "fp", "keys")).alias("r")).select("node", "r.*")
    alike = components(simhash.fingerprint_links(lead.select("fp").distinct(), distance)).withColumnRenamed("node", "fp")
    by_fp = lead.select("node", "fp").join(alike, "fp", "left").select(F.xxhash64(F.lit("simhash"), F.coalesce("root", "fp")).alias("key"), "node")
    met = lead.select(F.explode("keys").alias("key"), "node").unionByName(by_fp)
    shared = met.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("mark")).where("n > 1")
    # buckets with the same nodes: one of them is searched
    shared = shared.groupBy("n", "mark").agg(F.min("key").alias("key")).select("key")
    met = materialize(met.join(shared, "key"), "met")
    asked = lead.select("node", "doc_id", "raw").join(met.select("node").distinct(), "node").select("doc_id", "raw")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = [words(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([unit_hash(w) for w in split], pa.int64()), pa.array([shingles(w, shingle).tobytes() for w in split], pa.binary())], ["node", "sh"])

    a, b = rows.alias("a"), asked.alias("b")
    # the same plan at every size
    texts = a.join(b.hint("merge"), F.expr("a.raw = b.raw and a.doc_id <=> b.doc_id"), "left_semi").dropDuplicates(["raw"])
    known = materialize(texts.select("text").mapInArrow(lean(sets), "node long, sh binary"), "sets")
    stars = components(buckets.links(met, known, threshold))
    found = signed.select("doc_id", "raw", "node").join(stars, "node", "left")
    return found.select("doc_id", "raw", F.coalesce("root", "node").alias("root"))
