"""Exact top-k search by inner product, by three-phase uniform threshold.

The dimensions are cut into ``LISTS`` groups; a vector's score is the sum of its partial scores, one for each group.
Phase 1: every block of rows gathers one list, the blocks taking the lists in turn: for each query its k best entries
there, whose scores it resolves. The k-th best over all blocks is a cutoff that the k-th best score of all rows cannot be
below; a quarter of the partial scores is enough for it.
Phase 2: with the cutoff, every block goes through its lists and collects the entries that reach cutoff / LISTS in at least
one; a row below that in every list cannot reach the cutoff. A list is read only for rows that a bound (the partial scores
so far, and the product of the two vectors' lengths in the lists to come) leaves in reach of the cutoff of some query.
Phase 3: the remaining scores of the entries are resolved exactly; a block sends its k best of at least the cutoff.

Rows and queries travel in blocks of bounded size, and each block of rows meets each block of the stated query set.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, materialize

LISTS = 4
#: Rows and queries of one block; a block of 64 dimensions has about 2 MB and 0.5 MB.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component as double. Vectors that are null or hold a null or non-finite
    component, or have no id, take no part; rows that repeat an id do, each by itself. Components beyond 64 bits are held
    at the ends of that range."""
    usable = F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(usable)
    held = lambda x: F.floor(F.least(F.greatest(x * scale, F.lit(-(2.0**63))), F.lit(2.0**63 - 1024))).cast("long")
    return rows.select("vec_id", F.transform("v", held).alias("v"))


def _pack(rows: DataFrame, block_rows: int) -> DataFrame:
    """block, dim, ids, data: rows in blocks of one vector length each."""
    kind = "block string, dim int, ids binary, data binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def flush(dim: int) -> pa.RecordBatch:
            ids, data = held.pop(dim)
            arrays = [[uuid.uuid4().hex], [dim], [np.array(ids, np.int64).tobytes()], [np.array(data, np.int64).tobytes()]]
            types = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], ["block", "dim", "ids", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                v = v.values.to_numpy(zero_copy_only=False)
                ids, data = held.setdefault(len(v), ([], []))
                ids.append(i)
                data.append(v)
                if len(ids) == block_rows:
                    yield flush(len(v))
        for dim in list(held):
            yield flush(dim)

    return rows.mapInArrow(lean(run), kind)


def _matrix(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(len(ids) // 8, dim)


#: Scores that leave 64 bits are held at the ends of that range.
_LEAST_SCORE, _MOST_SCORE = -(2**63) + 1, 2**63 - 1


def _lists(dim: int) -> list[slice]:
    cuts = np.linspace(0, dim, min(LISTS, max(dim, 1)) + 1).astype(int).tolist()
    return [slice(a, b) for a, b in zip(cuts, cuts[1:])]


def _exact(rows: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both in a type whose products are exact (doubles below 2**53, then integers), and a bound of any score."""
    top = lambda x: max(float(x.max(initial=0)), -float(x.min(initial=0)))
    bound = top(rows) * top(queries) * max(rows.shape[1], 1)
    kind = np.float64 if bound < 2**52 else object if bound >= 2**62 else np.int64
    return rows.astype(kind), queries.astype(kind), bound


def _whole(score) -> int:
    return min(max(int(score), _LEAST_SCORE), _MOST_SCORE)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= least)
        return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    return np.lexsort((ids, -scores))


def local_lists(row_ids, rows, query_ids, queries, k, turn) -> Iterator[tuple[int, int, int]]:
    """Phase 1 in one block: query, row, score of the k best entries of the list whose turn it is."""
    rows, queries, _ = _exact(rows, queries)
    lists = _lists(rows.shape[1])
    part = lists[turn % len(lists)]
    found = queries[:, part] @ rows[:, part].T
    for i, q in enumerate(query_ids.tolist()):
        own = np.flatnonzero(row_ids != q)
        for j in own[_best(row_ids[own], found[i][own], k)].tolist():
            yield q, int(row_ids[j]), _whole(rows[j] @ queries[i])


def resolved(row_ids, rows, query_ids, queries, cutoffs, k) -> Iterator[tuple[int, int, int]]:
    """Phases 2 and 3 in one block."""
    rows, queries, bound = _exact(rows, queries)
    lists = _lists(rows.shape[1])
    n = len(lists)
    length = lambda x: np.sqrt(np.stack([(x[:, part].astype(float) ** 2).sum(axis=1) for part in lists]))
    of_rows, of_queries = length(rows), length(queries)
    # what the lists from the j-th on can still add, for each query and row
    slack = 1e-9 * bound + 1e-6
    alive = np.arange(len(row_ids))
    so_far = np.zeros((len(query_ids), len(alive)), rows.dtype)
    reached = np.zeros(so_far.shape, bool)
    # without k entries before, or with a score held at the end of the range, there is no cutoff
    bounds = np.where(cutoffs <= _LEAST_SCORE, -np.inf, cutoffs.astype(float))
    thresholds = bounds / n
    for j, part in enumerate(lists):
        rest = of_queries[j:].T @ of_rows[j:, alive]
        near = so_far.astype(float) + rest >= bounds[:, None] - slack
        keep = near.any(axis=0)
        if not keep.all():
            alive, so_far, reached = alive[keep], so_far[:, keep], reached[:, keep]
        if not len(alive):
            return
        mine = queries[:, part] @ rows[alive, part].T
        reached |= mine >= thresholds[:, None] - slack
        so_far = so_far + mine
    ids = row_ids[alive]
    for i, (q, cutoff) in enumerate(zip(query_ids.tolist(), cutoffs.tolist())):
        entries = np.flatnonzero(reached[i] & (ids != q))
        total = so_far[i][entries]
        good = total >= (cutoff if cutoff > _LEAST_SCORE else -math.inf)
        entries, total = entries[good], total[good]
        for e in _best(ids[entries], total, k).tolist():
            yield q, int(ids[entries[e]]), _whole(total[e])


def _meet(blocks: DataFrame, queries: DataFrame, run) -> DataFrame:
    """``run(block, row_ids, rows, query_ids, queries, cutoffs)`` for each block of rows and of queries of one length.
    The blocks of rows are dealt over salts, each of which gets a copy of the stated queries: no length gathers all rows
    in one task, and a block of rows travels once."""
    kind = "query_id long, vec_id long, score long"
    names = ["query_id", "vec_id", "score"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, dim, ids, data, q_ids, q_data, cutoffs in zip(*(batch.column(c).to_pylist() for c in ("block", "dim", "ids", "data", "q_ids", "q_data", "cutoffs"))):
                found = list(run(block, *_matrix(ids, data, dim), *_matrix(q_ids, q_data, dim), np.frombuffer(cutoffs, np.int64)))
                columns = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    salts = max(1, min(blocks.count(), 2 * blocks.sparkSession.sparkContext.defaultParallelism))
    dealt = blocks.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    copied = queries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copied.hint("merge"), ["dim", "salt"]).mapInArrow(lean(each), kind)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``vectors``, ``queries``: vec_id, v (array of integers). For each query the k rows of highest inner product
    but its own, ties to the smaller vec_id, all if there are fewer: query_id, rank (from 1), vec_id, score.
    Vectors are scored against queries of their own length only; an empty table gives an empty result."""
    blocks = materialize(_pack(vectors, BLOCK_ROWS), "rows")
    packed = materialize(_pack(queries, BLOCK_QUERIES), "queries")
    q = packed.select(F.col("block").alias("q_block"), "dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"))
    none = q.withColumn("cutoffs", F.lit(b""))
    first = _meet(blocks, none, lambda b, ri, r, qi, qs, _: local_lists(ri, r, qi, qs, k, int(b[:8], 16)))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    cut = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", F.col("score").alias("cutoff"))
    cut = materialize(cut, "cutoffs")

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, pairs in zip(batch.column("q_ids").to_pylist(), batch.column("cuts").to_pylist()):
                known = {p["query_id"]: p["cutoff"] for p in pairs or ()}
                out.append(np.array([known.get(i, _LEAST_SCORE) for i in np.frombuffer(ids, np.int64).tolist()], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("q_block", "dim", "q_ids", "q_data")), pa.array(out, pa.binary())], ["q_block", "dim", "q_ids", "q_data", "cutoffs"])

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(ids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([b] * len(ids), pa.string()), pa.array(ids)], ["q_block", "query_id"])

    # each block of queries gets its cutoffs: at most BLOCK_QUERIES of them
    of_block = q.select("q_block", "q_ids").mapInArrow(lean(members), "q_block string, query_id long").join(cut, "query_id")
    cuts = of_block.groupBy("q_block").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cuts"))
    bounded = q.join(cuts, "q_block", "left").mapInArrow(lean(attach), "q_block string, dim int, q_ids binary, q_data binary, cutoffs binary")
    last = _meet(blocks, bounded, lambda _, ri, r, qi, qs, c: resolved(ri, r, qi, qs, c, k))
    out = last.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def search_every(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by ``every``, against all rows."""
    vectors = materialize(integer_vectors(embeddings, scale), "vectors")
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k)
