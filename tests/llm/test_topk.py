import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import topk


def brute(rows, k=5, every=50):
    """Rows that repeat an id are candidates each, and queries each."""
    held = lambda x: max(-(2**63), min(2**63 - 1024, math.floor(256 * x)))
    vs = [(i, [held(x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for q in {i for i, _ in vs if i % every == 0}:
        scored = [(max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for p, v in vs if p == q for i, w in vs if i != q and len(w) == len(v)]
        found = sorted((-s, i) for s, i in scored)
        out.update((q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k]))
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(12)]) for i in range(300)]
    rows += [(i, rows[50][1]) for i in range(300, 420)]  # a hot vector, with ties
    rows += [(i, [-1.0] * 12) for i in range(450, 452)] + [(500, [0.0] * 12), (550, [1.0, 2.0]), (551, [3.0, 1.0]), (600, []), (601, [])]
    rows += [(None, [1.0] * 12), (700, None), (701, [None] * 12), (702, [float("nan")] * 12), (703, [float("inf")] + [0.0] * 11), (100, [9.0] * 12), (130, [8.0] * 12), (130, [8.5] * 12)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int")
    assert Counter(map(tuple, topk.search_every(df).collect())) == brute(rows)


def test_small_tables(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert topk.search_every(spark.createDataFrame([], kind)).count() == 0
    assert topk.search_every(spark.createDataFrame([(0, [1.0, 2.0], 1)], kind)).count() == 0
    two = spark.createDataFrame([(0, [1.0, 2.0], 1), (50, [0.5, -1.0], None)], kind)
    assert {tuple(r) for r in topk.search_every(two).collect()} == {(0, 1, 50, 256 * 128 - 512 * 256), (50, 1, 0, 256 * 128 - 512 * 256)}
    assert topk.integer_vectors(two).select(F.size("v")).distinct().count() == 1


def test_huge_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e300, -1e300, 3e17, 1.0, -2.0**54, 2.0**30]) for _ in range(4)]) for i in range(0, 400, 25)]
    rows += [(1000, [-1e300] * 4), (1001, [1e300] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter(map(tuple, topk.search_every(df).collect()))
    scores = lambda c: Counter((q, n, s) for q, n, _, s in c.elements())
    assert scores(got) == scores(brute(rows))


def test_bounds_drop_no_entry():
    rng = np.random.default_rng(2)
    rows, queries = rng.integers(-300, 300, (500, 64)), rng.integers(-300, 300, (9, 64))
    rows[::7] = queries[rng.integers(0, 9, len(rows[::7]))] + rng.integers(-20, 20, (len(rows[::7]), 64))
    ids, names = np.arange(1000, 1500), np.arange(9)
    scores = queries @ rows.T
    cut = np.sort(scores, axis=1)[:, -5]
    got = {(q, i, s) for q, i, s in topk.resolved(ids, rows, names, queries, cut, 5)}
    assert got == {(q, 1000 + int(j), int(scores[q, j])) for q in range(9) for j in np.argsort(-scores[q])[:5]}
