import math
import random
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, n string, dim string, v int"


def brute(rows):
    """(vec_id, component) -> n, deviation, |whitened|, explained, from exact fractions."""
    vectors = defaultdict(list)
    for i, v, *_ in rows:
        if v is not None and v and all(c is not None and math.isfinite(c) for c in v):
            x = tuple(min(max(math.floor(256 * float(np.float32(c))), -(2**63)), 2**63 - 1024) for c in v)
            vectors[len(x)].append((i, x))
    out = []
    for dim, members in vectors.items():
        fit = sorted({x for _, x in members})
        n, s = len(fit), [sum(c) for c in zip(*fit)]
        cov = [[Fraction(n * sum(x[a] * x[b] for x in fit) - s[a] * s[b], n * n) for b in range(dim)] for a in range(dim)]
        values, vecs = np.linalg.eigh(np.array(cov, float))
        values, vecs = values[::-1][:4], vecs.T[::-1][:4]
        trace = float(sum(cov[a][a] for a in range(dim)))
        for i, x in members:
            dev = sum((n * c - t) ** 2 for c, t in zip(x, s))
            y = np.array([float(Fraction(n * c - t, n)) for c, t in zip(x, s)])
            for k, (e, w) in enumerate(zip(values, vecs), 1):
                flat = e <= 16 * dim * 2.3e-16 * max(values[0], 0)
                out.append((i, k, n, dev, None if flat else abs(y @ w / math.sqrt(e)), None if not trace else 0.0 if flat else e / trace, flat))
    return out


def same(got, want):
    assert Counter((r.vec_id, r.component, r.n, r.deviation) for r in got) == Counter(w[:3] + (w[3] if w[3] < 10**38 else None,) for w in want)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], abs(r[4] or 0))
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert (r[4] is None) == (w[4] is None) and (r[4] is None or math.isclose(abs(r[4]), w[4], rel_tol=1e-6, abs_tol=1e-6)), (r, w)
        assert (r[5] is None) == (w[5] is None) and (r[5] is None or math.isclose(r[5], w[5], rel_tol=1e-9, abs_tol=1e-15))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vector = lambda d: [rng.gauss(0.3, 0.1 * (k % 7 + 1)) for k in range(d)]
    out = [(i, vector(6), "a", "b", 1) for i in range(200)]
    out += [(900 + i, out[3][1], None, None, None) for i in range(150)]  # copies of one vector
    out += [out[5], out[5], (None, vector(6), "", "", 0), (None, vector(6), "", "", 0)]
    out += [(2000 + i, vector(2), "", "", 0) for i in range(20)] + [(2100, vector(9), "", "", 0)]
    out += [(3000 + i, [1.0, rng.random(), 5.0], "", "", 0) for i in range(12)]
    out += [(4000, None, "", "", 0), (4001, [], "", "", 0), (4002, [1.0, None], "", "", 0), (4003, [math.nan] * 6, "", "", 0), (4004, [math.inf, 1.0], "", "", 0), (4005, [-math.inf] * 2, "", "", 0)]
    return out


def test_odd_rows_against_fractions(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = whiten.whiten(whiten.integer_vectors(df)).collect()
    same(got, brute(rows))
    assert all(r.identity_error is None or r.identity_error < 1e-9 for r in got)
    assert {r.vec_id for r in got if r.identity_error is None} == {2100}
    # signs agree over the rows: vectors and their mirror images on either side
    first = {r.vec_id: r.whitened for r in got if r.component == 1 and r.n == 202}
    assert abs(sum(first[i] for i in range(200)) / 200) < 0.2 and min(first.values()) < -1 < 1 < max(first.values())


def test_report_and_empty_table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = whiten.report(df)
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    assert whiten.report(df.where("false")).count() == 0


def test_entries_beyond_doubles(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randrange(0, 19) for _ in range(3)]) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = whiten.whiten(whiten.integer_vectors(df.withColumn("embedding", F.col("embedding").cast("array<float>")))).collect()
    want = brute(rows)
    assert Counter((r.vec_id, r.component, r.deviation) for r in got) == Counter((w[0], w[1], w[3] if w[3] < 10**38 else None) for w in want)
    far = whiten.report(df).where("deviation is null").count()
    assert far > 0


def test_scatters_of_different_shifts_add_up():
    rng = np.random.default_rng(1)
    x = rng.integers(-(10**6), 10**6, (300, 5)) + 10**12
    parts = []
    for rows in np.array_split(x, 7):
        s = whiten.Scatter(np.array([int(v) for v in rows[0]], object))
        s.add(rows[: len(rows) // 2])
        s.add(rows[len(rows) // 2 :])
        parts.append(whiten.Scatter.unpacked(*s.packed()))
    for p in parts[1:]:
        parts[0].merge(p)
    o = x.astype(object)
    assert parts[0].n == 300 and (parts[0].total() == o.sum(axis=0)).all()
    assert (parts[0].centred() == 300 * (o.T @ o) - np.outer(o.sum(axis=0), o.sum(axis=0))).all()


def test_one_vector_with_most_rows_and_large_models(spark, monkeypatch):
    monkeypatch.setattr(whiten, "MODEL_BYTES", -1)  # the models meet the blocks by a join
    rng = random.Random(6)
    rows = [(i, [rng.random() for _ in range(3 + i % 2)]) for i in range(80)] + [(100 + i, [0.5, 0.25, 0.125]) for i in range(2000)]
    got = whiten.report(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    want = brute(rows)
    assert len(got) == len(want) and {r.n for r in got} == {41, 40}
    same(got, want)
