import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import periodic

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def smallest_period(w):
    fail, k = [0] * len(w), 0
    for i in range(1, len(w)):
        while k and w[i] != w[k]:
            k = fail[k - 1]
        k += w[i] == w[k]
        fail[i] = k
    return len(w) - fail[-1]


def brute(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        same = [a == b for a, b in zip(w, w[q:])] + [False]
        start = None
        for i, s in enumerate(same):
            if s and start is None:
                start = i
            elif not s and start is not None:
                n = i - start + q
                if n >= max(6, 4 * q) and smallest_period(w[start : start + n]) == q:
                    found.add((start, n, q))
                start = None
    return sorted(found)


def numbers(w):
    return periodic._numbers(pa.array([str(x) for x in w], pa.string()))


def made(rng):
    out = []
    while len(out) < rng.choice([20, 120, 500]):
        unit = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([1, 1, 2, 3, 5, 8, 13, 31]))]
        n = rng.randrange(1, 9 * len(unit))
        out += (unit * 9)[:n] + [rng.randrange(60) for _ in range(rng.choice([0, 1, 5]))]
    return out


def test_runs_against_all_periods():
    rng = random.Random(1)
    for _ in range(400):
        w = made(rng)
        assert periodic.runs(numbers(w)) == brute(w), w


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=80), st.lists(st.integers(0, 2), min_size=1, max_size=6), st.integers(1, 9))
def test_runs_of_few_letters(w, unit, times):
    w = w + unit * times + w[:3]
    assert periodic.runs(numbers(w)) == brute(w)


def test_words_and_strange_spaces():
    for t in ["", " ", "a", " a\tb\x0bc\x0cd\re \n f\x00g h i\x85j", "😀 é\x1f" * 3]:
        assert periodic.words(t.encode()).to_pylist() == WORD.findall(t)


def test_long_uniform_and_repeated_texts():
    w = [7] * 200_000
    assert periodic.runs(np.array(w)) == [(0, 200_000, 1)]
    rng = random.Random(5)
    unit = [rng.randrange(1000) for _ in range(9000)]
    w = [-1, *unit * 5, *unit[:100], -2, *[1, 2] * 30_000, -3, *[1, 2] * 30_000]
    n = 45_100
    assert periodic.runs(np.unique(w, return_inverse=True)[1]) == [(1, n, 9000), (n + 2, 60_000, 2), (n + 60_003, 60_000, 2)]


def expected(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and w:
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, len(w))]
    found = brute(w) if len(w) < 3000 else periodic.runs(numbers(w))
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_report_on_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rng = random.Random(2)
    more = [(i, " ".join(map(str, made(rng))), None, None, None, "r", "f", 2) for i in range(1000, 1400)]
    df = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema))
    got = periodic.report(df).collect()
    assert Counter(tuple(r) for r in got) == Counter(expected(r[0], r[1]) for r in [*odd_rows, *more])
    assert sum(r.n_runs for r in got) > 500 and periodic.report(no_docs).count() == 0


def test_operator_gives_runs_and_text(spark):
    df = spark.createDataFrame([(1, "so  ha ha ha ha ha ha\tthen", "x")], "doc_id long, text string, runs string")
    assert [tuple(r) for r in periodic.periodic_runs(df).collect()] == [(1, [(1, 6, 1)], "so ha then")]
