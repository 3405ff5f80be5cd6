import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.operators import chunk

SCHEMA = "doc long, ordinal int, heading string, kind string, text string, language string"


def test_merging_tries_the_other_neighbour():
    assert chunk.fit_groups([60, 10, 30], [0.1, 0.5], [True, True], 65, 20) == [(0, 1), (1, 3)]
    assert chunk.fit_groups([60, 10, 60], [0.1, 0.5], [True, True], 65, 20) == [(0, 1), (1, 2), (2, 3)]
    assert chunk.fit_groups([5, 5, 5, 5], [0.4, 0.3, 0.2], [True, True, True], 100, 11, [2, 2, 1, 1]) == slow([5, 5, 5, 5], [0.4, 0.3, 0.2], [True, True, True], 100, 11, [2, 2, 1, 1])


def slow(lengths, distances, breaks, size, least, gaps):
    """The rule by texts: every change begins from the front again."""
    n = lambda g: sum(lengths[g[0] : g[1]]) + sum(gaps[g[0] + 1 : g[1]])
    cuts = [0, *(i + 1 for i, b in enumerate(breaks) if b), len(lengths)]

    def split(g):
        if g[1] - g[0] < 2 or n(g) <= size:
            return [g]
        best = g[0]
        for i in range(g[0], g[1] - 1):
            if distances[i] > distances[best]:
                best = i
        return split((g[0], best + 1)) + split((best + 1, g[1]))

    groups = [x for a, b in zip(cuts, cuts[1:]) for x in split((a, b))]
    again = True
    while again:
        again = False
        for i, g in enumerate(groups):
            if n(g) >= least:
                continue
            left = distances[g[0] - 1] if i else math.inf
            right = distances[g[1] - 1] if i + 1 < len(groups) else math.inf
            order = [i - 1, i + 1] if left <= right else [i + 1, i - 1]
            for t in order:
                if 0 <= t < len(groups) and (joined := (min(g[0], groups[t][0]), max(g[1], groups[t][1]))) and n(joined) <= size:
                    groups[min(i, t) : max(i, t) + 1] = [joined]
                    again = True
                    break
            if again:
                break
    return groups


def test_groups_against_the_rule():
    rng = random.Random(1)
    for _ in range(3000):
        k = rng.randrange(1, 14)
        args = ([rng.randrange(1, 40) for _ in range(k)], [rng.randrange(10) / 10 for _ in range(k - 1)], [rng.random() < 0.4 for _ in range(k - 1)], rng.randrange(20, 120), rng.randrange(1, 50), [rng.choice([1, 2]) for _ in range(k)])
        assert chunk.fit_groups(*args) == slow(*args), args


def test_long_lines_of_code_stay_as_they_are():
    assert [t for t, _, _ in chunk.code_lines("a\n" + " " * 60 + "x", 50)] == ["a", " " * 50, "          x"]


def test_segments_and_runs(spark):
    rows = [
        (1, 0, "A", "prose", "One is. Two is.", ""),
        (1, 1, "A", "prose", "Three is.", ""),
        (1, 2, "A", "prose", "  ", ""),
        (1, 3, "B", "prose", "Four.", ""),
        (1, 4, "B", "code", "x = 1", "py"),
        (1, 5, "C", "table", "a | b", ""),
        (1, 6, "B", "prose", "Five. " + "word " * 40, ""),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.segment for r in chunk.segments(df, "doc").orderBy("ordinal").collect()] == [1, 1, 2, 3, 3, 4]
    got = chunk.semantic_runs(df, "doc", 60).orderBy("pos").collect()
    assert [(r.run, r.sentence, r.begins) for r in got][:5] == [(1, "One is.", True), (1, "Two is.", False), (1, "Three is.", True), (2, "Four.", True), (4, "Five.", True)]
    assert all(len(r.sentence) <= 60 for r in got) and [r.pos for r in got] == list(range(len(got)))


def vector(text):
    rng = random.Random(text[:3])
    return [rng.gauss(0, 1) for _ in range(5)]


def test_packing_against_the_rule(spark):
    rng = random.Random(6)
    blocks = []
    for doc in range(30):
        for o in range(rng.randrange(0, 14)):
            kind = rng.choice(["prose", "prose", "prose", "code", "table"])
            text = " ".join(rng.choice(["abc", "def", "ghi", "jkl"]) + f" says number {rng.randrange(99)}." for _ in range(rng.randrange(1, 6)))
            blocks.append((doc, o, f"h{o // 4 % 2}", kind, text, "py" if kind == "code" else ""))
    blocks.append((99, 0, "", "prose", "Alone.", ""))
    df = spark.createDataFrame(blocks, SCHEMA)
    embed = F.udf(vector, "array<double>")
    options, least = chunk.ChunkOptions(120, 0), 40
    sentences = chunk.semantic_runs(df, "doc", 120).withColumn("vector", F.when(F.col("doc") != 7, embed("sentence")))
    planned, stats = chunk.semantic_plan(sentences, "doc", "percentile", 60.0)
    known = {r.doc: r for r in stats.collect()}
    got = {}
    for r in chunk.semantic_pack(df, planned, stats, "doc", options, least).orderBy("doc", "ordinal").collect():
        got.setdefault(r.doc, []).append((r.heading, r.kind, r.language, r.content, r.overlap))
    for doc in {b[0] for b in blocks}:
        own = [{"heading": h, "kind": k, "text": t, "language": g} for d, _, h, k, t, g in blocks if d == doc]
        parts = []
        for b in own:
            mark = b["heading"] if b["kind"] == "prose" else None
            if not parts or parts[-1][0] != mark:
                parts.append((mark, []))
            parts[-1][1].append(b)
        runs = [[(s, j == 0) for b in bs for j, (s, _) in enumerate(chunk.split_sentences(b["text"]))] if mark is not None else None for mark, bs in parts]
        dist = [[max(0.0, 1 - float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v))) for (a, _), (b, _) in zip(r, r[1:]) for u, v in [(vector(a), vector(b))]] if r else [] for r in runs]
        pooled = [x for d in dist for x in d]
        n = sum(len(r) for r in runs if r)
        reason = "too_short" if n < 2 else "error" if doc == 7 else "too_short" if len(pooled) < 3 else None
        if n:
            assert (known[doc].sentences, known[doc].fallback) == (n, reason)
        out = []
        if reason:
            out = [(c["heading"], c["kind"], c["language"], c["text"], c["overlap"]) for c in chunk.pack_blocks(own, options)]
        else:
            limit = float(np.percentile(pooled, 60))
            assert abs(known[doc].threshold - limit) < 1e-9 and known[doc].breakpoints == sum(x > limit + 1e-12 for x in pooled)
            for (mark, bs), run, d in zip(parts, runs, dist):
                if mark is None:
                    out += [(c["heading"], c["kind"], c["language"], c["text"], c["overlap"]) for c in chunk.pack_blocks(bs, options)]
                    continue
                gaps = [2 if b else 1 for _, b in run]
                for a, z in slow([len(s) for s, _ in run], d, [x > limit + 1e-12 for x in d], 120, least, gaps):
                    out.append((mark, "prose", "", chunk.join_sentences(run[a:z]), 0 if a == 0 or run[a][1] else chunk.CONTINUES))
        assert got.get(doc, []) == out, doc
