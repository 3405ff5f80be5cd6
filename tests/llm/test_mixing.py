import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from millrace.llm import mixing


def test_targets():
    assert mixing.targets([10, 10, 10], [5, 2, 1]) == [30 * 5 / 8, 30 * 2 / 8, 30 / 8]
    t = mixing.targets([1, 100, 100], [5, 2, 1])
    assert t[0] == 3 and abs(sum(t) - 201) < 1e-9 and abs(t[1] - 2 * t[2]) < 1e-9
    assert mixing.targets([0, 0], [5, 2]) == [0, 0]
    assert mixing.targets([], []) == []


def test_split_tree_keeps_every_block():
    tree = mixing.split_tree([1000, 37, 0, 5], 7, 3)
    assert (tree.sum(axis=0) == [1000, 37, 0, 5]).all()
    assert np.ptp(tree.sum(axis=1)) <= 3
    assert (tree == mixing.split_tree([1000, 37, 0, 5], 7, 3)).all()


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["hot"] * 6 + ["b", "é", None, "z"]), 1) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    out = mixing.report(df).collect()
    assert len(out) == 3000 and sorted(out) == sorted(mixing.report(df).collect())
    assert all(len(r.shards) == r.taken // r["size"] and r.shards == sorted(r.shards) for r in out)
    size, source = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1])) for r in rows}, {r[0]: r[2] for r in rows}
    words, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r["size"] == size[r.doc_id] and r.taken <= 3 * r["size"] and r.taken % r["size"] == 0
        words[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    names = sorted((s for s in words if s), key=str.encode) + [None]
    want = mixing.targets([words[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))])
    for s, t in zip(names, want):
        assert abs(target[s] - t) < 1e-6 and abs(taken[s] - t) <= 60
    mix = mixing.mixed(df, shards=4).select("doc_id", "source").collect()
    assert Counter(r.doc_id for r in mix) == Counter({r.doc_id: r.taken // r["size"] for r in out if r.taken})
    shards = defaultdict(Counter)
    for r in mixing.placements(df, shards=4).collect():
        for p in r.placed:
            shards[p.shard][r.source] += 1
    assert set(shards) == {0, 1, 2, 3} and sum(shards.values(), Counter()) == Counter(r.source for r in mix)


def test_odd_rows(odd_docs, odd_rows, no_docs):
    out = mixing.report(odd_docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in odd_rows)
    assert mixing.report(no_docs).count() == 0
    assert mixing.mixed(odd_docs).columns == odd_docs.columns


def brute_taken(rows, weights=(5, 2, 1), cap=3, seed=1):
    """Times each document is taken, from the rules: whole repeats of the source, then a permuted prefix of its blocks."""
    h64 = lambda seed, *xs: spark_hash(seed, xs)
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((i, len(re.findall(r"[^\x20\x09-\x0D]+", t)), signed(xxhash.xxh64_intdigest(t.encode(), 42))))
    names = sorted((s for s in by if s is not None), key=str.encode) + [None] * (None in by)
    want = mixing.targets([sum(d[1] for d in by[s]) for s in names], [weights[i % 3] for i in range(len(names))], cap)
    taken = {}
    for k, s in enumerate(names):
        total = sum(d[1] for d in by[s])
        times = min(cap, int(want[k] // total))
        room = 0.0 if times == cap else want[k] - times * total
        n = math.isqrt(len(by[s]) - 1) + 1
        blocks = defaultdict(list)
        for d in by[s]:
            blocks[h64(seed, ("l", d[0]), ("l", d[2])) % n].append(d)
        for b in sorted(blocks, key=lambda b: (h64(seed + 2, ("i", k), ("i", b)), b)):
            words = sum(d[1] for d in blocks[b])
            upto = 0
            for d in sorted(blocks[b], key=lambda d: (h64(seed + 1, ("l", d[0]), ("l", d[2])), d[0], d[2])):
                upto += d[1]
                extra = words <= room or room > 0 and upto - d[1] / 2 <= room
                taken[d[0]] = (times + extra) * d[1]
            room -= words
    return taken


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def spark_hash(seed, values):
    """xxhash64 of a literal integer and columns, chained as Spark chains them, from its definition over 4 and 8 bytes."""
    h = 42
    for kind, v in (("i", seed), *values):
        h = xxhash.xxh64_intdigest(v.to_bytes(4 if kind == "i" else 8, "little", signed=True), h)
    return signed(h)


def test_taken_by_brute_force(spark):
    rng = random.Random(12)
    rows = [(i, " ".join("w" * rng.randrange(1, 9) for _ in range(rng.randrange(0, 50))) + f" {i}", rng.choice(["hot"] * 5 + ["b", "é", None])) for i in range(900)]
    out = {r.doc_id: r.taken for r in mixing.report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out == brute_taken(rows)


def test_shards_grow_with_the_words():
    assert mixing.shard_count(0) == 16 and mixing.shard_count(400 * mixing.SHARD_WORDS) == 400 and mixing.shard_count(10**13) == mixing.MAX_SHARDS


def test_rows_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1, "r", 5, 6)] * 3 + [(None, "d e", None, 2, "s", 7, 8)], "doc_id long, text string, source string, at int, row string, shard int, place int")
    out = mixing.mixed(df)
    assert out.columns == df.columns and set(out.collect()) <= set(df.collect())
