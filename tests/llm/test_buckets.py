import random

import numpy as np

from millrace.llm import buckets


def components(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(a)] = find(b)
    return {n: min(m for m in nodes if find(m) == find(n)) for n in nodes}


def made(rng, n):
    sets = {}
    for i in range(n):
        if i % 10 == 1:  # near copies of an earlier member, in whatever cell they fall
            own = set(sets[i - 1])
            for x in rng.sample(sorted(own), 2):
                own.discard(x)
            sets[i] = own
        elif i % 3 == 0:  # many are reached from the pivot
            sets[i] = set(range(40)) | {1000 + i}
        else:
            sets[i] = {rng.randrange(100, 10**6) for _ in range(rng.randrange(5, 40))} | {7}
    return sets


def test_a_large_bucket_of_unlike_members(spark, monkeypatch):
    rng = random.Random(5)
    sets = made(rng, 600)
    members = spark.createDataFrame([(1, i) for i in sets] + [(2, i) for i in list(sets)[:20]], "key long, node long")
    blobs = spark.createDataFrame([(i, np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()], "node long, sh binary")
    want = components(list(sets), [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert len(set(want.values())) > 300
    for wide in (None, 4):
        edges = [(r.src, r.dst) for r in buckets.links(members, blobs, 0.8, hot=30, wide=wide).collect()]
        assert components(list(sets), edges) == want, wide


def test_unlike_members_travel_by_their_shingles(spark):
    """A bucket of 600 members with one shingle in common: visits would be a member for each of 20 cells."""
    rng = random.Random(6)
    sets = {i: {7, *(rng.randrange(100, 10**9) for _ in range(29))} for i in range(600)}
    rows = spark.createDataFrame([(1, i, np.array(sorted(s), np.uint64).tobytes()) for i, s in sets.items()], "key long, node long, sh binary")
    met = buckets._rare(rows, rows, 0.8)
    sizes = [r["count"] for r in met.groupBy("key").count().collect()]
    assert sum(sizes) == 600 * 7 and max(sizes) <= 3  # 30 - 24 + 1 shingles each, none of them the common one
