import random
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import simhash


def brute_fp(text, n=4, seed=42):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))]
    hs = [xxhash.xxh64_intdigest(s, seed) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_roots(fps, distance=4):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    fs = sorted(up)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= distance:
                up[find(a)] = find(b)
    return {f: find(f) for f in fs}


@given(st.text(alphabet="aB \n\té ", max_size=60))
@settings(max_examples=150, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fp(text)


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**64, (2, 4000), dtype=np.uint64)
    manhattan = sum(abs(np.bitwise_count(a >> np.uint64(2 * k) & np.uint64(3)).astype(int) - np.bitwise_count(b >> np.uint64(2 * k) & np.uint64(3))) for k in range(32))
    assert (np.bitwise_count(simhash.embed(a) ^ simhash.embed(b)) == manhattan).all()
    assert (manhattan <= np.bitwise_count(a ^ b)).all()


def test_links_match_brute_force():
    rng = random.Random(3)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(90):
            x = centre
            for _ in range(rng.randrange(7)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(300)}
    forest = simhash._Forest()
    for mask in simhash.grids(4):
        simhash.link_cell_rows(np.array(sorted(fps), np.uint64), mask, 4, forest)
    want = brute_roots(fps)
    got, back = {}, {}
    for f in fps:
        assert got.setdefault(want[f], forest.find(f)) == forest.find(f)
        assert back.setdefault(forest.find(f), want[f]) == want[f]


def test_large_cells_are_cut_by_finer_grids(monkeypatch):
    monkeypatch.setattr(simhash, "_LARGE_CELL", 60)
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 900:  # one dense cloud, so that cells are large
        x = base
        for _ in range(rng.randrange(12)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    forest = simhash._Forest()
    for mask in simhash.grids(4):
        simhash.link_cell_rows(np.array(sorted(fps), np.uint64), mask, 4, forest)
    want = brute_roots(fps)
    pairs = {(want[f], forest.find(f)) for f in fps}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_long_text_is_hashed_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "HASHED", 7)
    text = " ".join(f"w{i % 41}" for i in range(3000)) + "\n "
    assert simhash.fingerprint(text.encode()) == brute_fp(text)


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    out = [tuple(r) for r in simhash.near_duplicates(odd_docs).collect()]
    roots = brute_roots({brute_fp(r[1]) for r in odd_rows})
    least = {}
    for r in odd_rows:
        k = roots[brute_fp(r[1])]
        least[k] = min(x for x in (least.get(k), r[0]) if x is not None) if (least.get(k), r[0]) != (None, None) else None
    want = [(r[0], f"{brute_fp(r[1]):016x}", least[roots[brute_fp(r[1])]]) for r in odd_rows]
    assert Counter(out) == Counter(want)
    assert simhash.near_duplicates(no_docs).count() == 0
