import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import suffix


def brute(rows, n=100):
    """rows: (doc_id, text), by distinct (doc_id, text) in the operator's order of rows that share an id."""
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        spans = int(np.diff(np.concatenate(([0], gone.astype(int)))).clip(0).sum())
        out[(i, t)] = (i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def texts(seed=4):
    rng = random.Random(seed)
    words = "alpha beta gamma délta epsilon zeta eta theta iota kappa".split()
    pool = [" ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(40)) for _ in range(8)]
    for i in range(160):
        t = " ".join(rng.choice(words) + str(rng.randrange(500)) for _ in range(rng.randrange(5, 60)))
        for _ in range(rng.randrange(3)):
            p = rng.choice(pool)
            a = rng.randrange(len(p) // 2)
            t = t[: rng.randrange(len(t))] + p[a : a + rng.randrange(60, 300)] + t[rng.randrange(len(t)) :]
        yield i, t


@pytest.mark.parametrize("block", [2000, 1 << 21])
def test_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(suffix, "BLOCK", block)
    rows = list(texts())
    rows += [(200 + i, rows[3][1]) for i in range(40)]  # a hot group of copies
    rows += [(300, "ab" * 400), (301, "a" * 1000), (302, "b" + "a" * 300), (303, None), (304, ""), (305, "x" * 99), (306, "x" * 99), (307, "y" * 100), (308, "y" * 100)]
    df = spark.createDataFrame([(i, t, "h", 1) for i, t in rows], "doc_id long, text string, h string, k int").repartition(5)
    assert Counter(map(tuple, suffix.report(df).collect())) == Counter(brute(rows).values())


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = sorted(dict.fromkeys((r[0], r[1]) for r in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0))
    want = brute(rows)
    assert Counter(map(tuple, suffix.report(odd_docs).collect())) == Counter(want[(r[0], r[1])] for r in odd_rows)
    assert suffix.report(no_docs).count() == 0
    kept = {(r.doc_id, hashlib.sha256(r.kept).hexdigest()) for r in suffix.deduplicated(odd_docs).collect()}
    assert kept == {(w[0], w[4]) for w in want.values()}


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(1)
    text = bytes(rng.choice(b"abcde ") for _ in range(30000))
    whole = list(suffix.anchor_windows([text]))
    assert len(whole) == 1 and int(whole[0][2].sum()) == len(text) - 99
    at, h = suffix.window_anchors(np.frombuffer(text, np.uint8))
    for p in rng.sample(range(len(at)), 300):
        hs = [int(x) >> 24 for x in h[p : p + 61]]
        assert at[p] == p + hs.index(min(hs))


def test_cover_has_every_difference():
    differences = {(int(a) - int(b)) % suffix.PERIOD for a in suffix.COVER for b in suffix.COVER}
    assert differences == set(range(suffix.PERIOD)) and len(suffix.COVER) <= 8
    for a in range(suffix.PERIOD):
        for b in range(suffix.PERIOD):
            d = int(suffix._SHIFT[a, b])
            assert {(a + d) % suffix.PERIOD, (b + d) % suffix.PERIOD} <= set(suffix.COVER.tolist())


@pytest.mark.parametrize("alphabet", [b"ab", b"a", b"abcdefgh", b"\x00\xff"])
def test_order_of_suffixes(alphabet):
    """Against plain sorting by the first LENGTH bytes; ties of PERIOD bytes at all residues."""
    rng = random.Random(2)
    body = b"".join(bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 60))) * rng.randrange(1, 9) for _ in range(25))
    body += body[100:500]
    text = np.frombuffer(body + bytes(suffix.LENGTH + 4 * suffix.PERIOD + 16), np.uint8)
    starts = np.arange(len(body))
    heads = [bytes(text[i : i + suffix.PERIOD]) for i in starts]
    often = Counter(heads)
    want = sorted((bytes(text[i : i + suffix.LENGTH]) for i in starts if often[heads[i]] > 1))
    got = [bytes(text[starts[i] : starts[i] + suffix.LENGTH]) for i in suffix.block_order(text, starts)]
    assert got == want
