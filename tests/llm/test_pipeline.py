import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
import xxhash

import corpus_pipeline as p
from millrace.llm import buckets, langid, ngrams, pii


def representatives(rows):
    """(doc_id, text) of the row that stays of each component of texts of similarity 0.8."""
    sets = {}
    for r in rows:
        w = (r[1] or "").lower().split()
        sets[" ".join(w)] = {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    up = {t: t for t in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    names = list(sets)
    for i, a in enumerate(names):
        for b in names[:i]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for r in rows:
        k = find(" ".join((r[1] or "").lower().split()))
        raw = xxhash.xxh64_intdigest((r[1] or "").encode(), 42)
        place = (r[0] is None, r[0] or 0, raw - (1 << 64) if raw >> 63 else raw, r[0], r[1])
        least[k] = min(least.get(k, place), place, key=lambda x: x[:3])
    return [x[3:] for x in least.values()]


def test_stages_one_by_one(spark, odd_docs, odd_rows):
    docs = p.language(spark, odd_docs, "")
    rows = Counter(map(tuple, docs.collect()))
    model = langid.fit(odd_docs.where("doc_id is not null").select("doc_id", "text", "lang"))
    assert rows == Counter(r for r in odd_rows if not model.predict(r[1])[2])
    assert all(ngrams.has_letter(r[1] or "") for r in rows) and all(rows[r] for r in odd_rows if r[2] and ngrams.has_letter(r[1] or "") and len(set((r[1] or "").split())) > 1)

    kept = list(map(tuple, p.near_duplicates(spark, docs, "").collect()))
    assert Counter((r[0], r[1]) for r in kept) == Counter(representatives(list(rows.elements()))) and set(kept) <= set(rows)

    df = spark.createDataFrame(kept, docs.schema)
    clean = list(map(tuple, p.personal_data(spark, df, "").collect()))
    assert Counter(clean) == Counter((r[0], pii.redact(r[1], pii.find(r[1])), *r[2:]) for r in kept)

    mixed = p.mix(spark, df, "")
    assert mixed.columns == odd_docs.columns and set(map(tuple, mixed.collect())) <= set(kept)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = p.tokens(spark, df, "").collect()
    text = {r[0]: r[1] for r in kept}
    assert len(out) == len(kept) and all(r.ids == lib.encode(text[r.doc_id]) and r.round_trip and not r.off and r.n_tokens == len(r.ids) for r in out)


def test_empty(spark, no_docs):
    docs = no_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in p.STAGES:
        assert stage(spark, docs, "").count() == 0


def jaccard(a, b):
    a, b = ({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(a & b) / len(a | b)


def test_near_duplicates_by_similarity(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows, near, far = [], set(), set()
    for k in range(60):  # pairs just above and just below 0.8
        w = [rng.choice(words) for _ in range(200)]
        v = w[:180 if k % 2 else 172] + [rng.choice(words) for _ in range(20 if k % 2 else 28)]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
        (near if jaccard(rows[-1][1], rows[-2][1]) >= 0.8 else far).add(2 * k + 1)
    df = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in p.near_duplicates(spark, df, "").collect()]
    assert len(near) == len(far) == 30
    assert sorted(kept) == sorted({i for i, _ in rows} - near)


def test_repeated_ids(spark):
    rng = random.Random(4)
    line = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(80))
    a, b, c, d = (line() for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a + " more"), (None, c), (None, c), (None, d), (None, a), (3, d), (None, None), (4, "")]
    df = spark.createDataFrame([(i, t, "en", None, None, f"{k % 2}", "r") for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, stays string, row string")
    got = p.near_duplicates(spark, df, "").select("doc_id", "text").collect()
    assert Counter(map(tuple, got)) == Counter(representatives(rows)) and (1, a) in got and (1, b) in got and len(got) == 5
    assert sorted(p.near_duplicates(spark, df, "").collect(), key=repr) == sorted(p.near_duplicates(spark, df, "").collect(), key=repr)


def test_hot_buckets(spark):
    """Large candidate buckets are dealt into cells; links across cells are not lost."""
    rng = random.Random(6)
    sets, groups = {}, [sorted(rng.sample(range(10**9), 60)) for _ in range(3)]
    for n in range(220):
        own = list(groups[n % 3])
        for _ in range(rng.randrange(4)):
            own[rng.randrange(60)] = rng.randrange(10**9)
        sets[n] = np.unique(np.array(own, np.uint64))
    sets |= {n: np.unique(np.array(rng.sample(range(10**9), 60), np.uint64)) for n in range(220, 240)}
    chain = list(range(10**9, 10**9 + 400))  # each is near its neighbours only
    sets |= {240 + k: np.array(chain[4 * k : 4 * k + 60], np.uint64) for k in range(60)}
    members = spark.createDataFrame([(key, n) for n in sets for key in ((7, 8) if n % 5 else (7,))], "key long, node long")
    known = spark.createDataFrame([(n, bytearray(s.tobytes())) for n, s in sets.items()], "node long, sh binary")
    want = components_of({(a, b) for a in sets for b in sets if a < b and len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}, sets)
    for hot in (10, 37, 4096):
        edges = {(r.src, r.dst) for r in buckets.links(members, known, 0.8, hot).collect()}
        assert components_of(edges, sets) == want, hot


def components_of(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}
