"""Both classifiers written once more with numbers and dictionaries, without arrays."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from millrace.llm import langid, quality

from .test_classifiers import rows

MIX, WHOLE = 0x9E3779B97F4A7C15, (1 << 64) - 1


def bucket(values, bits):
    h = 0
    for n, v in enumerate(values, 1):
        h = (h * MIX + v + n) & WHOLE
    h = h * MIX & WHOLE
    h ^= h >> 31
    return (h * 0xBF58476D1CE4E5B9 & WHOLE) >> (64 - bits)


def dot(a, b):
    return sum(v * b.get(k, 0.0) for k, v in a.items())


def unit(x):
    n = math.sqrt(dot(x, x))
    return {k: v / n for k, v in x.items()} if n else x


def letters(text):
    codes = [ord(c) for c in re.sub(r"[^a-zà-ÿ]+", " ", f" {text.lower()} ")]
    return Counter(bucket(codes[i : i + n], langid.BITS) for n in (1, 2, 3) for i in range(len(codes) - n + 1))


def kmeans(x, k):
    mean = {}
    for v in x:
        for key, val in v.items():
            mean[key] = mean.get(key, 0.0) + val
    starts = [max(range(len(x)), key=lambda i: dot(x[i], mean))]
    while len(starts) < min(k, len(x)):
        starts.append(min(range(len(x)), key=lambda i: max(dot(x[i], x[s]) for s in starts)))
    c = [x[s] for s in starts]
    for _ in range(12):
        near = [max(range(len(c)), key=lambda j: dot(v, c[j])) for v in x]
        new = []
        for j in range(len(c)):
            own = [v for v, n in zip(x, near) if n == j]
            total = {}
            for v in own:
                for key, val in v.items():
                    total[key] = total.get(key, 0.0) + val
            new.append(unit(total) if own else c[j])
        c = new
    return c


def test_languages_against_dictionaries(spark):
    data = [(i, t, lang) for i, t, lang, _ in rows(120, 4)]
    learned = [(t, lang) for i, t, lang in data if zlib.crc32(str(i).encode()) % 4 != 2]
    counts = [letters(t) for t, _ in learned]
    df = Counter(k for c in counts for k in c)
    idf = lambda k: math.log((1 + len(learned)) / (1 + df[k])) + 1
    vector = lambda c: unit({k: math.log1p(n) * idf(k) for k, n in c.items()})
    centroids = []
    for lang in sorted({x for _, x in learned}):
        own = sorted((c for c, (_, x) in zip(counts, learned) if x == lang), key=lambda c: (len(c), np.array(sorted(c), np.int32).tobytes(), np.array([c[k] for k in sorted(c)], np.float32).tobytes()))
        centroids += [(lang, c) for c in kmeans([vector(c) for c in own], langid.CENTROIDS)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    for i, t, _ in data:
        score, lang = max((dot(vector(letters(t)), c), lang) for lang, c in centroids)
        assert got[i].lang_pred == lang and abs(got[i].score - score) < 1e-3, (got[i], score, lang)


def word_features(text):
    tokens = re.findall(r"\w+|[^\w\s]+|\n", text.lower())
    base = [zlib.crc32(t.encode()) for t in tokens]
    shape = [(1 << 40) + ((2 if i and base[i] == base[i - 1] else 1) if t[0].isalnum() else base[i] + 3) for i, t in enumerate(tokens)]
    found = Counter(bucket(s[i : i + n], quality.BITS) for s, most in ((base, 2), (shape, 3)) for n in range(1, most + 1) for i in range(len(s) - n + 1))
    return unit({k: math.log1p(n) for k, n in found.items()})


def test_quality_against_dictionaries(spark):
    data = list(rows(150, 7)) + [(900, "", "en", 1), (901, "the the the !!", "en", 0)]
    z, n = {}, {}

    def weight(k):
        v = z.get(k, 0.0)
        if abs(v) <= quality.L1:
            return 0.0
        return -(v - math.copysign(quality.L1, v)) / ((quality.BETA + math.sqrt(n.get(k, 0.0))) / quality.ALPHA + quality.L2)

    logistic = lambda x: 1 / (1 + math.exp(-min(35.0, max(-35.0, x))))
    learned = sorted((i, t, q) for i, t, _, q in data if zlib.crc32(str(i).encode()) % 3 != 1)
    xs = [{**word_features(t), "bias": 1.0} for _, t, _ in learned]
    rng = np.random.default_rng(9)
    for _ in range(quality.EPOCHS):
        for j in rng.permutation(len(learned)).tolist():
            w = {k: weight(k) for k in xs[j]}
            error = logistic(dot(xs[j], w)) - learned[j][2]
            for k, v in xs[j].items():
                g, old = error * v, n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w[k]
                n[k] = old + g * g
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in data], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in data], "doc_id long, quality int")
    for r in quality.classify(docs, labels).collect():
        text = next(t for i, t, _, _ in data if i == r.doc_id)
        want = logistic(weight("bias") + sum(v * weight(k) for k, v in word_features(text).items()))
        assert abs(r.score - want) < 1e-3, (r, want)
