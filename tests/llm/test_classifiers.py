import random
import zlib
from collections import Counter

from millrace.llm import langid, ngrams, quality

WORDS = {"en": "the of and to in is that it with for".split(), "de": "der die und das ist nicht für über ein auf".split(), "fr": "le la et les des une que pour dans où".split()}


def rows(n=240, seed=1):
    rng = random.Random(seed)
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        bad = rng.random() < 0.3
        text = " ".join(rng.choice(WORDS[lang]) + ("$$$" if bad else "") for _ in range(rng.randrange(3, 60)))
        yield i, text, lang, int(not bad)


def test_language_held_out(spark):
    data = list(rows())
    df = spark.createDataFrame([(i, t, l if i % 5 else None, 2.0) for i, t, l, _ in data], "doc_id long, text string, lang string, score double")
    out = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(out) == len(data)
    for i, _, lang, _ in data:
        assert out[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert out[i].lang_pred == lang and 0 < out[i].score <= 1 and not out[i].rejected


def test_language_learns_from_the_rest_only(spark):
    data = [(i, t, l) for i, t, l, _ in rows()]
    swapped = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else l) for i, t, l in data]
    kind = "doc_id long, text string, lang string"
    one, two = (Counter(tuple(r) for r in langid.identify(spark.createDataFrame(d, kind)).collect()) for d in (data, swapped))
    assert one == two


def test_quality(spark):
    data = list(rows(400, 2))
    docs = spark.createDataFrame([(i, t, l) for i, t, l, _ in data], "doc_id long, text string, quality string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, _, q in data], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    held = [(out[i].predicted, q) for i, _, _, q in data if out[i].held_out]
    assert len(out) == 400 and len(held) > 80
    assert sum(a == b for a, b in held) > 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    found = langid.identify(odd_docs).collect()
    assert len(found) == len(odd_rows)
    empty = {r[0] for r in odd_rows if not ngrams.has_letter(r[1] or "")}
    assert all((r.lang_pred == "und") == (r.doc_id in empty) for r in found)
    labels = spark.createDataFrame([(0, None, 1), (None, 1, 1), (7, 1, 1), (7, 0, 1), (14, 5, 1), (21, 1, 1)], "doc_id long, quality int, text int")
    scored = quality.classify(odd_docs, labels).collect()
    assert len(scored) == len(odd_rows) and all(0 <= r.score <= 1 for r in scored)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.score == 0.5 for r in quality.classify(odd_docs, none).collect())
    assert langid.identify(no_docs).count() == quality.classify(no_docs, labels).count() == 0
