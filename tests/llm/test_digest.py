import hashlib
import re
import unicodedata
from collections import Counter

import xxhash

from millrace.llm import digest


def canon(t):
    t = re.sub(r"[ \t\n\x0b\x0c\r\x85\xa0  -     　]+", " ", unicodedata.normalize("NFC", t).casefold())
    return unicodedata.normalize("NFC", t.strip(" "))


def wide(t):
    c = canon(t).encode()
    return f"{xxhash.xxh64_intdigest(c, 42):016x}" + f"{xxhash.xxh64_intdigest(c, xxhash.xxh64_intdigest(b'millrace', 42)):016x}"


def test_odd_rows(spark, odd_docs, odd_rows, no_docs):
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0))
    want = []
    for i, r in enumerate(rows):
        t, n = r[1] or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(t) // 4
        e = t[: len(t) - k] + n[:k]
        want.append((r[0], len(t), hashlib.sha256(e.encode()).hexdigest(), wide(t), wide(e), float(wide(t) == wide(e)), float(wide(t) == wide(n))))
    assert Counter(tuple(r) for r in digest.fingerprints(odd_docs).collect()) == Counter(want)
    assert digest.fingerprints(no_docs).count() == 0


def test_collisions_are_told_apart(spark):
    rows = spark.createDataFrame([("x", "a"), ("x", "a"), ("y", "a"), ("y", "b")], "digest string, canon string")
    assert [r[0] for r in digest.colliding(rows).collect()] == ["y"]


def test_groups_of_sparse_ids(spark):
    ids = [1, 2, 3, 10**6, 10**9, -5, 10**15, *range(5000, 9000), *range(2**40, 2**50, 2**41)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.doc_id: r.next_text for r in digest.with_next(df).collect()}
    ids.sort()
    assert got == {a: f"t{b}" for a, b in zip(ids, ids[1:] + ids[:1])}


def test_no_python_in_the_plan(spark, odd_docs):
    plan = digest.fingerprints(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_groups_follow_the_density(spark):
    ids = [*range(0, 10**9, 10**5), *range(5 * 10**8, 5 * 10**8 + 30_000), *range(-(10**15), 0, 10**12)]
    df = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    sizes = sorted(r[1] for r in df.groupBy(digest._group(df).alias("g")).count().collect())
    assert sum(sizes) == len(ids) and sizes[-1] <= 4 * digest.GROUP_ROWS


def test_case_folding(spark):
    texts = ["Straße", "STRASSE", "strasse", "ΣΊΣΥΦΟΣ", "σίσυφος", "σίσυφοσ", "Éa", "e\u0301A", "a  B", "A\u2003b "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [r.fingerprint for r in digest.fingerprints(df).orderBy("doc_id").collect()]
    assert len({*found[:3]}) == len({*found[3:6]}) == len({*found[6:8]}) == len({*found[8:]}) == 1 and len(set(found)) == 4


def test_dense_and_sparse_ids_together(spark):
    rows = [(i, f"text {(i or 0) % 97}") for i in (*range(3000), *range(10**6, 10**12, 10**10))] + [(None, "x"), (None, "y"), (5, "another")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = digest.fingerprints(df).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest(r[1].encode(), 42))))
    want = Counter((r[0], wide(r[1]), float(r[1] == n[1])) for r, n in zip(order, order[1:] + order[:1]))
    assert Counter((r.doc_id, r.fingerprint, r.near_next) for r in out) == want


def signed(x):
    return x - (1 << 64) if x >> 63 else x
