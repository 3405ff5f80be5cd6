import math
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.providers import HashEmbedding, OverlapReranking, embedding_udf, rerank_scores
from millrace.operators import assemble, chunk, evaluate, extract, parse, relational, retrieve
from millrace.sources import files, web
from millrace.streaming import state


def metrics(spark, grades, k, pool=None, total=None):
    df = spark.createDataFrame([("q", i + 1, g) for i, g in enumerate(grades)], "q string, rank int, grade int")
    totals = spark.createDataFrame([("q", total)], "q string, total int") if total is not None else None
    pool = spark.createDataFrame([("q", g) for g in pool], "q string, grade int") if pool else None
    return evaluate.ranking_metrics(df, "q", k, totals, pool).first()


def test_ranking_metrics(spark):
    m = metrics(spark, [3, 0, 2, 1, 2], 5, total=3)
    assert m.precision_at_k == pytest.approx(3 / 5) and m.recall_at_k == 1.0 and m.mrr == 1.0
    assert m.average_precision == pytest.approx((1 + 2 / 3 + 3 / 5) / 3)
    assert metrics(spark, [3, 0, 2, 1, 2], 3, total=4).recall_at_k == pytest.approx(2 / 4)
    assert metrics(spark, [3, 0, 2, 1, 2], 10).precision_at_k == pytest.approx(3 / 5)
    assert metrics(spark, [0, 1, 2], 3).mrr == pytest.approx(1 / 3) and metrics(spark, [0, 0, 3], 2).mrr == 0
    none = metrics(spark, [0, 0], 2)
    assert none.recall_at_k is None and none.average_precision is None and none.ndcg is None
    assert metrics(spark, [3, 2, 2, 1, 0], 5, pool=[3, 2, 2, 1, 0]).ndcg == pytest.approx(1)
    dcg = 7 + 3 / 2 + 1 / math.log2(5) + 3 / math.log2(6)
    ideal = 7 + 3 / math.log2(3) + 3 / 2 + 1 / math.log2(5)
    assert metrics(spark, [3, 0, 2, 1, 2], 5, pool=[3, 2, 2, 1, 0]).ndcg == pytest.approx(dcg / ideal)


def leg(spark, scores):
    return spark.createDataFrame([("q", k, float(v)) for k, v in scores.items()], "q string, id string, score double")


def test_min_max_fusion(spark):
    rows = retrieve.min_max_fusion(leg(spark, {"a": 12, "b": 6, "c": 0}), leg(spark, {"c": 0.75, "b": 0.5, "a": 0.25}), "q", "id", 0.5, 10).orderBy("rank").collect()
    assert [(r.id, r.score) for r in rows] == [("a", 0.5), ("b", 0.5), ("c", 0.5)]
    rows = {r.id: r for r in retrieve.min_max_fusion(leg(spark, {"a": 8, "b": 4}), leg(spark, {"a": 0.6}), "q", "id", 0.5, 10).collect()}
    assert rows["a"].score == 1.0 and rows["b"].score == 0.0 and rows["b"].semantic_score is None
    assert [r.score for r in retrieve.min_max_fusion(leg(spark, {"a": 3, "b": 3}), leg(spark, {}), "q", "id", 0.0, 10).collect()] == [1.0, 1.0]


def test_breakpoints(spark):
    d = spark.range(1, 11).select(F.col("id").cast("double").alias("d"))
    at = lambda m, v: d.agg(chunk.breakpoint_threshold(F.col("d"), m, v)).first()[0]
    assert at("percentile", 95) == pytest.approx(9.55) and at("percentile", 50) == pytest.approx(5.5)
    assert at("stddev", 1) == pytest.approx(5.5 + math.sqrt(8.25)) and at("iqr", 1.5) == pytest.approx(7.75 + 6.75)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "a", X.fnv1a) == 0xE40C292C and one(spark, "", X.fnv1a) == 2166136261
    assert one(spark, "getUserName snake_case_name HTTP2Client", X.code_tokens)[:4] == ["getusername", "get", "user", "name"]
    assert {"snake_case_name", "snake", "http2client", "http", "2", "client"} <= set(one(spark, "getUserName snake_case_name HTTP2Client", X.code_tokens))
    import uuid, hashlib  # noqa: E401

    want = uuid.UUID(bytes=hashlib.md5(b"chunk:1").digest(), version=3)
    assert one(spark, "chunk:1", X.uuid3) == str(want)
    assert one(spark, " What  is IT?! ", X.normal_question) == "what is it"
    assert one(spark, "score: 7,5 of 10", X.first_number) == 7.5 and one(spark, "none", X.first_number) is None
    assert one(spark, "- \"a query\"", X.strip_list_marker) == "a query" and one(spark, "2. b", X.strip_list_marker) == "b"
    assert one(spark, "```json\n{}\n```", X.strip_fence) == "{}"
    assert one(spark, "  ", X.blank_to_null) is None and one(spark, None, lambda c: X.clip(c, 3)) == "unk..."
    assert one(spark, "one two three", lambda c: X.truncate_words(c, 9)) == "one two"
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert zero.select(X.cosine(F.col("a"), F.col("b")), X.cosine_distance(F.col("a"), F.col("b"))).first()[:] == (0.0, 1.0)
    assert [spark.range(1).select(X.percent_change(F.lit(a), F.lit(b))).first()[0] for a, b in ((0, 0), (5, 0), (3, 2))] == [0, 100, 50]


def test_dartboard():
    q = [1.0, 0.0]
    c = np.array([[math.cos(math.radians(a)), math.sin(math.radians(a))] for a in (10, 11, -30)])
    assert retrieve.dartboard_order(q, c, 2, 1, 1, 0.1) == [0, 2]
    assert retrieve.dartboard_order(q, c, 2, 1, 0, 0.1) == [0, 1]
    assert [retrieve.dartboard_pool(*x) for x in ((5, 3), (50, 10), (150, 3))] == [15, 100, 150]
    assert retrieve.dartboard_order(q, np.zeros((0, 2)), 2, 1, 1, 0.1) == []


def test_context_windows(spark):
    hits = spark.createDataFrame([("q", "d", 0, 5), ("q", "d", 1, 10), ("q", "d", 2, 3)], "q string, d string, rank int, ordinal int")
    got = assemble.context_windows(hits, "q", "d", 1).orderBy("first").collect()
    assert [(r.first, r.last, r.primary_rank) if False else (r["first"], r["last"], r.primary_rank) for r in got] == [(2, 6, 0), (9, 11, 1)]
    kept = assemble.primary_hits(hits, assemble.context_windows(hits, "q", "d", 1), "q", "d")
    assert sorted(r["rank"] for r in kept.collect()) == [0, 1]


def test_assembly(spark):
    s = spark.createDataFrame([("q", 1, "abcdef"), ("q", 2, "ghij"), ("q", 3, "k")], "q string, rank int, t string")
    assert [r.t for r in assemble.budget(s, "q", "t", 2).orderBy("rank").collect()] == ["abcdef", "gh"]
    a = spark.createDataFrame([("a", "so [1] and [SOURCE 2] and [9]")], "k string, t string")
    src = spark.createDataFrame([("a", 1, "T", "https://x"), ("a", 2, "U", "file:/y")], "k string, citation int, title string, uri string")
    assert [r.citation for r in assemble.used_citations(a, "k", "t", src).collect()] == [1]
    assert a.select(assemble.superscript_citations(F.col("t"))).first()[0] == "so ¹ and ² and ⁹"
    v = lambda s, r, p: spark.range(1).select(assemble.verification(F.lit(s), F.lit(r), F.lit(p))).first()[0]
    assert [v(True, None, "block"), v(False, None, "block"), v(False, True, "revise"), v(False, False, "revise"), v(False, None, "warn")] == ["verified", "blocked", "revised", "unsupported", "unsupported"]


@given(st.lists(st.text(alphabet="abcde fgh", min_size=1, max_size=12), max_size=80).map(" ".join), st.integers(50, 120), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_split_and_join(text, size, overlap):
    parts = chunk.prose_parts(text, size, overlap)
    assert all(len(p.text) <= size for p in parts)
    assert "".join(chunk.join_parts(parts).split()) == "".join(text.split())
    assert all(p.overlap in (0, chunk.CONTINUES) or parts[i].text.endswith(p.text[: p.overlap]) for i, p in enumerate(parts[1:]))


def test_prose_parts():
    text = "aaaa bbbb cccc dddd eeee"
    assert [(p.text, p.overlap) for p in chunk.prose_parts(text, 10, 3)] == [("aaaa bbbb", 0), ("bbb cccc", 3), ("ccc dddd", 3), ("ddd eeee", 3)]
    assert [(p.text, p.overlap) for p in chunk.prose_parts(text, 10, 0)] == [("aaaa bbbb", 0), ("cccc dddd", -1), ("eeee", -1)]
    assert [(p.text, p.overlap) for p in chunk.prose_parts("x" * 25, 10, 2)] == [("x" * 10, 0), ("x" * 10, 2), ("x" * 9, 2)]
    assert chunk.prose_parts("   ", 10, 2) == []
    P = chunk.Part
    assert chunk.join_parts([P("one two three four five six", 0), P("three four five six seven", None)]) == "one two three four five six\n\nthree four five six seven"
    assert chunk.join_parts([P("intro three four five six seven", 0), P("three four five six seven eight", None)]) == "intro three four five six seven eight"
    assert chunk.join_parts([P("abcdef", 0), P("defghi", 5)]) == "abcdef\n\ndefghi" and chunk.join_parts([P("abc", 0), P("bcd", 2)]) == "abcd"


def test_code_lines():
    code = "def a():\n    x\n\ndef b():\n    y\n    z\n"
    assert chunk.code_lines(code, 30) == [("def a():\n    x", 1, 2), ("def b():\n    y\n    z", 4, 6)]
    assert [t for t, _, _ in chunk.code_lines("a" * 25 + "\nb", 10)] == ["a" * 10, "a" * 10, "aaaaa\nb"]
    assert chunk.code_lines("a\n\nbbbb\ncccc\n", 10) == [("a\n\nbbbb", 1, 3), ("cccc", 4, 4)]  # the blank line lies before half
    assert chunk.code_lines("\n  \n", 10) == []


def test_pack_counts_fences():
    prose, code = {"heading": "A", "kind": "prose", "text": "p" * 40}, {"heading": "A", "kind": "code", "text": "y = 1", "language": "py"}
    assert [len(c["text"]) for c in chunk.pack_blocks([prose, code], chunk.ChunkOptions(60, 0))] == [40 + 2 + 15]
    assert [(c["kind"], c["text"]) for c in chunk.pack_blocks([prose, code], chunk.ChunkOptions(56, 0))] == [("prose", "p" * 40), ("code", "y = 1")]
    assert all(len(c["text"]) <= 50 for c in chunk.pack_blocks([prose, {**code, "text": "z\n" * 60}, prose], chunk.ChunkOptions(50, 0)))


def test_chunks():
    assert chunk.ChunkOptions(10, 90).size == 50 and chunk.ChunkOptions(10, 90).overlap == 49
    assert chunk.ChunkOptions.for_job(100, 500) == chunk.ChunkOptions(200, 100)
    blocks = [{"heading": "A", "kind": "prose", "text": "x" * 30}, {"heading": "A", "kind": "code", "text": "y = 1"}, {"heading": "B", "kind": "code", "text": "z"}]
    got = chunk.pack_blocks([{**b, "language": ""} for b in blocks], chunk.ChunkOptions(60, 0))
    assert [(c["heading"], c["kind"]) for c in got] == [("A", "prose"), ("B", "code")] and "```\ny = 1\n```" in got[0]["text"]
    source = "import os\n\n# about f\ndef f():\n    return 1\n\nclass A:\n    def m(self):\n        return 2\n"
    assert [(n, a, b) for n, _, a, b in chunk.code_chunks("a.py", source, chunk.ChunkOptions(500))] == [("", 1, 1), ("f", 3, 5), ("A", 7, 9)]
    assert chunk.code_chunks("a.rs", "fn a() {}\n", chunk.ChunkOptions(500))[0][2:] == (1, 1)
    s = "One is here. Two is there! \"Three?\" Four.\n\nFive."
    assert [x for x, _ in chunk.split_sentences(s)] == ["One is here.", "Two is there!", "\"Three?", "Four.", "Five."]
    assert chunk.join_sentences([("A.", True), ("B.", False), ("C.", True)]) == "A. B.\n\nC."
    assert chunk.fit_groups([10, 10, 10, 10], [0.1, 0.9, 0.1], [False, True, False], 100, 5) == [(0, 2), (2, 4)]
    assert chunk.fit_groups([60, 60, 60], [0.2, 0.5], [False, False], 130, 5) == [(0, 2), (2, 3)]


def test_semantic_chunks(spark):
    rows, at = [], 0
    for topic, v in (("cat", [1.0, 0.0, 0.0]), ("stock", [0.0, 1.0, 0.0]), ("rocket", [0.0, 0.0, 1.0])):
        for i in range(4):
            rows.append(("d", at, f"The {topic} sentence number {i} goes on for a while here.", v))
            at += 1
    df = spark.createDataFrame(rows, "d string, pos int, sentence string, vector array<double>")
    assert chunk.semantic_chunks(df, "d", "percentile", 80.0).count() == 3


def test_tables_and_pages():
    html = "<html lang='en'><head><title>T</title></head><body><nav>menu</nav><main><h1>A</h1><p>one <b>two</b></p><h2>B</h2><ul><li>x<ul><li>y</li></ul></li><li>z</li></ul><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table><pre class='language-java'>int i;\n</pre><img src='s.png' srcset='m.png 100w, l.png 300w' alt='pic'></main></body></html>"
    got = parse.html_blocks(html)
    assert [(b["heading"], b["kind"], b["text"]) for b in got] == [("A", "prose", "one two"), ("A > B", "prose", "- x\n  - y\n- z"), ("A > B", "prose", "a | b\n1 | 2"), ("A > B", "code", "int i;"), ("A > B", "image", "[Image: pic] (l.png)")]
    assert got[3]["language"] == "java" and parse.page_metadata(html)["title"] == "T" and parse.page_metadata(html)["lang"] == "en"
    prose = lambda h, t: {"heading": h, "kind": "prose", "text": t}
    assert parse.body_text([prose("A", "x"), prose("A > B", "y"), prose("A > B", " ")]) == "A\nx\n\nB\ny"


def test_web(spark, tmp_path):
    urls = {"HTTP://Ex.COM:80/a#f": "http://ex.com/a", "https://ex.com": "https://ex.com/", "https://ex.com:8443/x?q=1": "https://ex.com:8443/x?q=1", "mailto:a@b": None, "http://a/b/../c/./d": "http://a/c/d", "http://a/b/c/..": "http://a/b/", "http://a//b///c": "http://a/b/c", "http://a/./": "http://a/", "http://a/../x": "http://a/../x", "http://bücher.de/ü": "http://xn--bcher-kva.de/ü"}
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", web.canonical_url(F.col("u")).alias("c")).collect()
    assert {r.u: r.c for r in rows} == urls
    graph = {"https://a/": ["https://a/1", "https://b/"], "https://a/1": ["https://a/2#x", "https://a/"], "https://a/2": ["https://a/3"]}
    edges = spark.createDataFrame([(a, b) for a, bs in graph.items() for b in bs], "src string, dst string")
    scope = spark.createDataFrame([("https://sub.a/x",), ("https://b/x",), (None,)], "u string")
    assert [r[0] for r in scope.select(web.in_scope(F.col("u"), [], True, seed="HTTPS://A/start")).collect()] == [True, False, False]
    assert [r[0] for r in scope.select(web.in_scope(F.col("u"), [])).collect()] == [False] * 3
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    links = lambda pages: pages.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url"))
    seen = web.expand_frontier(spark.createDataFrame([("https://a",)], "url string"), links, lambda u: web.in_scope(u, ["a"]), 2, 10)
    assert {(r.url, r.depth) for r in seen.collect()} == {("https://a/", 0), ("https://a/1", 1), ("https://a/2", 2)}
    assert web.public_host("8.8.8.8") and not any(map(web.public_host, ("127.0.0.1", "10.0.0.1", "169.254.169.254", "::1", "x")))


def test_globs(spark):
    import re

    hit = lambda p, s: bool(re.search(X.path_glob_to_regex(p), s))
    assert hit("*.java", "a/b/C.java") and hit("docs/", "docs/a/b") and hit("**/x/*.md", "a/b/x/y.md") and not hit("src/*.py", "src/a/b.py")
    assert not hit("docs/", "x/docs/a") and hit("/docs/*", "docs/a") and hit("**", "a/b") and not hit("a/b.py", "x/a/b.py")
    names = {"x/Dockerfile": "dockerfile", "dockerfile.dev": "dockerfile", "a/MAKEFILE": "makefile", "a.mts": "typescript", "b.tf": "terraform", "c": None, "d.unknown": None}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", parse.language_of(F.col("n")).alias("l")).collect()
    assert {r.n: r.l for r in rows} == names


def test_knn_in_blocks(spark):
    from millrace.operators import textindex

    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "id long, v array<double>")
    q = v.select(F.col("id").alias("q"), F.col("v").alias("qv"))
    whole, parts = (sorted(map(tuple, textindex.knn(v, q, "id", "v", "q", "qv", 3, n).collect())) for n in (1 << 20, 200))
    assert whole == parts and len(whole) == 120


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.py").write_text("x = 1\n")
    (tmp_path / "a/b.bin").write_bytes(b"a\0b")
    (tmp_path / "l.txt").write_text(files.LFS_PREFIX + "\noid")
    (tmp_path / "y.md").write_text("hi")
    assert [r.path for r in files.scan_tree(spark, str(tmp_path)).orderBy("path").collect()] == ["a/x.py", "y.md"]
    assert [r.path for r in files.scan_tree(spark, str(tmp_path), ["*.md"]).collect()] == ["y.md"]
    rows = spark.createDataFrame([(1, "a", "s")], "id int, name string, api_key string")
    files.export_bundle({"t": rows}, str(tmp_path / "bundle"))
    assert [tuple(r) for r in files.import_bundle(spark, str(tmp_path / "bundle"), {"t": "id int, name string"})["t"].collect()] == [(1, "a")]


def test_versions_and_lists(spark):
    v = relational.versions(spark.createDataFrame([("d", 1, "x"), ("d", 2, "x"), ("d", 3, "y")], "d string, at int, h string"), "d", "h", [F.col("at")])
    assert [(r["at"], r.version, r.current) for r in v.orderBy("at").collect()] == [(1, 1, False), (3, 2, True)]
    a = spark.createDataFrame([("k", 1)], "k string, n int")
    assert [tuple(r) for r in relational.upsert(a, spark.createDataFrame([("k", 2), ("l", 3)], "k string, n int"), ["k"]).orderBy("k").collect()] == [("k", 2), ("l", 3)]
    d = relational.line_diff(spark.createDataFrame([("a\nb", "a\r\nc", 2)], "x string, y string, v int"), "x", "y", "v").first().diff
    assert d == "--- v1\n+++ v2\n a\n+c\n-b\n"
    assert one(spark, "oops", relational.json_tags) == [] and one(spark, '["a"]', relational.json_tags) == ["a"]


def test_extract(spark):
    rows = spark.createDataFrame([("c", "ip 10.0.0.1, bad 300.1.1.1 and ::1 or fe80::1; id AB-12 AB-13")], "chunk_id string, content string")
    got = extract.extract(rows, [("ip", "ip", None), ("id", "regex", r"AB-\d+")]).collect()
    assert sorted((r.rule_id, r.matched_value) for r in got) == [("id", "AB-12"), ("id", "AB-13"), ("ip", "10.0.0.1"), ("ip", "::1"), ("ip", "fe80::1")]
    with pytest.raises(ValueError):
        extract.check_rule("regex", "(")


def test_state():
    at = datetime(2024, 1, 7, 10, 30)  # a Sunday
    assert state.cron_matches("30 10 * * *", at) and state.cron_matches("*/15 9-11 * * 0", at) and state.cron_matches("30 10 1 * 7", at)
    assert not state.cron_matches("0 10 * * *", at) and not state.cron_matches("30 10 * 2 *", at)
    with pytest.raises(ValueError):
        state.cron_matches("61 * * * *", at)
    r = retrieve.SearchRequest("  x ", 500)
    assert (r.query, r.limit, r.resolved_mode(True), r.resolved_mode(False), r.candidate_limit(100, 50)) == ("x", 100, "hybrid", "lexical", 100)
    with pytest.raises(ValueError):
        retrieve.SearchRequest(" ")


def test_providers(spark):
    df = spark.createDataFrame([("q", 1, "red car", "a red car"), ("q", 2, "blue", "a red car")], "q string, id int, t string, qt string")
    v = df.select(embedding_udf(HashEmbedding(16))(F.col("t")).alias("v")).first().v
    assert len(v) == 16 and sum(x * x for x in v) == pytest.approx(1)
    s = {r.id: r.rerank_score for r in rerank_scores(df, OverlapReranking(), "q", "id", "t", "qt").collect()}
    assert s[1] == pytest.approx(2 / 3) and s[2] == 0


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([("a", True, datetime(2024, 1, 1, 1)), ("b", False, datetime(2024, 1, 1, 2)), ("b", False, datetime(2024, 1, 1, 2, 5))], "item_id string, ok boolean, ts timestamp")
    events.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        return [tuple(r) for r in spark.table(name).collect()]

    assert sorted(n for _, n in drain(state.stream_hourly(stream(), "ts"), "hours", "update")) == [1, 2]
    assert sorted(drain(state.stream_retries(stream()), "retries", "update")) == [("a", 0, "DONE", 0), ("b", 2, "RETRY_WAITING", 4)]
    q = stream().writeStream.foreachBatch(state.counter_sink(str(tmp_path / "hits"), ["item_id"], "ts")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.item_id: r.hits for r in state.read_counters(spark, str(tmp_path / "hits"), ["item_id"]).collect()} == {"a": 1, "b": 2}


@given(st.lists(st.sampled_from("abcd"), max_size=14), st.lists(st.sampled_from("abcd"), max_size=14))
@settings(max_examples=300, deadline=None)
def test_diff_is_longest(x, y):
    out = relational.unified_diff("\n".join(x), "\n".join(y))
    x, y = "\n".join(x).split("\n"), "\n".join(y).split("\n")
    assert [o[1:] for o in out if o[0] in " -"] == x and [o[1:] for o in out if o[0] in " +"] == y
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
    assert sum(o[0] == " " for o in out) == table[-1][-1]
    assert relational.unified_diff("a\nb", "c", 1) == ["-a", "-b", "+c"]


def test_topics_beyond_the_cap(spark):
    rows = [("t", f"topic {i}", 1000 - i, [1.0, float(i)]) for i in range(5)]
    rows += [("t", x, 9 - k, [0.0, 1.0]) for k, x in enumerate(["Late one?", "late one", "other!", "LATE ONE.", "alone"])]
    df = spark.createDataFrame(rows, "tenant string, topic string, frequency int, vector array<double>")
    got = {r.topic: r.leader for r in evaluate.leader_clusters(df, "tenant", cap=5).collect()}
    assert len(got) == 10 and [got[x] for x in ("Late one?", "late one", "LATE ONE.", "other!", "alone")] == ["Late one?"] * 3 + ["other!", "alone"]
    assert got["topic 0"] == "topic 0" and got["topic 4"] == "topic 3"


def test_rules_beyond_any_list(spark):
    cases = spark.createDataFrame([(1, "What is it?", ["a"]), (2, "say it twice", ["b"]), (3, "none", [])], "case_id int, question string, tags array<string>")
    rules = [(f"x{i}", "EQUALS", f"never {i}", 1) for i in range(300)] + [("eq", "EQUALS", "WHAT is it", 5), ("tag", "TAG", "a", 4), ("in", "CONTAINS", "it tw", 9), ("tag2", "TAG", "b", 9)]
    df = spark.createDataFrame(rules, "rule_id string, kind string, pattern string, created_at int")
    for most in (10_000, 0):
        relational.LISTED, was = most, relational.LISTED
        got = {r.case_id: r.rule_id for r in relational.ignore_rules(cases, df, X.normal_question).collect()}
        relational.LISTED = was
        assert got == {1: "tag", 2: "in", 3: None}


def test_sources_left_whole(spark):
    rows = [("q", 1, "One. Two. One."), ("q", 2, "```\nx\n``` One."), ("q", 3, "s. " * 400), ("q", 4, "two. Three.")]
    got = [(r["rank"], r.pos, r.sentence, r.whole) for r in assemble.distinct_sentences(spark.createDataFrame(rows, "q string, rank int, t string"), "q", "t").orderBy("rank", "pos").collect()]
    assert got == [(1, 0, "One.", False), (1, 1, "Two.", False), (2, 0, rows[1][2], True), (3, 0, rows[2][2], True), (4, 1, "Three.", False)]


def test_prompts_and_requests():
    assert assemble.system_prompt("base") == "base" and assemble.clean_prompt("a\r\n\x07b ") == "a\nb" and assemble.clean_prompt(" \x00") is None
    assert [assemble.system_prompt("base", "one", "two").index(x) for x in ("base", "one", "two")] == sorted(assemble.system_prompt("base", "one", "two").index(x) for x in ("base", "one", "two"))
    with pytest.raises(ValueError):
        assemble.clean_prompt("x" * 4001)
    assemble.check_request("q", [("user", "a")])
    for bad in (("", []), ("q" * 8001, []), ("q", [("system", "a")]), ("q", [("user", "")]), ("q", [("user", "a")] * 21)):
        with pytest.raises(ValueError):
            assemble.check_request(*bad)


def test_sinks(spark, tmp_path):
    from millrace.sources import sinks

    rows = spark.createDataFrame([("a", bytearray(b"xy")), ("b", bytearray(b"xy")), ("c", bytearray(b"x" * 50))], "name string, content binary")
    got = {r.name: (r.size, r.accepted) for r in sinks.put_artifacts(rows, str(tmp_path / "art"), 10).collect()}
    assert got == {"a": (2, True), "b": (2, True), "c": (50, False)} and spark.read.parquet(str(tmp_path / "art")).count() == 1
    sinks.put_artifacts(rows, str(tmp_path / "art"), 100)  # what lies there already is not written again
    assert spark.read.parquet(str(tmp_path / "art")).count() == 2
    a = spark.createDataFrame([("c1", "s1"), ("c2", "s2")], "crate_id string, source_id string")
    b = spark.createDataFrame([("c1", "j1", "s1"), ("c1", "j2", None)], "crate_id string, job_id string, source_id string")
    out = sinks.duplicate_configuration({"sources": a, "jobs": b}, "c1", "new", {"sources": "source_id", "jobs": "job_id"}, {"jobs": {"source_id": "sources"}})
    new = out["sources"].first()
    assert out["sources"].count() == 1 and new.crate_id == "new" and new.source_id != "s1"
    assert {r.source_id for r in out["jobs"].collect()} == {new.source_id, None}


def test_routing_and_replies(spark):
    settings, made = {"a": {"kind": "x"}}, []
    index = retrieve.RoutingIndex(lambda c: settings[c], lambda s: made.append(dict(s)) or len(made))
    assert index.of("a") == index.of("a") == 1
    settings["a"]["kind"] = "y"
    assert index.of("a") == 2 and made == [{"kind": "x"}, {"kind": "y"}]
    from millrace.functions.providers import ReplayedAnswers

    ask = [{"role": "user", "content": "q"}]
    assert ReplayedAnswers({ReplayedAnswers.fingerprint(ask): "r"}).complete(ask) == "r"
    assert [t.num_rows for t in retrieve.both_legs(spark.range(3), spark.range(4))] == [3, 4]
