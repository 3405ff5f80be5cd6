import json
import random
from collections import defaultdict

from pyspark.sql import functions as F

from millrace.operators import evaluate, retrieve


def test_judge_groups_are_repaired(spark):
    topics = [("a", f"t{i}", 100 - i) for i in range(6)] + [("b", "x", 1), ("c", "y", 2), ("d", "z", 3), ("d", "w", 4)]
    df = spark.createDataFrame(topics, "tenant string, topic string, frequency int")
    replies = [("a", 'So {"groups": [[4, 1, 9], [1, 2, "3"], 5, [-1, 1.5, 0]]}'), ("b", "none"), ("c", None), ("d", json.dumps({"groups": []}))]
    got = {(r.tenant, r.topic): r.leader for r in evaluate.judge_clusters(df, spark.createDataFrame(replies, "tenant string, reply string"), "tenant", 5).collect()}
    assert got == {("a", "t0"): "t0", ("a", "t1"): "t1", ("a", "t4"): "t1", ("a", "t2"): "t2", ("a", "t3"): "t3", ("a", "t5"): "t5", ("d", "z"): "z", ("d", "w"): "w"}


def test_leaders_need_no_window_over_a_tenant(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 50 == 0, "few").otherwise("most").alias("tenant"), F.concat(F.lit("topic "), "id").alias("topic"), (F.col("id") % 900).alias("frequency"), F.array(F.sin("id"), F.cos("id")).alias("vector"))
    out = evaluate.leader_clusters(rows, "tenant")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2 and out.count() == 5000
    assert evaluate.leader_clusters(rows.where("false"), "tenant").count() == 0


def test_gap_cube_on_odd_cases(spark):
    kind = "tenant string, created_at int, status string, reason string, leader string, tags array<string>, faithfulness double"
    rows = [
        ("a", 1, "UNANSWERED", "no-sources", "x", ["p", "q", "p"], 0.5),
        ("a", 2, "PARTIAL", "partial", "x", [], None),
        ("a", 3, "ANSWERED", None, "x", ["p"], 1.0),
        ("a", 4, None, None, None, None, 0.0),
        (None, 5, "UNANSWERED", "not-in-sources", "y", ["p", None], None),
    ]
    cube = evaluate.gap_cube(spark.createDataFrame(rows, kind), "tenant")
    got = {(r.tenant, r.level, r.topic, r.tag): (r.cases, r.tracked, r.gaps, r.newest_gap, r.faithfulness) for r in cube.collect()}
    assert got == {
        ("a", "tenant", None, None): (4, 3, 2, 2, 0.5),
        ("a", "topic", "x", None): (3, 3, 2, 2, 0.75),
        ("a", "tag", None, "p"): (2, 2, 1, 1, 0.75),
        ("a", "tag", None, "q"): (1, 1, 1, 1, 0.5),
        ("a", "topic_tag", "x", "p"): (2, 2, 1, 1, 0.75),
        ("a", "topic_tag", "x", "q"): (1, 1, 1, 1, 0.5),
        (None, "tenant", None, None): (1, 1, 1, 5, None),
        (None, "topic", "y", None): (1, 1, 1, 5, None),
        (None, "tag", None, "p"): (1, 1, 1, 5, None),
        (None, "topic_tag", "y", "p"): (1, 1, 1, 5, None),
    }
    variants = spark.createDataFrame([("a", "x", ["X!"])], "tenant string, topic string, variants array<string>")
    best = {r.topic: (r.at, r.gaps, r.tags, r.variants) for r in evaluate.gap_topics(cube, "tenant", variants).collect() if r.tenant}
    assert best == {"x": (1, 2, ["p", "q"], ["X!"])}


def brute_weights(hits, documents, feedback, sources, verdicts, per):
    """One question after the other, as the rule says."""
    out = {}
    identity = {d: i for d, i in documents if i is not None}
    for q in {h[0] for h in hits}:
        own = sorted((h for h in hits if h[0] == q), key=lambda h: h[2])
        ids = {identity[h[1]] for h in own if h[1] in identity}
        rated = sorted(((at, f, r) for f, at, r in feedback if r is not None and any(g == f and i in ids for g, i in sources)), reverse=True)[: min(40, per * len(ids))]
        ratings = defaultdict(list)
        for _, f, r in rated:
            if (verdicts.get((q, f)) or "").strip().lower().startswith("yes"):
                for i in {i for g, i in sources if g == f and i in ids}:
                    if len(ratings[i]) < per:
                        ratings[i].append(r)
        new = []
        for _, d, _, s in own:
            of = ratings.get(identity.get(d))
            new.append((d, s * (sum(of) / len(of) / 3) if of else s))
        for n, (d, s) in enumerate(sorted(new, key=lambda x: -x[1]), 1):
            out[q, d] = (n, round(s, 9))
    return out


def test_feedback_budget_is_shared(spark):
    rng = random.Random(4)
    hits = [(q, d, n + 1, float(9 - n // 2)) for q in range(6) for n, d in enumerate(rng.sample(range(30), 8))]
    documents = [(d, None if d % 11 == 0 else f"u{d % 9}") for d in range(30)]
    feedback = [(f, rng.randrange(1000), rng.choice([None, 1, 2, 3, 4, 5])) for f in range(400)]
    sources = [(f, rng.choice(["u1", "u2", "u3", "u4", "u8", None])) for f in range(400) for _ in range(2)]
    verdicts = {(q, f): rng.choice(["yes", "Yes.", " no", None]) for q in range(5) for f in range(400)}  # none for the last question
    frame = spark.createDataFrame
    args = (frame(hits, "query int, document_id int, rank int, score double"), frame(documents, "document_id int, identity string"), frame(feedback, "feedback_id int, rated_at int, relevance int"), frame(sources, "feedback_id int, identity string"))
    asked = frame([(q, f, r) for (q, f), r in verdicts.items()], "query int, feedback_id int, reply string")
    for per in (2, 20):
        got = {(r.query, r.document_id): (r.rank, round(r.score, 9)) for r in retrieve.feedback_weighted(*args, asked, "query", per).collect()}
        assert got == brute_weights(hits, documents, feedback, sources, verdicts, per)
        most = retrieve.feedback_checks(*args, "query", per).groupBy("query").count().agg(F.max("count")).first()[0]
        assert most <= 40
    assert {d: r for (q, d), r in got.items() if q == 5} == {h[1]: (h[2], h[3]) for h in hits if h[0] == 5}


def test_citations_and_their_list(spark):
    from millrace.operators import assemble

    answers = [(1, "One [1], two\t[SOURCE  12].\n  [1] three [3] [9]"), (2, "none [1]"), (3, "[2]"), (4, " "), (5, None), (6, "no marks")]
    sources = [(1, 1, "A", "http://a"), (1, 12, None, "https://b"), (1, 3, "C", "git+x"), (2, 1, "A", None), (3, 2, " ", "HTTP://c"), (4, 1, "A", "http://a"), (5, 1, "A", "http://a"), (6, 1, "A", "http://a")]
    out = assemble.annotated_answers(spark.createDataFrame(answers, "id int, text string"), spark.createDataFrame(sources, "id int, citation int, title string, link string"), "id")
    rule = "\n\n---\n\n"
    assert {r.id: r.text for r in out.collect()} == {
        1: f"One¹, two¹².\n  ¹ three [3] [9]{rule}[1] [A](http://a)\n[12] [https://b](https://b)",
        2: "none [1]",
        3: f"²{rule}[2] [HTTP://c](HTTP://c)",
        4: " ",
        5: None,
        6: "no marks",
    }
