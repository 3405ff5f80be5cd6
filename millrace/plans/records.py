"""Queries of records, evaluation reports, queues and lists."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..operators import assemble, evaluate, extract, parse, relational, retrieve
from ..sources import sinks
from ..streaming import state
from .registry import query, table
from .reports import ITEMS_SQL, _items

NOW = datetime(2024, 1, 20)


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


# records


@query("""
SELECT concat('chunk:', doc_id) AS record_id, 'chunk' AS kind, text AS content, lang AS language FROM documents
UNION ALL SELECT concat('question:', conv_id, ':', turn), 'question', text, NULL FROM conversations WHERE role = 'user'
UNION ALL SELECT concat('summary:', conv_id, ':', turn), 'summary', text, NULL FROM conversations WHERE role = 'assistant'
UNION ALL SELECT concat('proposition:', conv_id, ':', turn), 'proposition', text, NULL FROM conversations WHERE role = 'system'
UNION ALL SELECT concat('document:', page_id), 'document', html, NULL FROM pages
""")
def all_records(spark, sf_dir):
    said = table(spark, sf_dir, "conversations")
    turn = lambda kind, role: said.where(F.col("role") == role).select(F.concat_ws(":", F.lit(kind), "conv_id", "turn").alias("record_id"), F.col("text").alias("content"))
    parts = {
        "chunk": table(spark, sf_dir, "documents").select(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string")).alias("record_id"), F.col("text").alias("content"), F.col("lang").alias("language")),
        "question": turn("question", "user"),
        "summary": turn("summary", "assistant"),
        "proposition": turn("proposition", "system"),
        "document": table(spark, sf_dir, "pages").select(F.concat(F.lit("document:"), F.col("page_id").cast("string")).alias("record_id"), F.col("html").alias("content")),
    }
    return retrieve.all_records(parts).select("record_id", "kind", "content", "language")


@query("""
WITH d AS (SELECT *, CASE WHEN trim(coalesce(source, '')) <> '' THEN concat('Title: ', source) END AS h1, CASE WHEN doc_id % 4 = 0 AND trim(coalesce(lang, '')) <> '' THEN concat('Section: ', lang) END AS h2 FROM documents),
b AS (SELECT *, concat_ws(chr(10), h1, h2) AS head, CASE WHEN doc_id % 3 = 0 THEN '[' || coalesce(lang, 'code') || ']' || CASE WHEN doc_id % 2 = 0 THEN ' f' || doc_id ELSE '' END || chr(10) || text ELSE text END AS body FROM d)
SELECT doc_id, CASE WHEN head <> '' THEN head || chr(10) || chr(10) || body ELSE body END AS retrieval_text FROM b
""")
def retrieval_text(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "code").otherwise("prose")
    symbol = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("f"), F.col("doc_id").cast("string")))
    section = F.when(F.col("doc_id") % 4 == 0, F.col("lang"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", retrieve.retrieval_text(kind, F.col("lang"), symbol, F.col("text"), F.col("source"), F.lit(None).cast("string"), section).alias("retrieval_text"))


@query("SELECT concat('chunk:', doc_id) AS record_id, doc_id % 3 AS run FROM documents WHERE doc_id % 3 = 1 AND doc_id IN (SELECT doc_id FROM labels)")
def filter_records(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string")).alias("record_id"), F.lit("chunk").alias("kind"), (F.col("doc_id") % 3).alias("run_id"), F.col("doc_id").alias("chunk_id"))
    known = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id"))
    return retrieve.filter_records(rows, "chunk", 1, known).select("record_id", F.col("run_id").alias("run"))


@query("""
SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE concat('passage ', vec_id) END AS passage, CASE WHEN vec_id % 3 = 1 THEN 1 - label ELSE label END AS first FROM embeddings WHERE vec_id % 50 = 0
""")
def hyde_vectors(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select("vec_id", "label", F.array(F.col("label").cast("double")).alias("v"))
    passages = q.where("vec_id % 3 <> 0").select("vec_id", F.concat(F.lit("```text\npassage "), F.col("vec_id").cast("string"), F.lit("\n```")).alias("text"), F.when(F.col("vec_id") % 3 == 1, F.array((1 - F.col("label")).cast("double"))).alias("passage_vector"))
    found = retrieve.hyde_vectors(q, passages, "vec_id", "v")
    return found.select("vec_id", "passage", F.element_at("v", 1).cast("int").alias("first"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents),
c AS (SELECT doc_id, ordinal, concat('h', ordinal // 3) AS heading, CASE WHEN ordinal % 4 = 1 THEN concat(content, ' (img', doc_id % 5, '.png)') ELSE content END AS content FROM l),
i AS (SELECT doc_id, concat('img', doc_id % 7, '.png') AS url, concat('h', doc_id % 3) AS heading FROM documents)
SELECT i.doc_id AS document_id, i.url, CAST(coalesce(min(CASE WHEN contains(content, concat('(', i.url, ')')) THEN ordinal END), max(CASE WHEN c.heading = i.heading THEN ordinal END)) AS INTEGER) AS anchor_ordinal FROM i LEFT JOIN c USING (doc_id) GROUP BY 1, 2
""")
def image_anchor(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumnRenamed("doc_id", "document_id")
    lines = docs.select("document_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))
    shown = F.concat("content", F.lit(" (img"), (F.col("document_id") % 5).cast("string"), F.lit(".png)"))
    chunks = lines.select("document_id", "ordinal", F.concat(F.lit("h"), F.floor(F.col("ordinal") / 3).cast("string")).alias("heading"), F.when(F.col("ordinal") % 4 == 1, shown).otherwise(F.col("content")).alias("content"))
    images = docs.select("document_id", F.concat(F.lit("img"), (F.col("document_id") % 7).cast("string"), F.lit(".png")).alias("url"), F.concat(F.lit("h"), (F.col("document_id") % 3).cast("string")).alias("heading"))
    return parse.image_anchor(images, chunks)


@query("""
WITH o AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 100000 AS BIGINT) AS size FROM lineitem),
lists AS (SELECT l_orderkey, list(size ORDER BY l_linenumber, size) AS sizes, list(l_linenumber ORDER BY l_linenumber, size) AS ids FROM o GROUP BY 1),
f AS (SELECT l_orderkey, list_reduce(list_prepend({'t': 0::BIGINT, 'k': []::BIGINT[]}, list_transform(range(1, len(sizes) + 1), lambda i: {'t': sizes[i], 'k': [ids[i]]::BIGINT[]})), lambda s, x: CASE WHEN len(s.k) < 4 AND s.t + x.t <= 12582912 THEN {'t': s.t + x.t, 'k': list_concat(s.k, x.k)} ELSE s END) AS r FROM lists)
SELECT l_orderkey, CAST(unnest(range(1, len(r.k) + 1)) AS INTEGER) AS n, CAST(unnest(r.k) AS VARCHAR) AS id FROM f
""")
def answer_images(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("rank"), F.col("l_linenumber").alias("id"), (F.col("l_quantity") * 100000).cast("long").alias("size"))
    return assemble.answer_images(rows, "l_orderkey").select("l_orderkey", "n", "id")


# evaluation

CASES_SQL = """
WITH cases AS (SELECT event_id AS case_id, ts AS created_at, CASE WHEN user_id % 3 = 0 THEN 'GOLDEN' ELSE 'LIVE' END AS source, value / 500 AS faithfulness, CASE WHEN event_id % 4 > 0 THEN (event_id % 11) / 10::DOUBLE END AS answer_relevance, CASE WHEN event_id % 5 > 0 THEN (event_id % 7) / 6::DOUBLE END AS completeness,
concat(event_type, CASE event_id % 3 WHEN 0 THEN '?' WHEN 1 THEN '' ELSE '!' END) AS topic, event_type AS leader, concat('u', user_id % 10) AS t1, concat('v', event_id % 6) AS t2, CASE WHEN event_id % 9 = 0 THEN concat('r', event_id % 4) END AS rule_id FROM events)
"""


def _cases(spark, sf_dir):
    e, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        e.alias("case_id"),
        F.col("ts").alias("created_at"),
        F.when(u % 3 == 0, "GOLDEN").otherwise("LIVE").alias("source"),
        (F.col("value") / 500).alias("faithfulness"),
        F.when(e % 4 > 0, (e % 11) / 10.0).alias("answer_relevance"),
        F.when(e % 5 > 0, (e % 7) / 6.0).alias("completeness"),
        F.concat("event_type", F.when(e % 3 == 0, "?").when(e % 3 == 1, "").otherwise("!")).alias("topic"),
        F.col("event_type").alias("leader"),
        F.array(F.concat(F.lit("u"), (u % 10).cast("string")), F.concat(F.lit("v"), (e % 6).cast("string"))).alias("tags"),
        F.when(e % 9 == 0, F.concat(F.lit("r"), (e % 4).cast("string"))).alias("rule_id"),
    )


SCORES = ["faithfulness", "answer_relevance", "completeness"]


@query(CASES_SQL + "SELECT source, count(*) AS cases, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevance), 6) AS answer_relevance, round(avg(completeness), 6) AS completeness FROM cases WHERE rule_id IS NULL GROUP BY 1")
def source_averages(spark, sf_dir):
    return evaluate.averages(_cases(spark, sf_dir).where("rule_id is null"), ["source"], SCORES)


@query(CASES_SQL + "SELECT source, CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, count(*) AS cases, round(avg(faithfulness), 6) AS faithfulness, round(avg(answer_relevance), 6) AS answer_relevance, round(avg(completeness), 6) AS completeness FROM cases WHERE rule_id IS NULL AND created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-20' GROUP BY 1, 2")
def report_trend(spark, sf_dir):
    rows = relational.between_times(_cases(spark, sf_dir).where("rule_id is null"), "created_at", datetime(2024, 1, 10), NOW)
    return evaluate.averages(rows, ["source", F.to_date("created_at").cast("string").alias("day")], SCORES)


@query(CASES_SQL + "SELECT case_id FROM cases WHERE coalesce(faithfulness >= 0.8, true) AND coalesce(answer_relevance >= 0.7, true) AND coalesce(completeness >= 0.7, true)")
def well_answered(spark, sf_dir):
    return _cases(spark, sf_dir).where(evaluate.well_answered()).select("case_id")


@query(CASES_SQL + """, w AS (SELECT leader, topic, count(*) AS n FROM cases GROUP BY 1, 2)
SELECT leader AS label, CAST(sum(n) AS BIGINT) AS cases, list_aggregate(list(topic ORDER BY n DESC, topic) FILTER (topic <> leader), 'string_agg', '|') AS variants FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""")
def top_topics(spark, sf_dir):
    found = evaluate.top_topics(_cases(spark, sf_dir), "topic", "leader")
    return found.select("label", "cases", F.array_join("variants", "|").alias("variants"))


@query(CASES_SQL + """, t AS (SELECT leader, tag, count(*) AS n FROM (SELECT leader, unnest([t1, t2]) AS tag FROM cases) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY n DESC, tag) AS rn FROM t)
SELECT leader, string_agg(tag, '|' ORDER BY rn) AS tags FROM r WHERE rn <= 5 GROUP BY 1""")
def topic_tags(spark, sf_dir):
    return evaluate.topic_tags(_cases(spark, sf_dir), "leader", "tags").select("leader", F.array_join("tags", "|").alias("tags"))


@query(CASES_SQL + "SELECT r.rule_id, count(c.case_id) AS ever, count(*) FILTER (c.created_at >= TIMESTAMP '2024-01-20') AS lately FROM (VALUES ('r0'), ('r1'), ('r2'), ('r3'), ('r9')) r(rule_id) LEFT JOIN cases c ON c.rule_id = r.rule_id GROUP BY 1")
def rule_counts(spark, sf_dir):
    rules = spark.createDataFrame([(f"r{i}",) for i in (0, 1, 2, 3, 9)], "rule_id string")
    return evaluate.rule_counts(rules, _cases(spark, sf_dir), _now())


@query(CASES_SQL + "SELECT case_id, CASE WHEN source = 'GOLDEN' THEN topic END AS topic FROM cases")
def scrubbed_cases(spark, sf_dir):
    return evaluate.scrubbed(_cases(spark, sf_dir), ["topic"], F.col("source") == "GOLDEN").select("case_id", "topic")


@query("SELECT l_orderkey, round(avg(CAST(CAST(l_quantity AS INTEGER) % 2 = 1 AS INTEGER)), 6) AS faithfulness FROM lineitem WHERE l_linenumber <= 20 GROUP BY 1")
def faithfulness(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("pos"), (F.col("l_quantity").cast("int") % 2).alias("score"))
    return evaluate.share(rows, "l_orderkey", "score", "faithfulness").withColumn("faithfulness", F.round("faithfulness", 6))


@query("SELECT l_orderkey, round(avg(CAST(l_suppkey % 3 = 1 AS INTEGER)), 6) AS reference_recall FROM lineitem WHERE l_linenumber <= 20 GROUP BY 1")
def reference_recall(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).alias("pos"), (F.col("l_suppkey") % 3).alias("score"))
    return evaluate.share(rows, "l_orderkey", "score", "reference_recall").withColumn("reference_recall", F.round("reference_recall", 6))


@query("""
WITH p AS (SELECT a.vec_id // 10 AS case_id, a.embedding AS x, CASE WHEN a.vec_id // 10 % 4 > 0 THEN b.embedding END AS y, (a.vec_id // 10) % 4 AS judged FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT case_id, round(coalesce(avg(CASE WHEN y IS NOT NULL THEN greatest(0.0, least(1.0, list_cosine_similarity(CAST(x AS DOUBLE[]), CAST(y AS DOUBLE[])))) END), max(judged) / 3.0), 6) AS answer_relevance FROM p GROUP BY 1
""")
def answer_relevance(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    case = F.floor(F.col("vec_id") / 10)
    rows = v.join(nxt, "vec_id").select(case.alias("case_id"), "embedding", F.when(case % 4 > 0, F.col("y")).alias("y"), (case % 4).alias("judged"))
    return evaluate.answer_relevance(rows, "case_id", "embedding", "y", "judged").withColumn("answer_relevance", F.round("answer_relevance", 6))


@query("SELECT user_id, CASE WHEN bool_or(value < 50) THEN 'DONE' ELSE 'FAILED' END AS status, string_agg(concat(event_type, ':', event_id), '; ' ORDER BY concat(event_type, ':', event_id)) FILTER (value >= 50) AS errors FROM events GROUP BY 1")
def case_outcome(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.concat_ws(":", "event_type", "event_id").alias("name"), (F.col("value") < 50).alias("ok"))
    return evaluate.case_outcome(rows, "user_id")


@query("""
WITH h AS (SELECT doc_id % 20 AS q, source AS uri FROM documents), e(entry) AS (VALUES ('rc1'), ('SRC2'), ('none'))
SELECT q, round(count(DISTINCT e.entry) FILTER (contains(lower(uri), lower(entry))) / 3.0, 6) AS recall FROM h CROSS JOIN e GROUP BY 1
""")
def golden_recall(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select((F.col("doc_id") % 20).alias("q"), F.col("source").alias("uri"))
    entries = spark.createDataFrame([(0, "rc1"), (1, "SRC2"), (2, "none")], "position int, entry string")
    expected = hits.select("q").distinct().join(F.broadcast(entries), F.lit(True))
    pairs = hits.distinct().join(expected, "q").where(F.lower("uri").contains(F.lower("entry")))
    return evaluate.golden_recall(pairs, expected, "q").withColumn("recall", F.round("recall", 6))


# queues


@query(ITEMS_SQL + """, t AS (SELECT item_id FROM items WHERE stage = 'FETCH' AND ((status IN ('PENDING', 'RETRY_WAITING') AND available_at <= TIMESTAMP '2024-01-20') OR (status = 'LEASED' AND lease_until < TIMESTAMP '2024-01-20')) ORDER BY priority DESC, created_at, item_id LIMIT 25)
SELECT i.item_id, CASE WHEN t.item_id IS NOT NULL THEN 'LEASED' ELSE status END AS status, CASE WHEN t.item_id IS NOT NULL THEN TIMESTAMP '2024-01-20 00:00:30' ELSE lease_until END AS lease_until, CAST(attempts + CASE WHEN t.item_id IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS attempts FROM items i LEFT JOIN t USING (item_id)""")
def leased_work(spark, sf_dir):
    return state.leased(_items(spark, sf_dir), _now(), 25, "FETCH").select("item_id", "status", "lease_until", "attempts")


@query(ITEMS_SQL + """, o AS (SELECT *, CASE WHEN item_id % 4 = 0 THEN NULL WHEN item_id % 3 = 0 THEN 'done' WHEN item_id % 5 = 0 THEN 'fail' ELSE 'retry' END AS outcome, status = 'LEASED' AND item_id % 4 > 0 AS held FROM items)
SELECT item_id, CASE WHEN NOT held THEN status WHEN outcome = 'done' THEN 'DONE' WHEN outcome = 'fail' OR attempts >= 5 THEN 'DEAD_LETTER' ELSE 'RETRY_WAITING' END AS status, attempts, CASE WHEN held THEN NULL ELSE lease_until END AS lease_until,
  CASE WHEN held AND outcome = 'retry' AND attempts < 5 THEN TIMESTAMP '2024-01-20' + to_seconds(least(300, CAST(pow(2, least(8, attempts)) AS INTEGER))) ELSE available_at END AS available_at FROM o""")
def acknowledged_work(spark, sf_dir):
    items = _items(spark, sf_dir)
    outcome = F.when(F.col("item_id") % 3 == 0, "done").when(F.col("item_id") % 5 == 0, "fail").otherwise("retry")
    outcomes = items.where("item_id % 4 > 0").select("item_id", outcome.alias("outcome"))
    return state.acknowledged(items, outcomes, _now()).select("item_id", "status", "attempts", "lease_until", "available_at")


@query(ITEMS_SQL + "SELECT item_id, CASE WHEN status = 'DEAD_LETTER' THEN 'PENDING' ELSE status END AS status, attempts, CASE WHEN status = 'DEAD_LETTER' THEN TIMESTAMP '2024-01-20' ELSE available_at END AS available_at FROM items")
def requeued_work(spark, sf_dir):
    return state.requeued(_items(spark, sf_dir), _now()).select("item_id", "status", "attempts", "available_at")


@query(ITEMS_SQL + "SELECT stage, count(*) FILTER (status IN ('PENDING', 'RETRY_WAITING')) AS waiting, count(*) FILTER (status = 'LEASED') AS leased, count(*) FILTER (status = 'DEAD_LETTER') AS dead FROM items GROUP BY 1")
def queue_depth(spark, sf_dir):
    return state.queue_depth(_items(spark, sf_dir))


@query(ITEMS_SQL + "SELECT item_id, CASE WHEN run_id % 10 >= 8 THEN 'reject' WHEN stage = 'FETCH' THEN 'FETCH' ELSE 'skip' END AS route FROM items")
def stage_router(spark, sf_dir):
    items = _items(spark, sf_dir).withColumn("tenant", F.col("run_id") % 10)
    return state.routed(items, ["FETCH", "PARSE"], spark.range(8).select(F.col("id").alias("tenant"))).select("item_id", "route")


@query("""
WITH s AS (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN ts END AS last_run, TIMESTAMP '2024-01-20' - to_hours(12 * (1 + event_id % 28)) AS due FROM events), c AS (SELECT *, last_run IS NULL OR last_run <= due AS claimed FROM s)
SELECT event_id, claimed, CASE WHEN claimed THEN TIMESTAMP '2024-01-20' ELSE last_run END AS last_run FROM c
""")
def claim_due(spark, sf_dir):
    """Schedules with intervals of their own, from 12 hours to 14 days."""
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", F.when(e % 3 > 0, F.col("ts")).alias("last_run"), (12 * (1 + e % 28)).cast("int").alias("hours"))
    return state.claim_due(rows, _now(), _now() - F.make_dt_interval(F.lit(0), "hours")).select("event_id", "claimed", "last_run")


@query("""
WITH r AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 400 ELSE 500 END AS status, CASE event_id % 3 WHEN 0 THEN 'This model''s Maximum context length is 512' WHEN 1 THEN 'Too many tokens requested' ELSE 'the rate limit was exceeded' END AS body FROM events)
SELECT user_id, CAST(greatest(256, floor(8000 / pow(2, least(62, count(*) FILTER (status = 400 AND (contains(lower(body), 'context length') OR contains(lower(body), 'too many tokens'))))))) AS INTEGER) AS "limit" FROM r GROUP BY 1
""")
def learned_limit(spark, sf_dir):
    e = F.col("event_id") % 3
    body = F.when(e == 0, "This model's Maximum context length is 512").when(e == 1, "Too many tokens requested").otherwise("the rate limit was exceeded")
    rows = table(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", 400).otherwise(500).alias("status"), body.alias("body"))
    return state.learned_limit(rows, ["user_id"], 8000)


@query("SELECT doc_id AS document_id, 'INDEX' AS stage, sha256(concat('reindex:run7:', doc_id)) AS idempotency_key FROM documents WHERE doc_id % 5 > 0 AND doc_id % 3 = 0")
def unindexed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 5 > 0).alias("current_version"), (F.col("doc_id") % 3 > 0).alias("indexed"))
    return state.unindexed(docs, "run7")


@query("""
WITH s AS (SELECT user_id, event_id, epoch(date_trunc('second', ts))::BIGINT AS sec, event_type AS m, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
f AS (SELECT *, p IS NULL OR p <> m AS fresh FROM s), g AS (SELECT *, max(CASE WHEN fresh THEN sec END) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS UNBOUNDED PRECEDING) AS since FROM f),
b AS (SELECT *, (sec - since) // 86400 AS beat FROM g), r AS (SELECT *, lag(beat) OVER (PARTITION BY user_id, since ORDER BY sec, event_id) AS before FROM b)
SELECT event_id FROM r WHERE fresh OR beat > before
""")
def changed_only(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return state.changed_only(rows, "user_id", "ts", ["event_type"], 86400).select("event_id")


# lists and counts


@query("SELECT DISTINCT doc_id FROM labels WHERE toxic = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def distinct_semi(spark, sf_dir):
    known = table(spark, sf_dir, "documents").where("lang = 'en'")
    return table(spark, sf_dir, "labels").where("toxic = 1").join(known, "doc_id", "left_semi").select("doc_id").distinct()


@query("SELECT doc_id, (SELECT max(quality) FROM labels l WHERE l.doc_id = d.doc_id) AS quality FROM documents d")
def scalar_lookup(spark, sf_dir):
    return relational.with_looked_up(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "quality")


@query(ITEMS_SQL + "SELECT status, count(*) AS n FROM items GROUP BY 1")
def count_by_status(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT event_type, CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 400 THEN 21 ELSE floor(value / 20) + 1 END AS INTEGER) AS bin, count(*) AS n FROM events GROUP BY 1, 2")
def value_histogram(spark, sf_dir):
    return relational.histogram(table(spark, sf_dir, "events"), "event_type", "value", 0, 400, 20)


@query("SELECT c_custkey, c_name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 200")
def name_order(spark, sf_dir):
    return relational.ordered_by_name(table(spark, sf_dir, "customer"), "c_name", "c_custkey").select("c_custkey", "c_name").limit(200)


@query("SELECT doc_id, source, CASE WHEN lang = 'en' THEN text END AS text FROM documents")
def hidden_texts(spark, sf_dir):
    return relational.view(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"), ["text"], F.col("lang") == "en").drop("lang")


@query("SELECT user_id, string_agg(concat(k, '=', v), ',' ORDER BY k) AS merged FROM (SELECT user_id, event_type AS k, CAST(sum(event_id % 3 + 1) AS BIGINT) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def merged_maps(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.create_map("event_type", F.col("event_id") % 3 + 1).alias("m"))
    merged = relational.merged_maps(rows, "user_id", "m")
    return merged.select("user_id", F.array_join(F.transform(F.map_entries("merged"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("merged"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k'), 'none') AS k, coalesce(json_extract_string(props, '$.missing'), 'none') AS other FROM events")
def json_values(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", relational.json_value(F.col("props"), "$.k", "none").alias("k"), relational.json_value(F.col("props"), "$.missing", "none").alias("other"))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def newest_audit(spark, sf_dir):
    return sinks.newest_audit(table(spark, sf_dir, "events"), "ts", "event_id").select("event_id", "event_type")


@query("""
WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]*[A-Za-z0-9]')) AS v FROM documents)
SELECT d.source, (SELECT count(*) FROM r JOIN documents x USING (doc_id) WHERE x.source = d.source) AS results, (SELECT count(*) FROM documents x JOIN labels l USING (doc_id) WHERE x.source = d.source) AS labels, (SELECT count(*) FROM documents x WHERE x.source = d.source AND x.lang = 'fr') AS french
FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) d
""")
def related_counts(spark, sf_dir):
    """Addresses found, labels and French documents of each source."""
    docs = table(spark, sf_dir, "documents")
    found = extract.extract(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), [("mail", "regex", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]*[A-Za-z0-9]")])
    of = docs.select(F.col("doc_id").alias("chunk_id"), "source")
    children = {"results": found.join(of, "chunk_id"), "labels": docs.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id"), "french": docs.where("lang = 'fr'")}
    return relational.related_counts(docs, "source", children)
