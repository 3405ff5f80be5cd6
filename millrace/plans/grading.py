"""Queries of gap reports, topic groups and feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, retrieve
from .registry import query, table

CASES_SQL = """
WITH c AS (SELECT event_id, CAST(user_id % 3 AS BIGINT) AS tenant, ts AS created_at, CASE WHEN event_id % 9 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'UNANSWERED' WHEN value > 60 THEN 'ANSWERED' WHEN value > 30 THEN 'PARTIAL' ELSE 'UNANSWERED' END AS status,
  CASE WHEN event_id % 9 = 0 THEN NULL WHEN user_id % 4 = 0 THEN 'no-sources' WHEN value > 60 THEN NULL WHEN value > 30 THEN 'partial' ELSE 'not-in-sources' END AS reason,
  CASE WHEN event_id % 7 > 0 THEN concat(event_type, ' ', user_id % 5) END AS topic, list_distinct(list_value(concat('t', event_id % 6), concat('t', event_id % 4))) AS tags, ln(1 + abs(value)) AS faithfulness, CASE WHEN event_id % 2 = 0 THEN ln(2 + abs(value)) END AS ndcg FROM events)
"""


def _cases(spark, sf_dir):
    e, user = F.col("event_id"), F.col("user_id")
    score = F.when(F.col("value") > 60, 2).when(F.col("value") > 30, 1).otherwise(0)
    status, reason = evaluate.answer_status(score, user % 4)
    known = e % 9 > 0
    tag = lambda n: F.concat(F.lit("t"), (e % n).cast("string"))
    return table(spark, sf_dir, "events").select(
        (user % 3).cast("long").alias("tenant"),
        F.col("ts").alias("created_at"),
        F.when(known, status).alias("status"),
        F.when(known, reason).alias("reason"),
        F.when(e % 7 > 0, F.concat("event_type", F.lit(" "), (user % 5).cast("string"))).alias("leader"),
        F.array(tag(6), tag(4)).alias("tags"),
        F.log(1 + F.abs("value")).alias("faithfulness"),
        F.when(e % 2 == 0, F.log(2 + F.abs("value"))).alias("ndcg"),
    )


@query(
    CASES_SQL
    + """, m AS (SELECT tenant, topic, NULL AS tag, 'topic' AS level, * EXCLUDE (tenant, topic) FROM c WHERE topic IS NOT NULL UNION ALL SELECT tenant, NULL, NULL, 'tenant', * EXCLUDE (tenant, topic) FROM c
  UNION ALL SELECT tenant, NULL, unnest(tags), 'tag', * EXCLUDE (tenant, topic) FROM c UNION ALL SELECT tenant, topic, unnest(tags), 'topic_tag', * EXCLUDE (tenant, topic) FROM c WHERE topic IS NOT NULL), g AS (SELECT *, coalesce(status IN ('UNANSWERED', 'PARTIAL'), false) AS gap FROM m)
SELECT tenant, level, topic, tag, count(*) AS cases, count(status) AS tracked, count(*) FILTER (gap) AS gaps, count(*) FILTER (status = 'UNANSWERED') AS unanswered, count(*) FILTER (gap AND reason = 'no-sources') AS no_sources, count(*) FILTER (gap AND reason = 'not-in-sources') AS not_in_sources,
  count(*) FILTER (gap AND reason = 'partial') AS partial, max(created_at) FILTER (gap) AS newest_gap, round(avg(faithfulness), 6) AS faithfulness, round(avg(ndcg), 6) AS ndcg FROM g GROUP BY tenant, level, topic, tag
"""
)
def gap_cube(spark, sf_dir):
    return evaluate.gap_cube(_cases(spark, sf_dir), "tenant")


@query(
    CASES_SQL
    + """, g AS (SELECT * FROM c WHERE status IN ('UNANSWERED', 'PARTIAL') AND topic IS NOT NULL),
t AS (SELECT tenant, topic, count(*) AS gaps, count(*) FILTER (reason = 'no-sources') AS no_sources, count(*) FILTER (reason = 'not-in-sources') AS not_in_sources, count(*) FILTER (reason = 'partial') AS partial, max(created_at) AS newest_gap FROM g GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY tenant ORDER BY gaps DESC, topic) AS INTEGER) AS at FROM t),
n AS (SELECT tenant, topic, tag, count(*) AS k FROM (SELECT tenant, topic, unnest(tags) AS tag FROM g) u GROUP BY 1, 2, 3), s AS (SELECT *, row_number() OVER (PARTITION BY tenant, topic ORDER BY k DESC, tag) AS j FROM n)
SELECT r.tenant, r.at, r.topic, gaps, no_sources, not_in_sources, partial, newest_gap, (SELECT string_agg(tag, ',' ORDER BY j) FROM s WHERE s.tenant = r.tenant AND s.topic = r.topic AND j <= 5) AS tags FROM r WHERE r.at <= 10
""".replace(" AS at ", ' AS "at" ').replace("r.at", 'r."at"')
)
def gap_topics(spark, sf_dir):
    cube = evaluate.gap_cube(_cases(spark, sf_dir), "tenant")
    return evaluate.gap_topics(cube, "tenant").withColumn("tags", F.array_join("tags", ","))


def _topics(spark, sf_dir):
    """Topics of 40 tenants: the first words of what users say."""
    said = table(spark, sf_dir, "conversations").where("role = 'user'")
    return said.groupBy((F.col("conv_id") % 40).alias("tenant"), F.substring("text", 1, 6).alias("topic")).agg(F.count("*").alias("frequency"))


TOPICS_SQL = "WITH t AS (SELECT conv_id % 40 AS tenant, substr(text, 1, 6) AS topic, count(*) AS frequency FROM conversations WHERE role = 'user' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY tenant ORDER BY frequency DESC, topic) - 1 AS i FROM t)"


@query(TOPICS_SQL + ", k AS (SELECT *, regexp_replace(lower(topic), '[\\s.?!]+$', '') AS key FROM r) SELECT tenant, topic, first_value(topic) OVER (PARTITION BY tenant, key ORDER BY i) AS leader FROM k")
def topic_text_clusters(spark, sf_dir):
    return evaluate.text_clusters(_topics(spark, sf_dir), "tenant")


@query(TOPICS_SQL + """, l AS (SELECT *, CASE WHEN i IN (0, 2) THEN 0 WHEN i IN (1, 3, 4) THEN 1 END AS g FROM r WHERE tenant % 5 > 0)
SELECT tenant, topic, CASE WHEN g IS NULL THEN topic ELSE first_value(topic) OVER (PARTITION BY tenant, g ORDER BY i) END AS leader FROM l""")
def judge_topic_groups(spark, sf_dir):
    """Groups as a judge's replies name them, with numbers that repeat or do not exist; every fifth reply is none."""
    topics = _topics(spark, sf_dir)
    none = evaluate.JUDGED_TOPICS  # numbers start at 0, so this one is never shown, however many topics a tenant has
    reply = F.when(F.col("tenant") % 5 == 0, "I cannot").otherwise(f'Sure: {{"groups": [[2, 0, {none}], [3, 2, 1, 4, -1], "x", [{none}, 1]]}} done')
    replies = topics.select("tenant").distinct().withColumn("reply", reply)
    return evaluate.judge_clusters(topics, replies, "tenant")


@query("""
WITH h AS (SELECT event_type AS query_id, event_id % 100 AS document_id, max(value) AS score FROM events GROUP BY 1, 2), hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS INTEGER) AS rank FROM h),
d AS (SELECT DISTINCT event_id % 100 AS document_id, event_id % 100 // 2 AS identity FROM events WHERE event_id % 100 < 90),
f AS (SELECT event_id AS feedback_id, ts AS rated_at, CASE WHEN event_id % 8 > 0 THEN 1 + event_id % 5 END AS relevance FROM events), s AS (SELECT event_id AS feedback_id, event_id % 60 AS identity FROM events UNION SELECT event_id, event_id % 7 FROM events),
a AS (SELECT DISTINCT query_id, identity FROM hits JOIN d USING (document_id)), b AS (SELECT query_id, least(40, 20 * count(*)) AS budget FROM a GROUP BY 1),
m AS (SELECT DISTINCT query_id, feedback_id, rated_at, relevance FROM a JOIN s USING (identity) JOIN f USING (feedback_id) WHERE relevance IS NOT NULL), c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rated_at DESC, feedback_id DESC) AS n FROM m),
v AS (SELECT * FROM c JOIN b USING (query_id) WHERE n <= budget AND feedback_id % 3 > 0), w AS (SELECT *, row_number() OVER (PARTITION BY query_id, identity ORDER BY rated_at DESC, feedback_id DESC) AS k FROM v JOIN s USING (feedback_id) JOIN a USING (query_id, identity)),
x AS (SELECT query_id, identity, avg(relevance) / 3 AS factor FROM w WHERE k <= 20 GROUP BY 1, 2), y AS (SELECT h.query_id, h.document_id, h.rank, h.score * coalesce(factor, 1.0) AS score FROM hits h LEFT JOIN d USING (document_id) LEFT JOIN x ON x.query_id = h.query_id AND x.identity = d.identity)
SELECT query_id, document_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS INTEGER) AS rank FROM y
""")
def feedback_budget(spark, sf_dir):
    """Hits weighed by ratings that replayed verdicts hold relevant, forty checks a question at most."""
    from pyspark.sql import Window

    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    hits = e.groupBy(F.col("event_type").alias("query_id"), (n % 100).alias("document_id")).agg(F.max("value").alias("score"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")))
    docs = e.where(n % 100 < 90).select((n % 100).alias("document_id"), F.floor(n % 100 / 2).alias("identity")).distinct()
    feedback = e.select(n.alias("feedback_id"), F.col("ts").alias("rated_at"), F.when(n % 8 > 0, 1 + n % 5).alias("relevance"))
    sources = e.select(n.alias("feedback_id"), (n % 60).alias("identity")).unionByName(e.select(n.alias("feedback_id"), (n % 7).alias("identity")))
    verdicts = e.select(n.alias("feedback_id"), F.when(n % 3 > 0, " Yes, it is").when(n % 2 == 0, "no").alias("reply")).join(hits.select("query_id").distinct())
    found = retrieve.feedback_weighted(hits, docs, feedback, sources, verdicts, "query_id")
    return found.select("query_id", "document_id", F.round("score", 6).alias("score"), "rank")


@query()
def semantic_pack(spark, sf_dir):
    """Documents as blocks (every third paragraph with digits is code) in semantic chunks by hashed vectors of sentences."""
    from ..functions.providers import HashEmbedding
    from ..operators import chunk

    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.paragraphs(F.regexp_replace("text", "\n", "\n\n"))).alias("ordinal", "text"))
    kind = F.when((F.col("ordinal") % 3 == 2) & F.col("text").rlike("[0-9]"), "code").otherwise("prose")
    blocks = docs.select("doc_id", "ordinal", F.concat(F.lit("part "), F.floor(F.col("ordinal") / 8).cast("string")).alias("heading"), kind.alias("kind"), "text", F.lit("").alias("language"))
    return chunk.semantic_chunked(blocks, "doc_id", HashEmbedding(), chunk.ChunkOptions(600, 0))
