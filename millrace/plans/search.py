"""Search, fusion and assembly queries."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assemble, chunk, evaluate, retrieve, textindex, tools
from ..operators.relational import listed
from ..session import written
from .registry import query, table

BM25_SQL = """
WITH tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents),
st AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
post AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok) GROUP BY doc_id, term),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
s AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
      FROM q JOIN post USING (term) JOIN df USING (term), st GROUP BY item_id, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s)
"""


def _bm25(spark, sf_dir, k):
    scored = textindex.bm25(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text", k)
    return textindex.top_k(scored, "item_id", "doc_id", k)


def _bm25_rows(spark, sf_dir, k, *columns):
    """The hits with columns of their documents: the hits are sent to the documents, not the texts shuffled to them."""
    hits = written(_bm25(spark, sf_dir, k), "hits")
    return table(spark, sf_dir, "documents").select("doc_id", *columns).join(listed(hits), "doc_id")


@query(BM25_SQL + "SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 10")
def bm25_topk(spark, sf_dir):
    return _bm25(spark, sf_dir, 10).select("item_id", "doc_id", "score", "rank")


@query("""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term, 1 AS one FROM documents) GROUP BY 1, 2),
src AS (SELECT doc_id, term, 3 * count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(source), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2),
both_ AS (SELECT doc_id, term, sum(tf) AS tf FROM (SELECT * FROM t UNION ALL SELECT * FROM src) GROUP BY 1, 2),
h AS (SELECT doc_id, sum(tf) AS tf, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, CAST(octet_length(encode(term)) AS BIGINT) + 1), lambda i: CAST(ascii(substr(term, i, 1)) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS term_hash FROM both_ GROUP BY doc_id, term),
g AS (SELECT doc_id, term_hash, sum(tf) AS tf FROM h GROUP BY 1, 2),
w AS (SELECT doc_id, term_hash, tf * 2.2 / (tf + 1.2) AS weight FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term_hash) AS n FROM w)
SELECT doc_id, term_hash, round(weight, 6) AS weight FROM r WHERE n <= 10000
""")
def sparse_tf_saturation(spark, sf_dir):
    found = textindex.sparse_weights(table(spark, sf_dir, "documents"), "doc_id", {"text": 1.0, "source": 3.0})
    return found.select("doc_id", "term_hash", F.round("weight", 6).alias("weight"))


@query("""
SELECT DISTINCT term, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, CAST(octet_length(encode(term)) AS BIGINT) + 1), lambda i: CAST(ascii(substr(term, i, 1)) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 4294967295) AS term_hash
FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark)
""")
def fnv1a_terms(spark, sf_dir):
    terms = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return terms.select("term", X.fnv1a(F.col("term")).alias("term_hash"))


@query("""
WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2),
n AS (SELECT count(DISTINCT doc_id) AS n FROM p),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT item_id, doc_id, round(sum(tf * 2.2 / (tf + 1.2) * ln(1 + (n - df + 0.5) / (df + 0.5))), 6) AS score FROM q JOIN p USING (term) JOIN df USING (term), n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, score FROM r WHERE rank <= 10
""")
def sparse_idf_dot(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    asked = textindex.sparse_query(items, "item_id", "text")
    weights, some = textindex.sparse_postings(docs, "doc_id", "text", asked)
    scored = textindex.sparse_dot(weights, asked, "doc_id", "item_id", some)
    return textindex.top_k(scored, "item_id", "doc_id", 10).select("item_id", "doc_id", "score")


@query("""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents),
p AS (SELECT doc_id, w, regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+') AS ps FROM t),
x AS (SELECT doc_id, lower(w) AS term FROM p UNION ALL SELECT doc_id, lower(unnest(ps)) FROM p WHERE len(ps) > 1)
SELECT doc_id, term, count(*) AS tf FROM x GROUP BY 1, 2
""")
def code_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.code_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query("""
WITH q AS (SELECT item_id, split_part(text, ' ', 3) AS needle FROM benchmark),
m AS (SELECT item_id, needle, doc_id, text, greatest(0, strpos(lower(text), lower(needle)) - 101) AS s FROM q JOIN documents ON contains(lower(text), lower(needle)))
SELECT item_id, doc_id, CASE WHEN length(text) <= 240 THEN text ELSE concat(CASE WHEN s > 0 THEN '...' ELSE '' END, substr(text, s + 1, 240), CASE WHEN s + 240 < length(text) THEN '...' ELSE '' END) END AS snippet FROM m
""")
def snippet(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.element_at(F.split("text", " "), 3).alias("needle"))
    return textindex.snippets(table(spark, sf_dir, "documents"), items, "doc_id", "text", "item_id", "needle")


@query("""
WITH q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
n AS (SELECT item_id, count(*) AS asked FROM q GROUP BY 1),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(source), '[a-z0-9]+')) AS term, 1.0 AS w FROM documents
      UNION ALL SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z0-9]+')), 0.4 FROM documents
      UNION ALL SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')), 0.1 FROM documents),
b AS (SELECT doc_id, term, CAST(max(w) AS DOUBLE) AS w FROM d GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, round(sum(w) / any_value(asked), 6) AS score FROM b JOIN q USING (term) JOIN n USING (item_id) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, score FROM r WHERE rank <= 10
""")
def weighted_fulltext(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("head", F.substring_index("text", "\n", 1))
    scored = textindex.full_text_rank(docs, table(spark, sf_dir, "benchmark"), "doc_id", {"a": "source", "b": "head", "d": "text"}, "item_id", "text", 10)
    return textindex.top_k(scored, "item_id", "doc_id", 10).select("item_id", "doc_id", "score")


KNN_SQL = """
WITH q AS (SELECT vec_id AS query_id, embedding AS q, label AS ql FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, ql, vec_id, label, round(list_cosine_similarity(CAST(q AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS score FROM q, embeddings WHERE vec_id <> query_id),
"""


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    q = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return v, q


@query(KNN_SQL + "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) SELECT query_id, vec_id, score, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 10")
def knn_cosine_topk(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return textindex.knn(v, q, "vec_id", "embedding", "query_id", "q", 10)


@query(KNN_SQL + "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s WHERE label IN (1, 2, 3)) SELECT query_id, vec_id, score, CAST(n AS INTEGER) AS rank FROM r WHERE n <= 10")
def knn_filtered(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return textindex.knn(v.where(F.col("label").isin(1, 2, 3)), q, "vec_id", "embedding", "query_id", "q", 10)


def _leg(spark, sf_dir, k=30):
    """Queries are the rows whose id is divisible by 50; the semantic leg by cosine."""
    v, q = _vectors(spark, sf_dir)
    return textindex.knn(v, q, "vec_id", "embedding", "query_id", "q", k)


LEGS_SQL = KNN_SQL + "sem AS (SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 30),"

#: Word counts of a text at 64 places by a hash, as SQL and Spark both have it: the stand-in for an embedding model.
PLACES = 64
HYBRID_SQL = BM25_SQL + """, lex AS (SELECT item_id, doc_id, score, rank FROM r WHERE rank <= 30),
w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents),
p AS (SELECT id, CAST(concat('0x', substr(md5(term), 1, 4)) AS INTEGER) % 64 AS pl, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY 1, 2),
dn AS (SELECT id, sqrt(sum(n * n)) AS len FROM p GROUP BY 1),
qp AS (SELECT item_id, CAST(concat('0x', substr(md5(term), 1, 4)) AS INTEGER) % 64 AS pl, CAST(count(*) AS DOUBLE) AS n FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
qn AS (SELECT item_id, sqrt(sum(n * n)) AS len FROM qp GROUP BY 1),
dots AS (SELECT item_id, id AS doc_id, sum(qp.n * p.n) AS dot FROM qp JOIN p USING (pl) GROUP BY 1, 2),
cs AS (SELECT q.item_id, d.doc_id, round(coalesce(dot / (qn.len * dn.len), 0.0), 6) AS score FROM benchmark q CROSS JOIN documents d LEFT JOIN dots ON dots.item_id = q.item_id AND dots.doc_id = d.doc_id LEFT JOIN qn ON qn.item_id = q.item_id LEFT JOIN dn ON dn.id = d.doc_id),
sem AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM cs) WHERE rank <= 30),
"""


_places: dict[str, int] = {}


def _place(term: str) -> int:
    if term not in _places:
        if len(_places) >= 1 << 18:
            _places.clear()
        _places[term] = int(hashlib.md5(term.encode()).hexdigest()[:4], 16) % PLACES
    return _places[term]


def _placed(rows, key, name):
    """key, name: the vector of each text, in one pass over the texts."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            v = [0.0] * PLACES
            for term in re.findall("[a-z0-9]+", (t or "").lower()):
                v[_place(term)] += 1.0
            out.append(v)
        return pd.Series(out)

    return rows.select(key, vectors("text").alias(name))


def _hybrid_legs(spark, sf_dir, k=30):
    """Documents by BM25 and by the cosine of their vectors, for each benchmark item: both legs of one plan."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    semantic = textindex.knn(_placed(docs, "doc_id", "v"), _placed(items, "item_id", "q"), "doc_id", "v", "item_id", "q", k, itself=True)
    return _bm25(spark, sf_dir, k), semantic


@query(HYBRID_SQL + """f AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT item_id, doc_id, rank FROM lex UNION ALL SELECT item_id, doc_id, rank FROM sem) GROUP BY 1, 2),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) SELECT item_id, doc_id, score, rank FROM o WHERE rank <= 10""")
def rrf_hybrid(spark, sf_dir):
    return retrieve.rrf(_hybrid_legs(spark, sf_dir), "item_id", "doc_id", 10)


@query(HYBRID_SQL + """a AS (SELECT item_id, doc_id, score, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM lex WINDOW w AS (PARTITION BY item_id)),
b AS (SELECT item_id, doc_id, score, CASE WHEN max(score) OVER w - min(score) OVER w <= 1e-12 THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM sem WINDOW w AS (PARTITION BY item_id)),
f AS (SELECT item_id, doc_id, round(0.5 * coalesce(b.x, 0) + 0.5 * coalesce(a.x, 0), 6) AS score, a.score AS lexical_score, b.score AS semantic_score FROM a FULL JOIN b USING (item_id, doc_id)),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f) SELECT item_id, doc_id, rank, score, lexical_score, semantic_score FROM o WHERE rank <= 10""")
def minmax_fusion(spark, sf_dir):
    return retrieve.min_max_fusion(*_hybrid_legs(spark, sf_dir), "item_id", "doc_id", 0.5, 10)


@query(BM25_SQL.replace("SELECT doc_id, regexp_extract_all(lower(text)", "SELECT doc_id, regexp_extract_all(lower(split_part(text, chr(10), 1))").replace("s AS (SELECT", "s1 AS (SELECT").replace("r AS (SELECT *, CAST", "unused AS (SELECT *, CAST").replace("FROM s)", "FROM s1)") + """,
tok2 AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents), st2 AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok2),
post2 AS (SELECT doc_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT doc_id, len(ts) AS dl, unnest(ts) AS term FROM tok2) GROUP BY doc_id, term),
df2 AS (SELECT term, count(*) AS df FROM post2 GROUP BY term),
raw1 AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN post USING (term) JOIN df USING (term), st GROUP BY item_id, doc_id),
raw2 AS (SELECT item_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN post2 USING (term) JOIN df2 USING (term), st2 GROUP BY item_id, doc_id),
m AS (SELECT item_id, doc_id, round(sum(score), 6) AS score FROM (SELECT item_id, doc_id, 2 * score AS score FROM raw1 UNION ALL SELECT * FROM raw2) GROUP BY 1, 2),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM m) SELECT item_id, doc_id, score, rank FROM o WHERE rank <= 10""")
def bm25_fields(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("head", F.substring_index("text", "\n", 1))
    scored = textindex.bm25_fields(docs, table(spark, sf_dir, "benchmark"), "doc_id", {"head": 2.0, "text": 1.0}, "item_id", "text", 10)
    return textindex.top_k(scored, "item_id", "doc_id", 10).select("item_id", "doc_id", "score", "rank")


@query(LEGS_SQL + """u AS (SELECT query_id // 200 AS question, query_id AS list, vec_id, rank FROM sem),
f AS (SELECT question, vec_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list * 1000 + rank) AS seen FROM u GROUP BY 1, 2),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY question ORDER BY score DESC, seen, vec_id) AS INTEGER) AS rank FROM f) SELECT question, vec_id, score, rank FROM r WHERE rank <= 10""")
def multi_query_rrf(spark, sf_dir):
    semantic = _leg(spark, sf_dir)
    lists = semantic.select(F.floor(F.col("query_id") / 200).alias("question"), F.col("query_id").alias("list"), "vec_id", "rank")
    return retrieve.multi_query_rrf(lists, "question", "vec_id", 10)


@query(LEGS_SQL + """m AS (SELECT query_id, vec_id, score, rank, CASE WHEN query_id % 2 = 0 OR vec_id % 7 <> 0 THEN CAST(vec_id % 13 AS DOUBLE) END AS rr FROM sem),
o AS (SELECT *, count(*) OVER w = count(rr) OVER w AS ok FROM m WINDOW w AS (PARTITION BY query_id)),
r AS (SELECT query_id, vec_id, CASE WHEN ok THEN rr ELSE score END AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN ok THEN -rr ELSE rank END, vec_id) AS INTEGER) AS rank FROM o) SELECT * FROM r WHERE rank <= 8""")
def rerank_fail_open(spark, sf_dir):
    semantic = _leg(spark, sf_dir)
    scores = semantic.where("query_id % 2 = 0 or vec_id % 7 <> 0").select("query_id", "vec_id", (F.col("vec_id") % 13).cast("double").alias("rerank_score"))
    return retrieve.rerank(semantic, scores, "query_id", "vec_id", 8).select("query_id", "vec_id", "score", "rank")


@query(LEGS_SQL + """l AS (SELECT query_id, vec_id, vec_id // 8 AS chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM sem),
d AS (SELECT *, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY n) AS m FROM l WHERE n <= 20)
SELECT query_id, chunk_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n) AS INTEGER) AS rank FROM d WHERE m = 1""")
def hit_dedup_after_limit(spark, sf_dir):
    semantic = _leg(spark, sf_dir)
    hits = semantic.drop("rank").withColumn("chunk_id", F.floor(F.col("vec_id") / 8))
    return retrieve.dedup_hits(hits, "query_id", "vec_id", "chunk_id", 20).select("query_id", "chunk_id", "vec_id", "score", "rank")


@query()
def dartboard_select(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    hits = textindex.knn(v, q, "vec_id", "embedding", "query_id", "q", retrieve.dartboard_pool(5, 6))
    rows = hits.join(v, "vec_id").join(listed(q), "query_id").select("query_id", F.col("vec_id").alias("key"), "rank", F.col("embedding").alias("vector"), F.col("q").alias("query_vector"))
    return retrieve.dartboard(rows, 5)


@query("""
WITH hits AS (SELECT event_type AS query_id, event_id % 100 AS doc_id, max(value) AS score FROM events GROUP BY 1, 2),
ratings AS (SELECT event_id AS rating_id, user_id % 100 AS doc_id, ts AS rated_at, 1 + event_id % 3 AS relevance FROM events WHERE event_type = 'click'),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY rated_at DESC, rating_id DESC) AS n FROM ratings),
fac AS (SELECT doc_id, avg(relevance) / 3 AS factor FROM kept WHERE n <= 20 GROUP BY 1),
m AS (SELECT query_id, h.doc_id, round(score * coalesce(factor, 1.0), 6) AS score FROM hits h LEFT JOIN fac USING (doc_id))
SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM m
""")
def feedback_reweight(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    hits = e.groupBy(F.col("event_type").alias("query_id"), (F.col("event_id") % 100).alias("doc_id")).agg(F.max("value").alias("score"))
    ratings = e.where("event_type = 'click'").select(F.col("event_id").alias("rating_id"), (F.col("user_id") % 100).alias("doc_id"), F.col("ts").alias("rated_at"), (1 + F.col("event_id") % 3).alias("relevance"))
    return retrieve.feedback_reweight(hits, ratings, "query_id", "doc_id").select("query_id", "doc_id", "score", "rank")


LINES_SQL = """
WITH lines AS (SELECT doc_id AS document_id, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents),
"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("ordinal", "content"))


@query(LINES_SQL + """h AS (SELECT document_id, content, ordinal, CASE WHEN length(content) < 30 THEN content END AS head FROM lines),
i AS (SELECT *, count(head) OVER (PARTITION BY document_id ORDER BY ordinal) AS sec FROM h)
SELECT document_id, CAST(sec AS BIGINT) AS section, CAST(min(ordinal) AS INTEGER) AS first_ordinal, CAST(max(ordinal) AS INTEGER) AS last_ordinal FROM i GROUP BY 1, 2""")
def section_grouping(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    line = Window.partitionBy("document_id").orderBy("ordinal")
    rows = rows.withColumn("heading", F.count(F.when(F.length("content") < 30, 1)).over(line).cast("string"))
    found = chunk.sections(rows, "document_id")
    return found.select("document_id", F.col("heading").cast("long").alias("section"), "first_ordinal", "last_ordinal")


@query(LINES_SQL + """h AS (SELECT document_id, content, ordinal, count(CASE WHEN length(content) < 30 THEN 1 END) OVER (PARTITION BY document_id ORDER BY ordinal) AS sec FROM lines),
secs AS (SELECT document_id, sec, min(ordinal) AS a, max(ordinal) AS b FROM h GROUP BY 1, 2),
hit AS (SELECT document_id % 10 AS query_id, document_id, sec FROM secs WHERE b - a >= 6)
SELECT DISTINCT query_id, l.document_id, CAST(l.ordinal AS INTEGER) AS ordinal FROM hit JOIN secs USING (document_id, sec) JOIN lines l ON l.document_id = secs.document_id AND l.ordinal BETWEEN a AND b""")
def hierarchical_scope(spark, sf_dir):
    rows = _lines(spark, sf_dir)
    line = Window.partitionBy("document_id").orderBy("ordinal")
    rows = rows.withColumn("heading", F.count(F.when(F.length("content") < 30, 1)).over(line).cast("string"))
    secs = chunk.sections(rows, "document_id").withColumn("section_id", F.concat_ws(":", "document_id", "heading"))
    hits = secs.where("last_ordinal - first_ordinal >= 6").select((F.col("document_id") % 10).alias("query_id"), "section_id")
    scope = retrieve.hierarchical_scope(hits, secs.select("section_id", "document_id", "first_ordinal", "last_ordinal"), rows.withColumn("chunk_id", F.struct("document_id", "ordinal")))
    return scope.select("query_id", "chunk_id.document_id", "chunk_id.ordinal")


WINDOWS_SQL = LINES_SQL + """hits AS (SELECT document_id % 5 AS query_id, document_id, ordinal, row_number() OVER (PARTITION BY document_id % 5 ORDER BY length(content) DESC, document_id, ordinal) AS rank FROM lines WHERE length(content) >= 400),
sp AS (SELECT query_id, document_id, rank, greatest(0, ordinal - 1) AS a, ordinal + 1 AS b FROM hits),
re AS (SELECT *, max(b) OVER (PARTITION BY query_id, document_id ORDER BY a, b, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
fr AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id, document_id ORDER BY a, b, rank ROWS UNBOUNDED PRECEDING) AS win FROM re),
w AS (SELECT query_id, document_id, CAST(win AS BIGINT) AS win, CAST(min(a) AS INTEGER) AS a, CAST(max(b) AS INTEGER) AS b, CAST(min(rank) AS INTEGER) AS primary_rank FROM fr GROUP BY 1, 2, 3)
"""


def _hits(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("length(content) >= 400").withColumn("query_id", F.col("document_id") % 5)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.length("content").desc(), "document_id", "ordinal")))


@query(WINDOWS_SQL + 'SELECT query_id, document_id, win AS "window", a AS "first", b AS "last", primary_rank FROM w')
def context_window_merge(spark, sf_dir):
    return assemble.context_windows(_hits(spark, sf_dir), "query_id", "document_id", 1)


@query(WINDOWS_SQL + "SELECT query_id, w.document_id, primary_rank, string_agg(content, chr(10) ORDER BY ordinal) AS context FROM w JOIN lines l ON l.document_id = w.document_id AND l.ordinal BETWEEN a AND b GROUP BY 1, 2, 3")
def context_window_text(spark, sf_dir):
    windows = assemble.context_windows(_hits(spark, sf_dir), "query_id", "document_id", 1)
    met = assemble.window_chunks(windows, _lines(spark, sf_dir), "document_id")
    by = met.groupBy("query_id", "document_id", "primary_rank").agg(F.sort_array(F.collect_list(F.struct("ordinal", "content"))).alias("c"))
    return by.select("query_id", "document_id", "primary_rank", F.array_join(F.transform("c", lambda c: c["content"]), "\n").alias("context"))


@query(BM25_SQL + """, t AS (SELECT item_id, doc_id, rank, text, coalesce(sum(length(text)) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r JOIN documents USING (doc_id) WHERE rank <= 10)
SELECT item_id, doc_id, rank, substr(text, 1, CAST(8000 - used AS BIGINT)) AS text FROM t WHERE used < 8000""")
def context_budget(spark, sf_dir):
    hits = _bm25_rows(spark, sf_dir, 10, "text")
    return assemble.budget(hits.select("item_id", "doc_id", "rank", "text"), "item_id", "text", 2000)


@query(BM25_SQL + """, cut AS (SELECT item_id, rank, text, list_filter(list_transform(regexp_extract_all(text, '[^.!?\\n]+[.!?]*'), lambda x: trim(x, ' ')), lambda x: x <> '') AS ss FROM r JOIN documents USING (doc_id) WHERE rank <= 5),
e AS (SELECT item_id, rank, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM cut WHERE NOT (contains(text, '```') OR len(ss) > 300)),
d AS (SELECT *, row_number() OVER (PARTITION BY item_id, lower(regexp_replace(sentence, '\\s+', ' ', 'g')) ORDER BY rank, pos) AS n FROM e)
SELECT item_id, rank, CAST(pos AS INTEGER) AS pos, sentence, false AS whole FROM d WHERE n = 1 UNION ALL SELECT item_id, rank, 0, text, true FROM cut WHERE contains(text, '```') OR len(ss) > 300""")
def sentence_dedup(spark, sf_dir):
    hits = _bm25_rows(spark, sf_dir, 5, "text")
    return assemble.distinct_sentences(hits, "item_id", "text").select("item_id", "rank", "pos", "sentence", "whole")


@query(BM25_SQL + """, t AS (SELECT item_id, rank, concat('[SOURCE ', rank, ']', chr(10), source, chr(10), '[END SOURCE ', rank, ']') AS b FROM r JOIN documents USING (doc_id) WHERE rank <= 4)
SELECT item_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS context FROM t GROUP BY 1""")
def source_blocks(spark, sf_dir):
    hits = _bm25_rows(spark, sf_dir, 4, "source")
    return assemble.source_blocks(hits, "item_id", "source")


METRICS_SQL = KNN_SQL + """g AS (SELECT query_id, vec_id, score, CASE WHEN ql = label THEN 3 WHEN abs(ql - label) = 1 THEN 2 ELSE 0 END AS grade FROM s),
l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM g),
tot AS (SELECT query_id, count(*) FILTER (grade >= 2) AS total FROM g GROUP BY 1),
t AS (SELECT *, CAST(grade >= 2 AS INTEGER) AS rel, sum(CAST(grade >= 2 AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS upto FROM l WHERE rank <= 10),
m AS (SELECT query_id, avg(rel) AS p, sum(rel) AS found, coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0) AS mrr, sum(CASE WHEN rel = 1 THEN upto::DOUBLE / rank ELSE 0 END) AS ap, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM t GROUP BY 1),
ide AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(n + 1)) AS ideal FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS n FROM g) WHERE n <= 10 GROUP BY 1)
"""


def _metrics(spark, sf_dir):
    """Only the ten best of a query are ranked; totals and the ideal pool follow from the counts of labels."""
    v, q = _vectors(spark, sf_dir)
    labels = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    hits = textindex.knn(v, q, "vec_id", "embedding", "query_id", "q", 10)
    graded = hits.join(v.select("vec_id", "label"), "vec_id").join(labels, "query_id")
    grade = F.when(F.col("ql") == F.col("label"), 3).when(F.abs(F.col("ql") - F.col("label")) == 1, 2).otherwise(0)
    near = labels.select("query_id", "ql", F.explode(F.array(F.col("ql") - 1, F.col("ql"), F.col("ql") + 1)).alias("label"))
    counts = near.join(v.groupBy("label").agg(F.count("*").alias("n")), "label")
    counts = counts.select("query_id", grade.alias("grade"), (F.col("n") - (F.col("ql") == F.col("label")).cast("int")).alias("n"))
    totals = labels.select("query_id").join(counts.groupBy("query_id").agg(F.sum("n").alias("total")), "query_id", "left").fillna(0, ["total"])
    pool = counts.where("n > 0").select("query_id", "grade", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(10)))).alias("i"))
    return evaluate.ranking_metrics(graded.select("query_id", "rank", grade.alias("grade")), "query_id", 10, totals, pool)


@query(METRICS_SQL + "SELECT query_id, round(p, 6) AS precision_at_k, round(least(1.0, found::DOUBLE / nullif(total, 0)), 6) AS recall_at_k FROM m JOIN tot USING (query_id)")
def precision_recall_at_k(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", *(F.round(c, 6).alias(c) for c in ("precision_at_k", "recall_at_k")))


@query(METRICS_SQL + "SELECT query_id, round(mrr, 6) AS mrr, round(least(1.0, ap / nullif(total, 0)), 6) AS average_precision, round(dcg / nullif(ideal, 0), 6) AS ndcg FROM m JOIN tot USING (query_id) JOIN ide USING (query_id)")
def mrr_map_ndcg(spark, sf_dir):
    return _metrics(spark, sf_dir).select("query_id", *(F.round(c, 6).alias(c) for c in ("mrr", "average_precision", "ndcg")))


@query("""
WITH d AS (SELECT vec_id, label, CASE WHEN nx IS NOT NULL THEN greatest(0.0, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(nx AS DOUBLE[]))) END AS distance FROM (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings))
SELECT vec_id, label, round(distance, 6) AS distance FROM d
""")
def neighbour_distance(spark, sf_dir):
    d = chunk.neighbour_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")
    return d.select("vec_id", "label", F.round("distance", 6).alias("distance"))


def _breaks(spark, sf_dir, method, value):
    d = chunk.neighbour_distances(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").withColumn("distance", F.round("distance", 6))
    return chunk.semantic_groups(d, "label", "vec_id", method, value).select("vec_id", "label", F.col("chunk").cast("long").alias("chunk"))


BREAK_SQL = """
WITH d AS (SELECT vec_id, label, CASE WHEN nx IS NOT NULL THEN round(greatest(0.0, 1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(nx AS DOUBLE[]))), 6) END AS distance FROM (SELECT *, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nx FROM embeddings)),
t AS (SELECT label, {} AS threshold FROM d GROUP BY 1)
SELECT vec_id, label, CAST(coalesce(sum(CASE WHEN distance > threshold THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chunk FROM d JOIN t USING (label)
"""


@query(BREAK_SQL.format("quantile_cont(distance, 0.9)"))
def semantic_breakpoints_percentile(spark, sf_dir):
    return _breaks(spark, sf_dir, "percentile", 90.0)


@query(BREAK_SQL.format("avg(distance) + 1.0 * stddev_pop(distance)"))
def semantic_breakpoints_stddev(spark, sf_dir):
    return _breaks(spark, sf_dir, "stddev", 1.0)


@query(BREAK_SQL.format("quantile_cont(distance, 0.75) + 0.5 * (quantile_cont(distance, 0.75) - quantile_cont(distance, 0.25))"))
def semantic_breakpoints_iqr(spark, sf_dir):
    return _breaks(spark, sf_dir, "iqr", 0.5)


@query("""
SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS pos, unnest(ps) AS paragraph FROM (
SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(replace(text, '. ', '.' || chr(10) || chr(10)), '\\r\\n?', chr(10), 'g'), '[ \\t]+\\n', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), chr(10) || chr(10)), lambda p: regexp_replace(p, '^\\s+|\\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents)
""")
def paragraph_blocks(spark, sf_dir):
    text = F.replace(F.col("text"), F.lit(". "), F.lit(".\n\n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunk.paragraphs(text)).alias("pos", "paragraph"))


@query("""
WITH l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: contains(x, ' | ')) AS t FROM documents)
SELECT doc_id, len(list_filter(range(1, len(t)), lambda i: t[i] AND t[i + 1])) > 0 AS has_table FROM l
""")
def table_detector(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", chunk.contains_table(F.col("text")).alias("has_table"))


@query("SELECT doc_id, CAST(length(text) AS INTEGER) AS character_count, CAST(greatest(1, length(text) // 4) AS INTEGER) AS token_estimate FROM documents")
def token_estimate(spark, sf_dir):
    n, t = chunk.derived_counts(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("character_count"), t.alias("token_estimate"))


@query()
def chunk_pack(spark, sf_dir):
    return chunk.chunk_documents(table(spark, sf_dir, "documents"), "doc_id", "text", chunk.ChunkOptions.for_job())


@query("SELECT doc_id, true AS same FROM documents WHERE regexp_matches(text, '\\S')")
def chunk_join_roundtrip(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    back = chunk.joined_text(chunk.chunk_documents(docs, "doc_id", "text", chunk.ChunkOptions(300, 60)), "doc_id")
    flat = lambda c: F.regexp_replace(c, r"\s+", "")
    return docs.join(back, "doc_id").select("doc_id", (flat("text") == flat("content")).alias("same"))


@query(BM25_SQL + """, h AS (SELECT item_id, rank, d.source, text, coalesce(sum(length(text)) OVER (PARTITION BY item_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r JOIN documents d USING (doc_id) WHERE rank <= 8),
n AS (SELECT item_id, count(*) FILTER (before >= 40000) AS omitted FROM h GROUP BY 1)
SELECT item_id, rank AS citation, source AS title, md5(substr(text, 1, CAST(40000 - before AS BIGINT))) AS body, length(text) > 40000 - before AS truncated, omitted FROM h JOIN n USING (item_id) WHERE before < 40000""")
def tool_passages(spark, sf_dir):
    """Passages for each benchmark item within the budget of a tool."""
    hits = _bm25_rows(spark, sf_dir, 10, "source", "text")
    rows = hits.select("item_id", "rank", F.lit(" ").alias("title"), F.col("source").alias("uri"), F.col("text").alias("content"), F.lit(None).cast("string").alias("snippet"))
    return tools.passages(rows, "item_id").select("item_id", "citation", "title", F.md5("body").alias("body"), "truncated", "omitted")


@query("""
SELECT doc_id AS document_id, greatest(0, least(length(text), doc_id % 7 * 100 - 50)) AS "offset", length(text) AS characters, md5(substr(text, greatest(0, least(length(text), doc_id % 7 * 100 - 50)) + 1, CASE WHEN doc_id % 2 = 0 THEN 300 ELSE 20000 END)) AS body,
  greatest(0, length(text) - greatest(0, doc_id % 7 * 100 - 50) - CASE WHEN doc_id % 2 = 0 THEN 300 ELSE 20000 END) AS remaining FROM documents
""")
def tool_documents(spark, sf_dir):
    """A part of every document, from different places on."""
    docs = table(spark, sf_dir, "documents")
    at = F.col("doc_id")
    asked = docs.select(at.alias("request"), at.alias("document_id"), (at % 7 * 100 - 50).cast("int").alias("offset"), F.when(at % 2 == 0, 300).alias("most"))
    found = tools.document_windows(asked, docs.select(at.alias("document_id"), F.col("source").alias("title"), F.col("text").alias("body")))
    return found.select("document_id", F.col("offset").cast("long").alias("offset"), F.col("characters").cast("long").alias("characters"), F.md5("body").alias("body"), F.col("remaining").cast("long").alias("remaining"))
