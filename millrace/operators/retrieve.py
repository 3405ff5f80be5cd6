"""Ranked lists: fusion, deduplication, reranking, scoping, diversity, feedback."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_number, strip_list_marker

RRF_CONSTANT = 60
CANDIDATES = 100
MODES = ("lexical", "semantic", "hybrid", "fusion")


@dataclass(frozen=True)
class SearchRequest:
    """A search with its parameters brought into range."""

    query: str
    limit: int = 10
    mode: str | None = None
    vector_weight: float = 0.5
    kind: str | None = None
    run_id: str | None = None

    def __post_init__(self) -> None:
        if not self.query or not self.query.strip():
            raise ValueError("a query is needed")
        if self.mode is not None and self.mode.lower() not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if not 0 <= self.vector_weight <= 1:
            raise ValueError("the vector weight lies between 0 and 1")
        object.__setattr__(self, "query", self.query.strip())
        object.__setattr__(self, "limit", max(1, min(100, self.limit)))

    def resolved_mode(self, embeddings: bool) -> str:
        """Hybrid unless told otherwise, lexical where there are no embeddings."""
        mode = (self.mode or ("hybrid" if embeddings else "lexical")).lower()
        if mode == "semantic" and not embeddings:
            raise ValueError("semantic search needs embeddings")
        return mode if embeddings else "lexical"

    def candidate_limit(self, backend: int = CANDIDATES, reranker: int | None = None) -> int:
        return min(backend, max(self.limit, reranker)) if reranker else self.limit


def filter_records(records: DataFrame, kind: str | None = None, run_id: str | None = None, chunk_ids: DataFrame | None = None) -> DataFrame:
    """Records of one kind, or of all but summaries; of a run; and of the given chunks, none if there are none."""
    out = records.where(F.col("kind") == kind) if kind else records.where(F.coalesce(F.col("kind") != "summary", F.lit(True)))
    if run_id is not None:
        out = out.where(F.col("run_id") == run_id)
    return out.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi") if chunk_ids is not None else out


def dedup_hits(hits: DataFrame, query: str, record: str, chunk: str, limit: int) -> DataFrame:
    """Of the ``limit`` best records of a query the best of each chunk stays; ranks are then counted anew."""
    order = [F.desc("score"), F.col(record)]
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where(F.col("n") <= limit)
    one = best.withColumn("m", F.row_number().over(Window.partitionBy(query, chunk).orderBy("n"))).where("m = 1")
    return one.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("n"))).drop("n", "m")


def rrf(legs: Iterable[DataFrame], query: str, key: str, k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal-rank fusion of lists that have a ``rank`` column; ties by id."""
    rows = None
    for leg in legs:
        part = leg.select(query, key, (1.0 / (constant + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    fused = rows.groupBy(query, key).agg(F.round(F.sum("part"), 9).alias("score"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def multi_query_rrf(lists: DataFrame, query: str, key: str, k: int, constant: int = RRF_CONSTANT) -> DataFrame:
    """Fusion over several result lists of one question (columns list, rank); ties by where a hit was first seen."""
    fused = lists.groupBy(query, key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    order = Window.partitionBy(query).orderBy(F.desc("score"), "seen", key)
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("seen")


def min_max_fusion(lexical: DataFrame, semantic: DataFrame, query: str, key: str, weight: float, k: int) -> DataFrame:
    """weight * scaled semantic + (1 - weight) * scaled lexical score; each leg is scaled to its own range by query,
    a leg without range counts 1, a missing leg 0. The legs' raw scores stay as they are."""

    def scaled(leg: DataFrame, name: str) -> DataFrame:
        whole = Window.partitionBy(query)
        low, high = F.min("score").over(whole), F.max("score").over(whole)
        value = F.when(high - low <= 1e-12, F.lit(1.0)).otherwise((F.col("score") - low) / F.nullif(high - low, F.lit(0.0)))
        return leg.select(query, key, F.col("score").alias(f"{name}_score"), value.alias(f"{name}_scaled"))

    both = scaled(lexical, "lexical").join(scaled(semantic, "semantic"), [query, key], "full_outer")
    total = weight * F.coalesce("semantic_scaled", F.lit(0.0)) + (1 - weight) * F.coalesce("lexical_scaled", F.lit(0.0))
    both = both.withColumn("score", F.round(total, 6))
    order = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query, key, "rank", "score", "lexical_score", "semantic_score")


def rerank(hits: DataFrame, scores: DataFrame, query: str, key: str, limit: int) -> DataFrame:
    """Order by the reranker's score where it answered for all hits of a query; else the order stays."""
    met = hits.join(scores.select(query, key, "rerank_score"), [query, key], "left")
    whole = Window.partitionBy(query)
    good = F.count("*").over(whole) == F.count("rerank_score").over(whole)
    met = met.withColumn("ok", good)
    order = Window.partitionBy(query).orderBy(F.when(F.col("ok"), -F.col("rerank_score")).otherwise(F.col("rank").cast("double")), key)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).withColumn("score", F.when(F.col("ok"), F.col("rerank_score")).otherwise(F.col("score"))).drop("ok")


def judged_rerank_scores(replies: DataFrame) -> DataFrame:
    """rerank_score from free-text replies: the first number, between 0 and 10; 0 where there is none. A query whose
    scores are all 0 has failed and gets none."""
    value = F.least(F.lit(10.0), F.greatest(F.lit(0.0), F.coalesce(first_number(F.col("reply")), F.lit(0.0))))
    scored = replies.withColumn("rerank_score", value)
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    return scored.withColumn("best", best).withColumn("rerank_score", F.when(F.col("best") > 0, F.col("rerank_score"))).drop("best")


def planned_queries(replies: DataFrame, limit: int = 6, width: int = 500) -> DataFrame:
    """Lines of a planner's reply as queries: markers and quotes dropped, repeats whatever their case too."""
    lines = replies.select("query_id", F.posexplode(F.split("reply", "\n")).alias("pos", "line"))
    lines = lines.select("query_id", "pos", F.substring(F.trim(strip_list_marker(F.col("line"))), 1, width).alias("query")).where("query <> ''")
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy("query_id", F.lower("query")).orderBy("pos"))).where("n = 1")
    return first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("n") <= limit)


def hierarchical_scope(section_hits: DataFrame, sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks inside the sections that were hit: query_id, chunk_id. A chunk that is anchored elsewhere, as captions
    are, counts at its anchor."""
    picked = section_hits.join(sections, "section_id").select("query_id", "document_id", "first_ordinal", "last_ordinal")
    at = F.coalesce("anchor_ordinal", "ordinal") if "anchor_ordinal" in chunks.columns else F.col("ordinal")
    within = chunks.withColumn("at", at).join(picked, "document_id").where("at between first_ordinal and last_ordinal")
    return within.select("query_id", "chunk_id").distinct()


def scoped_or_all(hits: DataFrame, scope: DataFrame) -> DataFrame:
    """Hits inside the scope; all hits of a query for which none lies inside."""
    inside = hits.join(scope, ["query_id", "chunk_id"], "left_semi")
    return inside.unionByName(hits.join(inside.select("query_id").distinct(), "query_id", "left_anti"))


def dartboard_pool(k: int, factor: int) -> int:
    """Candidates that diversity selection looks at: k * factor, at most 100, but never fewer than k."""
    return max(k, min(100, k * factor))


def dartboard_order(query: np.ndarray, candidates: np.ndarray, k: int, relevance: float, diversity: float, sigma: float) -> list[int]:
    """Greedy choice by relevance and spread. Vectors are compared by cosine distance under a Gaussian of width
    ``sigma``; the next pick has the best weighted sum of its log relevance and of how far the picks so far, taken
    together as a density, leave it uncovered. Ties go to the candidate nearer the query, then the earlier one."""

    def unit(x: np.ndarray) -> np.ndarray:
        n = np.linalg.norm(x, axis=-1, keepdims=True)
        return np.divide(x, n, out=np.zeros_like(x, float), where=n > 0)

    q, c = unit(np.asarray(query, float)), unit(np.asarray(candidates, float))
    if not len(c):
        return []
    scale = 2 * sigma * sigma
    near = np.maximum(0, 1 - c @ q)
    own = -near * near / scale
    between = np.maximum(0, 1 - c @ c.T)
    cover = -between * between / scale
    by_distance = np.lexsort((np.arange(len(c)), near))
    picked = [int(by_distance[0])]
    density = cover[picked[0]].copy()
    while len(picked) < min(k, len(c)):
        gain = relevance * own - diversity * density
        gain[picked] = -np.inf
        best = gain.max()
        tied = [i for i in by_distance.tolist() if gain[i] >= best - 1e-12 and i not in picked]
        picked.append(tied[0])
        density = np.logaddexp(density, cover[tied[0]])
    return picked


def dartboard(candidates: DataFrame, k: int, relevance: float = 1.0, diversity: float = 1.0, sigma: float = 0.1) -> DataFrame:
    """``candidates``: query_id, key, rank, vector, query_vector; at most 100 ranks of a query are looked at.
    Returns query_id, key, pick."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank", "key"])
        order = dartboard_order(np.array(pdf.query_vector.iloc[0]), np.stack(pdf.vector.to_list()), k, relevance, diversity, sigma)
        return pd.DataFrame({"query_id": pdf.query_id.iloc[0], "key": pdf.key.iloc[order].to_numpy(), "pick": np.arange(1, len(order) + 1)})

    kinds = dict(candidates.dtypes)
    bounded = candidates.where(F.col("rank") <= 100)
    return bounded.groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, key {kinds['key']}, pick int")


def feedback_reweight(hits: DataFrame, ratings: DataFrame, query: str, document: str, per_document: int = 20) -> DataFrame:
    """Scores times the mean relevance over 3 of a document's newest ratings; documents without ratings keep theirs."""
    newest = Window.partitionBy(document).orderBy(F.desc("rated_at"), F.desc("rating_id"))
    kept = ratings.withColumn("n", F.row_number().over(newest)).where(F.col("n") <= per_document)
    factor = kept.groupBy(document).agg((F.avg("relevance") / 3).alias("factor"))
    met = hits.join(factor, document, "left").withColumn("score", F.round(F.col("score") * F.coalesce("factor", F.lit(1.0)), 6))
    order = Window.partitionBy(query).orderBy(F.desc("score"), document)
    return met.withColumn("rank", F.row_number().over(order)).drop("factor")


#: Ratings that are checked for one question, and the rating that changes nothing. Fixed values.
MOST_CHECKS, NEUTRAL = 40, 3


def feedback_checks(hits: DataFrame, documents: DataFrame, feedback: DataFrame, sources: DataFrame, query: str, per_document: int) -> DataFrame:
    """The ratings that a judge is to be asked about, for each question at most MOST_CHECKS and ``per_document`` for each identity
    among its hits: query, feedback_id, rated_at, relevance, by falling time, then id.

    ``hits``: query, document_id; ``documents``: document_id, identity; ``feedback``: feedback_id, rated_at, relevance; ``sources``:
    feedback_id, identity. An identity's ratings beyond its newest MOST_CHECKS cannot be among the newest of a question,
    so they are dropped before they meet questions; a rating of many identities counts once."""
    asked = hits.join(documents.where("identity is not null").select("document_id", "identity").distinct(), "document_id").select(query, "identity").distinct()
    line = Window.partitionBy("identity").orderBy(F.desc("rated_at"), F.desc("feedback_id"))
    rated = feedback.where("relevance is not null").select("feedback_id", "rated_at", "relevance")
    rated = sources.where("identity is not null").select("feedback_id", "identity").distinct().join(rated, "feedback_id")
    newest = rated.withColumn("n", F.row_number().over(line)).where(F.col("n") <= MOST_CHECKS).drop("n")
    budget = asked.groupBy(query).agg(F.least(F.lit(MOST_CHECKS), per_document * F.count("*")).alias("budget"))
    met = asked.join(newest, "identity").groupBy(query, "feedback_id").agg(F.max("rated_at").alias("rated_at"), F.max("relevance").alias("relevance"))
    first = Window.partitionBy(query).orderBy(F.desc("rated_at"), F.desc("feedback_id"))
    ranked = met.withColumn("n", F.row_number().over(first)).where(F.col("n") <= MOST_CHECKS)
    return ranked.join(budget, query).where("n <= budget").select(query, "feedback_id", "rated_at", "relevance")


def feedback_weighted(hits: DataFrame, documents: DataFrame, feedback: DataFrame, sources: DataFrame, verdicts: DataFrame, query: str, per_document: int = 20) -> DataFrame:
    """``hits`` (query, document_id, rank, score) with scores times the mean relevance over NEUTRAL of the ratings that a judge
    holds relevant for the question, ``per_document`` newest for each identity, and new ranks; equal scores keep their order.

    ``verdicts``: query, feedback_id, reply. Only a reply that begins with yes makes a rating count; a reply that is
    missing or failed (null) does not, so where all checks of a question fail its hits keep scores and order."""
    checks = feedback_checks(hits, documents, feedback, sources, query, per_document)
    yes = verdicts.where(F.lower(F.trim("reply")).startswith("yes")).select(query, "feedback_id").distinct()
    held = checks.join(yes, [query, "feedback_id"])
    own = documents.where("identity is not null").select("document_id", "identity").distinct()
    asked = hits.join(own, "document_id").select(query, "identity").distinct()
    line = Window.partitionBy(query, "identity").orderBy(F.desc("rated_at"), F.desc("feedback_id"))
    counted = held.join(sources.select("feedback_id", "identity").distinct(), "feedback_id").join(asked, [query, "identity"])
    counted = counted.withColumn("n", F.row_number().over(line)).where(F.col("n") <= per_document)
    factor = counted.groupBy(query, "identity").agg((F.avg("relevance") / NEUTRAL).alias("factor"))
    met = hits.join(own, "document_id", "left").join(factor, [query, "identity"], "left")
    met = met.withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0)))
    order = Window.partitionBy(query).orderBy(F.desc("score"), "rank")
    return met.withColumn("rank", F.row_number().over(order)).select(*hits.columns)


def accepted_propositions(propositions: DataFrame, least: int = 7) -> DataFrame:
    """Those whose four scores all lie above ``least``."""
    names = ("accuracy", "clarity", "completeness", "conciseness")
    good = F.lit(True)
    for n in names:
        good = good & (F.col(n) > least)
    return propositions.where(good)


def alias_records(chunks: DataFrame, replies: DataFrame, record_type: str, least: int = 40) -> DataFrame:
    """Records that point back at their chunk: one for each line of a reply, for chunks that are long enough."""
    fit = chunks.where((F.length("content") >= least) & (F.coalesce("kind", F.lit("")) != "image"))
    lines = fit.join(replies, "chunk_id").select("chunk_id", F.posexplode(F.split("reply", "\n")).alias("ordinal", "line"), "content")
    text = F.trim(strip_list_marker(F.col("line")))
    return lines.select(F.concat_ws(":", "chunk_id", F.lit(record_type), "ordinal").alias("record_id"), "chunk_id", F.lit(record_type).alias("record_type"), text.alias("retrieval_text"), F.col("content").alias("source_content")).where("retrieval_text <> ''")


def fingerprint(*parts):
    return F.sha2(F.concat_ws("\n", *parts), 256)


def cached_replies(asks: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Asks (fingerprint, …) with the reply that is known, and those for which there is none."""
    known = cache.select("fingerprint", "reply").dropDuplicates(["fingerprint"])
    return asks.join(known, "fingerprint"), asks.join(known, "fingerprint", "left_anti")


def summary_fallback(text, width: int = 300, cut: int = 500):
    """A section's own text where it is short, else its start."""
    return F.when(F.length(text) <= width, text).otherwise(F.concat(F.substring(text, 1, cut), F.lit("...")))


#: Kinds of records beside chunks.
RECORD_KINDS = ("chunk", "proposition", "question", "summary", "caption", "document")


def all_records(parts: dict) -> DataFrame:
    """One table of the records of every kind that is there, each with its kind; kinds that are not known are an error."""
    unknown = set(parts) - set(RECORD_KINDS)
    if unknown or not parts:
        raise ValueError(f"kinds are {', '.join(RECORD_KINDS)}")
    tables = [parts[k].withColumn("kind", F.lit(k)) for k in RECORD_KINDS if k in parts]
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def retrieval_text(kind, language, symbol, content, title=None, summary=None, section=None):
    """What is indexed for a chunk: code below its language and symbol; below a header of what is known of its document."""
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    head = F.concat(F.lit("["), F.coalesce(language, F.lit("code")), F.lit("]"), F.when(has(symbol), F.concat(F.lit(" "), symbol)).otherwise(""), F.lit("\n"))
    body = F.when(kind == "code", F.concat(head, content)).otherwise(content)
    lines = [F.when(has(c), F.concat(F.lit(f"{name}: "), c)) for name, c in (("Title", title), ("Summary", summary), ("Section", section)) if c is not None]
    if not lines:
        return body
    header = F.concat_ws("\n", *lines)
    return F.when(header != "", F.concat(header, F.lit("\n\n"), body)).otherwise(body)


def hyde_vectors(queries: DataFrame, passages: DataFrame, query: str, vector: str, width: int = 2000) -> DataFrame:
    """Queries with ``vector`` replaced by that of their generated passage (query, text, passage_vector) where there is one;
    the text of the query, which the lexical leg uses, stays. ``passage`` is the text without fence, cut to length."""
    text = F.substring(F.trim(F.regexp_replace("text", r"(?s)^\s*```[^\n]*\n(.*?)\n?```\s*$", "$1")), 1, width)
    found = passages.select(query, F.nullif(text, F.lit("")).alias("passage"), "passage_vector")
    met = queries.join(found, query, "left")
    return met.withColumn(vector, F.when(F.col("passage").isNotNull(), F.coalesce("passage_vector", vector)).otherwise(F.col(vector))).drop("passage_vector")


class RoutingIndex:
    """The backend of each crate: ``make(configuration)`` builds one, kept until the configuration's fingerprint changes."""

    def __init__(self, configuration, make) -> None:
        self.configuration, self.make = configuration, make
        self.kept: dict = {}

    def of(self, crate: str):
        settings = self.configuration(crate)
        mark = repr(sorted(settings.items()))
        if self.kept.get(crate, (None, None))[0] != mark:
            self.kept[crate] = mark, self.make(settings)
        return self.kept[crate][1]


def both_legs(lexical, semantic):
    """The rows of two plans gathered at the same time; the first error of either is raised."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(2) as pool:
        waiting = [pool.submit(leg.toArrow) for leg in (lexical, semantic)]
        return tuple(w.result() for w in waiting)
