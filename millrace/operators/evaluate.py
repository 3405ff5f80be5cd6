"""Ranking and answer-quality metrics. Empty input gives NULL, which is not zero."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import cosine, normal_question

RELEVANT = 2


def ranking_metrics(graded: DataFrame, query: str, k: int, totals: DataFrame | None = None, pool: DataFrame | None = None) -> DataFrame:
    """``graded``: query, rank, grade. One row a query: precision_at_k, recall_at_k, mrr, average_precision, ndcg.

    ``totals``: query, total relevant (else those of the list). ``pool``: query, grade of all judged hits, from which
    the ideal gain is taken (else the list)."""
    rel = (F.col("grade") >= RELEVANT).cast("int")
    running = Window.partitionBy(query).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    top = graded.where(F.col("rank") <= k).withColumn("rel", rel).withColumn("upto", F.sum(rel).over(running))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1)
    by = top.groupBy(query).agg(
        F.avg(F.col("rel").cast("double")).alias("precision_at_k"),
        F.sum("rel").alias("found"),
        F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(F.when(F.col("rel") == 1, F.col("upto") / F.col("rank")).otherwise(0.0)).alias("ap_sum"),
        F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"),
    )
    totals = graded.groupBy(query).agg(F.sum(rel).alias("total")) if totals is None else totals.select(query, F.col("total"))
    judged = (graded if pool is None else pool).select(query, "grade")
    best = judged.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("grade")))).where(F.col("n") <= k)
    ideal = best.groupBy(query).agg(F.sum(gain(F.col("grade"), F.col("n"))).alias("ideal"))
    met = by.join(totals, query, "left").join(ideal, query, "left")
    total = F.nullif(F.col("total"), F.lit(0))
    return met.select(
        query,
        "precision_at_k",
        F.when(total.isNotNull(), F.least(F.lit(1.0), F.col("found") / total)).alias("recall_at_k"),
        "mrr",
        F.when(total.isNotNull(), F.least(F.lit(1.0), F.col("ap_sum") / total)).alias("average_precision"),
        (F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0))).alias("ndcg"),
    )


def golden_grades(hits: DataFrame, expected: DataFrame, query: str) -> DataFrame:
    """Grade 3 for a hit whose URI contains an expected entry, else 0, with the first entry that it contains.
    ``expected``: query, entry, position; a golden set has at most 200 questions of few entries."""
    met = hits.join(expected, [query], "left")
    hit = F.lower("uri").contains(F.lower("entry"))
    first = met.groupBy(query, "rank", "uri").agg(F.min_by(F.when(hit, F.col("entry")), F.when(hit, F.col("position"))).alias("entry"))
    return first.withColumn("grade", F.when(F.col("entry").isNull(), 0).otherwise(3))


def golden_recall(graded: DataFrame, expected: DataFrame, query: str) -> DataFrame:
    """Share of the expected entries that some hit contains."""
    found = graded.groupBy(query).agg(F.count_distinct("entry").alias("found"))
    want = expected.groupBy(query).agg(F.count_distinct("entry").alias("n"))
    return want.join(found, query, "left").select(query, (F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"))


#: Fixed weights of the aspects of an answer.
ASPECT_WEIGHTS = {"core": 1.0, "background": 0.5, "follow_up": 0.25}


def completeness(aspects: DataFrame, key: str) -> DataFrame:
    """Weighted mean of aspect scores 0, 1, 2 over 2."""
    w = F.coalesce(*(F.when(F.col("aspect") == a, F.lit(x)) for a, x in ASPECT_WEIGHTS.items()))
    return aspects.groupBy(key).agg((F.sum(w * F.col("score") / 2.0) / F.nullif(F.sum(F.when(F.col("score").isNotNull(), w)), F.lit(0.0))).alias("completeness"))


def answer_status(score: Column, retrieved: Column):
    """Status and reason for a gap: without retrieved sources the judge (0 to 2) is not asked."""
    none = F.coalesce(retrieved, F.lit(0)) == 0
    status = F.when(none, "UNANSWERED").when(score == 2, "ANSWERED").when(score == 1, "PARTIAL").when(score.isNotNull(), "UNANSWERED")
    reason = F.when(none, "no-sources").when(score == 1, "partial").when(score == 0, "not-in-sources")
    return status, reason


def extend_pool(results: DataFrame, judged: DataFrame, query: str, key: str, size: int) -> DataFrame:
    """Hits of the ``size`` best that are not judged yet."""
    return results.where(F.col("rank") <= size).join(judged.select(query, key), [query, key], "left_anti")


def topic_text_groups(questions: DataFrame, text: str) -> DataFrame:
    """Groups of questions that are equal once normalised: topic, questions, variants."""
    topic = normal_question(F.col(text))
    return questions.where(topic != "").groupBy(topic.alias("topic")).agg(F.count("*").alias("questions"), F.count_distinct(text).alias("variants"))


#: Cosine from which a topic joins a leader, topics that are compared, and topics that a judge is shown. Fixed values.
MERGE_AT, MOST_TOPICS, JUDGED_TOPICS = 0.92, 300, 100


def topic_key(topic: Column) -> Column:
    """Topics are the same text but for case and closing marks."""
    return F.regexp_replace(F.lower(topic), r"[\s.?!]+$", "")


def text_clusters(topics: DataFrame, tenant: str) -> DataFrame:
    """tenant, topic, leader: topics of one key follow the most frequent of them. Two aggregates, whatever the number."""
    order = F.struct((-F.col("frequency")).alias("f"), F.col("topic"))
    lead = topics.groupBy(tenant, topic_key(F.col("topic")).alias("__key")).agg(F.min_by("topic", order).alias("leader"))
    return topics.withColumn("__key", topic_key(F.col("topic"))).join(lead, [tenant, "__key"]).select(tenant, "topic", "leader")


def most_frequent(topics: DataFrame, tenant: str, most: int) -> DataFrame:
    """The ``most`` topics of each tenant with the highest frequency, with their number n from 1: every task keeps as many
    of each tenant before anything is sent, so a tenant's topics never meet as a whole."""
    order = Window.partitionBy(tenant).orderBy(F.desc("frequency"), F.asc_nulls_last("topic"))
    return topics.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)


def leader_clusters(topics: DataFrame, tenant: str, threshold: float = MERGE_AT, cap: int = MOST_TOPICS) -> DataFrame:
    """``topics``: tenant, topic, frequency, vector. Returns tenant, topic, leader. By falling frequency each of the
    ``cap`` most frequent topics of a tenant joins the first leader whose cosine reaches the threshold, or leads anew;
    the topics beyond merge among themselves where their texts are equal but for case and closing marks."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        leaders: list[int] = []
        units, out = [], []
        for name, v in zip(pdf.topic, pdf.vector):
            v = np.asarray(v, float)
            v = v / (np.linalg.norm(v) or 1.0)
            at = next((i for i, u in enumerate(units) if u @ v >= threshold), None)
            if at is None:
                at = len(units)
                units.append(v)
                leaders.append(name)
            out.append(leaders[at])
        return pd.DataFrame({tenant: pdf[tenant], "topic": pdf.topic, "leader": out})

    kinds = dict(topics.dtypes)
    head = most_frequent(topics, tenant, cap)
    grouped = head.groupBy(tenant).applyInPandas(group, f"{tenant} {kinds[tenant]}, topic {kinds['topic']}, leader {kinds['topic']}")
    # at most ``cap`` topics of a tenant are taken out of the others
    names = most_frequent(topics.drop("vector"), tenant, cap).select(tenant, "topic")
    rest = topics.select(tenant, "topic", "frequency").join(names, [tenant, "topic"], "left_anti")
    return grouped.unionByName(text_clusters(rest, tenant))


def judge_clusters(topics: DataFrame, replies: DataFrame, tenant: str, asked: int = JUDGED_TOPICS) -> DataFrame:
    """``topics``: tenant, topic, frequency; ``replies``: tenant, reply, a judge's {"groups": [[0, 2], [1]]} over the ``asked`` most
    frequent topics, numbered from 0. Returns tenant, topic, leader for the tenants with groups in their reply: numbers that
    are unknown or were given before are ignored, a group is led by its most frequent topic, topics that the judge forgot
    or was not shown stand alone. Tenants whose reply has no groups are left out, for ``text_clusters``."""
    body = F.regexp_extract("reply", r"(?s)(\{.*\})", 1)
    given = replies.select(tenant, F.from_json(body, "groups array<string>")["groups"].alias("groups")).where("groups is not null")
    numbers = F.regexp_extract_all("group", F.lit(r"(?<=[\[,])\s*(-?\d{1,9})\s*(?=[,\]])"), F.lit(1))
    places = given.select(tenant, F.posexplode("groups").alias("g", "group")).where(F.col("group").startswith("["))
    places = places.select(tenant, "g", F.posexplode(numbers).alias("m", "number")).select(tenant, "g", "m", (F.col("number").cast("int") + 1).alias("n"))
    shown = most_frequent(topics.select(tenant, "topic", "frequency"), tenant, asked).select(tenant, "topic", "n")
    # the first group that names a topic has it
    own = places.where(F.col("n").between(1, asked)).groupBy(tenant, "n").agg(F.min("g").alias("g"))
    placed = shown.join(own, [tenant, "n"])
    lead = placed.groupBy(tenant, "g").agg(F.min_by("topic", "n").alias("leader"))
    named = placed.join(lead, [tenant, "g"]).select(F.col(tenant).alias("__tenant"), F.col("topic").alias("__topic"), F.struct("leader").alias("lead"))
    all_topics = topics.select(tenant, "topic").join(given.select(tenant).distinct(), tenant, "left_semi")
    met = all_topics.join(named, (F.col(tenant) == F.col("__tenant")) & F.col("topic").eqNullSafe(F.col("__topic")), "left")
    return met.select(tenant, "topic", F.when(F.col("lead").isNull(), F.col("topic")).otherwise(F.col("lead.leader")).alias("leader"))


#: Averages of a report, by the names that scores have in a case.
SCORES = ("precision_at_k", "recall_at_k", "mrr", "average_precision", "ndcg", "faithfulness", "answer_relevance", "completeness", "reference_recall")
GAPS = ("UNANSWERED", "PARTIAL")


def gap_cube(cases: DataFrame, tenant: str, scores: tuple[str, ...] = SCORES, digits: int = 6) -> DataFrame:
    """``cases``: tenant, created_at, status, reason, leader (label of its topic, or null), tags (array), and any of ``scores``. One
    pass with grouping sets gives a row for each tenant (level tenant), topic, tag, and tag of a topic: cases, tracked
    (with a status), gaps, unanswered, no_sources, not_in_sources, partial, newest_gap, and the means of the scores that there are.

    A case has each of its tags once; cases without topic or tags count for their tenant only."""
    own = F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))
    rows = cases.select("*", F.posexplode_outer(own).alias("__at", "tag")).drop("tags").withColumnRenamed("leader", "topic")
    # what is counted for a case is counted at its first tag, except where tags are told apart
    level = F.grouping_id()
    gap = F.col("status").isin(*GAPS)
    counts = lambda c: F.count_if((c) & ((F.col("__at").isNull()) | (F.col("__at") == 0)))
    named = {
        "cases": F.lit(True),
        "tracked": F.col("status").isNotNull(),
        "gaps": gap,
        "unanswered": F.col("status") == "UNANSWERED",
        "no_sources": gap & (F.col("reason") == "no-sources"),
        "not_in_sources": gap & (F.col("reason") == "not-in-sources"),
        "partial": gap & (F.col("reason") == "partial"),
    }
    first = F.col("__at").isNull() | (F.col("__at") == 0)
    there = [n for n in scores if n in cases.columns]
    by = [tenant, "topic", "tag"]
    grouped = rows.groupingSets([[F.col(tenant)], [F.col(tenant), F.col("topic")], [F.col(tenant), F.col("tag")], [F.col(c) for c in by]], *(F.col(c) for c in by))
    whole, split = "__whole", "__split"
    out = grouped.agg(
        level.alias("__level"),
        *(counts(F.coalesce(c, F.lit(False))).alias(f"{n}{whole}") for n, c in named.items()),
        *(F.count_if(F.coalesce(c, F.lit(False))).alias(f"{n}{split}") for n, c in named.items()),
        F.max(F.when(gap, F.col("created_at"))).alias("newest_gap"),
        *(F.avg(F.when(first, F.col(n))).alias(f"{n}{whole}") for n in there),
        *(F.avg(n).alias(f"{n}{split}") for n in there),
    )
    # the two last bits of the level: topic and tag are summed over
    tagged = F.col("__level").bitwiseAND(F.lit(1)) == 0
    names = F.when(F.col("__level") == 3, "tenant").when(F.col("__level") == 1, "topic").when(F.col("__level") == 2, "tag").otherwise("topic_tag")
    pick = lambda n: F.when(tagged, F.col(f"{n}{split}")).otherwise(F.col(f"{n}{whole}"))
    out = out.select(tenant, names.alias("level"), "topic", "tag", *(pick(n).alias(n) for n in named), "newest_gap", *(F.round(pick(n), digits).alias(n) for n in there))
    has = {"topic": F.col("topic").isNotNull(), "tag": F.col("tag").isNotNull(), "topic_tag": F.col("topic").isNotNull() & F.col("tag").isNotNull()}
    return out.where((F.col("level") == "tenant") | F.coalesce(*(F.when(F.col("level") == n, c) for n, c in has.items())))


def gap_topics(cube: DataFrame, tenant: str, variants: DataFrame | None = None, most: int = 10, tags: int = 5) -> DataFrame:
    """tenant, at (from 1), topic, gaps, no_sources, not_in_sources, partial, newest_gap, tags: of each tenant the ``most`` topics
    with gaps, by falling number, then name, each with its ``tags`` most frequent tags among the gaps. ``variants``: tenant, topic,
    variants (array) are added if given. Every task keeps its own best of a tenant or topic before they meet."""
    topics = cube.where("level = 'topic' and gaps > 0")
    best = topics.withColumn("at", F.row_number().over(Window.partitionBy(tenant).orderBy(F.desc("gaps"), "topic"))).where(F.col("at") <= most)
    of = Window.partitionBy(tenant, "topic").orderBy(F.desc("gaps"), "tag")
    named = cube.where("level = 'topic_tag' and gaps > 0").withColumn("k", F.row_number().over(of)).where(F.col("k") <= tags)
    named = named.groupBy(tenant, "topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tag"))), lambda x: x["tag"]).alias("tags"))
    out = best.join(named, [tenant, "topic"], "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    out = out.join(variants.select(tenant, "topic", "variants"), [tenant, "topic"], "left") if variants is not None else out
    return out.select(tenant, "at", "topic", "gaps", "no_sources", "not_in_sources", "partial", "newest_gap", "tags", *(("variants",) if variants is not None else ()))


def judge_reply(reply: Column, low: int, high: int):
    """The score of a judge's reply: the object from the first brace to the last, its integer score in range."""
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    score = F.try_to_number(F.get_json_object(F.nullif(body, F.lit("")), "$.score"), F.lit("999")).cast("int")
    return F.when(score.between(low, high), score)


def clean_tags(tags: Column, most: int = 5, width: int = 40):
    """Trimmed, lower-case, distinct tags of bounded width."""
    return F.slice(F.array_distinct(F.filter(F.transform(tags, lambda t: F.substring(F.trim(F.lower(t)), 1, width)), lambda t: t != "")), 1, most)


def fact_line(name: str, value: Column):
    return F.concat(F.lit(f"{name}: "), F.coalesce(F.format_string("%.2f", value), F.lit("n/a")))


def share(verdicts: DataFrame, key: str, score: str, name: str, most: int = 20) -> DataFrame:
    """Faithfulness or reference recall: the share of a case's first ``most`` statements (pos) with score 1."""
    return verdicts.where(F.col("pos") < most).groupBy(key).agg(F.avg((F.col(score) == 1).cast("double")).alias(name))


def answer_relevance(questions: DataFrame, key: str, vector: str, generated: str, judged: str) -> DataFrame:
    """Mean cosine, held between 0 and 1, of a question's vector and those of the questions generated from its answer;
    the judge's score (0 to 3) over 3 where there are no vectors."""
    near = F.when(F.col(generated).isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col(vector), F.col(generated)))))
    return questions.groupBy(key).agg(F.coalesce(F.avg(near), F.max(F.col(judged)) / 3.0).alias("answer_relevance"))


def case_outcome(dimensions: DataFrame, key: str) -> DataFrame:
    """``dimensions``: key, name, ok of each dimension that was attempted. FAILED only where all failed; ``errors`` names
    the failed ones."""
    bad = F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("name"))))
    return dimensions.groupBy(key).agg(F.when(F.max("ok"), "DONE").otherwise("FAILED").alias("status"), F.nullif(F.array_join(bad, "; "), F.lit("")).alias("errors"))


#: Scores from which an answer counts as good, where it has them.
WELL_ANSWERED = {"faithfulness": 0.8, "answer_relevance": 0.7, "completeness": 0.7}


def well_answered() -> Column:
    good = F.lit(True)
    for name, least in WELL_ANSWERED.items():
        good = good & F.coalesce(F.col(name) >= least, F.lit(True))
    return good


def averages(cases: DataFrame, group: list, names: list[str], digits: int = 6) -> DataFrame:
    """Means of the scores by group; those that a case lacks do not count."""
    return cases.groupBy(*group).agg(F.count("*").alias("cases"), *(F.round(F.avg(n), digits).alias(n) for n in names))


def top_topics(cases: DataFrame, topic: str, leader: str, most: int = 25, variants: int = 5) -> DataFrame:
    """label, cases, variants: the most frequent groups of topics, by falling count, then label. Variants are the other
    wordings, the most frequent first."""
    words = cases.groupBy(leader, topic).agg(F.count("*").alias("n"))
    others = F.array_sort(F.collect_list(F.when(F.col(topic) != F.col(leader), F.struct((-F.col("n")).alias("n"), F.col(topic).alias("t")))))
    by = words.groupBy(leader).agg(F.sum("n").alias("cases"), F.slice(F.transform(others, lambda x: x["t"]), 1, variants).alias("variants"))
    return by.select(F.col(leader).alias("label"), "cases", "variants").orderBy(F.desc("cases"), "label").limit(most)


def topic_tags(cases: DataFrame, topic: str, tags: str, most: int = 5) -> DataFrame:
    """topic, tags: the most frequent tags of each topic, by falling count, then name."""
    n = cases.select(topic, F.explode(tags).alias("tag")).groupBy(topic, "tag").agg(F.count("*").alias("n"))
    order = Window.partitionBy(topic).orderBy(F.desc("n"), "tag")
    best = n.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
    return best.groupBy(topic).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"]).alias("tags"))


def rule_counts(rules: DataFrame, cases: DataFrame, since: Column) -> DataFrame:
    """rule_id, ever, lately: cases that each rule ignored, rules without any included."""
    hits = cases.groupBy("rule_id").agg(F.count("*").alias("ever"), F.count_if(F.col("created_at") >= since).alias("lately"))
    zero = F.lit(0).cast("long")
    return rules.select("rule_id").join(hits, "rule_id", "left").select("rule_id", F.coalesce("ever", zero).alias("ever"), F.coalesce("lately", zero).alias("lately"))


def scrubbed(cases: DataFrame, columns: list[str], keep: Column) -> DataFrame:
    """Texts of judged cases become null unless they are to be kept."""
    return cases.withColumns({c: F.when(keep, F.col(c)) for c in columns})
