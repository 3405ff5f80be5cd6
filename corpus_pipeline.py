"""A training-data pipeline over ``documents``: language, near-duplicates, personal data, mixing, tokens.

Each stage works on all rows that its predecessor kept and returns the columns of documents; the last returns tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import langid, mixing, nearcopies, pii, spm
from millrace.llm.common import materialize, table, text_or_empty
from millrace.llm.entry import piece_model

#: Near copies: Jaccard similarity of at least SIMILARITY between the sets of SHINGLE-word shingles.
SIMILARITY = 0.8
SHINGLE = 5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document whose language is known; goes: null, letterless, or unlike every learned language, where
    short texts are held against short texts. Rows that repeat one another share their fate; rows without an id are
    scored but not learned from; other columns stay as they are; an empty table stays empty."""
    model = langid.fit(docs.where("doc_id is not null").select("doc_id", "text", "lang"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return langid.predict(rows, model, ("row",)).where("not rejected").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate component: that of smallest id (a row without id only where none has one),
    then of least text hash; of rows that share both, that of least hash over all columns. Rows that share an id but not
    their component are kept apart. Texts without words (null ones too) are near copies of each other."""
    found = nearcopies.classes(docs, SHINGLE, SIMILARITY)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")
    spots = found.groupBy("root", "doc_id", "raw").agg(F.count("*").alias("n"))
    lead = spots.groupBy("root").agg(F.min(place).alias("lead"))
    marks = spots.join(lead, "root").select("doc_id", "raw", F.when(place == F.col("lead"), F.lit(1)).otherwise(F.lit(0)).alias("stays"), "n")
    marks = materialize(marks.where("stays = 0 or n > 1").select(F.col("doc_id").alias("id"), F.col("raw").alias("h"), "stays"), "marks")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("raw"))
    met = rows.join(marks.hint("merge"), rows["doc_id"].eqNullSafe(marks["id"]) & (rows["raw"] == marks["h"]), "left")
    kept = met.where("stays is null").select("row")
    if marks.where("stays = 1").limit(1).count():
        one = met.where("stays = 1").groupBy("doc_id", "raw").agg(F.min_by("row", F.struct(F.xxhash64("row"), F.to_json("row"))).alias("row"))
        kept = kept.unionByName(one.select("row"))
    return kept.select("row.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each span of personal data by its kind; keeps every document: repeated rows, null and empty texts and rows
    without id as well. n_chars follows where a text changes; an empty table stays empty."""
    return pii.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents so often as their source's target weight asks, in shuffled shards; see mixing.mixed for rows
    without id, repeated rows and texts without words."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip, off: the token ids of each text, whether they decode to it, and how many of its
    chunks the library sees otherwise (none). Null and empty texts have no tokens; repeated rows are kept."""
    path = piece_model()
    names = docs.select("doc_id", "text")
    return spm.encoded_rows(names, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]

#: SQL has no fingerprints, hypergeometric draws or merge agendas: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
