"""Models as plug-ins: protocols, a deterministic stand-in, replayed replies."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class EmbeddingProvider(Protocol):
    dimensions: int

    def embed(self, texts: list[str], query: bool) -> list[list[float]]: ...


class RerankingProvider(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[float]: ...


class AnswerProvider(Protocol):
    def complete(self, messages: list[dict], temperature: float = 0.0, images: list[bytes] = ()) -> str: ...


class IndexBackend(Protocol):
    def search(self, queries: DataFrame, limit: int) -> DataFrame: ...

    def write(self, records: DataFrame) -> None: ...


class ArtifactStore(Protocol):
    def put(self, rows: DataFrame, most_bytes: int) -> DataFrame: ...

    def read(self, digest: str) -> DataFrame: ...


class PipelineQueue(Protocol):
    def claim(self, items: DataFrame, n: int) -> DataFrame: ...

    def acknowledge(self, items: DataFrame, outcomes: DataFrame) -> DataFrame: ...


class ReplayedAnswers:
    """Answers from recorded replies by the fingerprint of their messages; an ask that was not recorded is an error."""

    def __init__(self, replies: dict[str, str]) -> None:
        self.replies = replies

    @staticmethod
    def fingerprint(messages: list[dict]) -> str:
        return hashlib.sha256("\n".join(f"{m['role']}: {m['content']}" for m in messages).encode()).hexdigest()

    def complete(self, messages: list[dict], temperature: float = 0.0, images: list[bytes] = ()) -> str:
        return self.replies[self.fingerprint(messages)]


_words: dict[str, int] = {}


def _word_hash(word: str) -> int:
    """32 bits of a word's place and one of its sign; words that come again are looked up."""
    h = _words.get(word)
    if h is None:
        if len(_words) >= 1 << 18:
            _words.clear()
        digest = hashlib.md5(word.encode()).digest()
        h = _words[word] = int.from_bytes(digest[:4], "big") << 1 | digest[4] & 1
    return h


class HashEmbedding:
    """Words hashed to signed places, normalised: a deterministic stand-in for a model."""

    def __init__(self, dimensions: int = 64) -> None:
        self.dimensions = dimensions

    def embed(self, texts: list[str], query: bool = False) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        words = [(text or "").lower().split() for text in texts]
        found = np.array([_word_hash(w) for own in words for w in own], np.int64)  # whole signs, so their order adds nothing
        rows = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        np.add.at(out, (rows, (found >> 1) % self.dimensions), np.where(found & 1, 1.0, -1.0))
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()


class OverlapReranking:
    """Share of the query's words that a document holds."""

    def rerank(self, query: str, documents: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set(d.lower().split())) / max(1, len(q)) for d in documents]


def embedding_udf(provider: EmbeddingProvider, query: bool = False):
    """A vectorised function of texts; the provider goes to each worker once."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(provider.embed([t or "" for t in texts], query))

    return embed


def rerank_scores(hits: DataFrame, provider: RerankingProvider, query: str, key: str, text: str, query_text: str) -> DataFrame:
    """query, key, rerank_score; a provider that fails on a query leaves it without scores."""

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            s = provider.rerank(pdf[query_text].iloc[0], pdf[text].tolist())
        except Exception:
            s = [None] * len(pdf)
        return pd.DataFrame({query: pdf[query], key: pdf[key], "rerank_score": pd.array(s, dtype="Float64")})

    kinds = dict(hits.dtypes)
    return hits.groupBy(query).applyInPandas(score, f"{query} {kinds[query]}, {key} {kinds[key]}, rerank_score double")


def replayed(asks: DataFrame, replies: DataFrame, purpose: str) -> DataFrame:
    """Asks with the recorded reply to their fingerprint; null where there is none."""
    known = replies.where(F.col("purpose") == purpose).select("fingerprint", "reply").dropDuplicates(["fingerprint"])
    return asks.join(known, "fingerprint", "left")


def mean_pool(tokens: Column) -> Column:
    """Mean of token vectors (array of arrays), of unit length."""
    from .text import normalized

    total = F.reduce(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.element_at(tokens, 1), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    return normalized(F.transform(total, lambda x: x / F.size(tokens)))
