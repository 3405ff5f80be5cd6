"""Pattern extraction with offsets and context, by rules over chunks."""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .relational import optional_filters, page

CONTEXT, VALUE_CAP = 80, 4096
_IP = re.compile(r"(?<![0-9A-Za-z_.:])(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+)(?![0-9A-Za-z_:]|\.[0-9])")


def check_rule(strategy: str, pattern: str | None) -> re.Pattern | None:
    """The compiled pattern of a rule; an error where it is none."""
    if strategy == "ip":
        return None
    if strategy != "regex" or not pattern:
        raise ValueError("a rule is ip, or regex with a pattern")
    try:
        return re.compile(pattern)
    except re.error as e:
        raise ValueError(f"not a pattern: {e}") from None


def matches(strategy: str, pattern: re.Pattern | None, text: str) -> Iterator[tuple[str, int, int]]:
    """(value, start, end) of each match that is not empty."""
    for m in (_IP if strategy == "ip" else pattern).finditer(text):
        if m.end() == m.start():
            continue
        if strategy == "ip":
            try:
                ipaddress.ip_address(m.group())
            except ValueError:
                continue
        yield m.group(), m.start(), m.end()


def extract(chunks: DataFrame, rules: list[tuple[str, str, str | None]]) -> DataFrame:
    """``rules``: (id, strategy, pattern). rule_id, chunk_id, matched_value, match_start, match_end, context_before,
    context_after, result_id for each match in ``chunks`` (chunk_id, content)."""
    compiled = [(i, s, check_rule(s, p)) for i, s, p in rules]
    names = ["rule_id", "chunk_id", "matched_value", "match_start", "match_end", "context_before", "context_after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for chunk, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for rule, strategy, pattern in compiled:
                    for value, a, b in matches(strategy, pattern, text or ""):
                        rows.append((rule, chunk, value[:VALUE_CAP], a, b, text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.string(), batch.column(0).type, pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    kind = dict(chunks.dtypes)["chunk_id"]
    found = chunks.select("chunk_id", "content").mapInArrow(run, f"rule_id string, chunk_id {kind}, matched_value string, match_start int, match_end int, context_before string, context_after string")
    return found.withColumn("result_id", F.sha2(F.concat_ws(":", "rule_id", "chunk_id", "match_start", "match_end"), 256))


def replace_results(results: DataFrame, fresh: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results with those of the given chunks replaced."""
    return results.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti").unionByName(fresh)


def matching_results(results: DataFrame, value: str | None = None, **ids) -> DataFrame:
    """All results whose value contains ``value``, in no order."""
    rows = optional_filters(results, **ids)
    if value:
        rows = rows.where(F.lower("matched_value").contains(value.lower()))
    return rows


def find_results(results: DataFrame, value: str | None = None, number: int = 0, size: int = 50, **ids) -> DataFrame:
    """One page of the matching results."""
    rows = matching_results(results, value, **ids)
    return page(rows, [F.desc("created_at"), F.col("result_id")] if "created_at" in results.columns else [F.col("result_id")], number, size)
