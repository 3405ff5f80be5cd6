"""Filters, joins, windows, paging, versions: the relational operators of reports and lists."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def optional_filters(rows: DataFrame, **wanted: Any) -> DataFrame:
    """Equality on each column whose value is not None."""
    for name, value in wanted.items():
        if value is not None:
            rows = rows.where(F.col(name) == F.lit(value))
    return rows


def search_like(rows: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows one of whose columns contains the needle, whatever its case."""
    found = F.lit(False)
    for c in columns:
        found = found | F.lower(F.coalesce(c, F.lit(""))).contains(needle.lower())
    return rows.where(found)


def between_times(rows: DataFrame, ts: str, start: Any = None, end: Any = None) -> DataFrame:
    """Half-open range; an end that is None is open."""
    if start is not None:
        rows = rows.where(F.col(ts) >= F.lit(start))
    return rows.where(F.col(ts) < F.lit(end)) if end is not None else rows


def first_in_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("__n = 1").drop("__n")


def latest_with_ties(rows: DataFrame, group: Sequence[str], ts: str) -> DataFrame:
    """All rows of each group's latest time, as a correlated maximum keeps them."""
    return rows.withColumn("__n", F.rank().over(Window.partitionBy(*group).orderBy(F.desc(ts)))).where("__n = 1").drop("__n")


def top_n_per_group(rows: DataFrame, group: str, key: str, measure: str, n: int) -> DataFrame:
    """The n keys of the largest sums in each group: group, key, total, rank."""
    sums = rows.groupBy(group, key).agg(F.sum(measure).alias("total"))
    order = Window.partitionBy(group).orderBy(F.desc("total"), key)
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def page(rows: DataFrame, order: Sequence[Column], number: int, size: int = 50, most: int = 200) -> DataFrame:
    size = max(1, min(most, size))
    return rows.orderBy(*order).offset(max(0, number) * size).limit(size)


def truncated(rows: DataFrame, order: Sequence[Column], n: int) -> tuple[DataFrame, bool]:
    """The first n rows, and whether there are more."""
    head = rows.orderBy(*order).limit(n + 1)
    return head.limit(n), head.count() > n


def dense_counts(rows: DataFrame, keys: Mapping[str, Sequence[str]]) -> DataFrame:
    """Counts over every combination of the given values, zeros included."""
    spark = rows.sparkSession
    domain = None
    for name, values in keys.items():
        one = spark.createDataFrame([(v,) for v in values], f"{name} string")
        domain = one if domain is None else domain.crossJoin(F.broadcast(one))  # the listed values only
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    return domain.join(counts, list(keys), "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def changed(incoming: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """key and state of each incoming row: NEW, UPDATED or UNCHANGED against the current digests."""
    old = current.select(key, F.col(digest).alias("__old"))
    state = F.when(F.col("__old").isNull(), "NEW").when(F.col("__old") == F.col(digest), "UNCHANGED").otherwise("UPDATED")
    return incoming.join(old, key, "left").withColumn("state", state).drop("__old")


def versions(rows: DataFrame, identity: str, digest: str, order: Sequence[Column]) -> DataFrame:
    """Slowly changing versions: a row whose digest equals the one before it in its identity adds none; version counts
    from 1 and the last is current."""
    line = Window.partitionBy(identity).orderBy(*order)
    kept = rows.withColumn("__p", F.lag(digest).over(line)).where(F.col("__p").isNull() | (F.col("__p") != F.col(digest))).drop("__p")
    kept = kept.withColumn("version", F.row_number().over(line))
    return kept.withColumn("current", F.lead("version").over(line).isNull())


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows in place of those with the same keys."""
    return current.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(incoming)


def insert_missing(current: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows to append: the first of each key that is not there yet."""
    return first_in_group(incoming, keys, order).join(current.select(*keys), list(keys), "left_anti")


def add_counters(current: DataFrame, deltas: DataFrame, keys: Sequence[str], count: str, seen: str) -> DataFrame:
    """Counters with deltas added, new keys inserted, the later time kept."""
    both = current.select(*keys, count, seen).unionByName(deltas.select(*keys, count, seen))
    return both.groupBy(*keys).agg(F.sum(count).alias(count), F.max(seen).alias(seen))


#: Rows of a listed side that are broadcast; larger ones are joined without.
LISTED = 10_000


def listed(rows: DataFrame, most: int = LISTED) -> DataFrame:
    """``rows`` to be broadcast if they are few, by their count."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def ignore_rules(cases: DataFrame, rules: DataFrame, normal) -> DataFrame:
    """rule_id of the oldest rule that matches each case, null where none does: kind EQUALS or CONTAINS on the normalised
    question, or TAG on any tag. Equal questions and tags are joined by value; only CONTAINS rules meet every case."""
    rows = cases.select("case_id", normal(F.col("question")).alias("text"), "tags")
    want = rules.select("rule_id", "kind", "created_at", F.when(F.col("kind") == "TAG", F.col("pattern")).otherwise(normal(F.col("pattern"))).alias("want"))
    of = lambda kind: want.where(F.col("kind") == kind).drop("kind")
    equal = rows.join(of("EQUALS"), F.col("text") == F.col("want"))
    tagged = rows.select("case_id", F.explode("tags").alias("tag")).join(of("TAG"), F.col("tag") == F.col("want"))
    inside = rows.join(listed(of("CONTAINS")), F.col("text").contains(F.col("want")))
    hits = [x.select("case_id", F.struct("created_at", "rule_id").alias("hit")) for x in (equal, tagged, inside)]
    first = hits[0].unionByName(hits[1]).unionByName(hits[2]).groupBy("case_id").agg(F.min("hit").alias("hit"))
    return cases.select("case_id").join(first, "case_id", "left").select("case_id", F.col("hit.rule_id").alias("rule_id"))


def sampled(rows: DataFrame, key: str, rate: float, keep: Column) -> DataFrame:
    """A fixed share by hash of the key; rows for which ``keep`` holds stay always."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10_000
    return rows.where((bucket < int(rate * 10_000)) | keep)


def json_tags(c: Column) -> Column:
    """A JSON array of strings; anything else is empty."""
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


_LINE_ENDS = re.compile("\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]")


def unified_diff(old: str, new: str, most_cells: int = 1_000_000) -> list[str]:
    """Lines of either text in order, ' ' before those of a longest common subsequence, '-' and '+' before the others;
    where either may come first the new line does. Texts whose table would exceed ``most_cells`` are replaced whole."""
    x, y = _LINE_ENDS.split(old), _LINE_ENDS.split(new)
    if len(x) * len(y) > most_cells:
        return [f"-{line}" for line in x] + [f"+{line}" for line in y]
    codes: dict[str, int] = {}
    a, b = (np.array([codes.setdefault(line, len(codes)) for line in lines]) for lines in (x, y))
    # common[i, j]: the longest common subsequence of what follows, a row at a time from the end
    common = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):
        best = np.where(b == a[i], common[i + 1, 1:] + 1, common[i + 1, :-1])
        common[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        if a[i] == b[j]:
            out.append(f" {x[i]}")
            i, j = i + 1, j + 1
        elif common[i, j + 1] >= common[i + 1, j]:
            out.append(f"+{y[j]}")
            j += 1
        else:
            out.append(f"-{x[i]}")
            i += 1
    return out + [f"+{line}" for line in y[j:]] + [f"-{line}" for line in x[i:]]


def line_diff(rows: DataFrame, old: str, new: str, version: str) -> DataFrame:
    """Adds ``diff``: the difference of two texts by lines, below a head with the version and the one before it."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, x, y = (batch.column(c).to_pylist() for c in (version, old, new))
            diffs = ["\n".join([f"--- v{n - 1}", f"+++ v{n}", *unified_diff(p or "", q or "")]) + "\n" for n, p, q in zip(v, x, y)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(diffs, pa.string())], names=[*names, "diff"])

    return rows.mapInArrow(run, _with(rows.schema, "diff"))


def _with(schema: StructType, name: str) -> StructType:
    return StructType([*schema.fields, StructField(name, StringType())])


def ordered_by_name(rows: DataFrame, name: str, key: str) -> DataFrame:
    """By name whatever its case, then id."""
    return rows.orderBy(F.lower(name), key)


def with_looked_up(rows: DataFrame, lookup: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the one value that their key has in ``lookup``, null where it has none."""
    return rows.join(lookup.groupBy(key).agg(F.max(value).alias(value)), key, "left")


def view(rows: DataFrame, texts: Sequence[str], elevated: Column) -> DataFrame:
    """Rows with their texts hidden unless the reader is elevated."""
    return rows.withColumns({c: F.when(elevated, F.col(c)) for c in texts})


def histogram(rows: DataFrame, group: str, value: str, low: float, high: float, bins: int) -> DataFrame:
    """group, bin, n: counts by bins of equal width; bin 0 lies below, bins + 1 from ``high`` on."""
    at = F.width_bucket(F.col(value), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return rows.groupBy(group, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def merged_maps(rows: DataFrame, group: str, entries: str) -> DataFrame:
    """group, merged: maps of counts added up key by key, as a map in the order of keys."""
    flat = rows.select(group, F.explode(entries).alias("k", "v")).groupBy(group, "k").agg(F.sum("v").alias("v"))
    return flat.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("merged"))


def json_value(c: Column, path: str, default: str) -> Column:
    return F.coalesce(F.get_json_object(c, path), F.lit(default))


def related_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """key, and for each table of ``children`` (with that key) the number of its rows, 0 where it has none: results of a rule,
    images of a run, entries of a frontier. Each table is counted before it meets the parents; null keys count for none."""
    out = parents.select(key).where(F.col(key).isNotNull()).distinct()
    for name, rows in children.items():
        out = out.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out
