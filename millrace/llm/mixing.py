"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into blocks of documents; a source that is to give r times its words gives each block floor(r)
times, and a permuted prefix of its blocks (the last of them cut at a document) once more. The tree halves the output
shards again and again and draws, at each node, how many blocks of each source go left, from the multivariate
hypergeometric distribution; every leaf so holds an exact quota of each source. Blocks are then taken in a permuted
order, without overlap, and shuffled inside their shard. All draws follow from ``seed``, so reruns agree.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words of a shard, about; a mix has MIN_SHARDS to MAX_SHARDS, and larger shards are written by several tasks.
SHARD_WORDS = 4_000_000
MIN_SHARDS, MAX_SHARDS = 16, 1024


def targets(sizes: list[int], weights: list[float], cap: float = MAX_REPEATS) -> list[float]:
    """Words wanted of each source: by weight, at most ``cap`` times its size, the excess reshared by weight."""
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return out


def split_tree(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """(shard, source): blocks of each source that each shard gets; columns sum to ``counts``."""
    out = np.zeros((shards, len(counts)), np.int64)

    def descend(first: int, last: int, here: np.ndarray) -> None:
        if last - first == 1:
            out[first] = here
            return
        mid, n = (first + last) // 2, int(here.sum())
        # so many as fall to the left half when all blocks are dealt evenly over the shards from ``first`` on
        take = n * (mid - first) // (last - first)
        key = hashlib.sha256(f"{seed}:{first}:{last}".encode()).digest()
        rng = np.random.default_rng(int.from_bytes(key[:8], "big"))
        left = np.zeros_like(here)
        todo, rest = take, n
        for i, c in enumerate(here.tolist()):  # one source at a time, each given those before it
            rest -= c
            left[i] = rng.hypergeometric(c, rest, todo) if todo and c else 0
            todo -= int(left[i])
        descend(first, mid, left)
        descend(mid, last, here - left)

    descend(0, shards, np.array(counts, np.int64))
    return out


def _hash(seed: int, *columns):
    return F.xxhash64(F.lit(seed), *columns)


def shard_count(words: int) -> int:
    return max(MIN_SHARDS, min(MAX_SHARDS, -(-words // SHARD_WORDS)))


def placements(docs: DataFrame, **options) -> DataFrame:
    return _placed(docs, **options)[0]


def _placed(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = MAX_REPEATS, shards: int | None = None, seed: int = 1) -> tuple[DataFrame, int, int]:
    """One row for each row of ``docs``: doc_id, source, size (words), source_size, target, and placed: an array of
    (shard, place), one entry for each time that the mix takes the document; the number of shards, and of words. Sorting
    a shard by place is its shuffle. Sources are in code point order, null last, and weigh ``weights``, repeating.
    A source of n documents has about sqrt(n) blocks, so neither the list of its blocks nor the block at the cut grows
    large. The driver holds one row a source and one number a source and shard.

    Null texts have size 0; a source without words is not taken; rows that repeat a doc_id are told apart by their
    text's hash, or taken together where that is the same too; an empty table gives an empty result."""
    spark = docs.sparkSession
    words = F.regexp_count(text_or_empty(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), words.alias("size"), F.xxhash64(text_or_empty()).alias("h"))
    rows = materialize(rows, "sizes")
    stats = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()  # one row a source
    stats.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    wanted = targets([r.words for r in stats], [weights[i % len(weights)] for i in range(len(stats))], cap)
    total = sum(r.words for r in stats)
    shards = shards or shard_count(total)
    plan = []
    for i, (r, target) in enumerate(zip(stats, wanted)):
        times = min(cap, int(target // r.words)) if r.words else 0
        plan.append((i, r.source, r.words, target, math.isqrt(max(1, r.n - 1)) + 1, times, 0.0 if times == cap else target - times * r.words))
    kind = "s int, source string, source_size long, target double, blocks int, times int, rest double"
    sources = spark.createDataFrame(plan, kind)
    rows = rows.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    rows = rows.withColumn("block", F.pmod(_hash(seed, "doc_id", "h"), F.col("blocks")).cast("int")).withColumn("order", _hash(seed + 1, "doc_id", "h"))

    # blocks in permuted order; the words before each say which are taken once more, and where the cut falls
    blocks = rows.groupBy("s", "block").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), F.first("times").alias("times"))
    permuted = Window.partitionBy("s").orderBy(_hash(seed + 2, "s", "block"), "block")
    blocks = blocks.withColumn("before", F.sum("words").over(permuted) - F.col("words"))
    blocks = materialize(blocks.withColumn("room", F.col("rest") - F.col("before")), "blocks")
    rows = rows.join(blocks.select("s", "block", "room", "words"), ["s", "block"])
    whole, cut = F.col("words") <= F.col("room"), (F.col("room") > 0) & (F.col("words") > F.col("room"))
    inside = Window.partitionBy("s", "block").orderBy("order", "doc_id", "h")
    partly = rows.where(cut).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # the document at the cut is taken if more of it lies inside than outside
    partly = partly.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("room")).cast("int")).drop("upto")
    rows = rows.where(~cut).withColumn("extra", whole.cast("int")).unionByName(partly)

    # quotas: units are (block, repeat), permuted within their source and dealt to the shards in turn
    taken = blocks.select("s", "block", F.explode(F.sequence(F.lit(0), F.col("times"))).alias("repeat"), "times", "room")
    taken = taken.where((F.col("repeat") < F.col("times")) | (F.col("room") > 0)).select("s", "block", "repeat")
    unit = Window.partitionBy("s").orderBy(_hash(seed + 3, "s", "block", "repeat"), "block", "repeat")
    units = materialize(taken.withColumn("u", F.row_number().over(unit) - 1), "units")
    counts = {r.s: r.n for r in units.groupBy("s").agg(F.count("*").alias("n")).collect()}
    tree = split_tree([counts.get(i, 0) for i in range(len(plan))], shards, seed).cumsum(axis=0)
    ends = spark.createDataFrame([(i, [int(x) for x in tree[:, i]]) for i in range(len(plan))], "s int, ends array<long>")
    dealt = units.join(ends, "s").select("s", "block", "repeat", F.size(F.filter("ends", lambda e: e <= F.col("u"))).alias("shard"))
    # a block has at most ``cap`` + 1 units
    of_block = dealt.groupBy("s", "block").agg(F.collect_list(F.struct("repeat", "shard")).alias("shares"))
    out = rows.join(of_block, ["s", "block"], "left")
    mine = F.filter(F.coalesce("shares", F.array().cast("array<struct<repeat:int,shard:int>>")), lambda x: x["repeat"] < F.col("times") + F.col("extra"))
    placed = F.transform(mine, lambda x: F.struct(x["shard"].alias("shard"), _hash(seed + 4, "doc_id", "h", x["repeat"]).alias("place")))
    return out.select("doc_id", "source", "size", "source_size", "target", placed.alias("placed"), "h"), shards, total


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is taken, in shards whose rows are
    shuffled. Rows are not collected by source: each finds its own places. Rows that repeat one another by id and text are
    taken together; texts without words are not taken, nor are sources without any; rows without id mix like others."""
    found, shards, words = _placed(docs, **options)
    where = found.where(F.size("placed") > 0).select(F.col("doc_id").alias("id"), "h", "placed").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("own"), F.xxhash64(text_or_empty()).alias("code"))
    met = keyed.join(where, F.col("own").eqNullSafe(F.col("id")) & (F.col("code") == F.col("h")))
    # a task takes a range of places of one shard, of about SHARD_WORDS
    tasks = max(1, -(-words // (shards * SHARD_WORDS)))
    spread = met.select("row", F.explode("placed").alias("at")).select("row", "at.shard", "at.place")
    spread = spread.withColumn("part", F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * tasks).cast("int"))
    return spread.repartition(shards * tasks, "shard", "part").sortWithinPartitions("shard", "place").select("row.*")


def report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards (one for each time the mix takes it) for each row of ``docs``."""
    found = placements(docs, **options)
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("placed")).alias("taken"), F.array_sort(F.col("placed.shard")).alias("shards"))
