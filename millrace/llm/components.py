"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a partial-aggregated minimum and a join, so a hub with very many neighbours is split by adaptive
execution and never gathered into one task; nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: columns src, dst of one orderable type. Returns node, root for every node with an edge to
    another node, root being the smallest node reachable. Loops, repeats and null ends are ignored."""
    pairs = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    current = materialize(pairs.where("src is not null and dst is not null and src <> dst").distinct(), "edges")
    mark = _mark(current)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(root, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        kept = root.select("u", F.col("m").alias("v"))
        current, read = materialize(moved.unionByName(kept).distinct(), "edges"), current
        before, mark = mark, _mark(current)
        forget(read)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
