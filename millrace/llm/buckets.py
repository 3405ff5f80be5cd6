"""Exact links inside candidate buckets: Jaccard similarity of the members' shingle sets.

A bucket is searched from one member to those not yet reached, which finds its components without listing all pairs. A
bucket of more than HOT members is dealt into cells of about HOT. One member of the whole bucket, its pivot, visits every
cell, and each cell is searched by itself, from the pivot first: whatever it reaches is connected across the cells. Only
members that it does not reach then visit the other cells, where they are compared with everyone. Where there would be more
than WIDE cells to visit, they meet by rare shingles instead: sets of Jaccard similarity t share one of the first
size - ceil(t * size) + 1 of their shingles in any one order, and here the rarest of the bucket come first. So unlike members
of a very large bucket travel in proportion to their shingles, not to the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_group, groups, lean, materialize

HOT = 4096
#: Cells of a bucket up to which members that the pivot does not reach visit all of them.
WIDE = 16
_EDGES = "src long, dst long"


class _Postings:
    """The members that hold each shingle."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.n = len(sets)
        self.sizes = np.array([len(s) for s in sets])
        flat, owner = np.concatenate(sets), np.repeat(np.arange(self.n), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]

    def near(self, own: np.ndarray, threshold: float) -> np.ndarray:
        """Which members reach the threshold with the set ``own``."""
        lo, hi = np.searchsorted(self.flat, own), np.searchsorted(self.flat, own, side="right")
        spans = hi - lo
        at = np.repeat(lo, spans) + np.arange(int(spans.sum())) - np.repeat(np.cumsum(spans) - spans, spans)
        shared = np.bincount(self.owner[at], minlength=self.n)
        return shared >= threshold * (self.sizes + len(own) - shared) - 1e-9

    def keep(self, members: np.ndarray) -> None:
        kept = members[self.owner]
        self.flat, self.owner = self.flat[kept], self.owner[kept]


def bucket_links(sets: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int]]:
    """Edges whose components are those of all pairs of Jaccard similarity of at least ``threshold``: from each member
    reached the search compares only with members not yet reached. The search begins at the first member."""
    held = _Postings(sets)
    waiting = np.ones(held.n, bool)
    for first in range(held.n):
        if not waiting[first]:
            continue
        waiting[first] = False
        frontier = [first]
        while frontier:
            u = frontier.pop()
            near = np.flatnonzero(waiting & held.near(sets[u], threshold))
            for v in near.tolist():
                yield u, v
            waiting[near] = False
            frontier += near.tolist()
            if len(near) and held.n > 64:  # drop the postings of members that are reached
                held.keep(waiting)


def _sets(blobs: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(b, np.uint64) for b in blobs]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    src, dst = zip(*pairs) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])


def _rare(rows: DataFrame, guests: DataFrame, threshold: float) -> DataFrame:
    """key, node: smaller buckets, a member for each of its rare shingles that is a rare one of some guest too. ``rows``,
    ``guests``: key, node, sh; guests are among the rows. Every pair of a guest and another member that reaches the threshold
    shares one of these buckets."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(b, np.int64) for b in batch.column(2).to_pylist()]
            sizes = np.array([len(s) for s in sets], np.int64)
            at = pa.array(np.repeat(np.arange(len(sets)), sizes))
            columns = [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.concatenate(sets) if sets else np.array([], np.int64)), pa.array(np.repeat(sizes, sizes))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "node", "token", "size"])

    tokens = materialize(rows.select("key", "node", "sh").mapInArrow(lean(unpack), "key long, node long, token long, size long"), "tokens")
    frequent = tokens.groupBy("key", "token").agg(F.count("*").alias("df"))
    first = F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1
    order = Window.partitionBy("key", "node").orderBy("df", "token")
    rare = tokens.join(frequent, ["key", "token"]).withColumn("at", F.row_number().over(order)).where(F.col("at") <= first)
    rare = materialize(rare.select("key", "node", "token"), "rare")
    asked = rare.join(guests.select("key", "node"), ["key", "node"], "left_semi").select("key", "token").distinct()
    return rare.join(asked, ["key", "token"], "left_semi").select(F.xxhash64("key", "token").alias("key"), "node").distinct()


def links(members: DataFrame, sets: DataFrame, threshold: float, hot: int = HOT, wide: int | None = WIDE) -> DataFrame:
    """``members``: key, node, without repeats. ``sets``: node, sh (sorted distinct hashes as bytes). Returns src, dst,
    whose components are those of all pairs of members of one bucket that reach the threshold."""
    large = materialize(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where(F.col("n") > hot), "hot")
    full = members.join(sets, "node")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches):
            ids = bucket.column("node").to_pylist()
            if len(ids) > 1:
                own = _sets(bucket.column("sh").to_pylist())
                yield _edges([(ids[a], ids[b]) for a, b in bucket_links(own, threshold)])

    if not large.limit(1).count():
        return by_group(full.select("key", "node", "sh"), "key").mapInArrow(lean(whole), _EDGES)
    small = by_group(full.join(large, "key", "left_anti").select("key", "node", "sh"), "key").mapInArrow(lean(whole), _EDGES)
    cells = F.ceil(F.col("n") / hot).cast("int")
    cell = lambda at: F.xxhash64("key", at)
    own = full.join(large, "key").withColumn("cells", cells)
    rows = materialize(own.select(cell(F.pmod(F.xxhash64("node"), "cells").cast("int")).alias("cell"), "key", "node", "sh", "cells", (F.col("node") == F.col("pivot")).alias("pivot")), "cells")
    every = F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("at")
    visits = lambda df: df.select("key", "node", "sh", "cells", every).select(cell(F.col("at")).alias("cell"), "key", "node", "sh", "cells")
    pivots = visits(rows.where("pivot")).withColumn("first", F.lit(True))
    dealt = rows.where("not pivot").select("cell", "key", "node", "sh", "cells", F.lit(False).alias("first")).unionByName(pivots)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges of a cell, and the members that its pivot does not reach."""
        for part in groups(batches):
            part = part.sort_by([("first", "descending"), ("node", "ascending")])
            ids, blobs = part.column("node").to_pylist(), part.column("sh").to_pylist()
            pairs = list(bucket_links(_sets(blobs), threshold))
            up = {0}
            for a, b in pairs:  # edges come component by component, from the pivot's on
                if a in up:
                    up.add(b)
            rest = [i for i in range(len(ids)) if i not in up]
            keys, cells = part.column("key").to_pylist(), part.column("cells").to_pylist()
            src = [ids[a] for a, _ in pairs] + [ids[i] for i in rest]
            dst = [ids[b] for _, b in pairs] + [None] * len(rest)
            none = [None] * len(pairs)
            arrays = [pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(none + [keys[i] for i in rest], pa.int64())]
            arrays += [pa.array(none + [blobs[i] for i in rest], pa.binary()), pa.array(none + [cells[i] for i in rest], pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, ["src", "dst", "key", "sh", "cells"])

    found = materialize(by_group(dealt, "cell").mapInArrow(lean(search), f"{_EDGES}, key long, sh binary, cells int"), "searched")
    lone = found.where("dst is null").select("key", F.col("src").alias("node"), "sh", "cells")
    far = None
    if wide is not None and lone.where(F.col("cells") > wide).limit(1).count():
        of = rows.where(F.col("cells") > wide).join(lone.select("key").distinct(), "key", "left_semi")
        # what is still large then holds one rare shingle in common, and its members visit cells as before
        far = links(_rare(of, lone.where(F.col("cells") > wide), threshold), sets, threshold, hot, None)
        lone = lone.where(F.col("cells") <= wide)
        rows = rows.where(F.col("cells") <= wide)
    guests = visits(lone).withColumn("guest", F.lit(True))
    met = rows.select("cell", "key", "node", "sh", "cells", F.lit(False).alias("guest")).unionByName(guests)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members of a cell come first and are held; its guests pass by."""
        last, ids, blobs, held = None, [], [], None
        for batch in batches:
            pairs = []
            for c, node, sh, guest in zip(*(batch.column(k).to_pylist() for k in ("cell", "node", "sh", "guest"))):
                if c != last:
                    last, ids, blobs, held = c, [], [], None
                if not guest:
                    ids.append(node)
                    blobs.append(sh)
                elif ids:
                    held = held or _Postings(_sets(blobs))
                    near = np.flatnonzero(held.near(np.frombuffer(sh, np.uint64), threshold))
                    pairs += [(node, ids[i]) for i in near.tolist() if ids[i] != node]
            yield _edges(pairs)

    crossed = met.repartition(F.col("cell")).sortWithinPartitions("cell", "guest").mapInArrow(lean(compare), _EDGES)
    out = small.unionByName(found.where("dst is not null").select("src", "dst")).unionByName(crossed)
    return out if far is None else out.unionByName(far)
