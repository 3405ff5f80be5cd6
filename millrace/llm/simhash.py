"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is cut into 32 segments of two bits and mapped to the vector of their bit counts. The
Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so the grid
range-join below is a superset of the links: the 32 coordinates are dealt to seven groups, and vectors within
Manhattan distance 4 agree on at least three whole groups. Each of the 35 choices of three groups is a grid
whose cells are joined; inside a cell pairs first pass the Manhattan bound, then the exact Hamming test.

Counts are kept as sorted bits (00, 01, 11), for which the Manhattan distance is the bit count of the exclusive or.
Only distinct fingerprints are joined, so copies cost nothing; a cell emits a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, groups, lean, materialize
from .components import components

SEED = 42
#: Shingles of a text that are hashed at a time.
HASHED = 1 << 15
_LOW = np.uint64(0x5555555555555555)
#: Cells up to this size are compared pair by pair; larger ones by canopies, with the same result.
_SMALL_CELL = 48
_LARGE_CELL = 2048


def fingerprint(data: bytes, shingle: int = 4, seed: int = SEED) -> int:
    """SimHash of the ``shingle``-word shingles (repeats included) of a UTF-8 text, A-Z lower-cased.

    A text of fewer words has its whole sequence as the one shingle; a text without words has fingerprint 0."""
    joined, ends = _words(data.lower())
    if not len(ends):
        return 0
    if len(ends) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    digest = xxhash.xxh64_intdigest
    last = ends[shingle - 1 :]
    starts = np.concatenate(([0], ends[: len(last) - 1] + 1))
    counts = np.zeros(64, np.int64)
    for at in range(0, len(last), HASHED):  # so many shingles at a time, however long the text is
        spans = zip(starts[at : at + HASHED].tolist(), last[at : at + HASHED].tolist())
        part = np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(last), bitorder="little").view(np.uint64)[0])


def _words(data: bytes) -> tuple[bytes, np.ndarray]:
    """The words of a text with one space between them, and where each ends."""
    codes = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    blank = (codes == 32) | ((codes >= 9) & (codes <= 13))
    keep = ~blank
    keep[1:] |= keep[:-1]  # each word and the blank after it
    kept, gap = codes[keep], blank[keep]
    kept = np.where(gap, np.uint8(32), kept)
    ends = np.flatnonzero(gap)
    if len(kept) and not gap[-1]:
        return kept.tobytes(), np.append(ends, len(kept))
    return kept[:-1].tobytes(), ends


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, fp long")


def embed(fps: np.ndarray) -> np.ndarray:
    """The bit counts of the 32 segments, each as sorted bits in its own two places."""
    high, low = (fps >> np.uint64(1)) & _LOW, fps & _LOW
    return (high | low) | ((high & low) << np.uint64(1))


def grids(distance: int) -> list[int]:
    """Bit masks of the grids: any two vectors within ``distance`` share a cell of at least one."""
    groups, at = [], 0
    for k in range(distance + 3):
        size = 32 // (distance + 3) + (k < 32 % (distance + 3))
        groups.append(((1 << 2 * size) - 1) << 2 * at)
        at += size
    return [sum(c) for c in combinations(groups, 3)]


class _Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while (y := up.get(x, x)) != root:
            up[x] = root
            x = y
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def edges(self) -> tuple[list[int], list[int]]:
        nodes = list(self.up)
        return nodes, [self.find(x) for x in nodes]


def _link_canopies(fps: np.ndarray, distance: int, forest: _Forest) -> None:
    """All links of a large cell up to connectivity. Members of a canopy are within distance/2 of its pivot and
    so linked with each other; two canopies can hold a link only if their pivots are within twice the distance."""
    half, left = distance // 2, fps
    canopies: list[np.ndarray] = []
    pivots: list[int] = []
    while len(left):
        d = np.bitwise_count(left ^ left[0])
        pivot = int(left[0])
        for x in left[d <= distance].tolist():
            forest.join(pivot, x)
        canopies.append(left[d <= half])
        pivots.append(pivot)
        left = left[d > half]
    centres = np.array(pivots, np.uint64)
    for i in range(len(canopies)):
        near = np.flatnonzero(np.bitwise_count(centres[i + 1 :] ^ centres[i]) <= distance + 2 * half) + i + 1
        for j in near.tolist():
            if forest.find(pivots[i]) == forest.find(pivots[j]):
                continue
            small, large = sorted((canopies[i], canopies[j]), key=len)
            for x in small:
                if (np.bitwise_count(large ^ x) <= distance).any():
                    forest.join(pivots[i], pivots[j])
                    break


def finer(mask: int, distance: int) -> list[int]:
    """Grids inside a cell of ``mask``: vectors that agree there and lie within ``distance`` agree on two more of
    ``distance`` + 2 groups of the other segments."""
    rest = [3 << 2 * s for s in range(32) if not mask >> 2 * s & 1]
    parts = [sum(rest[k :: distance + 2]) for k in range(distance + 2)]
    return [a | b for a, b in combinations(parts, 2)]


def link_cell_rows(fps: np.ndarray, mask: int, distance: int, forest: _Forest, finest: bool = False) -> None:
    """Links between distinct fingerprints that share a cell of the grid ``mask``. Cells of more than _LARGE_CELL are cut
    by finer grids, so their work stays near their size."""
    fps = np.unique(fps)
    vectors = embed(fps)
    keys = vectors & np.uint64(mask)
    order = np.argsort(keys, kind="stable")
    fps, vectors, keys = fps[order], vectors[order], keys[order]
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.array([], int)
    sizes = np.diff(np.append(starts, len(keys)))
    size_of = np.repeat(sizes, sizes)
    lag = 1
    while True:
        i = np.flatnonzero((size_of[lag:] <= _SMALL_CELL) & (keys[lag:] == keys[:-lag])) if lag < len(keys) else []
        if not len(i):
            break
        i = i[np.bitwise_count(vectors[i] ^ vectors[i + lag]) <= distance]
        i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= distance]
        for a, b in zip(fps[i].tolist(), fps[i + lag].tolist()):
            forest.join(a, b)
        lag += 1
    for s, n in zip(starts[sizes > _SMALL_CELL].tolist(), sizes[sizes > _SMALL_CELL].tolist()):
        if n > _LARGE_CELL and not finest:
            for inner in finer(mask, distance):
                link_cell_rows(fps[s : s + n], mask | inner, distance, forest, True)
        else:
            _link_canopies(fps[s : s + n], distance, forest)


def fingerprint_links(distinct: DataFrame, distance: int = 4, rows: int | None = None) -> DataFrame:
    """``distinct``: column fp, no repeats. Returns src, dst whose components are those of the links."""
    masks = grids(distance)
    rows = distinct.count() if rows is None else rows
    parts = max(1, -(-rows // 200_000))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            vectors = embed(fps)
            buckets, blobs = [], []
            for k, mask in enumerate(masks):
                cell = (vectors & np.uint64(mask)) * np.uint64(0x9E3779B97F4A7C15)
                part = (cell >> np.uint64(33)) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                for p in np.flatnonzero(np.diff(cuts)).tolist():
                    buckets.append(k * parts + p)
                    blobs.append(fps[order[cuts[p] : cuts[p + 1]]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "fps"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches):
            forest = _Forest()
            fps = np.frombuffer(b"".join(bucket.column("fps").to_pylist()), np.uint64)
            link_cell_rows(fps, masks[bucket.column("bucket")[0].as_py() // parts], distance, forest)
            ends = [np.array(x, np.uint64).view(np.int64) for x in forest.edges()]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in ends], ["src", "dst"])

    dealt = distinct.select("fp").mapInArrow(lean(deal), "bucket long, fps binary")
    dealt = by_group(dealt, "bucket")
    return dealt.mapInArrow(lean(link), "src long, dst long")


def classes(fps: DataFrame, distance: int = 4) -> DataFrame:
    """``fps``: doc_id, fp. Returns doc_id, fp, component_id: the smallest doc_id whose fingerprint is reached
    over links of at most ``distance`` differing bits (null only if no document of the component has an id)."""
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fps")
    stars = components(fingerprint_links(distinct.select("fp"), distance))
    rooted = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_fp = rooted.join(ids, "root").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4) -> DataFrame:
    """One row for each row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Null and empty texts have fingerprint zero and are linked like any other; rows that repeat a doc_id are
    kept; an empty table gives an empty result; other columns of ``docs`` are ignored."""
    found = classes(materialize(fingerprints(docs, shingle), "docfps"), distance)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
