"""Exact substring deduplication by blockwise suffix sorting with a cover sample.

Removed is each byte of a ``LENGTH``-byte string that also starts earlier (smaller doc_id, or earlier in its document).

1. Anchors. Each window of LENGTH bytes has an anchor, the least-hashed GRAM-byte string in it, so equal windows have
   equal anchors at equal places. Anchors that occur once are dropped: their windows cannot repeat.
2. Blocks. The windows of each remaining anchor, a stretch of fewer than 2 * LENGTH bytes, go to the bucket of the
   anchor's hash. Buckets are sorted one at a time, in blocks of bounded text: the suffixes of its windows by their first
   PERIOD bytes; longer ties of two places i and j by the ranks of i + d and j + d, where d < PERIOD brings both into the
   difference cover of period PERIOD. The ranks of the cover's places are computed before.
3. Neighbours in the order that agree in LENGTH bytes are one group; all but its earliest window are repeated.

Anchors only spare text that cannot repeat from the sort; they decide nothing.

Only byte ranges return to the documents. Stretches that are equal inside one batch travel once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, by_group, groups, lean, materialize, text_or_empty

LENGTH = 100
GRAM = 40
PERIOD = 32
#: Bytes hashed at once, and bytes of text in one block of a bucket.
CHUNK, BLOCK = 1 << 20, 1 << 21
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LEAST = -(2**63)


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, n.bit_length())
    if size not in _CACHE:
        _CACHE.clear()
        _CACHE[size] = _powers(size, _BASE), _powers(size, _INVERSE)
    return _CACHE[size]


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    n = len(data)
    up, down = _tables(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def window_anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window of LENGTH bytes the place of its anchor, and the hashes of all grams. Ties go to the first."""
    h = gram_hashes(data)
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | (np.arange(len(h), dtype=np.uint64) & low)
    span, done = LENGTH - GRAM + 1, 1
    least = key
    while 2 * done <= span:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if done < span:
        least = np.minimum(least[: len(key) - span + 1], least[span - done : span - done + len(key) - span + 1])
    return (least & low).astype(np.int64), h


def _pieces(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of documents of about CHUNK bytes together."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def anchor_windows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the document, the first window, the number of windows, the place and the hash of each
    anchor. Very long texts are cut into pieces that overlap by a window, which changes no anchor."""
    step = 1 << 22
    parts = [(d, a, t[a : a + step + LENGTH - 1]) for d, t in enumerate(texts) for a in range(0, max(1, len(t) - LENGTH + 1), step)]
    for lo, hi in _pieces([len(p[2]) for p in parts]):
        run = [p for p in parts[lo:hi] if len(p[2]) >= LENGTH]
        if not run:
            continue
        sizes = np.array([len(p[2]) for p in run])
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(p[2] for p in run), np.uint8)
        at, h = window_anchors(data)
        # windows that lie inside one document
        index = np.arange(len(at))
        owner = np.repeat(np.arange(len(run)), sizes)[: len(at)]
        inside = index + LENGTH <= (starts + sizes)[owner]
        index, owner, at = index[inside], owner[inside], at[inside]
        new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (owner[1:] != owner[:-1]))))
        count = np.diff(np.append(new, len(at)))
        owner = owner[new]
        shift = np.array([p[1] for p in run])[owner] - starts[owner]
        yield np.array([p[0] for p in run])[owner], index[new] + shift, count, at[new] + shift, h[at[new]]


def _rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    k, h = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("k", "h"))
    return k, h, batch.column("text").cast(pa.binary()).to_pylist()


def _anchor_hashes(docs: DataFrame, buckets: int) -> DataFrame:
    """bucket, k, h, at, hash (arrays as bytes): the anchors of all windows, by bucket of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h, texts = _rows(batch)
            for doc, _, _, at, code in anchor_windows(texts):
                bucket = (code >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
                own = [order[a:b] for a, b in zip(cuts, cuts[1:])]
                used = [i for i, x in enumerate(own) if len(x)]
                columns = [
                    pa.array(used, pa.int32()),
                    *(pa.array([f(own[i]).tobytes() for i in used], pa.binary()) for f in (lambda x: k[doc[x]], lambda x: h[doc[x]], lambda x: at[x].astype(np.uint32), lambda x: code[x].astype(np.uint32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "k", "h", "at", "code"])

    return docs.mapInArrow(lean(run), "bucket int, k binary, h binary, at binary, code binary")


_RUN = np.dtype([("k", "<i8"), ("h", "<i8"), ("start", "<u4"), ("n", "<u4")])


def _dealt(runs: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Runs as one row for each bucket of documents."""
    mixed = (runs["k"].astype(np.uint64) ^ runs["h"].astype(np.uint64)) * _BASE
    part = (mixed >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(buckets + 1, dtype=np.uint64))
    used = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([runs[order[cuts[i] : cuts[i + 1]]].tobytes() for i in used], pa.binary())], ["to", "runs"])


def _by_document(dealt: DataFrame) -> DataFrame:
    """k, h, runs: one row for each document, its runs as bytes of (start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches):
            r = np.frombuffer(b"".join(bucket.column("runs").to_pylist()), _RUN)
            r = r[np.lexsort((r["start"], r["h"], r["k"]))]
            new = np.flatnonzero(np.concatenate(([True], (r["k"][1:] != r["k"][:-1]) | (r["h"][1:] != r["h"][:-1])))) if len(r) else np.zeros(0, int)
            pairs = np.ascontiguousarray(np.stack((r["start"], r["n"]), axis=1))
            ends = np.append(new[1:], len(r))
            yield pa.RecordBatch.from_arrays([pa.array(r["k"][new]), pa.array(r["h"][new]), pa.array([pairs[a:b].tobytes() for a, b in zip(new, ends)], pa.binary())], ["k", "h", "runs"])

    return by_group(dealt, "to").mapInArrow(lean(run), "k long, h long, runs binary")


def _repeated(anchors: DataFrame, buckets: int) -> DataFrame:
    """k, h, ats: for each document the places (``start`` of runs) of its anchors whose hash is repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches):
            k, h = (np.frombuffer(b"".join(bucket.column(c).to_pylist()), np.int64) for c in ("k", "h"))
            at, code = (np.frombuffer(b"".join(bucket.column(c).to_pylist()), np.uint32) for c in ("at", "code"))
            order = np.argsort(code, kind="stable")
            same = code[order][1:] == code[order][:-1]
            twice = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(order) else order
            out = np.zeros(len(twice), _RUN)
            out["k"], out["h"], out["start"] = k[twice], h[twice], at[twice]
            yield _dealt(out, buckets)

    found = by_group(anchors, "bucket").mapInArrow(lean(run), "to int, runs binary")
    return _by_document(found).withColumnRenamed("runs", "ats")


def _stretches(found: DataFrame, buckets: int) -> DataFrame:
    """bucket, heads, data, runs: stretches of the windows of repeated anchors, by bucket. Of stretches that are equal
    inside a batch the earliest travels; ``runs`` holds the windows of the others, which are repeated."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, h, texts = _rows(batch)
            order = np.lexsort((h, k))
            k, h, texts = k[order], h[order], [texts[i] for i in order]
            ats = batch.column("ats").to_pylist()
            wanted = [np.unique(np.frombuffer(ats[i], np.uint32)[::2]) for i in order]
            seen: dict[bytes, tuple[int, int, int]] = {}
            out: dict[int, tuple[list, list[bytes], list]] = {}
            asked = np.concatenate([(np.int64(d) << 32) | w.astype(np.int64) for d, w in enumerate(wanted)]) if wanted else np.zeros(0, np.int64)
            for doc, first, count, at, code in anchor_windows(texts):
                mine = (doc.astype(np.int64) << 32) | at
                place = np.minimum(np.searchsorted(asked, mine), len(asked) - 1)
                chosen = np.flatnonzero(asked[place] == mine)
                bucket = ((code >> np.uint64(40)) % np.uint64(buckets))[chosen].tolist()
                for d, a, n, p, b in zip(doc[chosen].tolist(), first[chosen].tolist(), count[chosen].tolist(), at[chosen].tolist(), bucket):
                    data = texts[d][a : a + n + LENGTH - 1]
                    me = (int(k[d]), int(h[d]), a)
                    heads, bodies, runs = out.setdefault(b, ([], [], []))
                    was = seen.setdefault(data, me)
                    if was is me:
                        heads.append((*me, n, p - a))
                        bodies.append(data)
                    elif was != me:
                        runs.append((*me, n))
            kinds = [np.dtype([*_RUN.descr, ("at", "<u4")]), _RUN]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(out), pa.int32()),
                    pa.array([np.array(o[0], kinds[0]).tobytes() for o in out.values()], pa.binary()),
                    pa.array([b"".join(o[1]) for o in out.values()], pa.binary()),
                    pa.array([np.array(o[2], _RUN).tobytes() for o in out.values()], pa.binary()),
                ],
                ["bucket", "heads", "data", "runs"],
            )

    return found.mapInArrow(lean(run), "bucket int, heads binary, data binary, runs binary")


def _cover(period: int) -> np.ndarray:
    """Residues that have every difference modulo ``period`` between two of them, chosen greedily."""
    chosen, missing = [0], set(range(1, period))
    while missing:
        gain = lambda x: len(missing & {(s * (x - c)) % period for c in chosen for s in (1, -1)})
        best = max(range(period), key=lambda x: (gain(x), -x))
        missing -= {(s * (best - c)) % period for c in chosen for s in (1, -1)}
        chosen.append(best)
    return np.array(sorted(chosen))


COVER = _cover(PERIOD)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
#: The least d for which places of residues a and b both come into the cover d bytes on.
_SHIFT = np.array([[next(d for d in range(PERIOD) if _IN_COVER[(a + d) % PERIOD] and _IN_COVER[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def _word(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number that sorts like them."""
    words = np.lib.stride_tricks.sliding_window_view(text, 8)[at]
    return np.ascontiguousarray(words).view(">u8").ravel().astype(np.uint64)


def _refined(text: np.ndarray, starts: np.ndarray, depth: int, singles: bool) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes at ``starts`` by their first ``depth`` bytes, eight at a time, and the group of equal ones
    of each in that order. Without ``singles`` only groups of two or more are returned."""
    order, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    place = np.arange(len(starts))
    out = np.arange(len(starts))
    tags = np.zeros(len(starts), np.int64)
    for d in range(0, depth, 8):
        w = _word(text, starts[order] + d)
        if depth - d < 8:
            w &= np.uint64((~0 << 8 * (8 - depth + d)) & (2**64 - 1))
        inner = np.lexsort((w, group))
        order, w, group = order[inner], w[inner], group[inner]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (group[1:] != group[:-1])))
        # groups are named by the place of their first member in the whole order
        first = np.flatnonzero(new)
        group = place[first][np.cumsum(new) - 1]
        out[place], tags[place] = order, group
        sizes = np.diff(np.append(first, len(order)))
        keep = np.repeat(sizes > 1, sizes)
        order, group, place = order[keep], group[keep], place[keep]
        if not len(order):
            break
    return (out, tags) if singles else (order, group)


class _Sample:
    """The cover sample of a text: the places whose residue is in the cover, in the order of their first LENGTH bytes, and
    how many bytes neighbours in that order share, so that they can be compared by any fewer bytes too."""

    def __init__(self, text: np.ndarray, places: np.ndarray) -> None:
        order, _ = _refined(text, places, LENGTH, True)
        at = places[order]
        self.slot = np.zeros(len(text), np.int32)
        self.slot[at] = np.arange(len(at))
        shared = np.full(len(at), LENGTH, np.int64)
        shared[:1] = 0
        open_ = np.arange(1, len(at))
        for d in range(0, LENGTH, 8):
            if not len(open_):
                break
            x = _word(text, at[open_] + d) ^ _word(text, at[open_ - 1] + d)
            differ = x != 0
            byte = (x[differ].astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
            shared[open_[differ]] = np.minimum(LENGTH, d + byte)
            open_ = open_[~differ]
        self.shared = shared
        self.by_shift: dict[int, np.ndarray] = {}

    def ranks(self, places: np.ndarray, shift: int) -> np.ndarray:
        """Ranks of the suffixes ``shift`` bytes after ``places`` by their first LENGTH - shift bytes, ties alike."""
        if shift not in self.by_shift:
            self.by_shift[shift] = np.cumsum(self.shared < LENGTH - shift)
        return self.by_shift[shift][self.slot[places + shift]]


def block_order(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of the suffixes at ``starts`` those that share their first PERIOD bytes with another, in the order of their first
    LENGTH bytes. Such a tie between places i and j is resolved by the ranks of i + d and j + d in the cover sample, where
    d < PERIOD brings both into it. ``text`` has LENGTH + 2 * PERIOD bytes after the last window."""
    order, group = _refined(text, starts, PERIOD, False)
    if not len(order):
        return order
    tied = starts[order]
    near = np.zeros(len(text), bool)
    for d in range(PERIOD):
        near[tied + d] = True
    places = np.flatnonzero(near)
    sample = _Sample(text, places[_IN_COVER[places % PERIOD]])
    residue = tied % PERIOD
    # every residue by itself, then each one's members counted among those of each other
    lists, keys = [], group.astype(np.int64) << 32
    for a in range(PERIOD):
        own = np.flatnonzero(residue == a)
        d = int(_SHIFT[a, a])
        lists.append(own[np.argsort(keys[own] | sample.ranks(tied[own], d), kind="stable")])
    position = np.zeros(len(tied), np.int64)
    for a in range(PERIOD):
        position[lists[a]] += np.arange(len(lists[a]))
        for b in range(a + 1, PERIOD):
            one, two = lists[a], lists[b]
            if len(one) and len(two):
                d = int(_SHIFT[a, b])
                x, y = (keys[z] | sample.ranks(tied[z], d) for z in (one, two))
                position[one] += np.searchsorted(y, x, "left")
                position[two] += np.searchsorted(x, y, "right")
    out = np.empty_like(order)
    out[position] = order
    return out


def repeated_windows(heads: np.ndarray, data: bytes) -> np.ndarray:
    """Runs of windows of one block that are repeated. ``heads``: k, h, start, n, at of each stretch. Of equal
    stretches the earliest is sorted; the windows of the others are repeated whole."""
    sizes = heads["n"].astype(np.int64) + LENGTH - 1
    ends = np.cumsum(sizes).tolist()
    seen: dict[bytes, int] = {}
    chosen, whole = [], []
    order = np.lexsort((heads["start"], heads["h"], heads["k"])).tolist()
    bodies = [data[e - n : e] for e, n in zip(ends, sizes.tolist())]
    for i in order:
        first = seen.setdefault(bodies[i], i)
        if first == i:
            chosen.append(i)
        elif heads[first] != heads[i]:
            whole.append(i)
    if len(chosen) < len(heads):
        equal = heads[whole][["k", "h", "start", "n"]].astype(_RUN)
        return np.concatenate((equal, _sorted_windows(heads[chosen], b"".join([bodies[i] for i in chosen]))))
    return _sorted_windows(heads, data)


def _sorted_windows(heads: np.ndarray, data: bytes) -> np.ndarray:
    sizes = heads["n"].astype(np.int64) + LENGTH - 1
    ends = np.cumsum(sizes)
    room = sizes + 8
    place = np.cumsum(room) - room
    text = np.zeros(int(room.sum()) + LENGTH + 4 * PERIOD + 16, np.uint8)
    raw = np.frombuffer(data, np.uint8)
    inner = np.arange(len(raw)) - np.repeat(ends - sizes, sizes)
    text[np.repeat(place, sizes) + inner] = raw
    n = heads["n"].astype(np.int64)
    stretch = np.repeat(np.arange(len(heads)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    starts = place[stretch] + offset
    order = block_order(text, starts)
    if not len(order):
        return np.zeros(0, _RUN)
    equal = np.ones(len(order) - 1, bool)
    for d in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        w = _word(text, starts[order] + d)
        equal &= w[1:] == w[:-1]
    group = np.concatenate(([0], np.cumsum(~equal)))
    # one number for each window that sorts like (document, place)
    by = np.lexsort((heads["h"], heads["k"]))
    k, h = heads["k"][by], heads["h"][by]
    step = np.concatenate(([True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])))
    rank = np.zeros(len(heads), np.int64)
    rank[by] = np.cumsum(step) - 1
    where = (rank[stretch[order]] << 32) | (heads["start"][stretch[order]].astype(np.int64) + offset[order])
    least = np.minimum.reduceat(where, np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))))
    late = np.sort(where[where != least[group]])
    if not len(late):
        return np.zeros(0, _RUN)
    new = np.flatnonzero(np.concatenate(([True], late[1:] > late[:-1] + 1)))
    last = np.append(new[1:], len(late)) - 1
    out = np.zeros(len(new), _RUN)
    out["k"], out["h"] = k[step][late[new] >> 32], h[step][late[new] >> 32]
    out["start"], out["n"] = late[new] & 0xFFFFFFFF, late[last] - late[new] + 1
    return out


def _sorted_buckets(stretches: DataFrame, buckets: int) -> DataFrame:
    """k, h, runs: the repeated windows of each document as bytes of (start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype([*_RUN.descr, ("at", "<u4")])
        for bucket in groups(batches):
            runs = [np.frombuffer(r, _RUN) for r in bucket.column("runs").to_pylist() if r]
            heads = np.frombuffer(b"".join(bucket.column("heads").to_pylist()), kind)
            if len(heads):
                runs += list(_blocks(heads, b"".join(bucket.column("data").to_pylist())))
            if runs:
                yield _dealt(np.concatenate(runs), buckets)

    return _by_document(by_group(stretches, "bucket").mapInArrow(lean(run), "to int, runs binary"))


def _blocks(heads: np.ndarray, data: bytes) -> Iterator[np.ndarray]:
    """A bucket in blocks of about BLOCK bytes; windows of one anchor stay in one block."""
    sizes = heads["n"].astype(np.int64) + LENGTH - 1
    starts = np.cumsum(sizes) - sizes
    # equal anchors have equal GRAM bytes: deal by their hash
    raw = np.frombuffer(data, np.uint8)
    blocks = max(1, int(sizes.sum()) // BLOCK)
    if blocks == 1:
        yield repeated_windows(heads, data)
        return
    at = starts + heads["at"]
    code = np.zeros(len(heads), np.uint64)
    for d in range(0, GRAM, 8):
        code = (code ^ _word(raw, at + d)) * np.uint64(0xD6E8FEB86659FD93)
        code ^= code >> np.uint64(31)
    part = (code >> np.uint64(20)) % np.uint64(blocks)
    order = np.argsort(part, kind="stable")
    cuts = np.searchsorted(part[order], np.arange(blocks + 1, dtype=np.uint64))
    for a, b in zip(cuts, cuts[1:]):
        own = order[a:b]
        if len(own):
            yield repeated_windows(heads[own], b"".join([data[starts[i] : starts[i] + sizes[i]] for i in own.tolist()]))


def _kept(text: bytes, blob: bytes) -> tuple[int, int, list[tuple[int, int]]]:
    """Removed byte ranges of a text."""
    pairs = np.frombuffer(blob, np.uint32).reshape(-1, 2).astype(np.int64)
    if not len(pairs):
        return 0, 0, []
    a, b = pairs[:, 0], pairs[:, 0] + pairs[:, 1] + LENGTH - 1
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(np.concatenate(([True], a[1:] > b[:-1])))
    ends = b[np.append(new[1:], len(a)) - 1]
    return int((ends - a[new]).sum()), len(new), list(zip(a[new].tolist(), ends.tolist()))


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents keyed by k, h with their text as ``text``, and their repeated windows: k, h, runs.

    A row without id comes before all others. Rows of one id are told apart, and ordered, by their text's hash;
    wholly equal rows count as one document."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("k"), F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    again = materialize(docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LEAST)).alias("k")).count().where("count > 1").select("k", F.lit(True).alias("again")), "repeated")
    if again.limit(1).count():
        rows = rows.join(again, "k", "left").withColumn("h", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0).cast("long"))).drop("again")
    else:
        rows = rows.withColumn("h", F.lit(0).cast("long"))
    rows = rows.select("k", "h", "doc_id", "text")
    buckets = buckets_for(docs)
    twice = materialize(_repeated(_anchor_hashes(rows.select("k", "h", "text"), buckets), buckets), "anchors")
    found = rows.select("k", "h", "text").join(twice, ["k", "h"])
    runs = materialize(_sorted_buckets(_stretches(found, buckets), buckets), "runs")
    return rows, runs


def _with_ranges(docs: DataFrame, kind: str, make) -> DataFrame:
    rows, runs = repeated_ranges(docs)
    met = rows.join(runs, ["k", "h"], "left").select("doc_id", "text", "runs")
    names = [c.split()[0] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            made = [make(t, *_kept(t, r or b"")) for t, r in zip(texts, batch.column(2).to_pylist())]
            columns = list(zip(*made)) if made else [()] * (len(names) - 1)
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, types[k.split()[1]]) for c, k in zip(columns, kind.split(", ")[1:]))], names)

    return met.mapInArrow(lean(run), kind)


def _rest(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in ranges:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, kept (the bytes that stay) for each row of ``docs``; odd rows as in ``report``."""
    return _with_ranges(docs, "doc_id long, kept binary", lambda t, n, k, r: (_rest(t, r),))


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256. Null and empty texts, and
    texts under LENGTH bytes, lose nothing; very long texts are searched in pieces that overlap; rows without id come
    first, and rows that repeat one another are one document; other columns are ignored; an empty table gives an empty
    result."""
    return _with_ranges(docs, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", lambda t, n, k, r: (len(t), n, k, hashlib.sha256(_rest(t, r)).hexdigest()))
