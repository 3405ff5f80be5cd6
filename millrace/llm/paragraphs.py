"""Substring deduplication by paragraph MinHash banding.

Units are the lines of a text; inside lines of several sentences, groups of sentences that end where the content says;
and inside lines windows of WINDOW words, of each GAP neighbouring ones that of least hash. So a passage set into other
text has the same windows there: a shared run of WINDOW + GAP - 1 words or more loses all but at most GAP - 1 words at
either end. Units of at least MIN_WORDS words take part. Equal units meet by hash. Lines are near copies at a Jaccard similarity of at least THRESHOLD of their five-word shingles: bands of
minima find candidates, shingle sets verify them exactly. Components are clusters; of each the earliest place stays.

The band count follows from the rows of a band and the recall wanted at the threshold. A band bucket is searched from
one unit to those not yet reached, which finds its components without listing all pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import links as bucket_edges
from .common import buckets_for, by_group, groups, lean, materialize
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
MIN_WORDS = 12
#: A document belongs to the class of the document it repeats if at least this share of its text repeats.
CLASS_SHARE = 0.5
BAND_ROWS = 3
RECALL = 0.985
WINDOW, GAP = 20, 8
#: Keys of rows without an id of their own lie at or below this.
_ODD = -(2**62)
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]*[^\S\n]*|[.!?]+[^\S\n]*|\n")


def band_count(threshold: float = THRESHOLD, rows: int = BAND_ROWS, recall: float = RECALL) -> int:
    """Bands so that a pair at the threshold shares one with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


BANDS = band_count()
_rng = np.random.default_rng(20)
_MULTIPLY = _rng.integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
_LOWER = np.array([ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x20000)], np.uint64)
_P = 0x9E3779B97F4A7C15
_WEIGHTS = _rng.integers(0, 2**63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []
#: The hash of each character in lower case, made once in a worker.
_signs: list[np.ndarray] = []


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the windows inside lines."""
    none = np.array([], np.int64), np.array([], np.int64), np.array([], np.uint64)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (codes < 0x3001) & _SPACE[np.minimum(codes, 0x3000)]
    turn = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    starts, ends = turn[::2], turn[1::2]
    if len(starts) < WINDOW + GAP - 1:
        return none
    n = len(codes)
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, x, np.uint64))), dtype=np.uint64) for x in (_P, pow(_P, -1, 1 << 64))]
    if not len(_signs):
        _signs.append(_mixed((_LOWER + np.uint64(1)) * np.uint64(_P)))
    if codes.max() < 0x20000:
        signs = _signs[0][codes]
    else:
        low = np.where(codes < 0x20000, _LOWER[np.minimum(codes, 0x1FFFF)], codes)
        signs = _mixed((low + np.uint64(1)) * np.uint64(_P))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(signs * _powers[0][:n], out=sums[1:])
    word = _mixed((sums[ends] - sums[starts]) * _powers[1][starts])
    at = len(word) - WINDOW + 1
    hashes = np.zeros(at, np.uint64)
    for j, weight in enumerate(_WEIGHTS):
        hashes += word[j : j + at] * weight
    hashes = _mixed(hashes)
    line = np.searchsorted(np.flatnonzero(codes == 10), starts)
    whole = np.flatnonzero(line[:at] == line[WINDOW - 1 :])
    if len(whole) < GAP:
        return none
    # the first of the least of each GAP neighbours, by spans that double
    value, least, span = hashes[whole], np.arange(len(whole)), 1
    while span < GAP:
        step = min(span, GAP - span)
        later = value[step:] < value[:-step]
        value, least, span = np.where(later, value[step:], value[:-step]), np.where(later, least[step:], least[:-step]), span + step
    taken = whole[np.unique(least[line[whole[: len(least)]] == line[whole[GAP - 1 :]]])]
    return starts[taken], ends[taken + WINDOW - 1], hashes[taken]


def units(text: str) -> tuple[list[tuple[int, int]], int]:
    """Offsets of the lines, of the sentence groups of lines that have several, of the windows; the number of lines."""
    found, n = _lines_and_groups(text)
    starts, ends, _ = windows(text)
    return found + list(zip(starts.tolist(), ends.tolist())), n


def _lines_and_groups(text: str) -> tuple[list[tuple[int, int]], int]:
    lines, groups, at = [], [], 0
    for line in text.split("\n"):
        end = at + len(line)
        lines.append((at, end))
        if len(line) > 60:
            cuts, start = [], at
            for m in _SENTENCE.finditer(text, at, end):
                if zlib.crc32(m.group().strip().encode("utf-8", "surrogatepass")) & 1:
                    cuts.append((start, m.end()))
                    start = m.end()
            if start < end:
                cuts.append((start, end))
            if len(cuts) > 1:
                groups += cuts
        at = end + 1
    return lines + groups, len(lines)


def words(part: str) -> list[str]:
    return part.lower().split()


def unit_hash(w: list[str]) -> int:
    h = xxhash.xxh64_intdigest(" ".join(w).encode("utf-8", "surrogatepass"), 5)
    return h - (1 << 64) if h >> 63 else h


_words_seen: dict[str, int] = {}


def _word_hash(word: str) -> int:
    """Hash of a word; frequent ones are looked up."""
    h = _words_seen.get(word)
    if h is None:
        if len(_words_seen) >= 1 << 17:
            _words_seen.clear()
        h = _words_seen[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
    return h


def _combined(h: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hash of each ``n`` neighbouring words, their order included."""
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = _mixed((out + h[i : i + m]) * np.uint64(_P))
    return out


def shingles(w: list[str], n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; one of all words where there are fewer."""
    h = np.fromiter(map(_word_hash, w), np.uint64, len(w))
    return np.unique(_combined(h, min(n, len(w)))) if w else np.zeros(1, np.uint64)


def _keys_of_minima(minima: np.ndarray) -> np.ndarray:
    """A key for each band from minima (band, row, ...)."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64).reshape(-1, *(1,) * (minima.ndim - 2)) * np.ones(minima.shape[2:], np.uint64)
    for r in range(BAND_ROWS):
        key = (key ^ minima[:, r]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key


def band_keys(sh: np.ndarray) -> np.ndarray:
    return _keys_of_minima((sh * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1).reshape(BANDS, BAND_ROWS))


def line_band_keys(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Band keys (line, band) of lines of at least SHINGLE words each, from the hashes of their words one after the other."""
    ends = np.cumsum(lengths)
    sh = _combined(hashes)
    inside = np.ones(len(hashes), bool)  # a shingle may not run over the end of its line
    for k in range(1, SHINGLE):
        inside[ends - k] = False
    sh = sh[inside[: len(sh)]]
    starts = np.concatenate(([0], np.cumsum(lengths - SHINGLE + 1)[:-1]))
    minima = np.stack([np.minimum.reduceat(sh * m + a, starts) for m, a in zip(_MULTIPLY, _ADD)])
    return _keys_of_minima(minima.reshape(BANDS, BAND_ROWS, -1)).T


def _unit_table(docs: DataFrame) -> DataFrame:
    """k, doc_id, lines, starts, ends, hashes: the lines and groups of each document; null hashes do not take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, ends, hashes, lines = [], [], [], []
            for text in batch.column(2).to_pylist():
                text = text or ""
                found, n = _lines_and_groups(text)
                lines.append(n)
                starts.append([a for a, _ in found])
                ends.append([b for _, b in found])
                hashes.append([unit_hash(w) if len(w := words(text[a:b])) >= MIN_WORDS else None for a, b in found])
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(lines, pa.int32()), *(pa.array(c, t) for c, t in zip((starts, ends, hashes), kinds))], ["k", "doc_id", "lines", "starts", "ends", "hashes"])

    return docs.mapInArrow(lean(run), "k long, doc_id long, lines int, starts array<int>, ends array<int>, hashes array<long>")


#: A window's place is a number above all ordinals of lines and groups: mark, start, length.
_MARK, _LENGTH_BITS = 1 << 61, 28


def _span(starts: list[int], ends: list[int], place: int) -> tuple[int, int] | None:
    if place < _MARK:
        return (starts[place], ends[place]) if place < len(starts) else None
    start = (place - _MARK) >> _LENGTH_BITS
    return start, start + (place & ((1 << _LENGTH_BITS) - 1))


def _repeated_windows(docs: DataFrame, buckets: int) -> DataFrame:
    """k, ord, unit: the places of windows that occur more than once."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, places, units = [], [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                starts, ends, hashes = windows(text or "")
                if len(hashes):
                    ks.append(np.full(len(hashes), k, np.int64))
                    places.append(_MARK + (starts.astype(np.int64) << _LENGTH_BITS) + (ends - starts))
                    units.append(hashes)
            if not ks:
                continue
            columns = [np.concatenate(x) for x in (units, ks, places)]
            part = (columns[0] >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cuts))
            blobs = [[x[order[cuts[i] : cuts[i + 1]]].tobytes() for i in used] for x in columns]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], ["bucket", "units", "ks", "places"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches):
            unit, k, place = (np.frombuffer(b"".join(bucket.column(c).to_pylist()), np.int64) for c in ("units", "ks", "places"))
            order = np.argsort(unit, kind="stable")
            same = unit[order][1:] == unit[order][:-1]
            order = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))]
            for i in range(0, len(order), 1 << 17):
                yield pa.RecordBatch.from_arrays([pa.array(x[order[i : i + (1 << 17)]]) for x in (k, place, unit)], ["k", "ord", "unit"])

    dealt = docs.mapInArrow(lean(deal), "bucket int, units binary, ks binary, places binary")
    return by_group(dealt, "bucket").mapInArrow(lean(meet), "k long, ord long, unit long")


def _colliding(docs: DataFrame, buckets: int) -> DataFrame:
    """key, unit: the band keys under which different lines lie."""

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[int, int] = {}
            hashes = array("Q")
            for text in batch.column(2).to_pylist():
                for line in (text or "").split("\n"):
                    w = words(line)
                    if len(w) >= MIN_WORDS and (u := unit_hash(w)) not in seen:
                        seen[u] = len(w)
                        hashes.extend(map(_word_hash, w))
            if not seen:
                continue
            keys = line_band_keys(np.frombuffer(hashes, np.uint64), np.fromiter(seen.values(), np.int64, len(seen))).ravel()
            own = np.repeat(np.fromiter(seen, np.int64, len(seen)), BANDS)
            part = (keys >> np.uint64(33)) % np.uint64(buckets)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(buckets + 1, dtype=np.uint64))
            used = np.flatnonzero(np.diff(cuts))
            blobs = [[x[order[cuts[i] : cuts[i + 1]]].tobytes() for i in used] for x in (keys, own)]
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], ["bucket", "keys", "units"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in groups(batches):
            key = np.frombuffer(b"".join(bucket.column("keys").to_pylist()), np.uint64)
            unit = np.frombuffer(b"".join(bucket.column("units").to_pylist()), np.int64)
            order = np.lexsort((unit, key))
            key, unit = key[order], unit[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])))
            key, unit = key[new], unit[new]
            same = key[1:] == key[:-1]
            keep = np.concatenate(([False], same)) | np.concatenate((same, [False]))
            yield pa.RecordBatch.from_arrays([pa.array(key[keep].view(np.int64)), pa.array(unit[keep])], ["key", "unit"])

    dealt = docs.mapInArrow(lean(bands), "bucket int, keys binary, units binary")
    return by_group(dealt, "bucket").mapInArrow(lean(meet), "key long, unit long")


def _links(docs: DataFrame, table: DataFrame, buckets: int) -> DataFrame:
    """src, dst: near copies among different lines, up to connectivity."""
    met = materialize(_colliding(docs, buckets), "bands")
    asked = met.select("unit").distinct()
    places = table.select("k", F.explode(F.slice("hashes", F.lit(1), F.col("lines"))).alias("unit")).groupBy("unit").agg(F.min("k").alias("k"))
    by_doc = places.join(asked, "unit").groupBy("k").agg(F.collect_set("unit").alias("units"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[int, bytes] = {}
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                left = set(wanted)
                for line in (text or "").split("\n"):
                    w = words(line)
                    if len(w) >= MIN_WORDS and (u := unit_hash(w)) in left:
                        left.discard(u)
                        found[u] = shingles(w).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], ["unit", "sh"])

    known = docs.select("k", "text").join(by_doc, "k").select("text", "units").mapInArrow(lean(sets), "unit long, sh binary")
    known = materialize(known.withColumnRenamed("unit", "node"), "sets")
    return bucket_edges(met.withColumnRenamed("unit", "node"), known, THRESHOLD)


def _keyed(docs: DataFrame) -> DataFrame:
    """k, doc_id, text: k is the id where it is there and not repeated, else a number below all ids from the row's id and
    text; so such rows come before all others, and wholly equal rows are one document."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    again = materialize(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("again")), "repeated")
    odd = F.lit(_ODD) - F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 61) - 1))
    if again.limit(1).count():
        rows = rows.join(again, "doc_id", "left").withColumn("k", F.when(F.col("doc_id").isNull() | F.col("again"), odd).otherwise(F.col("doc_id")))
    else:
        rows = rows.withColumn("k", F.coalesce("doc_id", odd))
    return rows.select("k", "doc_id", "text")


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows keyed by k, the unit table, and k, removed, first, links: by document the places of units that repeat an
    earlier place, the smallest document that holds one of those places first, and how many such documents there are."""
    rows = _keyed(docs)
    buckets = buckets_for(docs)
    table = materialize(_unit_table(rows), "units")
    stars = components(_links(rows, table, buckets))
    places = table.select("k", F.posexplode("hashes").alias("ord", "unit")).where("unit is not null").withColumn("ord", F.col("ord").cast("long"))
    places = places.unionByName(materialize(_repeated_windows(rows, buckets), "windows"))
    # the earliest place of each unit, then of each cluster; only units with another place or another text go on
    first = places.groupBy("unit").agg(F.min("k").alias("k"), F.count("*").alias("n"))
    root = first.join(stars.withColumnRenamed("node", "unit"), "unit", "left").where("n > 1 or root is not null")
    root = materialize(root.select("unit", "k", F.coalesce("root", "unit").alias("root")), "roots")
    lead = root.groupBy("root").agg(F.min("k").alias("first"))
    of_unit = root.join(lead, "root").select("unit", "root", "first")
    repeated = materialize(places.join(of_unit, "unit"), "repeated")
    own = repeated.where("k = first").groupBy("root").agg(F.min("ord").alias("keep"))
    gone = repeated.where("k <> first").select("k", "ord", "first")
    later = repeated.where("k = first").join(own, "root").where("ord <> keep").select("k", "ord", "first")
    gone = gone.unionByName(later).groupBy("k").agg(F.sort_array(F.collect_set("ord")).alias("removed"), F.min("first").alias("first"), F.count_distinct(F.when(F.col("first") != F.col("k"), F.col("first"))).alias("links"))
    return rows, table, gone


def _union(starts: list[int], ends: list[int], removed: list[int]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(s for i in removed if (s := _span(starts, ends, i))):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_lines, n_removed (code points), n_spans, removed_spans (start:end,
    comma-joined), n_links (documents that hold what it repeats first), class_id: the smallest of them where at least
    CLASS_SHARE of its text repeats, else its own id.

    Null and empty texts and short lines lose nothing; very long texts are cut into units like any other. Rows without id,
    or whose id is repeated with other texts, come before all others; wholly equal rows count as one document. Other
    columns are ignored; an empty table gives an empty result."""
    _, table, gone = removals(docs)
    met = table.join(gone, "k", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, starts, ends, removed, first, links = (batch.column(c).to_pylist() for c in ("doc_id", "lines", "starts", "ends", "removed", "first", "links"))
            spans = [_union(a, b, r) if r else [] for a, b, r in zip(starts, ends, removed)]
            lost = [sum(b - a for a, b in s) for s in spans]
            length = [e[n - 1] if n else 0 for e, n in zip(ends, lines)]
            own = [i if f is None or f <= _ODD or i is None or m < CLASS_SHARE * n else min(i, f) for i, f, m, n in zip(ids, first, lost, length)]
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(lines, pa.int64()),
                pa.array(lost, pa.int64()),
                pa.array([len(s) for s in spans], pa.int64()),
                pa.array([",".join(f"{a}:{b}" for a, b in s) for s in spans], pa.string()),
                pa.array([n or 0 for n in links], pa.int64()),
                pa.array(own, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_lines", "n_removed", "n_spans", "removed_spans", "n_links", "class_id"])

    kind = "doc_id long, n_lines long, n_removed long, n_spans long, removed_spans string, n_links long, class_id long"
    return met.select("doc_id", "lines", "starts", "ends", "removed", "first", "links").mapInArrow(lean(run), kind)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, text without its repeated passages, for each row of ``docs``; odd rows as in ``report``."""
    rows, _, gone = removals(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, removed in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text and removed:
                    found = _lines_and_groups(text)[0]
                    for a, b in reversed(_union([u[0] for u in found], [u[1] for u in found], removed)):
                        text = text[:a] + text[b:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return rows.join(gone, "k", "left").select("doc_id", "text", "removed").mapInArrow(lean(run), "doc_id long, text string")
