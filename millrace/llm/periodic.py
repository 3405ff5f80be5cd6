"""Periodic runs of words inside documents, by block matching.

A run is a stretch of words with smallest period q, at least max(LEAST, 4 q) words long, that cannot be made longer. For
each power of two B the words are cut into aligned blocks of B; an automaton over the blocks' word numbers finds every
occurrence of a block in the document. A run of period q, B <= q < 2 B, holds two neighbouring blocks that both occur again q
words further on, so pairs of occurrences at distances from B to 2 B - 1 are the only seeds; each is extended in both
directions, word by word. Seeds inside a run of a smaller period cannot have their distance as the smallest period
and are left out, which bounds the extensions of one scale by a multiple of the document's length.

Before it, four-word strings that do not come again within 2 B words drop stretches that no run of that scale can touch;
they decide nothing. No rows move: a document is searched where it is read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, lean, text_or_empty

#: Words of the shortest run, and how often its period fits in at least.
LEAST, TIMES = 6, 4
#: Strings of so many words decide which stretches are searched; a run of LEAST words holds three of them.
GRAM = 4


def words(text: bytes) -> pa.Array:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text."""
    raw = np.frombuffer(text, np.uint8)
    inside = (raw != 0x20) & ((raw < 0x09) | (raw > 0x0D))
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    ends = np.concatenate(([0], np.cumsum(edges[1::2] - edges[::2])))
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw[inside]))


def _numbers(of: pa.Array) -> np.ndarray:
    """A number for each word, equal for equal words."""
    return of.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _recurrence(numbers: np.ndarray) -> np.ndarray:
    """For each string of GRAM words the distance to its nearest other occurrence, the document's length if there is none."""
    m = len(numbers) - GRAM + 1
    name = numbers[:m]
    for k in range(1, GRAM):  # exact names of ever longer strings
        name = np.unique(name * (len(numbers) + 1) + numbers[k : k + m], return_inverse=True)[1]
    order = np.argsort(name, kind="stable")
    same = name[order[1:]] == name[order[:-1]]
    gap = np.where(same, order[1:] - order[:-1], len(numbers))
    out = np.full(m, len(numbers))
    out[order[1:]] = gap
    out[order[:-1]] = np.minimum(out[order[:-1]], gap)
    return out


def _stretches(near: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of the stretches that runs of periods from ``block`` to 2 * block - 1 can lie in."""
    deep = np.zeros(len(near) + GRAM, np.int64)
    hits = np.flatnonzero(near < 2 * block)
    np.add.at(deep, hits, 1)
    np.add.at(deep, hits + GRAM, -1)
    edges = np.flatnonzero(np.diff(np.cumsum(deep[:-1]) > 0, prepend=False, append=False))
    for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
        if end - start >= max(LEAST, TIMES * block):
            yield start, end


def _occurrences(part: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The aligned blocks' classes, and the class of the block that begins at each word (-1: none)."""
    sequence = tuple(part.tolist())
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    classes: dict[tuple[int, ...], int] = {}
    own = np.empty(len(part) // block, np.int64)
    for j in range(len(own)):
        key = sequence[j * block : (j + 1) * block]
        own[j] = classes.setdefault(key, len(classes))
        if own[j] == len(classes) - 1:
            automaton.add_word(key, int(own[j]))
    automaton.make_automaton()
    found = np.full(len(part), -1, np.int64)
    for end, of in automaton.iter(sequence):
        found[end - block + 1] = of
    return own, found


def _seeds(part: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Where two neighbouring aligned blocks come again, and how far they are then: start of the second occurrence
    and distance, ``block`` <= distance < 2 * ``block``. One aligned start only lies at such a distance before a word."""
    own, found = _occurrences(part, block)
    at = np.arange(block, len(part))
    again = np.zeros(len(part) + block, bool)
    again[at] = found[at] == own[at // block - 1]
    at = at[again[at] & again[at + block]]
    return at, block + at % block


def _agreeing(left: np.ndarray, right: np.ndarray) -> int:
    """How many entries are equal before the first that is not."""
    n, step = min(len(left), len(right)), 64
    left, right, done = left[:n], right[:n], 0
    while done < n:
        differ = np.flatnonzero(left[done : done + step] != right[done : done + step])
        if len(differ):
            return done + int(differ[0])
        done, step = done + step, 2 * step
    return n


def _of_scale(part: np.ndarray, block: int, known: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs (start, length, period) with periods of one scale. ``known[i]``: the furthest end of the runs of smaller
    periods that begin at or before the word i."""
    at, distance = _seeds(part, block)
    fresh = known[at - distance] < at + 2 * block
    at, distance = at[fresh], distance[fresh]
    order = np.lexsort((at, distance))
    at, distance = at[order], distance[order]
    first = np.flatnonzero(np.concatenate(([True], (np.diff(distance) != 0) | (np.diff(at) != block)))) if len(at) else at
    last = np.concatenate((first[1:], [len(at)])) - 1
    for a, z in zip(first.tolist(), last.tolist() if len(at) else ()):
        d = int(distance[a])
        low, high = int(at[a]) - d, int(at[z]) + 2 * block
        low -= _agreeing(part[:low][::-1], part[: low + d][::-1])
        high += _agreeing(part[high:], part[high - d :])
        if high - low >= max(LEAST, TIMES * d):
            yield low, high - low, d


def runs(numbers: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a sequence of whole numbers, sorted."""
    if len(numbers) < LEAST:
        return []
    near = _recurrence(numbers)
    out: list[tuple[int, int, int]] = []
    block = 1
    while max(LEAST, TIMES * block) <= len(numbers):
        ends = np.zeros(len(numbers), np.int64)
        for start, length, _ in out:
            ends[start] = max(ends[start], start + length)
        ends = np.maximum.accumulate(ends)
        for start, end in list(_stretches(near, block)):
            out += [(start + a, length, q) for a, length, q in _of_scale(numbers[start:end], block, ends[start:end] - start)]
        block *= 2
    return sorted(out)


def collapsed(of: pa.Array, found: list[tuple[int, int, int]]) -> bytes:
    """The words that stay when each run keeps its first period, joined by one space."""
    depth = np.zeros(len(of) + 1, np.int64)
    for start, length, q in found:
        depth[start + q] += 1
        depth[start + length] -= 1
    kept = of.filter(pa.array(np.cumsum(depth[:-1]) == 0)) if found else of
    lists = pa.ListArray.from_arrays(pa.array([0, len(kept)], pa.int32()), kept)
    return pc.binary_join(lists, " ")[0].as_buffer().to_pybytes()


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, runs (array of start, length, period in words, by start, then
    period), collapsed (the text with each run cut to its first period, one space between words).

    A null or blank text has no runs and collapses to the empty text; very long texts are searched whole, in memory in
    proportion to their words; repeated rows and rows without id are rows like others; an empty table gives an
    empty result; other columns are ignored."""
    kind = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def each(batches: Batches) -> Batches:
        for batch in batches:
            all_runs, texts = [], []
            for text in batch.column(1):
                of = words(text.as_buffer())
                found = runs(_numbers(of))
                all_runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                texts.append(collapsed(of, found))
            shown = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(all_runs, run_type), shown], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(lean(each), kind)


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: with h = crc32(decimal doc_id) and g = floor(h / 10), a text of n > 0 words with h % 10 = 0 repeats, from its
    word a = g % n on, the words a to a + p - 1, p = 1 + floor((n - a) / (3 + g % 8)). Rows without id stay as they are."""

    def each(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                g, rest = divmod(zlib.crc32(str(i).encode()), 10)
                raw = text.as_buffer()
                if i is not None and not rest and len(of := words(raw)):
                    a = g % len(of)
                    p = 1 + (len(of) - a) // (3 + g % 8)
                    places = np.arange(len(of))
                    places[a:] = a + (places[a:] - a) % p
                    raw = collapsed(of.take(pa.array(places)), [])
                out.append(raw.to_pybytes() if isinstance(raw, pa.Buffer) else raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()).cast(pa.string())], ["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(lean(each), "doc_id long, text string")


def _listed(r: Column) -> Column:
    return F.concat_ws(",", r["start"], r["length"], r["period"])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli of the longest run (ties: smallest start, then period;
    nulls without one), runs_sha256, collapsed_sha256, of the ``planted`` texts."""
    found = periodic_runs(planted(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(_listed(r), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select(
        "doc_id",
        "n_runs",
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        "runs_sha256",
        "collapsed_sha256",
    )
