"""Chunking: blocks into chunks with exact overlaps, sentences, semantic breaks, sections, and back to text."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.providers import EmbeddingProvider
from ..functions.text import cosine_distance


@dataclass(frozen=True)
class ChunkOptions:
    size: int = 1000
    overlap: int = 200

    def __post_init__(self) -> None:
        object.__setattr__(self, "size", max(50, self.size))
        object.__setattr__(self, "overlap", max(0, min(self.overlap, self.size - 1)))

    @classmethod
    def for_job(cls, size: int | None = None, overlap: int | None = None) -> ChunkOptions:
        size = max(200, 1000 if size is None else size)
        return cls(size, max(0, min(200 if overlap is None else overlap, size // 2)))


#: The overlap of a part that goes on where the one before ended, without repeating anything.
CONTINUES = -1
#: Shortest repetition that counts as an overlap where none was recorded.
LEGACY_OVERLAP = 20
_TRIMMED = "".join(map(chr, range(33)))


@dataclass(frozen=True)
class Part:
    """A piece of text; ``overlap`` characters at its start repeat the end of the piece before. CONTINUES: it goes on after
    white space, 0: a new beginning, None: not recorded."""

    text: str
    overlap: int | None


def _windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``size`` characters; each ends at the last blank of its second half, where there is one, and the
    next begins ``overlap`` characters before that end."""
    start = 0
    while start < len(text):
        end = min(len(text), start + size)
        if end < len(text):
            blank = max(text.rfind(c, start, end + 1) for c in " \n")
            end = blank if blank > start + size // 2 else end
        yield start, end
        if end == len(text):
            return
        start = max(start + 1, end - overlap)


def prose_parts(text: str, size: int, overlap: int) -> list[Part]:
    """Trimmed windows, each with the stretch of the text that it shares with the one before."""
    spans = []
    for a, b in _windows(text, size, overlap):
        piece = text[a:b]
        left = len(piece) - len(piece.lstrip(_TRIMMED))
        span = a + left, a + left + len(piece.strip(_TRIMMED))
        if text[slice(*span)].strip():
            spans.append(span)
    parts = [Part(text[a:b], 0) for a, b in spans[:1]]
    for (p, q), (a, b) in pairwise(spans):
        shared = q - a if p <= a < q <= b else 0
        parts.append(Part(text[a:b], shared or CONTINUES))
    return parts


def _repeated(before: str, part: Part) -> int:
    """How many characters at the start of a part repeat the end of the text before it."""
    text, k = part.text, part.overlap
    if k is not None:
        return k if 0 < k <= len(text) and before.endswith(text[:k]) else 0
    head, first = text[:LEGACY_OVERLAP], max(0, len(before) - len(text))
    at = before.find(head, first) if len(head) == LEGACY_OVERLAP else -1
    while at >= 0:  # the first place from which the text runs to the end is the longest repetition
        if text.startswith(before[at:]):
            return len(before) - at
        at = before.find(head, at + 1)
    return 0


def join_parts(parts: list[Part]) -> str:
    """The text that was cut: repeated starts are left out, parts that go on follow a space, others a blank line."""
    out = parts[0].text if parts else ""
    for p in parts[1:]:
        if p.overlap is not None and p.overlap < 0:
            out += " " + p.text
        else:
            k = _repeated(out, p)
            out += p.text[k:] if k else "\n\n" + p.text
    return out


def code_lines(text: str, size: int) -> list[tuple[str, int, int]]:
    """Pieces of whole lines of at most ``size`` characters with first and last line number. A full piece ends after its
    last blank line where that lies past half of the size; longer lines are wrapped hard."""
    out: list[tuple[str, int, int]] = []
    held: list[tuple[int, str]] = []

    def release(count: int) -> None:
        rows = held[:count]
        del held[:count]
        while rows and not rows[0][1].strip():
            rows.pop(0)
        while rows and not rows[-1][1].strip():
            rows.pop()
        if rows:
            out.append(("\n".join(r for _, r in rows).rstrip(), rows[0][0], rows[-1][0]))

    for number, line in enumerate(text.split("\n"), 1):
        if len(line) > size:
            release(len(held))
            while len(line) > size:  # such a piece stays as it is, blanks included
                out.append((line[:size], number, number))
                line = line[size:]
        if held and sum(len(r) + 1 for _, r in held) + len(line) + 1 > size:
            blank = max((i + 1 for i, (_, r) in enumerate(held) if not r.strip()), default=0)
            release(blank if sum(len(r) + 1 for _, r in held[:blank]) > size // 2 else len(held))
        held.append((number, line))
    release(len(held))
    return out


def python_symbols(source: str) -> list[tuple[str, int, int]]:
    """Top declarations of Python source: dotted name, first and last line, comments above belonging to them."""
    lines = source.split("\n")
    out: list[tuple[str, int, int]] = []

    def visit(body, prefix: str, depth: int) -> None:
        for node in body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
                while first > 1 and lines[first - 2].lstrip().startswith("#"):
                    first -= 1
                out.append((prefix + node.name, first, node.end_lineno or first))
                if isinstance(node, ast.ClassDef) and depth < 6:
                    visit(node.body, f"{prefix}{node.name}.", depth + 1)

    visit(ast.parse(source).body, "", 1)
    return out


def code_chunks(path: str, source: str, options: ChunkOptions) -> list[tuple[str, str, int, int]]:
    """(symbol, text, first line, last line): by declaration for Python that parses, by lines otherwise."""
    if path.endswith(".py"):
        try:
            symbols = python_symbols(source)
        except (SyntaxError, ValueError, RecursionError):
            symbols = []
        lines = source.split("\n")
        out, at = [], 1
        for name, first, last in symbols:
            if first < at:
                continue
            if "\n".join(lines[at - 1 : first - 1]).strip():
                out.append(("", "\n".join(lines[at - 1 : first - 1]), at, first - 1))
            body = "\n".join(lines[first - 1 : last])
            inner = [s for s in symbols if s[0].startswith(name + ".")]
            if len(body) > options.size and inner:
                cuts = [first, *(s[1] for s in inner if s[0].count(".") == name.count(".") + 1), last + 1]
                out += [(name, "\n".join(lines[a - 1 : b - 1]), a, b - 1) for a, b in zip(cuts, cuts[1:]) if b > a]
            else:
                out.append((name, body, first, last))
            at = last + 1
        if symbols:
            if "\n".join(lines[at - 1 :]).strip():
                out.append(("", "\n".join(lines[at - 1 :]), at, len(lines)))
            return [(n, t, a + x - 1, a + y - 1) for n, body, a, _ in out for t, x, y in code_lines(body, options.size)]
    return [("", t, a, b) for t, a, b in code_lines(source, options.size)]


def rendered(block: dict) -> str:
    """A block as text; code stands between fences."""
    return f"```{block.get('language') or ''}\n{block['text']}\n```" if block["kind"] == "code" else block["text"]


def pack_blocks(blocks: list[dict], options: ChunkOptions) -> list[dict]:
    """Blocks (heading, kind, text, language) in order into chunks (heading, kind, language, text, overlap) of at most
    ``size`` characters. A chunk keeps to one heading; two characters stand between blocks; a block that is too long as
    it is shown is cut by itself; a chunk of code alone stays raw, in the language of its first block."""
    out: list[dict] = []
    runs: list[list[dict]] = []
    room = 0
    for b in blocks:
        if not b["text"].strip():
            continue
        n = len(rendered(b))
        last = runs[-1] if runs else None
        if n > options.size:
            runs.append([b])
            room = -1
        elif last and last[0]["heading"] == b["heading"] and room >= n + 2:
            last.append(b)
            room -= n + 2
        else:
            runs.append([b])
            room = options.size - n
    for run in runs:
        heading, code = run[0]["heading"], all(b["kind"] == "code" for b in run)
        base = {"heading": heading, "kind": "code" if code else "prose", "language": run[0].get("language") or "" if code else ""}
        if len(run) == 1 and len(rendered(run[0])) > options.size:
            cut = [(t, 0) for t, _, _ in code_lines(run[0]["text"], options.size)] if code else [(x.text, x.overlap) for x in prose_parts(run[0]["text"], options.size, options.overlap)]
            out += [base | {"text": t, "overlap": k} for t, k in cut]
        else:
            out.append(base | {"text": "\n\n".join(b["text"] if code else rendered(b) for b in run), "overlap": 0})
    return out


def chunk_documents(docs: DataFrame, key: str, text: str, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """key, ordinal, heading, kind, content, content_hash, overlap of plain-text documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, found in enumerate(batch.column(1).to_pylist()):
                packed = pack_blocks([{"heading": "", "kind": "prose", "text": p} for p in found or []], options)
                at += [i] * len(packed)
                rows += [(n, c["heading"], c["kind"], c["text"], c["overlap"]) for n, c in enumerate(packed)]
            columns = zip(*rows) if rows else [()] * 5
            kinds = (pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], [key, "ordinal", "heading", "kind", "content", "overlap"])

    kind = dict(docs.dtypes)[key]
    rows = docs.select(key, paragraphs(F.col(text)).alias("found")).mapInArrow(run, f"{key} {kind}, ordinal int, heading string, kind string, content string, overlap int")
    return rows.select(key, "ordinal", "heading", "kind", "content", F.sha2("content", 256).alias("content_hash"), "overlap")


def paragraphs(text: Column) -> Column:
    """Plain text as paragraphs: line ends made equal, lines trimmed at the right, cut at blank lines."""
    t = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[ \t]+\n", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.filter(F.transform(F.split(t, "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def derived_counts(text: Column) -> tuple[Column, Column]:
    """Characters, and tokens by the rule of four characters each."""
    return F.length(text), F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def contains_table(text: Column) -> Column:
    """Two lines in succession that hold cells."""
    lines = F.transform(F.split(text, "\n"), lambda x: x.contains(" | "))
    return F.exists(F.zip_with(lines, F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda a, b: F.coalesce(a, F.lit(False)) & F.coalesce(b, F.lit(False))), lambda x: x)


def display_content(kind: Column, language: Column, content: Column) -> Column:
    return F.when(kind == "code", F.concat(F.lit("```"), F.coalesce(language, F.lit("")), F.lit("\n"), content, F.lit("\n```"))).otherwise(content)


_SENTENCE_END = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+(?=[^\s])")


def split_sentences(text: str) -> list[tuple[str, bool]]:
    """Sentences, each with whether it begins a paragraph: a mark, white space, and what follows, inside paragraphs
    between blank lines."""
    out: list[tuple[str, bool]] = []
    for p in re.split(r"\n\s*\n", text):
        pieces = [s.strip() for s in _SENTENCE_END.split(p) if s and s.strip()]
        out += [(s, i == 0) for i, s in enumerate(pieces)]
    return out


def join_sentences(units: list[tuple[str, bool]]) -> str:
    return "".join(("" if i == 0 else "\n\n" if new else " ") + s for i, (s, new) in enumerate(units))


def neighbour_distances(rows: DataFrame, group: str, order: str, vector: str) -> DataFrame:
    """Each row with its cosine distance to the next of its group; the last has none."""
    nxt = F.lead(vector).over(Window.partitionBy(group).orderBy(order))
    return rows.withColumn("__next", nxt).withColumn("distance", F.when(F.col("__next").isNotNull(), cosine_distance(F.col(vector), F.col("__next")))).drop("__next")


def breakpoint_threshold(distance: Column, method: str, value: float) -> Column:
    """Aggregate: percentile with linear interpolation, mean plus value times population deviation, or third quartile
    plus value times the interquartile range."""
    if method == "percentile":
        return F.percentile(distance, value / 100.0)
    if method == "stddev":
        return F.avg(distance) + value * F.stddev_pop(distance)
    if method == "iqr":
        low, high = F.percentile(distance, 0.25), F.percentile(distance, 0.75)
        return high + value * (high - low)
    raise ValueError(f"unknown method {method}")


def semantic_groups(distances: DataFrame, group: str, order: str, method: str, value: float) -> DataFrame:
    """Rows with ``chunk``: a new one begins after a distance above the group's threshold."""
    limit = distances.groupBy(group).agg(breakpoint_threshold(F.col("distance"), method, value).alias("threshold"))
    line = Window.partitionBy(group).orderBy(order)
    rows = distances.join(limit, group).withColumn("brk", (F.col("distance") > F.col("threshold")).cast("int"))
    before = F.sum(F.coalesce("brk", F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("chunk", F.coalesce(before, F.lit(0))).drop("brk")


def fit_groups(lengths: list[int], distances: list[float], breaks: list[bool], size: int, least: int, gaps: list[int] | None = None) -> list[tuple[int, int]]:
    """Half-open ranges of sentences: breaks taken first; a range that is too long is cut at its largest inner
    distance, again and again; then, from the front, one that is shorter than ``least`` joins the neighbour across the
    smaller distance, or the other neighbour where that one is full. ``gaps``: the characters between a sentence and the one
    before, one if not given."""
    gaps = gaps or [1] * len(lengths)
    upto = np.concatenate(([0], np.cumsum([n + g for n, g in zip(lengths, gaps)]))).tolist()

    def total(a: int, b: int) -> int:
        return upto[b] - upto[a] - gaps[a]

    ends = [i + 1 for i, brk in enumerate(breaks) if brk] + [len(lengths)]
    waiting = [(a, b) for a, b in zip([0, *ends], ends) if b > a][::-1]
    groups: list[tuple[int, int]] = []
    while waiting:
        a, b = waiting.pop()
        if b - a < 2 or total(a, b) <= size:
            groups.append((a, b))
        else:
            at = max(range(a, b - 1), key=distances.__getitem__) + 1
            waiting += [(at, b), (a, at)]
    i = 0
    while i < len(groups):
        a, b = groups[i]
        sides = []
        if total(a, b) < least:
            sides = [(distances[groups[j][1] - 1], j) for j in (i - 1, i) if 0 <= j < len(groups) - 1]
        for _, j in sorted(sides, key=lambda s: s[0]):
            both = groups[j][0], groups[j + 1][1]
            if total(*both) <= size:
                groups[j : j + 2] = [both]
                i = max(0, j - 1) - 1  # what lies before was tried with the same neighbours
                break
        i += 1
    return groups


#: Sentences of a document beyond which it is packed by size, and distances that a threshold needs. Fixed values.
MOST_SENTENCES, LEAST_DISTANCES = 5000, 3


def _fitting_sentences(text: str, size: int) -> list[str]:
    """Sentences of one block; one that is longer than ``size`` is cut as long prose is."""
    return [p for s, _ in split_sentences(re.sub(r"\n\s*\n", "\n", text)) for p in ([s] if len(s) <= size else [x.text for x in prose_parts(s, size, 0)])]


def semantic_runs(blocks: DataFrame, document: str, size: int) -> DataFrame:
    """``blocks``: document, ordinal, heading, kind, text. Every sentence of the prose with its place: document, run, pos (in the
    document), sentence, begins (a paragraph). A run is a stretch of prose under one heading: it ends at other kinds of
    blocks and at another heading. Blank blocks are not there; a sentence longer than ``size`` is cut as long prose is."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(3).to_pylist()):
                pieces = _fitting_sentences(text, size)
                at += [i] * len(pieces)
                rows += [(k, p, k == 0) for k, p in enumerate(pieces)]
            columns = list(zip(*rows)) if rows else [()] * 3
            own = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.string(), pa.bool_())))], [document, "run", "ordinal", "k", "sentence", "begins"])

    kind = dict(blocks.dtypes)[document]
    prose = segments(blocks, document).where("kind = 'prose'").select(document, F.col("segment").alias("run"), F.col("ordinal").cast("int").alias("ordinal"), "text")
    rows = prose.mapInArrow(cut, f"{document} {kind}, run long, ordinal int, k int, sentence string, begins boolean")
    line = Window.partitionBy(document).orderBy("ordinal", "k")
    return rows.select(document, "run", (F.row_number().over(line) - 1).alias("pos"), "sentence", "begins")


def segments(blocks: DataFrame, document: str) -> DataFrame:
    """Blocks that are not blank, with the number of their segment: prose of one heading in succession, or other blocks in
    succession whatever their heading."""
    rows = blocks.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("heading", F.coalesce("heading", F.lit("")))
    line = Window.partitionBy(document).orderBy("ordinal")
    prose = F.col("kind") == "prose"
    mark = F.when(prose, F.concat(F.lit("prose:"), F.col("heading"))).otherwise("other")
    rows = rows.withColumn("__mark", mark)
    fresh = F.when(F.lag("__mark").over(line).eqNullSafe(F.col("__mark")), 0).otherwise(1)
    return rows.withColumn("__fresh", fresh).withColumn("segment", F.sum("__fresh").over(line)).drop("__mark", "__fresh")


def _pair_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine distance of each row of ``x`` to that of ``y``. Products are added one after the other, as ``cosine_distance``
    does, so both give the same bits."""
    dot = lambda p, q: np.cumsum(p * q, axis=1)[:, -1] if p.shape[1] else np.zeros(len(p))
    d = np.sqrt(dot(x, x)) * np.sqrt(dot(y, y))
    return np.maximum(0.0, 1 - np.divide(dot(x, y), d, out=np.zeros(len(d)), where=d != 0))


def _distances():
    """Cosine distance of two columns of vectors, null where either is, for batches of rows."""

    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.full(len(a), np.nan)
        sizes = [pc.fill_null(pc.list_value_length(x), -1).to_numpy(zero_copy_only=False) for x in (a, b)]
        there = (sizes[0] >= 0) & (sizes[1] >= 0)
        for w in np.unique(sizes[0][there]).tolist():
            at = np.flatnonzero(there & (sizes[0] == w) & (sizes[1] == w))
            x, y = (c.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), w) for c in (a, b))
            out[at] = _pair_distances(x, y)
        return pa.array(out, mask=~there)

    return distance


def _fallback() -> Column:
    """Why a document (sentences, bare, pairs) is packed by size alone."""
    return (
        F.when(F.col("sentences") > MOST_SENTENCES, "too_many_sentences")
        .when(F.col("sentences") < 2, "too_short")
        .when(F.col("bare") > 0, "error")
        .when(F.col("pairs") < LEAST_DISTANCES, "too_short")
    )


#: Documents that are held as Python objects at once, and sentences whose vectors are.
FOLDED, EMBEDDED = 100, 2000
_SAID = pa.list_(pa.struct([("run", pa.int64()), ("sentence", pa.string()), ("begins", pa.bool_()), ("distance", pa.float64())]))


def _said(provider: EmbeddingProvider, size: int):
    """Of documents as arrays of segments and of prose (null for other blocks): run, sentence, begins, distance to the next sentence
    of the run by the provider's vectors as floats. Vectors stay here."""

    def told(segments: list[list[int]], texts: list[list[str | None]]) -> pa.Array:
        rows = [(i, n, p, k == 0) for i, own in enumerate(zip(segments, texts)) for n, t in zip(*own) if t is not None for k, p in enumerate(_fitting_sentences(t, size))]
        apart = np.zeros(max(0, len(rows) - 1))
        for a in range(0, len(apart), EMBEDDED):
            v = np.array(provider.embed([r[2] for r in rows[a : a + EMBEDDED + 1]], False), np.float32).astype(float)
            apart[a : a + EMBEDDED] = _pair_distances(v[:-1], v[1:])
        out: list[list[tuple]] = [[] for _ in segments]
        for (i, n, p, begins), after, d in zip(rows, [*rows[1:], (None, None)], [*apart.tolist(), None]):
            out[i].append((n, p, begins, d if after[:2] == (i, n) else None))
        return pa.array(out, _SAID)

    @F.arrow_udf("array<struct<run:bigint,sentence:string,begins:boolean,distance:double>>")
    def said(segments: pa.Array, texts: pa.Array) -> pa.Array:
        parts = [told(segments.slice(a, FOLDED).to_pylist(), texts.slice(a, FOLDED).to_pylist()) for a in range(0, len(texts), FOLDED)]
        return pa.concat_arrays(parts) if parts else pa.array([], _SAID)

    return said


def listed_threshold(distances: Column, method: str, value: float) -> Column:
    """``breakpoint_threshold`` of an array of distances without nulls; null for an empty one."""
    line, n = F.array_sort(distances), F.size(distances)

    def percentile(p: float) -> Column:
        at = (n - 1) * F.lit(p)
        low, high = (F.get(line, f(at).cast("int")) for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    if method == "percentile":
        return percentile(value / 100.0)
    if method == "stddev":
        total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
        mean = total(distances) / F.nullif(n, F.lit(0))
        return mean + value * F.sqrt(total(F.transform(distances, lambda x: (x - mean) * (x - mean))) / F.nullif(n, F.lit(0)))
    if method == "iqr":
        return percentile(0.75) + value * (percentile(0.75) - percentile(0.25))
    raise ValueError(f"unknown method {method}")


def semantic_plan(sentences: DataFrame, document: str, method: str = "percentile", value: float = 95.0) -> tuple[DataFrame, DataFrame]:
    """``sentences``: those of ``semantic_runs`` with a column vector. Returns them with the distance to the next one of their run
    in place of the vector, and for each document: sentences, threshold (one for all its runs), breakpoints, fallback: the
    reason why it is packed by size alone (too_many_sentences, too_short, error: a sentence has no vector), or null."""
    line = Window.partitionBy(document, "run").orderBy("pos")
    nxt = F.lead("vector").over(line)
    rows = sentences.withColumn("__next", nxt).withColumn("distance", _distances()(F.col("vector"), F.col("__next"))).drop("__next")
    rows = rows.withColumn("last", F.lead("pos").over(line).isNull()).withColumn("bare", F.col("vector").isNull()).drop("vector")
    by = rows.groupBy(document).agg(
        F.count("*").alias("sentences"),
        F.count_if(~F.col("last")).alias("pairs"),
        F.count_if("bare").alias("bare"),
        breakpoint_threshold(F.col("distance"), method, value).alias("threshold"),
    )
    stats = by.withColumn("fallback", _fallback()).withColumn("threshold", F.when(F.col("fallback").isNull(), F.col("threshold"))).drop("pairs", "bare")
    breaks = rows.join(stats, document).groupBy(document).agg(F.count_if(F.col("distance") > F.col("threshold")).alias("breakpoints"))
    return rows.drop("bare", "last"), stats.join(breaks, document).select(document, "sentences", "breakpoints", "threshold", "fallback")


def semantic_pack(blocks: DataFrame, planned: DataFrame, stats: DataFrame, document: str, options: ChunkOptions = ChunkOptions(), least: int = 100) -> DataFrame:
    """document, ordinal, heading, kind, language, content, overlap. Runs of prose are cut after distances above the document's
    threshold, then made to fit; other blocks are packed as ever, and so are all blocks of documents that fall back
    (also those that ``stats`` does not know: they have no prose). Paragraphs stay apart inside a chunk; a chunk that begins inside a
    paragraph goes on (overlap CONTINUES)."""
    own = segments(blocks, document).select(document, "segment", F.struct(F.col("ordinal").cast("int").alias("ordinal"), "heading", "kind", "text", F.col("language") if "language" in blocks.columns else F.lit("").alias("language")).alias("b"))
    of = own.groupBy(document).agg(F.sort_array(F.collect_list(F.struct("b.ordinal", "segment", "b"))).alias("blocks"))
    said = planned.groupBy(document).agg(F.sort_array(F.collect_list(F.struct("pos", "run", "sentence", "begins", "distance"))).alias("said"))
    rows = of.join(stats.where("fallback is null").select(document, "threshold"), document, "left").join(said, document, "left")
    return _folded(rows, document, options, least)


def semantic_chunked(blocks: DataFrame, document: str, provider: EmbeddingProvider, options: ChunkOptions = ChunkOptions(), least: int = 100, method: str = "percentile", value: float = 95.0) -> DataFrame:
    """The chunks of ``semantic_pack`` from blocks and a provider of vectors. The texts move once, to their document, and are dealt with
    in its row from there on: sentences and vectors are neither shuffled nor written."""
    language = F.col("language") if "language" in blocks.columns else F.lit("").alias("language")
    b = F.struct(F.col("ordinal").cast("int").alias("ordinal"), "segment", F.struct(F.col("ordinal").cast("int").alias("ordinal"), "heading", "kind", "text", language).alias("b"))
    of = segments(blocks, document).groupBy(document).agg(F.sort_array(F.collect_list(b)).alias("blocks"))
    prose = F.transform("blocks", lambda x: F.when(x["b"]["kind"] == "prose", x["b"]["text"]))
    rows = of.withColumn("said", _said(provider, options.size)(F.col("blocks.segment"), prose))
    rows = rows.withColumn("distances", F.filter("said.distance", lambda d: d.isNotNull()))
    rows = rows.withColumns({"sentences": F.size("said"), "pairs": F.size("distances"), "bare": F.lit(0)})
    limit = F.when(_fallback().isNull(), listed_threshold(F.col("distances"), method, value))
    return _folded(rows.withColumn("threshold", limit), document, options, least)


def _folded(rows: DataFrame, document: str, options: ChunkOptions, least: int) -> DataFrame:
    """``rows``: document, blocks (segment, b), threshold (null: packed by size), said (run, sentence, begins, distance), in order."""

    def cut_run(run: list[dict], heading: str, threshold: float) -> list[tuple]:
        distances = [s["distance"] or 0.0 for s in run[:-1]]
        gaps = [2 if s["begins"] else 1 for s in run]
        found = fit_groups([len(s["sentence"]) for s in run], distances, [d > threshold for d in distances], options.size, least, gaps)
        texts = [join_sentences([(s["sentence"], s["begins"]) for s in run[a:b]]) for a, b in found]
        return [(heading, "prose", "", t, 0 if a == 0 or run[a]["begins"] else CONTINUES) for t, (a, _) in zip(texts, found)]

    def packed(found: list[dict]) -> list[tuple]:
        return [(c["heading"], c["kind"], c["language"], c["text"], c["overlap"]) for c in pack_blocks(found, options)]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(a, FOLDED) for b in batches for a in range(0, b.num_rows, FOLDED)):
            for i, (held, threshold, sentences) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)))):
                out: list[tuple] = []
                if threshold is None:
                    out = packed([x["b"] for x in held])
                else:
                    runs: dict[int, list[dict]] = {}
                    for s in sentences or ():
                        runs.setdefault(s["run"], []).append(s)
                    parts: dict[int, list[dict]] = {}
                    for x in held:
                        parts.setdefault(x["segment"], []).append(x["b"])
                    for number, part in parts.items():
                        if part[0]["kind"] != "prose":
                            out += packed(part)
                        elif number in runs:
                            out += cut_run(runs[number], part[0]["heading"], threshold)
                columns = list(zip(*out)) if out else [()] * 5
                kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(out), pa.int64())), pa.array(range(len(out)), pa.int32()), *(pa.array(c, k) for c, k in zip(columns, kinds))], [document, "ordinal", "heading", "kind", "language", "content", "overlap"])

    kind = dict(rows.dtypes)[document]
    return rows.select(document, "blocks", "threshold", "said").mapInArrow(fold, f"{document} {kind}, ordinal int, heading string, kind string, language string, content string, overlap int")


def semantic_chunks(sentences: DataFrame, group: str, method: str = "percentile", value: float = 95.0, size: int = 1000, least: int = 100) -> DataFrame:
    """``sentences``: group, pos, sentence, vector, and begins (a paragraph) where it is known. Returns group, ordinal, content.
    Documents of under two sentences or over 5000 are one run cut by size alone."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        text = pdf.sentence.tolist()
        n = len(text)
        distances = [0.0] * max(0, n - 1)
        if 3 < n <= 5000:
            v = np.stack([np.asarray(x, float) for x in pdf.vector])
            norm = np.linalg.norm(v, axis=1)
            d = norm[1:] * norm[:-1]
            cos = np.divide((v[1:] * v[:-1]).sum(axis=1), d, out=np.zeros(n - 1), where=d > 0)
            distances = np.maximum(0, 1 - cos).tolist()
            x = np.array(distances)
            q = lambda p: float(np.percentile(x, p))
            limit = q(value) if method == "percentile" else x.mean() + value * x.std() if method == "stddev" else q(75) + value * (q(75) - q(25))
            breaks = [y > limit for y in distances]
        else:
            breaks = [False] * max(0, n - 1)
        begins = pdf.begins.tolist() if "begins" in pdf else [False] * n
        groups = fit_groups([len(t) for t in text], distances, breaks, size, least, [2 if x else 1 for x in begins])
        return pd.DataFrame({group: pdf[group].iloc[0], "ordinal": range(len(groups)), "content": [join_sentences(list(zip(text[a:b], begins[a:b]))) for a, b in groups]})

    kind = dict(sentences.dtypes)[group]
    return sentences.groupBy(group).applyInPandas(fold, f"{group} {kind}, ordinal int, content string")


def sections(chunks: DataFrame, document: str) -> DataFrame:
    """Runs of chunks that share the first two levels of their heading ('A > B > C'): document, section, heading,
    occurrence, first_ordinal, last_ordinal."""
    top = F.array_join(F.slice(F.split(F.coalesce("heading", F.lit("")), " > "), 1, 2), " > ")
    line = Window.partitionBy(document).orderBy("ordinal")
    rows = chunks.withColumn("top", top)
    fresh = F.when(F.lag("top").over(line).eqNullSafe(F.col("top")), 0).otherwise(1)
    rows = rows.withColumn("fresh", fresh).withColumn("section", F.sum("fresh").over(line))
    runs = rows.groupBy(document, "section", F.col("top").alias("heading")).agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"))
    return runs.withColumn("occurrence", F.row_number().over(Window.partitionBy(document, "heading").orderBy("first_ordinal")))


def joined_text(chunks: DataFrame, document: str) -> DataFrame:
    """document, content: chunks in order joined by their overlaps; a null overlap is looked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [join_parts([Part(p["content"], p["overlap"]) for p in parts]) for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [document, "content"])

    rows = chunks.groupBy(document).agg(F.sort_array(F.collect_list(F.struct("ordinal", "content", "overlap"))).alias("parts"))
    return rows.mapInArrow(run, f"{document} {dict(chunks.dtypes)[document]}, content string")


def with_smaller_chunks(make, embed, options: ChunkOptions, attempts: int = 8, least: int = 256):
    """``embed(make(options))``, with half the size after each time that the input is too long (ValueError)."""
    size = options.size
    for _ in range(attempts):
        try:
            return embed(make(ChunkOptions(max(least, size), min(options.overlap, size // 2))))
        except ValueError:
            if size <= least:
                raise
            size = max(least, size // 2)
    raise ValueError("the input stays too long")
