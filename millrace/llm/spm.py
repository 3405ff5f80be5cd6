"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbol pairs whose joint piece is known wait in an agenda ordered by score, then position; the best is
merged and its new neighbours are entered. Where no piece runs from another character into a word mark or over a
line break, a text falls into chunks that merge independently; a task keeps results by chunk, up to so many bytes, and
holds each new chunk against the sentencepiece library, ids and decoded text, in groups of an Arrow batch. Results are
always the agenda's own; ``off`` counts the chunks of a text on which the two differ, and is zero where all is well.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MARK = "▁"
#: Symbols of a chunk up to which the agenda is a plain list.
SHORT = 64
#: About so many bytes of chunks and results that a task keeps; half of them are the ones used before.
KEPT_BYTES = 32 << 20
#: Symbols of a chunk up to which many chunks are merged together.
WIDE = 32
_UNKNOWN, _CONTROL, _BYTE = 2, 3, 6
#: Stands for no joint piece: the last entry of a table by piece.
_NEVER_ID = -1


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Field numbers and values of one protocol-buffer message."""

    def varint(at: int) -> tuple[int, int]:
        shift = value = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            n = 4 if kind == 5 else 8
            value, at = struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0], at + n
        yield tag >> 3, value


class _Pairs:
    """Pairs of symbols to their joint piece: an open-addressed table searched for many pairs at once."""

    def __init__(self, triples: np.ndarray) -> None:
        self.bits = max(4, int(4 * len(triples)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, _NEVER_ID, np.int32)
        left = np.arange(len(triples))
        keys = (triples[:, 0] << 32) | triples[:, 1]
        slot = self._slot(keys)
        self.probes = 0
        while len(left):  # of the keys that want a free slot one gets it, the others go on
            self.probes += 1
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = keys[free]
            self.values[slot[free]] = triples[free, 2]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        # a slot that two keys wanted holds the value written last, as it does the key
        own = self._search(keys)
        assert (own == triples[:, 2]).all()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _search(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], _NEVER_ID)
        open_ = np.flatnonzero((held != keys) & (held != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys = np.where((left < 0) | (right < 0), -2, keys)
        return self._search(keys.ravel()).reshape(keys.shape)


class Model:
    """A merge-type sentencepiece model with byte fallback and identity normalisation."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for field, value in top:
            if field == 1:
                p = dict(_fields(value))
                self.pieces.append(p[1].decode())
                scores.append(p.get(2, 0.0))
                self.kinds.append(p.get(3, 1))
        trainer = dict(_fields(next(v for f, v in top if f == 2)))
        normal = dict(_fields(next(v for f, v in top if f == 3)))
        if trainer.get(3) != 2 or not trainer.get(35) or normal.get(2) or normal.get(4, 1):
            raise ValueError("only merge-type models with byte fallback and identity normalisation are supported")
        self.prefix = bool(normal.get(3, 1))
        usable = [i for i, k in enumerate(self.kinds) if k not in (_UNKNOWN, _CONTROL, _BYTE)]
        self.ids = {self.pieces[i]: i for i in usable}
        self.scores = {self.pieces[i]: scores[i] for i in usable}
        self.costs, self.never = {p: -s for p, s in self.scores.items()}, float("inf")
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.chunks = re.compile(self._boundaries())

    def _boundaries(self) -> str:
        """A pattern for chunks that merge independently: no piece runs over their ends."""
        joined = "\n".join(self.ids)
        self.whole = bool(re.search(f"[^{MARK}\n]{MARK}", joined) or any("\n" in p for p in self.ids))
        if self.whole:
            return r"(?s).+"
        return r" *[^ \n]+| +|\n"

    def normalise(self, text: str) -> str:
        """With plain spaces for word marks; the library treats the two alike."""
        text = text.replace(MARK, " ")
        return " " + text if self.prefix and text else text

    def encode_chunk(self, chunk: str) -> list[int]:
        """Merge the characters of a chunk by the agenda: a plain list of scores for short chunks, else a heap."""
        symbols: list[str] = list(chunk.replace(" ", MARK))
        n = len(symbols)
        if n <= SHORT:
            return self._ids(self._merge_short(symbols))
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.scores, []

        def enter(left: int, right: int) -> None:
            if left >= 0 and right >= 0:
                score = scores.get(piece := symbols[left] + symbols[right])
                if score is not None:
                    agenda.append((-score, left, right, piece))

        for i in range(n - 1):
            enter(i, i + 1)
        heapq.heapify(agenda)
        while agenda:
            _, left, right, piece = heapq.heappop(agenda)
            if not symbols[left] or not symbols[right] or after[left] != right or symbols[left] + symbols[right] != piece:
                continue
            symbols[left], symbols[right] = piece, ""
            after[left] = nxt = after[right]
            if nxt >= 0:
                before[nxt] = left
            for a, b in ((before[left], left), (left, nxt)):
                if a >= 0 and b >= 0:
                    score = scores.get(joint := symbols[a] + symbols[b])
                    if score is not None:
                        heapq.heappush(agenda, (-score, a, b, joint))
        return self._ids([s for s in symbols if s])

    def _merge_short(self, symbols: list[str]) -> list[str]:
        cost, never = self.costs.get, self.never
        agenda = [cost(a + b, never) for a, b in pairwise(symbols)]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            symbols[i] = piece = symbols[i] + symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = cost(symbols[i - 1] + piece, never)
            if i < len(agenda):
                agenda[i] = cost(piece + symbols[i + 1], never)
        return symbols

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """Many chunks at once: those of up to WIDE symbols keep their agendas as rows of a matrix, from which each
        round takes and merges every row's best pair."""
        out: list[list[int] | None] = [None] * len(chunks)
        by_width: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            if (n := len(c)) <= WIDE:
                by_width.setdefault(8 if n <= 8 else 16 if n <= 16 else WIDE, []).append(i)
            else:
                out[i] = self.encode_chunk(c)
        for width, at in by_width.items():
            for lo in range(0, len(at), 1 << 12):
                part = at[lo : lo + (1 << 12)]
                for i, ids in zip(part, self._merge_rows([chunks[i] for i in part], width)):
                    out[i] = self.encode_chunk(chunks[i]) if ids is None else ids
        return out

    def _merge_rows(self, chunks: list[str], width: int) -> Iterator[list[int] | None]:
        """Ids of each chunk; None where a character is not in the vocabulary."""
        symbol_of, pairs = self._arrays
        codes = np.frombuffer("".join([c.ljust(width, "\0") for c in chunks]).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        sym = symbol_of[codes].reshape(-1, width)
        column = np.arange(width)
        sym[column >= size[:, None]] = -2
        strange = ((sym == -1) & (column < size[:, None])).any(axis=1)
        joint = np.full(sym.shape, _NEVER_ID, np.int32)
        joint[:, :-1] = pairs.find(sym[:, :-1], sym[:, 1:])
        rank = self._rank  # the order of the pieces by score; the agenda holds ranks
        agenda = rank[joint]
        done = sym.copy()
        rows = np.arange(len(sym))
        while len(rows):
            best = agenda.argmin(axis=1)
            line = np.arange(len(rows))
            live = agenda[line, best] < len(self.pieces)
            if not live.all():
                done[rows[~live]] = sym[~live]
                rows, sym, agenda, joint, best = rows[live], sym[live], agenda[live], joint[live], best[live]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            merged = joint[line, best]
            shift = np.minimum(column + (column > best[:, None]), width - 1)
            sym = np.take_along_axis(sym, shift, 1)
            joint = np.take_along_axis(joint, shift, 1)
            sym[:, -1] = -2
            joint[:, -1] = _NEVER_ID
            sym[line, best] = merged
            nxt = np.minimum(best + 1, width - 1)
            joint[line, best] = np.where(best + 1 < width, pairs.find(merged, sym[line, nxt]), _NEVER_ID)
            prev = np.maximum(best - 1, 0)
            fresh = pairs.find(sym[line, prev], merged)
            joint[line, prev] = np.where(best > 0, fresh, joint[line, prev])
            agenda = rank[joint]
        flat = done[done >= 0].tolist()
        ends = np.cumsum((done >= 0).sum(axis=1)).tolist()
        start = 0
        for end, odd in zip(ends, strange.tolist()):
            yield None if odd else flat[start:end]
            start = end

    @cached_property
    def _rank(self) -> np.ndarray:
        """By piece its place in score order, ties alike; the last entry stands for no piece."""
        values = sorted({-x for x in self.scores.values()})
        place = {v: i for i, v in enumerate(values)}
        out = np.full(len(self.pieces) + 1, 1 << 30, np.int32)
        for p, i in self.ids.items():
            out[i] = place[-self.scores[p]]
        return out

    @cached_property
    def _arrays(self) -> tuple[np.ndarray, _Pairs]:
        """The symbol of each code point (-1: none), and the table of pairs whose joint piece is known."""
        symbol_of = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                symbol_of[ord(p)] = i
        symbol_of[ord(" ")] = self.ids.get(MARK, -1)
        triples = [(self.ids[p[:k]], self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        return symbol_of, _Pairs(np.array(triples, np.int64).reshape(-1, 3))

    def _ids(self, symbols: list[str]) -> list[int]:
        ids: list[int] = []
        for piece in symbols:
            i = self.ids.get(piece)
            if i is None:
                ids += [self.bytes[b] for b in piece.encode()]
            else:
                ids.append(i)
        return ids

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks.findall(self.normalise(text)) for i in self.encode_chunk(c)]

    @cached_property
    def _plain_text(self) -> list[str | None]:
        """The text of each piece; None for bytes, controls and the unknown piece."""
        return [None if k in (_UNKNOWN, _CONTROL, _BYTE) else p.replace(MARK, " ") for p, k in zip(self.pieces, self.kinds)]

    def _surface(self, ids: list[int]) -> str:
        """Text of ids with the leading word mark still there."""
        try:
            return "".join([self._plain_text[i] for i in ids])
        except TypeError:  # one of them is no plain piece
            pass
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(_utf8(bytes(raw)))
                raw.clear()
            kind = self.kinds[i]
            out.append("" if kind == _CONTROL else " ⁇ " if kind == _UNKNOWN else self.pieces[i])
        if raw:
            out.append(_utf8(bytes(raw)))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self._plain(ids, self._surface(ids))

    def _plain(self, ids: list[int], surface: str) -> str:
        return surface[1:] if self.prefix and ids and self.pieces[ids[0]].startswith(MARK) else surface


def _utf8(raw: bytes) -> str:
    """Bytes as text; each byte that belongs to no valid sequence becomes a replacement character."""
    out = []
    at = 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


@lru_cache(maxsize=2)
def _library(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


#: Chunks that the library sees in one text, with line breaks between them.
TOGETHER = 64


def checked(m: Model, lib, chunks: list[str]) -> Iterator[tuple[str, list[int], str, bool]]:
    """Each chunk with its ids by the agenda, their surface, and whether the library finds the same ids and decodes them
    to the same text. It sees many chunks at once; where a text of several differs they are looked at one by one. A line
    break before each chunk keeps the library's own leading word mark apart."""
    own = m.encode_chunks(chunks)
    surfaces = [m._surface(ids) for ids in own]
    width = 1 if m.whole else TOGETHER
    head = [] if m.whole else lib.encode("\n")
    mark, end = head[:-1], head[-1:]

    starts = range(0, len(chunks), width)
    if m.whole:
        asked = [c[1:] if m.prefix else c for c in chunks]
        wanted = own
        texts = [m._plain(ids, x) for ids, x in zip(own, surfaces)]
    else:
        asked = ["\n" + "\n".join(chunks[lo : lo + width]) for lo in starts]
        wanted = [mark + [i for ids in own[lo : lo + width] for i in chain(end, ids)] for lo in starts]
        texts = ["\n" + "\n".join(surfaces[lo : lo + width]) for lo in starts]
    agree = [x == y for x, y in zip(lib.encode(asked, num_threads=1), wanted)] if asked else []
    agree = [a and x == y for a, x, y in zip(agree, lib.decode(wanted) if wanted else [], texts)]
    for lo, good in zip(starts, agree):
        for k in range(lo, min(lo + width, len(chunks))):
            alone = good or not m.whole and lib.encode("\n" + chunks[k]) == head + own[k] and lib.decode(head + own[k]) == "\n" + surfaces[k]
            yield chunks[k], own[k], surfaces[k], alone


class Encoder:
    """From texts to their ids (four bytes each), the surface of these, and the number of chunks that the library sees
    otherwise. Chunks are kept in two generations, each of half of ``most`` bytes: mostly as their ids alone, with surface
    and difference only where the surface is another than the chunk or there is a difference."""

    def __init__(self, path: str, most: int = KEPT_BYTES) -> None:
        self.model, self.library, self.most = model(path), _library(path), most
        self.now: dict[str, bytes | tuple[bytes, str, bool]] = {}
        self.before: dict[str, bytes | tuple[bytes, str, bool]] = {}
        self.size = 0

    def __call__(self, texts: list[str]) -> list[tuple[bytes, str, int]]:
        if self.size > self.most // 2:
            self.now, self.before, self.size = {}, self.now, 0
        m, now = self.model, self.now
        chunks = [m.chunks.findall(m.normalise(text)) for text in texts]
        new = set(chain.from_iterable(chunks)).difference(now)
        known = new.intersection(self.before)
        now.update((c, self.before[c]) for c in known)
        fresh = list(new.difference(known))
        for c, ids, surface, same in checked(m, self.library, fresh) if fresh else ():
            blob = array("i", ids).tobytes()
            now[c] = blob if same and surface == c else (blob, surface, not same)
        self.size += 220 * len(new) + 3 * sum(map(len, new))
        out = []
        for own in chunks:
            found = [now[c] for c in own]
            try:
                out.append((b"".join(found), "".join(own), 0))
            except TypeError:
                parts = [(f, c, False) if isinstance(f, bytes) else f for f, c in zip(found, own)]
                out.append((b"".join([p[0] for p in parts]), "".join([p[1] for p in parts]), sum([p[2] for p in parts])))
        return out


def _groups(batch: pa.RecordBatch, rows: int = 320, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch, of so many rows and about so many characters at most, with their texts."""
    at = 0
    while at < batch.num_rows:
        texts = [x or "" for x in batch.column(1).slice(at, rows).to_pylist()]
        n = total = 0
        while n < len(texts) and (not n or total + len(texts[n]) <= size):
            total += len(texts[n])
            n += 1
        yield batch.slice(at, n), texts[:n]
        at += n


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded, off for each row of ``docs``: the token ids of the whole text, without begin or end ids, and
    the text that they decode to. A null text counts as empty and has no ids."""
    return _encoded(docs, path, "decoded string", lambda back, text: back)


def encoded_rows(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip, off for each row of ``docs``: as ``encoded``, with whether the ids decode to
    the text (word marks that stand in the text itself come back as spaces)."""
    found = _encoded(docs, path, "round_trip boolean", lambda back, text: back == text)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "off")


def _encoded(docs: DataFrame, path: str, column: str, check) -> DataFrame:
    name, kind = column.split()
    arrow = {"string": pa.string(), "boolean": pa.bool_()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        encode = Encoder(path)
        for batch in batches:
            for part, texts in _groups(batch):
                ids, more, off = [], [], []
                for (blob, back, wrong), text in zip(encode(texts), texts):
                    ids.append(np.frombuffer(blob, np.int32))
                    more.append(check(back[1:] if m.prefix else back, text))
                    off.append(wrong)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(more, arrow), pa.array(off, pa.int64())], ["doc_id", "ids", name, "off"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), f"doc_id long, ids array<int>, {column}, off long")


def digests(docs: DataFrame, path: str, most: int = 144 << 20) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256, off. Null and empty texts have no tokens
    and the digests of empty strings; very long texts are handled by themselves, chunk by chunk; repeated rows are
    kept; other columns are ignored; an empty table gives an empty result."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        decimal = list(map(str, range(len(m.pieces)))).__getitem__
        encode = Encoder(path, most)
        for batch in batches:
            for part, texts in _groups(batch):
                n, ids, text, off = [], [], [], []
                for blob, back, wrong in encode(texts):
                    n.append(len(blob) // 4)
                    ids.append(sha(",".join(map(decimal, array("i", blob)))))
                    text.append(sha(back[1:] if m.prefix else back))
                    off.append(wrong)
                columns = [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string()), pa.array(off, pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "off"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, off long")
