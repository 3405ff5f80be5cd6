"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Four base kinds follow fixed rules and always stay: email, ip, card, phone. The added kinds need a score of at least
``threshold``, which context words on either side of a span raise: iban by mod 97, nino and ssn by their formats, key
(blocks of private keys), secret (runs of letters and digits by their entropy, surer behind a prefix of an issuer).
All scans are linear in the text: runs are matched greedily once and not retried from inside, but for an IBAN's at most
34 characters.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "nino", "key", "secret")
KINDS = BASE_KINDS + ADDED_KINDS

#: Words that speak for a kind when they stand within CONTEXT_CHARS before or after a span.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "nino": ("nino", "insurance", "national"),
    "key": ("key",),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential", "credentials", "passwort", "clave"),
}
CONTEXT_CHARS = 40
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "nino": 0.3, "key": 1.0, "secret": 0.3}
CONTEXT_BONUS = 0.4
THRESHOLD = 0.6

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE_HEAD = re.compile(r"\+[0-9][ ().0-9-]++")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![A-Za-z0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![A-Za-z0-9-])")
_NINO = re.compile(r"(?<![A-Za-z0-9])[A-CEGHJ-PR-TW-Z][A-CEGHJ-NPR-TW-Z][0-9]{6}[A-D](?![A-Za-z0-9])")
_KEY = re.compile(r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----")
_KEY_END = re.compile(r"-----END (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=.@-])[A-Za-z0-9+/_-]{16,}+(?:\.[A-Za-z0-9_-]++)*+={0,2}(?![@])")
#: Prefixes that issuers give their keys and tokens.
_ISSUED = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20}|glpat-|xox[abprs]-|sk-[A-Za-z0-9_-]{16}|[sr]k_live_|eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.")
#: Bits a character that a secret has at least.
SECRET_ENTROPY = 3.0
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|-)*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", max(done, at + 1))


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Quadruples of number groups from the left of every dotted run; groups above 255 drop their quadruple."""
    if "." not in text:
        return
    for run in _DOTTED.finditer(text):
        if "." not in run.group():
            continue
        parts, at = run.group().split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(v := p.lstrip("0")) <= 3 and int(v or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield m.start(), m.end()


def phones(text: str) -> Iterator[tuple[int, int]]:
    at = text.find("+")
    while at >= 0:
        after = at + 1
        if m := _PHONE_HEAD.match(text, at):
            last = m.end()
            while not text[last - 1].isdigit():
                last -= 1
            if last - at >= 4:
                if 8 <= sum(map(str.isdigit, text[at:last])) <= 15:
                    yield at, last
                after = last
        at = text.find("+", after)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest run that ends at a word border and has a valid checksum, from each head that no span holds."""
    m = _IBAN.search(text)
    while m:
        a, b = m.span()
        after = a + 1
        while b > a:
            if 15 <= len(own := text[a:b].replace(" ", "")) <= 34 and mod97(own):
                yield a, b
                after = b
                break
            b = text.rfind(" ", a, b)
        m = _IBAN.search(text, after)


def keys(text: str) -> Iterator[tuple[int, int]]:
    """Blocks of private keys; one without an end reaches to the end of its line."""
    at = 0
    while m := _KEY.search(text, at):
        end = _KEY_END.search(text, m.end())
        at = end.end() if end else len(text) if (n := text.find("\n", m.end())) < 0 else n
        yield m.start(), at


def entropy(run: str) -> float:
    """Bits a character, from the run's own frequencies."""
    n = len(run)
    return sum(c / n * math.log2(n / c) for c in Counter(run).values())


def secrets(text: str) -> Iterator[tuple[int, int, float]]:
    """Runs that mix letters and digits at a high entropy, with their score before context."""
    for m in _SECRET.finditer(text):
        run = m.group()
        if any(map(str.isdigit, run)) and any(map(str.isalpha, run)) and entropy(run) >= SECRET_ENTROPY:
            yield *m.span(), 0.8 if _ISSUED.match(run) else BASE_SCORE["secret"]


def _near(text: str, kind: str, start: int, end: int) -> bool:
    around = f"{text[max(0, start - CONTEXT_CHARS) : start]}\n{text[end : end + CONTEXT_CHARS]}".lower()
    return any(w in CONTEXT[kind] for w in _WORD.findall(around))


def find(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Every span of a text, by kind in the order of KINDS, then start; offsets in code points, end exclusive."""
    proposed: list[tuple[str, int, int]] = []
    for kind, scan in (("email", emails), ("ip", ips), ("card", cards), ("phone", phones)):
        proposed += [(kind, a, b) for a, b in scan(text)]
    taken = sorted((a, b) for _, a, b in proposed)
    starts = [a for a, _ in taken]

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return not any(taken[j][1] > a for j in range(max(0, i - 4), i))

    added: list[tuple[str, int, int, float]] = []
    for kind, found in (("iban", ibans(text)), ("ssn", (m.span() for m in _SSN.finditer(text))), ("nino", (m.span() for m in _NINO.finditer(text))), ("key", keys(text))):
        added += [(kind, a, b, BASE_SCORE[kind]) for a, b in found if free(a, b)]
    blocks = [(a, b) for kind, a, b, _ in added if kind in ("key", "iban")]
    added += [("secret", a, b, x) for a, b, x in secrets(text) if free(a, b) and not any(p < b and a < q for p, q in blocks)]
    rows = [(k, a, b, BASE_SCORE[k]) for k, a, b in proposed] + added
    spans = [Span(k, a, b, min(1.0, x + CONTEXT_BONUS * _near(text, k, a, b))) for k, a, b, x in rows]
    return [s for s in spans if s.kind in BASE_KINDS or s.score >= threshold]


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in square brackets; overlapping spans become one."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, spans: array of (kind, start_pos, end_pos, score), for each row of ``docs``. A null text has none."""
    struct = pa.struct([("kind", pa.string()), ("start_pos", pa.int64()), ("end_pos", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": s.kind, "start_pos": s.start, "end_pos": s.end, "score": s.score} for s in find(t, threshold)] if (t := x.as_py()) else [] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(struct))], ["doc_id", "spans"])

    kind = "doc_id long, spans array<struct<kind:string,start_pos:long,end_pos:long,score:double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), kind)


def redacted(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the spans of its texts replaced; n_chars, where there is such a column, is set anew where
    a text changed. Rows without personal data, null texts and all other columns stay as they are."""
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch.column(at)
            new = [redact(t, s) if (t := x.as_py()) and (s := find(t, threshold)) else t for x in old]
            arrays = list(batch.columns)
            arrays[at] = pa.array(new, old.type)
            if "n_chars" in names:
                k = names.index("n_chars")
                sizes = [n.as_py() if a == b.as_py() else len(a) for n, a, b in zip(arrays[k], new, old)]
                arrays[k] = pa.array(sizes, arrays[k].type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.mapInArrow(lean(run), docs.schema)


def report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans as text, the counts of
    the added kinds, n_spans of all kinds, top_score of any span (null without one). Null and empty texts have no spans;
    very long texts are scanned whole, in linear time; repeated rows are kept; other columns are ignored; an empty table
    gives an empty result."""
    found = scan(docs, threshold)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    label = lambda s: F.concat_ws(":", s["kind"], s["start_pos"].cast("string"), s["end_pos"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(F.array_join(F.transform(base, label), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", label), ",").alias("spans"),
        *(count(k).alias(f"n_{k}") for k in ADDED_KINDS),
        F.size("spans").cast("long").alias("n_spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )
