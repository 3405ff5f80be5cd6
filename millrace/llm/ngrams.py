"""Hashed n-gram features, vectorised over one text."""

from __future__ import annotations

import re
import zlib

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _spread(h: np.ndarray, bits: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def char_ngrams(text: str, bits: int, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the 1- to ``longest``-grams of the letters of a text, lower-cased; every run of other
    characters is one space, so digits, marks and layout do not count."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    letter = table[np.minimum(codes, len(table) - 1)]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    codes = codes[keep]
    found, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, longest + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        h = h[:m] * _MIX + codes[n - 1 :] + np.uint64(n)
        found.append(_spread(h * _MIX, bits))
    counts = np.bincount(np.concatenate(found), minlength=1 << bits) if found else np.zeros(1 << bits, np.int64)
    at = np.flatnonzero(counts)
    return at, counts[at]


_LETTERS: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points of the first three planes are letters."""
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.fromiter((chr(i).isalpha() for i in range(0x32000)), bool, 0x32000)
        _LETTERS[-1] = False
    return _LETTERS


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


_TOKEN = re.compile(r"\w+|[^\w\s]+|\n")


def word_ngrams(text: str, bits: int, longest: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of the 1- to ``longest``-grams of words, runs of marks and line breaks, and of the 1- to
    3-grams of the same sequence with each word replaced by whether it repeats the word before."""
    tokens = _TOKEN.findall(text.lower())
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    crc = zlib.crc32
    base = np.fromiter((crc(t.encode("utf-8", "surrogatepass")) for t in tokens), np.uint64, len(tokens))
    word = np.fromiter((t[0].isalnum() for t in tokens), bool, len(tokens))
    same = np.zeros(len(base), bool)
    same[1:] = base[1:] == base[:-1]
    shape = np.where(word, np.where(same, np.uint64(2), np.uint64(1)), base + np.uint64(3)) + np.uint64(1 << 40)
    found = []
    for sequence, most in ((base, longest), (shape, 3)):
        h = np.zeros(len(base), np.uint64)
        for n in range(1, min(most, len(base)) + 1):
            h = h[: len(base) - n + 1] * _MIX + sequence[n - 1 :] + np.uint64(n)
            found.append(_spread(h * _MIX, bits))
    return np.unique(np.concatenate(found), return_counts=True)
