"""Scalar expressions on text, vectors and identifiers; all stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.regexp_replace(c, r"^\s+|\s+$", ""), F.lit(""))


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_question(c: Column) -> Column:
    """Lower case, collapsed, without closing marks."""
    return F.regexp_replace(collapse(F.lower(c)), r"[\s.?!]+$", "")


def clip(c: Column, n: int, ellipsis: str = "...", default: str = "unknown") -> Column:
    c = F.coalesce(blank_to_null(c), F.lit(default))
    return F.when(F.length(c) <= n, c).otherwise(F.concat(F.substring(c, 1, n), F.lit(ellipsis)))


def strip_fence(c: Column) -> Column:
    """The inside of one surrounding code fence."""
    return F.regexp_replace(c, r"(?s)^\s*```[^\n]*\n(.*?)\n?```\s*$", "$1")


def strip_list_marker(c: Column) -> Column:
    """Without a leading list marker and surrounding quotes."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*(?:[-*•]|\d+[.)])\s+", ""), r"^[\"'“”]+|[\"'“”]+$", "")


def first_number(c: Column) -> Column:
    """The first number of a text as double, a comma counting as a point; null where there is none."""
    return F.regexp_replace(F.nullif(F.regexp_extract(c, r"\d+(?:[.,]\d+)?", 0), F.lit("")), ",", ".").cast("double")


def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1)


def code_tokens(c: Column) -> Column:
    """Words, each followed by its parts where it changes case, between letters and digits, or at underscores; all in
    lower case. Repeats stay, since they count in term frequencies."""
    whole = F.regexp_extract_all(c, F.lit("([A-Za-z0-9_]+)"), 1)

    def parts(w: Column) -> Column:
        found = F.regexp_extract_all(w, F.lit("([A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+)"), 1)
        return F.when(F.size(found) > 1, F.concat(F.array(w), found)).otherwise(F.array(w))

    return F.transform(F.flatten(F.transform(whole, parts)), F.lower)


#: Fixed values of 32-bit FNV-1a: offset basis and prime.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def fnv1a(c: Column) -> Column:
    """Unsigned 32-bit FNV-1a hash of the UTF-8 bytes, as long."""
    basis, prime, low = (F.lit(x).cast("long") for x in (FNV_BASIS, FNV_PRIME, 4294967295))
    fold = lambda codes: F.aggregate(codes, basis, lambda h, b: (h.bitwiseXOR(b) * prime).bitwiseAND(low))
    hexes, count = F.hex(c.cast("binary")), F.octet_length(c)
    codes = F.transform(F.sequence(F.lit(1), count), lambda i: F.conv(F.substring(hexes, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    plain = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    return F.when(c == "", basis).when(count == F.length(c), fold(plain)).otherwise(fold(codes))


def uuid3(c: Column) -> Column:
    """Name-based identifier: the MD5 of the text with version 3 and the standard variant."""
    m = F.md5(c.cast("binary"))
    variant = F.element_at(F.array(*(F.lit(x) for x in "89ab")), (F.conv(F.substring(m, 17, 1), 16, 10).cast("int") % 4 + 1))
    return F.concat(F.substring(m, 1, 8), F.lit("-"), F.substring(m, 9, 4), F.lit("-3"), F.substring(m, 14, 3), F.lit("-"), variant, F.substring(m, 18, 3), F.lit("-"), F.substring(m, 21, 12))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column, zero: float = 0.0) -> Column:
    """Cosine similarity; ``zero`` where a vector has no length."""
    d = norm(a) * norm(b)
    return F.when(d == 0, F.lit(zero)).otherwise(dot(a, b) / F.nullif(d, F.lit(0.0)))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, at least 0; 1 where a vector has no length."""
    return F.greatest(F.lit(0.0), 1 - cosine(a, b))


def normalized(v: Column) -> Column:
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x.cast("double") / n))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def percent_change(now: Column, before: Column) -> Column:
    """Rounded change in per cent; 0 from nothing to nothing, 100 from nothing to something."""
    return F.when(before == 0, F.when(now == 0, 0).otherwise(100)).otherwise(F.round((now - before) * 100.0 / F.nullif(before, F.lit(0))).cast("int")).cast("int")


def two_decimals(c: Column) -> Column:
    return F.coalesce(F.format_string("%.2f", c), F.lit("n/a"))


def snippet(text: Column, query: Column, width: int = 240, before: int = 100, low: Column | None = None) -> Column:
    """A short text whole; else a window that starts shortly before the first place of the query. ``low``: the text in lower
    case, where it is at hand."""
    start = F.greatest(F.lit(0), F.position(F.lower(query), F.lower(text) if low is None else low) - 1 - before)
    body = F.substring(text, start + 1, F.lit(width))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), body, F.when(start + width < F.length(text), "...").otherwise(""))
    return F.when(F.length(text) <= width, text).otherwise(cut)


def truncate_words(c: Column, n: int) -> Column:
    """At most n characters, cut at the last space or line break where there is one."""
    head = F.substring(c, 1, n)
    whole = F.regexp_extract(head, r"(?s)^(.*)[ \n]", 1)
    return F.when(F.length(c) <= n, c).when(whole == "", head).otherwise(whole)


def glob_to_regex(pattern: str) -> str:
    """Wildcards of crawl scopes: * any run, ? one character, anchored, whatever case."""
    return "(?i)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def path_glob_to_regex(pattern: str) -> str:
    """Wildcards of file trees: a pattern without slash matches in any folder, one with a slash from the root, a closing
    slash means all below, ** spans folders, * and ? stay inside one."""
    p = pattern.strip().replace("\\", "/")
    anchored = "/" in p or p == "**"
    p = p.removeprefix("/") + ("**" if p.endswith("/") else "")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += "[^/]*" if p[i] == "*" else "[^/]" if p[i] == "?" else re.escape(p[i])
            i += 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$"
