"""Canonical exact digests, with DataFrame functions only.

canonical form: Unicode NFC, full case folding, runs of white space as one space, none at the ends, NFC again.
digest: two chained XXH64 values (128 bits) as 32 hexadecimal digits. Texts of one digest are compared byte by
byte; should a digest hold different canonical texts, the SHA-256 of the canonical text is appended for all of them. A
document's likeness to its edited text and to the next document is decided by the bytes of the canonical texts as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

#: About so many documents share a window group of ``with_next``, whose width follows the ids' own density.
GROUP_ROWS = 512
QUANTILES = 64


def _nfc(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))).otherwise(c)


def _folded(c: Column) -> Column:
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))).otherwise(F.lower(c))


_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def canonical(c: Column) -> Column:
    """Canonical form of a non-null text, as one expression. It repeats its parts: for few rows."""
    return _nfc(F.trim(F.regexp_replace(_folded(_nfc(c)), _SPACE, " ")))


def with_canonical(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the canonical form of the column ``text`` as ``name``, a projection for each step, so that none is
    evaluated twice."""
    for step in (_nfc(F.col(text)), _folded(F.col(name)), F.trim(F.regexp_replace(name, _SPACE, " ")), _nfc(F.col(name))):
        rows = rows.withColumn(name, step)
    return rows


def with_digest(rows: DataFrame, text: str, name: str) -> DataFrame:
    """``rows`` with the digest of the column ``text`` as ``name``."""
    return with_canonical(rows, text, "canon").withColumn(name, wide_digest(F.col("canon"))).drop("canon")


def wide_digest(canon: Column) -> Column:
    """128 bits of a canonical text as 32 lowercase hexadecimal digits."""
    parts = [F.lpad(F.hex(x), 16, "0") for x in (F.xxhash64(canon), F.xxhash64(F.lit("millrace"), canon))]
    return F.lower(F.concat(*parts))


def colliding(canon: DataFrame) -> DataFrame:
    """``canon``: digest, canon. The digests under which different canonical texts lie, by comparing the bytes of
    the smallest and the largest text of each bucket. Both are combined before the shuffle, so that a bucket with
    very many copies sends one pair from each task."""
    ends = canon.groupBy("digest").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    return ends.where(F.col("low") != F.col("high")).select("digest")


def _group(docs: DataFrame) -> Column:
    """Numbers of groups of neighbouring ids, ascending: between two quantiles ids share groups of one width, set so that
    a group has about GROUP_ROWS. The driver gets the QUANTILES + 1 cuts and a count."""
    shares = [k / QUANTILES for k in range(QUANTILES + 1)]
    n, cuts = docs.agg(F.count("doc_id"), F.percentile_approx("doc_id", shares, 10 * QUANTILES)).first()
    if not n:
        return F.lit(0).cast("long")
    parts = max(1, -(-n // (QUANTILES * GROUP_ROWS)))
    marks = sorted(set(cuts))
    group, at = F.lit(0).cast("long"), 1
    for low, high in zip(marks, marks[1:] + [marks[-1] + 1]):
        width = max(1, -(-(high - low) // parts))
        group = F.when(F.col("doc_id") >= low, at + F.least(F.floor((F.col("doc_id") - low) / width), F.lit(parts))).otherwise(group)
        at += parts + 1
    return F.coalesce(group.cast("long"), F.lit(-1).cast("long"))


def with_next(docs: DataFrame, more=lambda rows: rows) -> DataFrame:
    """doc_id, text, next_text: the text of the next row by ascending doc_id, then text; the first after the last. Columns
    that ``more`` adds are carried along, and those of the next row as next_<name>.

    Rows are dealt into groups of neighbouring ids. The first row of each group is sent to the group before it
    as well, so one shuffle of the texts is enough. Nulls among the ids come first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    group = _group(docs)
    docs = docs.withColumn("g", F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(group))
    # the smallest id of each group, and the group before it; two levels, so no window holds all groups
    firsts = materialize(docs.groupBy("g").agg(F.min("doc_id").alias("first_id")).withColumn("top", F.floor(F.col("g") / 4096)), "groups")
    tops = firsts.groupBy("top").agg(F.max("g").alias("last_g"))
    before_top = tops.select("top", F.lag("last_g").over(Window.orderBy("top")).alias("before_top"))
    within = F.lag("g").over(Window.partitionBy("top").orderBy("g"))
    linked = firsts.withColumn("before", within).join(before_top, "top")
    edge = firsts.agg(F.min("g"), F.max("g")).first()
    linked = linked.select(
        F.col("first_id").alias("__id"),
        F.col("g").alias("__g"),
        F.coalesce("before", "before_top", F.lit(edge[1])).alias("__to"),
        (F.col("g") == F.lit(edge[0])).alias("__wraps"),
    )
    heads = docs.join(linked, F.col("g").eqNullSafe(F.col("__g")) & F.col("doc_id").eqNullSafe(F.col("__id")))
    heads = heads.select("doc_id", "text", F.col("__to").alias("g"), F.lit(True).alias("extra"), F.col("__wraps").alias("wraps"))
    rows = more(docs.select("*", F.lit(False).alias("extra"), F.lit(False).alias("wraps"))).unionByName(more(heads))
    names = [c for c in rows.columns if c not in ("doc_id", "g", "extra", "wraps")]
    order = Window.partitionBy("g").orderBy("wraps", F.col("extra"), "doc_id", F.xxhash64("text"), "text")
    return rows.select("doc_id", *names, "extra", *(F.lead(c).over(order).alias(f"next_{c}") for c in names)).where("not extra").drop("extra")


def edited(text: Column, nxt: Column) -> Column:
    """The last floor(n/4) code points replaced by the first as many, or all, of the next text."""
    k = F.floor(F.length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(nxt, F.lit(1), k))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. An exact digest knows only equal (1.0) and different (0.0).

    A null text counts as empty; with one row the next document is the row itself; equal texts, repeated rows
    included, have equal digests; rows without id come first; very long texts are digested whole; an empty table gives
    an empty result; other columns are ignored."""
    text = with_canonical(docs.select(text_or_empty().alias("text")), "text", "canon")
    clash = materialize(colliding(text.select(wide_digest(F.col("canon")).alias("digest"), "canon")), "collisions")
    rows = with_next(docs, lambda found: with_digest(found, "text", "digest"))
    rows = with_canonical(rows.withColumn("edit", edited(F.col("text"), F.col("next_text"))), "edit", "c_edit")
    rows = rows.withColumn("edit_digest", wide_digest(F.col("c_edit")))
    equal = lambda digest, canon: F.when(F.col("digest") == F.col(digest), canonical(F.col("text")) == canon).otherwise(F.lit(False)).cast("double")
    some = clash.limit(1).count() > 0
    out = rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edit", 256).alias("edited_sha256"),
        F.col("digest").alias("fingerprint"),
        F.col("edit_digest").alias("edited_fingerprint"),
        equal("edit_digest", F.col("c_edit")).alias("near_edited"),
        equal("next_digest", canonical(F.col("next_text"))).alias("near_next"),
        *((F.sha2(canonical(F.col("text")), 256).alias("fingerprint_more"), F.sha2("c_edit", 256).alias("edited_fingerprint_more")) if some else ()),
    )
    for name in ("fingerprint", "edited_fingerprint") if some else ():
        mark = clash.select(F.col("digest").alias(name), F.lit(True).alias("clash"))
        out = out.join(mark, name, "left").withColumn(name, F.when(F.col("clash"), F.concat(name, F.lit("-"), f"{name}_more")).otherwise(F.col(name))).drop("clash")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
