"""Answer context: windows around hits, budgets, sentence deduplication, citations."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHARACTERS_PER_TOKEN = 4
#: A sentence with its closing marks; shared with the SQL of the tests.
SENTENCE = r"[^.!?\n]+[.!?]*"


def context_windows(hits: DataFrame, query: str, document: str, radius: int) -> DataFrame:
    """query, document, window, first, last, primary_rank: ranges around the ordinals of hits, touching ones merged."""
    spans = hits.select(query, document, "rank", F.greatest(F.lit(0), F.col("ordinal") - radius).alias("first"), (F.col("ordinal") + radius).alias("last"))
    line = Window.partitionBy(query, document).orderBy("first", "last", "rank")
    reach = F.max("last").over(line.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("reach", reach)
    fresh = F.when(F.col("reach").isNull() | (F.col("first") > F.col("reach") + 1), 1).otherwise(0)
    spans = spans.withColumn("fresh", fresh).withColumn("window", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy(query, document, "window").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.min("rank").alias("primary_rank"))


def window_chunks(windows: DataFrame, chunks: DataFrame, document: str) -> DataFrame:
    """Chunks whose ordinal lies in a window: an equi-join on the document with a range condition."""
    return windows.join(chunks, document).where("ordinal between first and last")


def primary_hits(hits: DataFrame, windows: DataFrame, query: str, document: str) -> DataFrame:
    """Of each window the hit of best rank, in the order of ranks."""
    return hits.join(windows.select(query, document, F.col("primary_rank").alias("rank")), [query, document, "rank"], "left_semi")


def fetch_chunks(chunks: DataFrame, document_id, index: int, before: int = 0, after: int = 0) -> DataFrame:
    b, a = (max(0, min(5, x)) for x in (before, after))
    return chunks.where((F.col("document_id") == document_id) & F.col("ordinal").between(index - b, index + a)).orderBy("ordinal")


def budget(sources: DataFrame, query: str, text: str, tokens: int = 6000, order: str = "rank") -> DataFrame:
    """Sources in order until tokens * 4 characters are used; the last one is cut."""
    limit = tokens * CHARACTERS_PER_TOKEN
    before = F.sum(F.length(text)).over(Window.partitionBy(query).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    left = F.lit(limit) - F.coalesce(before, F.lit(0))
    rows = sources.withColumn("remaining", left).where("remaining > 0")
    return rows.withColumn(text, F.substring(F.col(text), F.lit(1), F.col("remaining").cast("int"))).drop("remaining")


def text_window(body: Column, offset: int, most: int) -> tuple[Column, Column]:
    """A part of a document for a tool result, and how many characters remain after it."""
    return F.substring(body, offset + 1, most), F.greatest(F.lit(0), F.length(body) - offset - most)


def graded_yes(chunks: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """Chunks but those graded no; unclear or missing verdicts keep them."""
    met = chunks.join(verdicts, keys, "left")
    return met.where(F.coalesce(F.lower(F.trim("verdict")), F.lit("?")) != "no").drop("verdict")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"({SENTENCE})"), 1), lambda s: F.trim(s)), lambda s: s != "")


def left_whole(text: Column, most: int = 300) -> Column:
    """Whether compression leaves a source alone: code, or more than ``most`` sentences."""
    return text.contains("```") | (F.size(sentences(text)) > most)


def distinct_sentences(sources: DataFrame, query: str, text: str) -> DataFrame:
    """query, rank, pos, sentence, whole: each sentence where it first stands in a query's sources, compared in lower case
    with white space collapsed. Sources that are left whole come as they are, in one row."""
    rows = sources.withColumn("whole", left_whole(F.col(text)))
    kept = rows.where("whole").select(query, "rank", F.lit(0).alias("pos"), F.col(text).alias("sentence"), "whole")
    rows = rows.where("not whole").select(query, "rank", F.posexplode(sentences(F.col(text))).alias("pos", "sentence"), "whole")
    normal = F.lower(F.regexp_replace("sentence", r"\s+", " "))
    first = Window.partitionBy(query, normal).orderBy("rank", "pos")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n").unionByName(kept)


def verification(supported: Column, revised: Column, policy: Column) -> Column:
    return F.when(supported.isNull(), "unavailable").when(supported, "verified").when(policy == "block", "blocked").when((policy == "revise") & F.coalesce(revised, F.lit(False)), "revised").otherwise("unsupported")


def source_blocks(sources: DataFrame, query: str, text: str) -> DataFrame:
    """One text a query: its sources between marks, in the order of ranks."""
    block = F.concat(F.lit("[SOURCE "), F.col("rank").cast("string"), F.lit("]\n"), F.col(text), F.lit("\n[END SOURCE "), F.col("rank").cast("string"), F.lit("]"))
    rows = sources.select(query, F.struct("rank", block.alias("b")).alias("s")).groupBy(query).agg(F.sort_array(F.collect_list("s")).alias("s"))
    return rows.select(query, F.array_join(F.transform("s", lambda s: s["b"]), "\n\n").alias("context"))


def used_citations(answers: DataFrame, key: str, text: str, sources: DataFrame) -> DataFrame:
    """key, citation, title, uri: citations [n] or [SOURCE n] of an answer that have a linkable source."""
    cited = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\[(?:SOURCE )?(\d+)\]"), 1))
    rows = answers.select(key, F.explode(cited).alias("c")).select(key, F.expr("try_cast(c as int)").alias("citation"))
    return rows.join(sources, [key, "citation"]).where(F.col("uri").rlike("^https?://"))


_SUPERSCRIPT = dict(zip("0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹"))


def superscript_citations(text: Column) -> Column:
    """Citations [n] and [SOURCE n] as raised digits."""
    marked = F.regexp_replace(text, r"\[(?:SOURCE )?(\d+)\]", "\u0001$1\u0002")
    parts = F.split(marked, "\u0001")
    plain, raised = "".join(_SUPERSCRIPT), "".join(_SUPERSCRIPT.values())
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.concat(F.translate(F.substring_index(p, "\u0002", 1), plain, raised), F.regexp_replace(p, "(?s)^[^\u0002]*\u0002", "")))
    return F.concat(F.element_at(parts, 1), F.array_join(rest, ""))


_MARK = r"[ \t]*\[(?:SOURCE\s+)?\d+\]"


def annotated_answers(answers: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """``answers`` (key, text) with marks [n] and [SOURCE n] as raised digits where the answer has a source n with a link, and behind
    a rule the list of those that were cited, by their numbers: key, text. ``sources``: key, citation, title, link (http or null).

    The blanks before a mark go, but not at the start of a line. Other marks stay as they are, and a text without any
    source that can be linked is left alone. Links come from the sources only."""
    linked = sources.where(F.lower("link").rlike("^https?://")).groupBy(key, "citation").agg(F.min_by(F.struct(F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("link")).alias("label"), "link"), "link").alias("s"))
    known = linked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("citation", "s"))).alias("known"))
    rows = answers.select(key, "text").join(known, key, "left")
    marks = F.regexp_extract_all("text", F.lit(_MARK), F.lit(0))
    rows = rows.withColumns({"parts": F.split("text", _MARK, -1), "marks": marks})
    number = lambda m: F.regexp_extract(m, r"(\d+)\]$", 1).try_cast("int")
    plain, raised = "".join(_SUPERSCRIPT), "".join(_SUPERSCRIPT.values())

    def shown(m: Column, i: Column) -> Column:
        before = F.element_at(F.col("parts"), i + 1)
        opens = before.endswith("\n") | ((i == 0) & (before == ""))
        blanks = F.when(opens, F.regexp_extract(m, r"^[ \t]*", 0)).otherwise("")
        there = F.coalesce(F.map_contains_key("known", number(m)), F.lit(False))
        return F.struct(F.when(there, F.concat(blanks, F.translate(number(m).cast("string"), plain, raised))).otherwise(m).alias("text"), F.when(there, number(m)).alias("n"))

    rows = rows.withColumn("shown", F.transform("marks", shown))
    body = F.array_join(F.transform("parts", lambda p, i: F.concat(p, F.coalesce(F.get(F.col("shown.text"), i), F.lit("")))), "")
    used = F.array_sort(F.array_distinct(F.filter(F.col("shown.n"), lambda n: n.isNotNull())))
    entry = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("] ["), F.element_at("known", n)["label"], F.lit("]("), F.element_at("known", n)["link"], F.lit(")"))
    listed = F.when(F.size(used) > 0, F.concat(F.lit("\n\n---\n\n"), F.array_join(F.transform(used, entry), "\n"))).otherwise("")
    return rows.select(key, F.when(F.trim("text") == "", F.col("text")).otherwise(F.concat(body, listed)).alias("text"))


def answer_images(images: DataFrame, query: str, most: int = 4, most_bytes: int = 12 << 20) -> DataFrame:
    """query, n, id, mark: images of an answer in the order of ranks, at most ``most``. One that would take the bytes
    together beyond bounds is passed over; smaller ones after it may still fit."""
    rows = images.groupBy(query).agg(F.array_sort(F.collect_list(F.struct("rank", "id", F.col("size").cast("long").alias("size")))).alias("all"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("ids"))
    fits = lambda s, x: (F.size(s["ids"]) < most) & (s["total"] + x["size"] <= most_bytes)
    step = lambda s, x: F.when(fits(s, x), F.struct((s["total"] + x["size"]).alias("total"), F.concat(s["ids"], F.array(x["id"].cast("string"))).alias("ids"))).otherwise(s)
    kept = rows.select(query, F.posexplode(F.aggregate("all", start, step, lambda s: s["ids"])).alias("pos", "id"))
    return kept.select(query, (F.col("pos") + 1).alias("n"), "id", F.format_string("[[image:%d]]", F.col("pos") + 1).alias("mark"))


PROMPT_LENGTH = 4000


def clean_prompt(text: str | None) -> str | None:
    """Equal line ends, no control characters but those and tabs; null where nothing is left, an error if it is too long."""
    plain = (text or "").replace("\r\n", "\n").replace("\r", "\n")
    plain = "".join(c for c in plain if c in "\n\t" or unicodedata.category(c) != "Cc").strip()
    if len(plain) > PROMPT_LENGTH:
        raise ValueError(f"a prompt has at most {PROMPT_LENGTH} characters")
    return plain or None


def system_prompt(built_in: str, installation: str | None = None, crate: str | None = None) -> str:
    """The built-in rules, then the layers that say something; earlier layers win over later ones."""
    layers = (("Rules of this installation", installation), ("Wishes of this crate, within the rules above", crate))
    return "\n\n".join([built_in, *(f"{head}:\n{text}" for head, layer in layers if (text := clean_prompt(layer)))])


#: Limits of a request.
QUESTION_LENGTH, HISTORY_MESSAGES, ROLES = 8000, 20, ("user", "assistant")


def check_request(question: str, history: list[tuple[str, str]] = ()) -> None:
    if not question or not question.strip() or len(question) > QUESTION_LENGTH:
        raise ValueError(f"a question of at most {QUESTION_LENGTH} characters is needed")
    if len(history) > HISTORY_MESSAGES:
        raise ValueError(f"at most {HISTORY_MESSAGES} messages of history")
    for role, text in history:
        if role not in ROLES or not text or len(text) > QUESTION_LENGTH:
            raise ValueError("messages have a role of user or assistant, and a text")
