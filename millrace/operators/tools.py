"""What a tool of an assistant gets: passages, documents, lists. Each is a function of tables that gives a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of all passages of a search, hits of a search, characters of a document, rows of a list, each with
#: what holds if nothing is asked for.
PASSAGE_BUDGET = 40_000
HITS, MOST_HITS = 8, 25
CHARACTERS, MOST_CHARACTERS = 20_000, 60_000
ROWS, MOST_ROWS = 25, 200


def bounded(asked: int | None, usual: int, most: int) -> int:
    return max(1, min(most, usual if asked is None else asked))


def passages(hits: DataFrame, query: str, limit: int | None = None, budget: int = PASSAGE_BUDGET) -> DataFrame:
    """``hits``: query, rank (from 1), title, uri, content, snippet. query, citation, title (the address where there is none), uri, body,
    truncated, omitted: the passages that fit into the budget of their query, the last one cut where it ends; omitted tells how
    many hits of the query were left out. The rows before a passage decide alone, so queries are independent."""
    top = hits.where(F.col("rank") <= bounded(limit, HITS, MOST_HITS))
    body = F.coalesce("content", "snippet", F.lit(""))
    line = Window.partitionBy(query).orderBy("rank")
    rows = top.withColumn("body", body).withColumn("before", F.coalesce(F.sum(F.length("body")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    whole = Window.partitionBy(query)
    shown = F.col("before") < budget
    rows = rows.withColumns({"citation": F.row_number().over(line), "omitted": F.count("*").over(whole) - F.count_if(shown).over(whole)}).where(shown)
    left = (F.lit(budget) - F.col("before")).cast("int")
    title = F.coalesce(F.when(F.trim("title") != "", F.col("title")), F.col("uri"))
    return rows.select(query, "citation", title.alias("title"), "uri", F.substring(F.col("body"), F.lit(1), left).alias("body"), (F.length("body") > left).alias("truncated"), "omitted")


def document_windows(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``requests``: request, document_id, offset, most (both may be null). request, document_id, found, title, body, characters,
    offset, remaining: the part of each document that was asked for; offsets beyond the end give an empty part."""
    met = requests.join(documents.select("document_id", "title", F.coalesce("body", F.lit("")).alias("text"), F.lit(True).alias("there")), "document_id", "left")
    n = F.length("text")
    start = F.when(n.isNotNull(), F.least(F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)), n))
    size = F.greatest(F.lit(1), F.least(F.lit(MOST_CHARACTERS), F.coalesce("most", F.lit(CHARACTERS))))
    found = F.coalesce("there", F.lit(False))
    rows = met.select("request", "document_id", found.alias("found"), "title", F.substring(F.col("text"), start + 1, size).alias("body"), n.alias("characters"), start.alias("offset"))
    return rows.withColumn("remaining", F.col("characters") - F.col("offset") - F.length("body"))


def document_list(documents: DataFrame, chunks: DataFrame, crate: str, query: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page of a crate's current documents, the newest first: document_id, title, uri, created_at, chunks, total (all that match).
    ``documents``: crate_id, document_id, title, uri, created_at, current. A query is part of title or address, in any
    case. Pages are whole: an offset inside one gives the page that it lies in. Chunks are counted for the page only."""
    size = bounded(limit, ROWS, MOST_ROWS)
    own = documents.where((F.col("crate_id") == crate) & F.col("current"))
    if query and query.strip():
        inside = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.lower()))
        own = own.where(inside("title") | inside("uri"))
    total = own.agg(F.count("*").alias("total"))  # one row
    page = own.orderBy(F.desc("created_at"), "document_id").offset(max(0, offset) // size * size).limit(size)
    counts = chunks.join(F.broadcast(page.select("document_id")), "document_id").groupBy("document_id").agg(F.count("*").alias("chunks"))
    out = page.join(counts, "document_id", "left").crossJoin(F.broadcast(total))
    return out.select("document_id", "title", "uri", "created_at", F.coalesce("chunks", F.lit(0).cast("long")).alias("chunks"), "total").orderBy(F.desc("created_at"), "document_id")


def endpoint(configuration: Column) -> Column:
    """The address in a source's configuration (JSON), without user, password or query; nothing else of it is shown."""
    address = F.coalesce(F.get_json_object(configuration, "$.git.repositoryUrl"), F.get_json_object(configuration, "$.website.url"))
    return F.regexp_replace(F.regexp_replace(address, r"^([a-z+]+://)[^/@]*@", "$1"), r"[?#].*$", "")


def source_list(sources: DataFrame, jobs: DataFrame, crate: str) -> DataFrame:
    """name, connector, description, endpoint, enabled, jobs of a crate's sources, by name. ``sources``: crate_id, source_id, name,
    connector, description, configuration, enabled; ``jobs``: source_id."""
    own = sources.where(F.col("crate_id") == crate)
    counts = jobs.groupBy("source_id").agg(F.count("*").alias("jobs"))
    met = own.join(counts, "source_id", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0).cast("long")))
    return met.select("name", "connector", "description", endpoint(F.col("configuration")).alias("endpoint"), "enabled", "jobs").orderBy("name")


def crate_list(crates: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """id, name, description, status of the crates that may be addressed, by name: all if ``allowed`` is None."""
    own = crates if allowed is None else crates.where(F.col("id").isin(*allowed)) if allowed else crates.where("false")
    return own.select("id", "name", "description", "status").orderBy("name", "id")
