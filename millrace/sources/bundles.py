"""Import of crate bundles of any schema version.

A bundle is a ZIP with manifest.json (schemaVersion, checksums by entry), data.json (an array for each table) and
artifacts/<acquisition id>. ``unzipped`` turns many bundles into a table of entries, a row for each; ``verified`` holds them against
their manifests; ``tables`` reads the arrays, brings older versions up to the newest step by step and gives rows with
their bundle; ``remapped`` gives every row a new id, and every reference the new id of its target, table by table in the
order of the references. A reference without a target is an error.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import written

NEWEST = 6
#: Columns of each table in the newest version, in the order of their references. Fixed values of the format.
TABLES = {
    "sources": "id string, name string, description string, connectorType string, configurationJson string, enabled boolean",
    "ingestionJobs": "id string, sourceId string, name string, configurationJson string, enabled boolean, mode string, cronExpression string, tokenConfigured boolean",
    "ingestionRuns": "id string, ingestionJobId string, sourceId string, status string, sourceConfigurationJson string, jobConfigurationJson string, resolvedRevision string",
    "sourceItems": "id string, runId string, locator string, sourceUri string, depth int, status string",
    "acquisitions": "id string, runId string, sourceItemId string, requestedLocator string, finalLocator string, statusCode int, contentType string, charset string, durationMs long, outcome string, errorMessage string",
    "documents": "id string, runId string, acquisitionId string, sourceUri string, identityUri string, versionNumber int, currentVersion boolean, title string, language string, description string, author string, body string, contentHash string, metadataJson string",
    "chunks": "id string, documentId string, ordinal int, heading string, content string, contentHash string, kind string, language string, symbol string, startLine int, endLine int, mediaUrl string, overlapChars int",
    "rules": "id string, name string, type string, pattern string, enabled boolean",
    "results": "id string, ruleId string, runId string, documentId string, chunkId string, chunkOrdinal int, matchedValue string, matchStart int, matchEnd int, contextBefore string, contextAfter string",
}
REFERENCES = {
    "ingestionJobs": {"sourceId": "sources"},
    "ingestionRuns": {"ingestionJobId": "ingestionJobs", "sourceId": "sources"},
    "sourceItems": {"runId": "ingestionRuns"},
    "acquisitions": {"runId": "ingestionRuns", "sourceItemId": "sourceItems"},
    "documents": {"runId": "ingestionRuns", "acquisitionId": "acquisitions"},
    "chunks": {"documentId": "documents"},
    "results": {"ruleId": "rules", "runId": "ingestionRuns", "documentId": "documents", "chunkId": "chunks"},
}
#: Names that version 1 had for tables and columns. Fixed values of the format.
FIRST_TABLES = {"sources": "jobs", "ingestionJobs": "jobs", "ingestionRuns": "runs", "sourceItems": "frontier", "acquisitions": "fetches"}
FIRST_COLUMNS = {
    "ingestionJobs": {"sourceId": "id"},
    "ingestionRuns": {"ingestionJobId": "jobId", "sourceId": "jobId", "jobConfigurationJson": "configurationJson"},
    "sourceItems": {"locator": "url", "sourceUri": "canonicalUrl"},
    "acquisitions": {"sourceItemId": "frontierEntryId", "requestedLocator": "requestedUrl", "finalLocator": "finalUrl"},
    "documents": {"acquisitionId": "fetchId", "sourceUri": "canonicalUrl"},
}


def unzipped(spark: SparkSession, path: str) -> DataFrame:
    """bundle (file name), name, content of every entry of the ZIP files below a folder."""

    def entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for info in z.infolist():
                        if not info.is_dir():
                            yield pd.DataFrame({"bundle": [file.rsplit("/", 1)[-1]], "name": [info.filename], "content": [z.read(info)]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInPandas(entries, "bundle string, name string, content binary")


def faults(entries: DataFrame) -> DataFrame:
    """bundle, fault: what speaks against importing a bundle. Names that leave the bundle, no manifest or data, a version that is
    not known, entries that are missing or are not what the manifest says."""
    unsafe = entries.where(F.col("name").startswith("/") | F.col("name").contains("..")).select("bundle", F.concat(F.lit("unsafe entry "), "name").alias("fault"))
    there = entries.groupBy("bundle").agg(F.count_if(F.col("name") == "manifest.json").alias("m"), F.count_if(F.col("name") == "data.json").alias("d"))
    lost = there.where("m <> 1 or d <> 1").select("bundle", F.lit("not one manifest.json and data.json").alias("fault"))
    listed = _manifests(entries)
    unknown = listed.where(F.col("version").isNull() | ~F.col("version").between(1, NEWEST)).select("bundle", F.lit("unsupported schema version").alias("fault"))
    sums = listed.select("bundle", F.explode("checksums").alias("name", "sum"))
    own = entries.select("bundle", "name", F.sha2("content", 256).alias("found"))
    wrong = sums.join(own, ["bundle", "name"], "left").where(~F.col("sum").eqNullSafe(F.col("found")))
    wrong = wrong.select("bundle", F.concat(F.when(F.col("found").isNull(), "missing ").otherwise("checksum mismatch "), F.col("name")).alias("fault"))
    return unsafe.unionByName(lost).unionByName(unknown).unionByName(wrong)


def _manifests(entries: DataFrame) -> DataFrame:
    read = F.from_json(F.col("content").cast("string"), "schemaVersion int, checksums map<string, string>")
    return entries.where("name = 'manifest.json'").select("bundle", read.alias("m")).select("bundle", F.col("m.schemaVersion").alias("version"), "m.checksums")


def verified(entries: DataFrame) -> DataFrame:
    """``entries`` as they are, or an error that names the first fault."""
    first = faults(entries).orderBy("bundle", "fault").first()
    if first:
        raise ValueError(f"{first.bundle}: {first.fault}")
    return entries


def _columns(kind: str) -> list[str]:
    return [c.split()[0] for c in kind.split(", ")]


def _blank_is_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _from_first(rows: DataFrame, name: str) -> DataFrame:
    """Version 1: a job was source and job in one, runs named it alone, pages had addresses where items have locators."""
    old = F.col("version") == 1
    for column, before in FIRST_COLUMNS.get(name, {}).items():
        rows = rows.withColumn(column, F.when(old, F.col(before)).otherwise(F.col(column)))
    if name == "sources":
        rows = rows.withColumn("connectorType", F.when(old, "HTTPS").otherwise(F.col("connectorType")))
    if name == "ingestionRuns":
        rows = rows.withColumn("sourceConfigurationJson", F.when(old, F.col("configurationJson")).otherwise(F.col("sourceConfigurationJson")))
    return rows


def _identities(rows: DataFrame, name: str) -> DataFrame:
    """Before identities were kept, a document was known by its address."""
    return rows.withColumn("identityUri", F.coalesce(_blank_is_null(F.col("identityUri")), F.col("sourceUri"))) if name == "documents" else rows


def _modes(rows: DataFrame, name: str) -> DataFrame:
    """Jobs without a mode are started by hand; only scheduled ones keep a schedule."""
    if name != "ingestionJobs":
        return rows
    mode = F.coalesce(_blank_is_null(F.col("mode")), F.lit("MANUAL"))
    return rows.withColumn("mode", mode).withColumn("cronExpression", F.when(F.col("mode") == "SCHEDULED", _blank_is_null(F.col("cronExpression"))))


def _blanks(rows: DataFrame, name: str) -> DataFrame:
    """Blank descriptions of documents and chunks mean that there are none."""
    optional = {"documents": ("title", "language", "description", "author"), "chunks": ("heading", "kind", "language", "symbol", "mediaUrl"), "acquisitions": ("finalLocator", "contentType", "charset", "errorMessage"), "ingestionRuns": ("resolvedRevision",)}
    return rows.withColumns({c: _blank_is_null(F.col(c)) for c in optional.get(name, ())}) if name in optional else rows


#: Each step takes rows of older versions a step on and leaves what newer ones say.
UPCASTS: tuple[Callable[[DataFrame, str], DataFrame], ...] = (_from_first, _identities, _modes, _blanks)


def tables(entries: DataFrame) -> dict[str, DataFrame]:
    """bundle, position (in its array) and the newest columns of each table's rows."""
    versions = _manifests(entries).select("bundle", "version")
    # null for other entries: filters that the optimizer derives from the arrays may be tried before the name is
    only = F.when(F.col("name") == "data.json", F.col("content").cast("string"))
    data = entries.where("name = 'data.json'").select("bundle", only.alias("data")).join(versions, "bundle")
    out = {}
    for name, kind in TABLES.items():
        extra = sorted(({*FIRST_COLUMNS.get(name, {}).values()} | ({"configurationJson"} if name == "ingestionRuns" else set())) - {*_columns(kind)})
        row = ", ".join([kind, *(f"{c} string" for c in extra)])
        first = FIRST_TABLES.get(name, name)
        both = {name: None, first: None}
        read = F.from_json("data", ", ".join(f"{t} array<struct<{_typed(row)}>>" for t in both), {"mode": "FAILFAST"})
        arrays = data.select("bundle", "version", read.alias("r"))
        chosen = F.when(F.col("version") == 1, F.col(f"r.{first}")).otherwise(F.col(f"r.{name}"))
        rows = arrays.select("bundle", "version", F.posexplode(chosen).alias("position", "row")).select("bundle", "version", "position", "row.*")
        for step in UPCASTS:
            rows = step(rows, name)
        out[name] = rows.select("bundle", "position", *_columns(kind))
    out["documents"] = _numbered(out["documents"], out["ingestionRuns"])
    return out


def _typed(row: str) -> str:
    return ", ".join("`{}`: {}".format(*c.split(" ", 1)) for c in row.split(", "))


def _numbered(documents: DataFrame, runs: DataFrame) -> DataFrame:
    """Documents without a version are numbered in the order of the bundle, by source and identity."""
    of = runs.select("bundle", F.col("id").alias("runId"), F.col("sourceId").alias("__source"))
    line = Window.partitionBy("bundle", "__source", "identityUri").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    counted = documents.join(of, ["bundle", "runId"], "left").withColumn("__n", F.count_if(F.col("versionNumber").isNull()).over(line))
    return counted.withColumn("versionNumber", F.coalesce("versionNumber", F.col("__n").cast("int"))).select(*documents.columns)


def fresh_id(crate: Column, name: str, old: Column) -> Column:
    """The new id of a row: the same for the same crate, so an import that is run again gives the same rows."""
    return F.sha2(F.concat_ws(":", crate, F.lit(name), old), 256)


def remapped(rows: dict[str, DataFrame], crates: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """``crates``: bundle, crate_id. The tables with crate_id in place of the bundle, new ids, and references to new ids; and what
    could not be mapped: table, column, bundle, id. Results need all their targets; a null reference stays null."""
    done: dict[str, DataFrame] = {}
    lost = None
    known: dict[str, DataFrame] = {}
    for name, table in rows.items():
        table = table.join(crates, "bundle").withColumn("__lost", F.array().cast("array<struct<column: string, id: string>>"))
        for column, target in REFERENCES.get(name, {}).items():
            table = table.join(known[target].select("bundle", F.col("old").alias(column), F.col("new").alias("__new")), ["bundle", column], "left")
            lost_here = F.when(F.col("__new").isNull() & F.col(column).isNotNull(), F.struct(F.lit(column).alias("column"), F.col(column).alias("id")))
            table = table.withColumn("__lost", F.array_append("__lost", lost_here)).withColumn(column, F.col("__new")).drop("__new")
        own = F.coalesce("id", F.concat(F.lit("#"), F.col("position").cast("string")))
        table = table.withColumn("__old", own).withColumn("id", fresh_id(F.col("crate_id"), name, F.col("__old")))
        table = written(table, "imported")  # later tables refer to it: nothing is parsed twice
        known[name] = table.select("bundle", F.col("__old").alias("old"), F.col("id").alias("new"))
        done[name] = table.drop("__old", "__lost")
        missing = table.select(F.lit(name).alias("table"), "bundle", F.explode("__lost").alias("l")).where("l is not null").select("table", "bundle", "l.*")
        lost = missing if lost is None else lost.unionByName(missing)
    return done, lost


def import_bundles(entries: DataFrame, crates: DataFrame) -> dict[str, DataFrame]:
    """All tables of verified bundles under their new crates, and ``work``: every document is indexed anew, under a key
    that makes a second import of the same crate no more work. A fault or a reference without target is an error."""
    done, lost = remapped(tables(verified(entries)), crates)
    first = lost.orderBy("table", "column", "bundle", "id").first()
    if first:
        raise ValueError(f"{first.bundle}: {first.table}.{first.column} names {first.id}, which is not there")
    out = {name: t.drop("bundle", "position") for name, t in done.items()}
    key = F.concat_ws(":", "crate_id", F.lit("import-index"), "id")
    out["work"] = out["documents"].select("crate_id", F.lit("INDEX").alias("stage"), F.col("id").alias("document_id"), F.lit(20).alias("priority"), key.alias("idempotency_key"))
    return out
