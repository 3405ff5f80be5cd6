"""Files, artifacts, bundles and golden sets in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import path_glob_to_regex

GOLDEN_SCHEMA = "question string, referenceAnswer string, relevantUris array<string>"
LFS_PREFIX = "version https://git-lfs.github.com/spec/v1"


def path_included(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    ok = F.lit(not include)
    for p in include:
        ok = ok | path.rlike(path_glob_to_regex(p))
    for p in exclude:
        ok = ok & ~path.rlike(path_glob_to_regex(p))
    return ok


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8192, or no valid UTF-8."""
    head = F.hex(F.substring(content, 1, 8192))
    return head.rlike("^(?:[0-9A-F]{2})*?00") | ~F.is_valid_utf8(content.cast("string"))


def is_lfs_pointer(content: Column) -> Column:
    return F.substring(content, 1, len(LFS_PREFIX)).cast("string") == LFS_PREFIX


def scan_tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), most_bytes: int = 1 << 20, most_files: int | None = None) -> DataFrame:
    """path, length, content, sha256 of the text files below a folder, by path; size and path are tested before any
    content is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    relative = F.regexp_replace("path", rf"^.*?{base}/", "")
    rows = rows.where(F.col("length").between(1, most_bytes)).withColumn("path", relative).where(path_included(F.col("path"), list(include), list(exclude)))
    rows = rows.where(~is_binary(F.col("content")) & ~is_lfs_pointer(F.col("content")))
    rows = rows.select("path", "length", "content", F.sha2("content", 256).alias("sha256"))
    return rows.orderBy("path").limit(most_files) if most_files else rows


def read_golden(spark: SparkSession, path: str, most: int = 200) -> DataFrame:
    """Golden questions of a JSON array; anything malformed, empty or too much fails as a whole."""
    rows = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad, n = rows.agg(F.count_if(F.coalesce(F.trim("question"), F.lit("")) == ""), F.count("*")).first()
    if bad or not 0 < n <= most:
        raise ValueError(f"{n} items, {bad} without a question; 1 to {most} are taken")
    return rows


def verified_documents(feedback: DataFrame, sources: DataFrame) -> DataFrame:
    """A document for each approved rating: question, answer and what it is based on."""
    titles = sources.groupBy("feedback_id").agg(F.sort_array(F.collect_set("title")).alias("titles"))
    based = F.concat(F.lit("\n\n# Based on\n"), F.array_join(F.transform("titles", lambda t: F.concat(F.lit("- "), t)), "\n"))
    body = F.concat(F.lit("# Question\n"), F.col("question"), F.lit("\n\n# Verified answer\n"), F.col("answer"), F.coalesce(based, F.lit("")))
    met = feedback.where("state = 'APPROVED'").join(titles, "feedback_id", "left")
    return met.select(F.concat(F.lit("feedback:"), F.col("feedback_id")).alias("document_id"), body.alias("body"))


def export_bundle(tables: dict[str, DataFrame], path: str, secrets: tuple[str, ...] = ("password", "secret", "token", "api_key")) -> None:
    """Every table as JSON lines without secret columns, with a manifest of rows and checksums."""
    manifest = None
    for name, rows in tables.items():
        kept = rows.select(*(c for c in rows.columns if not any(s in c.lower() for s in secrets)))
        lines = kept.select(F.to_json(F.struct(*kept.columns)).alias("value"))
        lines.write.mode("overwrite").text(f"{path}/{name}")
        part = lines.agg(F.lit(name).alias("name"), F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string").alias("checksum"))
        manifest = part if manifest is None else manifest.unionByName(part)
    if manifest is not None:
        manifest.write.mode("overwrite").json(f"{path}/manifest")


def import_bundle(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a bundle; rows and checksums must be those of its manifest."""
    want = {r.name: (r.n, r.checksum) for r in spark.read.schema("name string, n long, checksum string").json(f"{path}/manifest").collect()}
    out = {}
    for name, schema in schemas.items():
        lines = spark.read.text(f"{path}/{name}")
        found = lines.agg(F.count("*"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).cast("string")).first()
        if tuple(found) != want.get(name):
            raise ValueError(f"{name} is not what the manifest says")
        out[name] = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return out


def remapped(rows: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Rows with old ids replaced by new ones (old_id, new_id); an id that is not mapped is an error to look for with
    ``unmapped``."""
    for c in columns:
        m = ids.select(F.col("old_id").alias(c), F.col("new_id").alias("__new"))
        rows = rows.join(m, c, "left").withColumn(c, F.coalesce("__new", c)).drop("__new")
    return rows


def unmapped(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    return rows.join(ids.select(F.col("old_id").alias(column)), column, "left_anti")
