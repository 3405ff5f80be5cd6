"""Index generations and other tables that are written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert_documents(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """All records of the incoming parents are replaced."""
    return current.join(incoming.select("parent_id").distinct(), "parent_id", "left_anti").unionByName(incoming)


def delete_documents(current: DataFrame, ids: DataFrame) -> DataFrame:
    return current.join(ids.select("parent_id").distinct(), "parent_id", "left_anti")


def gauge_changes(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Series to publish, and those that are no longer among them."""
    return new, old.join(new.select(*keys), keys, "left_anti").select(*keys)


def purge(tables: dict[str, DataFrame], crate: str) -> dict[str, DataFrame]:
    return {n: t.where(F.col("crate_id") != crate) for n, t in tables.items()}


def duplicate(rows: DataFrame, crate: str, new_crate: str) -> DataFrame:
    return rows.where(F.col("crate_id") == crate).withColumn("crate_id", F.lit(new_crate))


def put_artifacts(rows: DataFrame, path: str, most_bytes: int) -> DataFrame:
    """Artifacts (name, content) written below their digest, one for each content; returns name, sha256, size, accepted.
    Contents beyond ``most_bytes`` are not written, nor those that lie there already. A write is whole or not there."""
    marked = rows.withColumns({"sha256": F.sha2("content", 256), "size": F.octet_length("content").cast("long")}).withColumn("accepted", F.col("size") <= most_bytes)
    fresh = marked.where("accepted").groupBy("sha256").agg(F.first("content").alias("content"))
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        fresh = fresh.join(spark.read.schema(fresh.schema).parquet(path).select("sha256"), "sha256", "left_anti")
    fresh.write.mode("append").parquet(path)
    return marked.select("name", "sha256", "size", "accepted")


def append_audit(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").parquet(path)


def newest_audit(entries: DataFrame, at: str, key: str, n: int = 100) -> DataFrame:
    return entries.orderBy(F.desc(at), F.desc(key)).limit(n)


def duplicate_configuration(tables: dict[str, DataFrame], crate: str, new_crate: str, ids: dict[str, str], refers: dict[str, dict[str, str]] | None = None) -> dict[str, DataFrame]:
    """The rows of a crate copied under a new one. ``ids``: the id column of each table; copies get ids made from the old
    one and the new crate, and columns in ``refers`` (table to column to table) follow their target."""
    fresh = lambda table, column: F.sha2(F.concat_ws(":", F.lit(table), F.lit(new_crate), F.col(column).cast("string")), 256)
    out = {}
    for name, rows in tables.items():
        own = rows.where(F.col("crate_id") == crate).withColumn("crate_id", F.lit(new_crate))
        for column, target in (refers or {}).get(name, {}).items():
            own = own.withColumn(column, F.when(F.col(column).isNotNull(), fresh(target, column)))
        out[name] = own.withColumn(ids[name], fresh(name, ids[name]))
    return out
