"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only in local mode where the session names no folder (tests, the bench): there one machine is all there is.
LOCAL_SHARED = "/tmp/checkpoints"
#: Bytes of a batch that a Python function gets at once.
BATCH_BYTES = 8 << 20
#: Rows here are whole texts, so batches are bounded by bytes; smaller column batches keep the readers' memory even.
WIDE_ROWS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.parquet.columnarReaderBatchSize": "1024",
}

Batches = Iterator[pa.RecordBatch]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from ``spark.checkpoint.dir``. Only a local session may leave
    it unset; elsewhere a machine's own folder would not be found by the others, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = LOCAL_SHARED
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, so a lost executor costs no more
    than its own tasks. The files go when the JVM ends, or with ``forget``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._millrace_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _cut(batch: pa.RecordBatch, size: int) -> Batches:
    if batch.num_rows < 2 or batch.nbytes <= size:
        yield batch
        return
    half = batch.num_rows // 2
    yield from _cut(batch.slice(0, half), size)
    yield from _cut(batch.slice(half), size)


def lean(run: Callable[[Batches], Batches], size: int = BATCH_BYTES) -> Callable[[Batches], Batches]:
    """A function for mapInArrow that works on batches of at most ``size`` bytes (or one row), and gives the memory that
    its worker holds back to the machine when the task ends, since workers live on."""

    def each(batches: Batches) -> Batches:
        try:
            yield from run(part for batch in batches for part in _cut(batch, size))
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # not glibc
                pass

    return each


def groups(batches: Batches) -> Iterator[pa.Table]:
    """The rows of each value of the first column, where equal values follow each other: one group at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = batch.column(0).to_pylist()
        start = 0
        while start < len(keys):
            end = start + 1
            while end < len(keys) and keys[end] == keys[start]:
                end += 1
            if held and keys[start] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
            last, start = keys[start], end
    if held:
        yield pa.Table.from_batches(held)


def by_group(rows: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Rows dealt by ``key`` and sorted by it inside a partition, as ``groups`` wants them; the sort spills."""
    dealt = rows.repartition(n, F.col(key)) if n else rows.repartition(F.col(key))
    return dealt.sortWithinPartitions(key)


def buckets_for(docs: DataFrame, size: int = 16 << 20) -> int:
    """Buckets of about ``size`` stored bytes for something as large as ``docs``, at least the shuffle partitions."""
    stored = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(partitions(docs.sparkSession), min(1 << 20, -(-stored // size)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    for key, value in WIDE_ROWS.items():
        spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
