"""Index generations: immutable snapshots of a crate's records, batches written beside them, and a pointer to the active one.

Below the root of an index:

crates/crate_id=C/generation=N/records/batch=B   Parquet, in ranges of the key; batch -1 is the build, others streamed
crates/crate_id=C/generation=N/manifest/batch=B  JSON lines: file, rows, low and high key of each file of the batch
pointers/crate_id=C                              a JSON object naming the active generation
building/crate_id=C                              the generation that is being built

A record of a batch replaces all records of its key from batches with smaller numbers; a record with ``deleted`` takes the key
away. The pointer is written beside its place and renamed over it, so readers see the old generation or the new one.

``register`` makes the format ``millrace_index`` known to a session: a data source that plans one task for each file it
must open, from pointers and manifests alone. Equality on crate_id, generation and the key is decided before any
file is opened; what remains of the key is decided by row groups. Without a generation the active one is read. The file
system must be one that Arrow opens (local, S3, HDFS, GCS).
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

BUILD = -1
#: The key of records: all records of a document share it.
KEY = "parent_id"


class Index:
    """An index below ``root``; ``records`` have a column parent_id (string) and any others but crate_id, generation,
    batch and deleted."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # files

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folder(self, crate: str, generation: int) -> str:
        return f"crates/crate_id={crate}/generation={generation}"

    def _write(self, name: str, value: dict, overwrite: bool = True) -> None:
        out = self._fs().create(self._path(name), overwrite)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()

    def _read(self, name: str) -> dict | None:
        fs, path = self._fs(), self._path(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    # generations

    def active(self, crate: str) -> int | None:
        """The generation that the pointer names; a pointer that cannot be read is an error."""
        found = self._read(f"pointers/crate_id={crate}")
        return found["generation"] if found else None

    def building(self, crate: str) -> int | None:
        found = self._read(f"building/crate_id={crate}")
        return found["generation"] if found else None

    def _generations(self, crate: str) -> list[int]:
        fs, path = self._fs(), self._path(f"crates/crate_id={crate}")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return [int(n.partition("=")[2]) for n in names if n.startswith("generation=")]

    def begin(self, crate: str) -> int:
        """Number of the generation whose build begins: from now on streamed batches reach it as well. One build at a time:
        the marker is created, never replaced."""
        number = max([0, *self._generations(crate)]) + 1
        self._write(f"building/crate_id={crate}", {"generation": number}, overwrite=False)
        return number

    def put(self, crate: str, generation: int, records: DataFrame, batch: int = BUILD) -> int:
        """Write one batch of records and its manifest; the same batch again replaces itself. Returns its rows."""
        base = f"{self.root}/{self._folder(crate, generation)}"
        rows = records if "deleted" in records.columns else records.withColumn("deleted", F.lit(False))
        rows = rows.withColumn(KEY, F.col(KEY).cast("string"))
        rows.repartitionByRange(F.col(KEY)).sortWithinPartitions(KEY).write.mode("overwrite").parquet(f"{base}/records/batch={batch}")
        # counts come from what lies there, not from what was sent
        written = self.spark.read.schema(rows.schema).parquet(f"{base}/records/batch={batch}")
        files = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), F.min(KEY).alias("low"), F.max(KEY).alias("high"))
        files.coalesce(1).write.mode("overwrite").json(f"{base}/manifest/batch={batch}")
        self._write(f"{self._folder(crate, generation)}/schema", json.loads(rows.schema.json()))
        return self.spark.read.schema("rows long").json(f"{base}/manifest/batch={batch}").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]

    def activate(self, crate: str, generation: int) -> None:
        """The pointer names ``generation`` from now on."""
        name = f"pointers/crate_id={crate}"
        self._write(f"{name}.new-{generation}", {"generation": generation})
        jvm = self.spark._jvm.org.apache.hadoop.fs
        files = jvm.FileContext.getFileContext(self._path().toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.Options.Rename, 1)
        options[0] = jvm.Options.Rename.OVERWRITE
        files.rename(self._path(f"{name}.new-{generation}"), self._path(name), options)
        self._fs().delete(self._path(f"building/crate_id={crate}"), False)

    def abandon(self, crate: str, generation: int) -> None:
        """A build that failed leaves no trace: first no batch finds it any more, then its files go."""
        self._fs().delete(self._path(f"building/crate_id={crate}"), False)
        self._fs().delete(self._path(self._folder(crate, generation)), True)

    def build(self, crate: str, records: DataFrame, expected: int | None = None) -> int:
        """A whole new generation, active once its rows are counted (against ``expected`` if given). A failure leaves the
        active generation as it was."""
        number = self.begin(crate)
        try:
            found = self.put(crate, number, records)
            if expected is not None and found != expected:
                raise RuntimeError(f"the generation has {found} of {expected} rows")
            self.activate(crate, number)
        except BaseException:
            self.abandon(crate, number)
            raise
        return number

    def drop(self, crate: str, generation: int) -> None:
        if generation == self.active(crate):
            raise ValueError("the active generation stays")
        self._fs().delete(self._path(self._folder(crate, generation)), True)

    def dual_write(self, crate: str) -> Callable[[DataFrame, int], None]:
        """A foreachBatch function: each batch goes to the active generation and to the one that is being built, under its own
        number. A batch that is run again replaces itself in both, also where the pointer moved in between: the generation
        that was being built has it already or gets it now."""

        def write(batch: DataFrame, number: int) -> None:
            targets = {g for g in (self.active(crate), self.building(crate)) if g is not None}
            if not targets:
                raise LookupError(f"{crate} has no generation to write to")
            batch.persist()
            try:
                for generation in sorted(targets):
                    self.put(crate, generation, batch, number)
            finally:
                batch.unpersist()

        return write

    # reading

    def scan(self, crate: str | None = None, generation: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """Records as they lie there, by the data source: crate_id, generation, batch, deleted and the records' columns."""
        register(self.spark)
        rows = self.spark.read.format(IndexSource.name()).option("path", self.root).load()
        for column, value in (("crate_id", crate), ("generation", generation)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        return rows if keys is None else rows.where(F.col(KEY).isin(*keys))

    def records(self, crate: str | None = None, generation: int | None = None, keys: list[str] | None = None) -> DataFrame:
        """Records that are in force: those of the last batch of their key, unless it took the key away."""
        rows = self.scan(crate, generation, keys)
        last = rows.groupBy("crate_id", "generation", KEY).agg(F.max("batch").alias("batch"))
        return rows.join(last, ["crate_id", "generation", KEY, "batch"]).where("not deleted").drop("batch", "deleted")


@dataclass
class FilePart(InputPartition):
    crate: str
    generation: int
    batch: int
    path: str
    keys: tuple[str, ...] | None


class IndexSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_index"

    def schema(self) -> StructType:
        """Columns of the widest schema among active generations, behind the columns that name the place."""
        own = StructType().add("crate_id", StringType()).add("generation", IntegerType()).add("batch", LongType())
        seen = {}
        files, root = _opened(self.options["path"])
        for crate, generation in _active(files, root).items():
            for field in StructType.fromJson(_json(files, f"{root}/crates/crate_id={crate}/generation={generation}/schema")):
                seen.setdefault(field.name, field)
        for field in seen.values():
            own.add(field.name, field.dataType, True)
        return own

    def reader(self, schema: StructType) -> DataSourceReader:
        return IndexReader(self.options["path"], schema)


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _names(files, folder: str) -> list[str]:
    from pyarrow import fs

    return [f.base_name for f in files.get_file_info(fs.FileSelector(folder, allow_not_found=True))]


def _json(files, path: str) -> dict:
    with files.open_input_stream(path) as f:
        return json.loads(f.read())


def _active(files, root: str) -> dict[str, int]:
    names = [n for n in _names(files, f"{root}/pointers") if n.startswith("crate_id=") and ".new-" not in n]
    return {n.partition("=")[2]: _json(files, f"{root}/pointers/{n}")["generation"] for n in names}


class IndexReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.kind = path, schema
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]):
        """Equality on crate_id, generation and the key is taken over whole; the rest stays with Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            column = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if column in ("crate_id", "generation", KEY):
                self.wanted[column] = self.wanted[column] & values if column in self.wanted else values
            else:
                yield f

    def _places(self, files, root: str) -> Iterator[tuple[str, int]]:
        crates, generations = self.wanted.get("crate_id"), self.wanted.get("generation")
        for crate, active in sorted(_active(files, root).items()):
            if crates is None or crate in crates:
                if generations is None:
                    yield crate, active
                    continue
                there = {int(n.partition("=")[2]) for n in _names(files, f"{root}/crates/crate_id={crate}")}
                yield from ((crate, g) for g in sorted(there & generations))

    def partitions(self) -> list[FilePart]:
        files, root = _opened(self.path)
        keys = self.wanted.get(KEY)
        keys = None if keys is None else sorted(k for k in keys if k is not None)
        out = []
        for crate, generation in self._places(files, root):
            base = f"{root}/crates/crate_id={crate}/generation={generation}"
            for batch in _names(files, f"{base}/manifest"):
                for part in _names(files, f"{base}/manifest/{batch}"):
                    if not part.startswith("part-"):
                        continue
                    with files.open_input_stream(f"{base}/manifest/{batch}/{part}") as f:
                        entries = [json.loads(line) for line in f.read().splitlines()]
                    for e in entries:
                        own = None if keys is None else tuple(k for k in keys if "low" in e and e["low"] <= k <= e["high"])
                        if own is None or own:
                            out.append(FilePart(crate, generation, int(batch.partition("=")[2]), f"{base}/records/{batch}/{e['file']}", own))
        return out

    def read(self, partition: FilePart | None):
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(self.kind)
        if partition is None:  # nothing was planned
            return
        files, _ = _opened(self.path)
        rows = ds.dataset(partition.path, filesystem=files, format="parquet")
        keep = None if partition.keys is None else ds.field(KEY).isin(list(partition.keys))
        place = {"crate_id": partition.crate, "generation": partition.generation, "batch": partition.batch}
        there = set(rows.schema.names)
        for batch in rows.to_batches(filter=keep, columns=[n for n in kind.names if n in there and n not in place]):
            if batch.num_rows:
                columns = [pa.array([place[f.name]] * batch.num_rows, f.type) if f.name in place else batch.column(f.name).cast(f.type) if f.name in there else pa.nulls(batch.num_rows, f.type) for f in kind]
                yield pa.RecordBatch.from_arrays(columns, schema=kind)


def register(spark: SparkSession) -> None:
    """Make the format known; filters reach Python data sources only where the session says so."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(IndexSource)
