"""Queries of index generations, streams with state, and bundles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import work_folder
from ..sources.index import Index
from .registry import query, table


def _drained(stream, spark, write, tag: str) -> None:
    """Run a foreachBatch function over all that a stream holds now."""
    state = work_folder(spark, tag)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def _as_stream(df, spark, tag: str):
    """A table written as files, and the stream that reads them, one file a batch."""
    folder = work_folder(spark, tag)
    df.write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _indexed(docs):
    return docs.select(F.col("doc_id").cast("string").alias("parent_id"), F.col("source"), F.col("text").alias("content"))


@query("""
SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS crate_id, CAST(CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END AS INTEGER) AS generation,
  CAST(doc_id AS VARCHAR) AS parent_id, source, CASE WHEN doc_id % 2 = 0 THEN upper(source) ELSE source END AS shown, length(text) AS chars FROM documents
""")
def index_scan(spark, sf_dir):
    """Records of two crates through the data source; one crate was built again."""
    docs = table(spark, sf_dir, "documents")
    index = Index(spark, work_folder(spark, "index"))
    even, odd = (_indexed(docs.where(F.pmod("doc_id", F.lit(2)) == k)).withColumn("shown", F.col("source")) for k in (0, 1))
    index.build("even", even.where("source <> ''"))
    index.build("odd", odd)
    index.build("even", even.withColumn("shown", F.upper("source")))
    return index.scan().select("crate_id", "generation", "parent_id", "source", "shown", F.length("content").alias("chars"))


@query("""
SELECT CAST(2 AS INTEGER) AS generation, CAST(d.doc_id AS VARCHAR) AS parent_id, d.source, CASE WHEN l.doc_id IS NULL THEN length(text) ELSE length(text) + 8 END AS chars
FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL OR l.toxic = 0
""")
def dual_write_index(spark, sf_dir):
    """Labelled documents change, toxic ones are deleted, by a stream that goes on while the next generation is built."""
    docs = table(spark, sf_dir, "documents")
    index = Index(spark, work_folder(spark, "index"))
    index.build("all", _indexed(docs))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("deleted"))
    changes = docs.join(labels, "doc_id")
    changes = changes.select(F.col("doc_id").cast("string").alias("parent_id"), "source", F.concat("text", F.lit(" changed")).alias("content"), "deleted")
    coming = index.begin("all")
    _drained(_as_stream(changes, spark, "changes"), spark, index.dual_write("all"), "stream")
    index.put("all", coming, _indexed(docs))
    index.activate("all", coming)
    return index.records("all").select("generation", "parent_id", "source", F.length("content").alias("chars"))


def _collected(stream, spark, tag: str):
    """What a stream gives in append mode over all that its source holds now."""
    out, state = work_folder(spark, tag), work_folder(spark, f"{tag}-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


#: Events as a queue's: an item for each user and week, kinds by the number of the event, times made narrow.
_KINDS = "CASE WHEN n = 1 THEN 'offer' WHEN event_id % 7 = 0 THEN 'done' WHEN event_id % 11 = 0 THEN 'fail' WHEN event_id % 13 = 0 THEN 'requeue' WHEN event_id % 3 = 0 THEN 'retry' ELSE 'claim' END"
_AT = "TIMESTAMP '2024-01-01' + to_microseconds(CAST((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 900 AS BIGINT))"


@query(f"""
WITH RECURSIVE e AS (SELECT *, user_id * 100 + event_id % 3 AS item_id, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts, event_id) AS n FROM events),
k AS (SELECT item_id, n, {_KINDS} AS kind, {_AT} AS tm FROM e),
s AS (
  SELECT item_id, n, 'PENDING' AS status, 0 AS attempts, tm AS available_at, CAST(NULL AS TIMESTAMP) AS lease_until, 0 AS expired, 1 AS changes FROM k WHERE n = 1
  UNION ALL
  SELECT item_id, n, CASE WHEN does THEN CASE kind WHEN 'claim' THEN 'LEASED' WHEN 'done' THEN 'DONE' WHEN 'requeue' THEN 'PENDING' WHEN 'fail' THEN 'DEAD_LETTER' ELSE CASE WHEN attempts >= 5 THEN 'DEAD_LETTER' ELSE 'RETRY_WAITING' END END ELSE status END,
    CASE WHEN does AND kind = 'claim' THEN attempts + 1 ELSE attempts END,
    CASE WHEN does AND kind = 'retry' AND attempts < 5 THEN tm + to_seconds(least(300, CAST(pow(2, attempts) AS INTEGER))) WHEN does AND kind = 'requeue' THEN tm ELSE available_at END,
    CASE WHEN does THEN CASE WHEN kind = 'claim' THEN tm + INTERVAL 30 SECOND END ELSE lease_until END,
    expired + ended, changes + ended + CAST(does AS INTEGER)
  FROM (
    SELECT *, (kind = 'claim' AND status IN ('PENDING', 'RETRY_WAITING') AND available_at <= tm) OR (kind IN ('done', 'retry') AND status = 'LEASED') OR (kind = 'fail' AND status NOT IN ('DONE', 'DEAD_LETTER')) OR (kind = 'requeue' AND status = 'DEAD_LETTER') AS does
    FROM (
      SELECT k.item_id, k.n, k.kind, k.tm, CASE WHEN s.lease_until < k.tm THEN 'PENDING' ELSE s.status END AS status, s.attempts, CASE WHEN s.lease_until < k.tm THEN s.lease_until ELSE s.available_at END AS available_at,
        CASE WHEN s.lease_until < k.tm THEN NULL ELSE s.lease_until END AS lease_until, s.expired, s.changes, CASE WHEN s.lease_until < k.tm THEN 1 ELSE 0 END AS ended
      FROM s JOIN k ON k.item_id = s.item_id AND k.n = s.n + 1
    ) p
  ) q
), l AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY n DESC) AS back FROM s), w AS (SELECT max(tm) - INTERVAL 10 MINUTE AS mark FROM k)
SELECT item_id, CASE WHEN status = 'LEASED' AND lease_until < mark THEN 'PENDING' ELSE status END AS status, attempts,
  CAST(changes + CASE WHEN status = 'LEASED' AND lease_until < mark THEN 1 ELSE 0 END AS BIGINT) AS changes
FROM l, w WHERE back = 1
""")
def lease_stream(spark, sf_dir):
    """Status, attempts and number of changes of each item after a stream of offers, claims and outcomes."""
    from pyspark.sql import Window

    from ..streaming.keyed import leases

    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").withColumn("n", F.row_number().over(Window.partitionBy("user_id", e % 3).orderBy("ts", "event_id")))
    kind = F.when(F.col("n") == 1, "offer").when(e % 7 == 0, "done").when(e % 11 == 0, "fail").when(e % 13 == 0, "requeue").when(e % 3 == 0, "retry").otherwise("claim")
    start = F.unix_micros(F.lit("2024-01-01 00:00:00 UTC").cast("timestamp"))
    at = F.timestamp_micros(start + F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - start) / 900))
    rows = rows.select((F.col("user_id") * 100 + e % 3).alias("item_id"), F.col("n").cast("long").alias("seq"), F.col("event_type").alias("stage"), kind.alias("kind"), at.alias("at"), F.concat(F.lit("w"), (e % 5).cast("string")).alias("worker"))
    folder = work_folder(spark, "offers")
    rows.write.parquet(folder)
    changes = _collected(leases(spark.readStream.schema(rows.schema).parquet(folder)), spark, "leases")
    return changes.groupBy("item_id").agg(F.max_by(F.struct("status", "attempts"), F.struct("at", "attempts", F.col("status") != "PENDING")).alias("l"), F.count("*").alias("changes")).select("item_id", "l.status", "l.attempts", "changes")


@query("""
WITH RECURSIVE e AS (SELECT event_id, event_type AS tenant, event_id % 4 = 0 AS takes, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE event_id % 4 = 0 OR event_id % 10 > 0),
s AS (
  SELECT tenant, n, event_id, NOT takes AS offers, CASE WHEN takes THEN 0 ELSE 1 END AS waiting, 0 AS dropped, true AS fits FROM e WHERE n = 1
  UNION ALL
  SELECT e.tenant, e.n, e.event_id, NOT e.takes, CASE WHEN e.takes THEN greatest(0, waiting - 1) ELSE least(200, waiting + 1) END, dropped + CASE WHEN NOT e.takes AND waiting >= 200 THEN 1 ELSE 0 END, e.takes OR waiting < 200
  FROM s JOIN e ON e.tenant = s.tenant AND e.n = s.n + 1
)
SELECT event_id, tenant, CASE WHEN fits THEN 'kept' ELSE 'dropped' END AS outcome, CAST(waiting AS BIGINT) AS waiting, CAST(dropped AS BIGINT) AS dropped FROM s WHERE offers
""")
def hand_over(spark, sf_dir):
    """What becomes of each offered case; every tenth answer is blank, a quarter of the events take a case."""
    from ..streaming import keyed

    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tenant"), e.alias("seq"), F.col("ts").alias("at"), F.when(e % 4 == 0, "take").otherwise("offer").alias("kind"), e.alias("case_id"), F.when(e % 10 > 0, "said").otherwise(" ").alias("answer"), F.lit(False).alias("suppressed"))
    folder = work_folder(spark, "cases")
    rows.write.parquet(folder)
    done = _collected(keyed.hand_over(spark.readStream.schema(rows.schema).parquet(folder)), spark, "handed")
    return done.where("outcome <> 'taken'").select(F.col("seq").alias("event_id"), "tenant", "outcome", "waiting", "dropped")


def _bundles(spark, sf_dir):
    """Entries of one bundle for each hundred documents: bundles of even numbers in version 1, the others in version 6."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 100).alias("b"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    same = {"id": text("d", "doc_id"), "runId": text("r", "b"), "title": F.col("source"), "language": F.col("lang"), "contentHash": F.col("hash")}
    first = F.struct(*(c.alias(n) for n, c in {**same, "fetchId": text("f", "doc_id"), "canonicalUrl": F.col("source")}.items()))
    later = F.struct(*(c.alias(n) for n, c in {**same, "acquisitionId": text("f", "doc_id"), "sourceUri": F.col("source"), "identityUri": text("u", "doc_id"), "versionNumber": F.lit(7)}.items()))
    fetch = F.struct(text("f", "doc_id").alias("id"), text("r", "b").alias("runId"), text("i", "doc_id").alias("frontierEntryId"), text("i", "doc_id").alias("sourceItemId"))
    item = F.struct(text("i", "doc_id").alias("id"), text("r", "b").alias("runId"), F.col("source").alias("url"), F.col("source").alias("locator"))
    in_order = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("doc_id", c.alias("x")))), lambda s: s["x"])
    by = docs.groupBy("b").agg(in_order(first).alias("v1"), in_order(later).alias("v6"), in_order(fetch).alias("fetches"), in_order(item).alias("items"))
    run = F.array(F.struct(text("r", "b").alias("id"), text("j", "b").alias("jobId"), text("j", "b").alias("ingestionJobId"), text("s", "b").alias("sourceId")))
    job = F.array(F.struct(text("j", "b").alias("id"), F.lit("job").alias("name"), text("s", "b").alias("sourceId")))
    source = F.array(F.struct(text("s", "b").alias("id"), F.lit("GIT").alias("connectorType")))
    old = F.to_json(F.struct(job.alias("jobs"), run.alias("runs"), F.col("items").alias("frontier"), "fetches", F.col("v1").alias("documents")))
    new = F.to_json(F.struct(source.alias("sources"), job.alias("ingestionJobs"), run.alias("ingestionRuns"), F.col("items").alias("sourceItems"), F.col("fetches").alias("acquisitions"), F.col("v6").alias("documents")))
    even = F.pmod("b", F.lit(2)) == 0
    by = by.select(text("bundle-", "b").alias("bundle"), F.when(even, 1).otherwise(6).alias("version"), F.when(even, old).otherwise(new).alias("data"))
    manifest = F.to_json(F.struct(F.col("version").alias("schemaVersion"), F.create_map(F.lit("data.json"), F.sha2("data", 256)).alias("checksums")))
    return by.select("bundle", F.explode(F.array(F.struct(F.lit("data.json").alias("name"), F.col("data").cast("binary").alias("content")), F.struct(F.lit("manifest.json").alias("name"), manifest.cast("binary").alias("content")))).alias("e")).select("bundle", "e.*")


@query("""
WITH d AS (SELECT doc_id, doc_id // 100 AS b, coalesce(source, '') AS source, coalesce(lang, '') AS lang, md5(coalesce(text, '')) AS hash FROM documents),
n AS (SELECT *, concat('crate-', b) AS crate, b % 2 = 0 AS first FROM d)
SELECT crate AS crate_id, sha256(concat(crate, ':documents:d', doc_id)) AS document_id, sha256(concat(crate, ':ingestionRuns:r', b)) AS run_id, sha256(concat(crate, ':acquisitions:f', doc_id)) AS acquisition_id,
  CASE WHEN first THEN source ELSE concat('u', doc_id) END AS identity_uri, CAST(CASE WHEN first THEN row_number() OVER (PARTITION BY b, CASE WHEN first THEN source ELSE concat('u', doc_id) END ORDER BY doc_id) ELSE 7 END AS INTEGER) AS version_number,
  nullif(trim(lang), '') AS language, hash AS content_hash, sha256(concat(crate, ':sources:', CASE WHEN first THEN 'j' ELSE 's' END, b)) AS source_id, CASE WHEN first THEN 'HTTPS' ELSE 'GIT' END AS connector, concat(crate, ':import-index:', sha256(concat(crate, ':documents:d', doc_id))) AS work_key FROM n
""")
def bundle_import(spark, sf_dir):
    """Documents of bundles of two versions, with the runs, sources and work that they lead to."""
    from ..sources import bundles

    folder = work_folder(spark, "bundles")
    _bundles(spark, sf_dir).write.parquet(folder)
    entries = spark.read.parquet(folder)
    crates = entries.select("bundle").distinct().select("bundle", F.regexp_replace("bundle", "^bundle", "crate").alias("crate_id"))
    out = bundles.import_bundles(entries, crates)
    runs = out["ingestionRuns"].select(F.col("id").alias("runId"), F.col("sourceId").alias("source_id"))
    sources = out["sources"].select(F.col("id").alias("source_id"), F.col("connectorType").alias("connector"))
    work = out["work"].select(F.col("document_id").alias("id"), F.col("idempotency_key").alias("work_key"))
    met = out["documents"].join(runs, "runId").join(sources, "source_id").join(work, "id")
    names = {"id": "document_id", "runId": "run_id", "acquisitionId": "acquisition_id", "identityUri": "identity_uri", "versionNumber": "version_number", "contentHash": "content_hash"}
    return met.select("crate_id", *(F.col(a).alias(b) for a, b in names.items()), "language", "source_id", "connector", "work_key")
