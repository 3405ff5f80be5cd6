"""Queues, counters and activity: batch functions, and Structured Streaming around them."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAX_ATTEMPTS = 5


def backoff_seconds(attempts: Column) -> Column:
    """Powers of two by attempt, at most 2 ** 8 and 300."""
    return F.least(F.lit(300), F.pow(F.lit(2.0), F.least(F.lit(8), attempts)).cast("int"))


def claimable(items: DataFrame, now: Column) -> DataFrame:
    """Items that are ready, or whose lease has run out."""
    ready = F.col("status").isin("PENDING", "RETRY_WAITING") & (F.col("available_at") <= now)
    return items.where(ready | (F.col("status") == "LEASED") & (F.col("lease_until") < now))


def claim(items: DataFrame, now: Column, n: int, stage: str | None = None) -> DataFrame:
    """The next ``n`` items of a stage, or of all."""
    ready = claimable(items, now)
    return (ready if stage is None else ready.where(F.col("stage") == stage)).orderBy(F.desc("priority"), F.asc_nulls_last("created_at"), "item_id").limit(n)


def after_failure(items: DataFrame, now: Column) -> DataFrame:
    """Waiting for a retry, or dead once so many attempts were claimed; a claim has counted the attempt already."""
    attempts = F.col("attempts")
    dead = attempts >= MAX_ATTEMPTS
    wait = F.make_interval(secs=backoff_seconds(attempts).cast("decimal(18,6)"))
    return items.withColumns({"status": F.when(dead, "DEAD_LETTER").otherwise("RETRY_WAITING"), "available_at": F.when(dead, F.col("available_at")).otherwise(now + wait), "lease_until": F.lit(None).cast(dict(items.dtypes)["lease_until"])})


def run_status(items: DataFrame, run: str) -> DataFrame:
    """FAILED by any dead letter outside fetching, RUNNING while work is active, then COMPLETED, with warnings where
    fetches died."""
    dead = F.col("status") == "DEAD_LETTER"
    by = items.groupBy(run).agg(
        F.count_if(dead & (F.col("stage") != "FETCH")).alias("hard"),
        F.count_if(dead & (F.col("stage") == "FETCH")).alias("soft"),
        F.count_if(F.col("status").isin("PENDING", "LEASED", "RETRY_WAITING")).alias("active"),
    )
    status = F.when(F.col("hard") > 0, "FAILED").when(F.col("active") > 0, "RUNNING").when(F.col("soft") > 0, "COMPLETED_WITH_WARNINGS").otherwise("COMPLETED")
    return by.select(run, status.alias("status"))


def hourly_activity(rows: DataFrame, ts: str, end: datetime, hours: int = 48, distinct: str | None = None) -> DataFrame:
    """hour, n for each of the ``hours`` before ``end``, empty ones included; the count of distinct values if named."""
    until = F.lit(end).cast("timestamp_ntz")
    start = until - F.expr(f"interval {hours} hours")
    what = F.count_distinct(distinct) if distinct else F.count("*")
    counts = rows.where((F.col(ts) >= start) & (F.col(ts) < until)).groupBy(F.date_trunc("hour", F.col(ts)).cast("timestamp_ntz").alias("hour")).agg(what.alias("n"))
    grid = rows.sparkSession.range(hours).select((start + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("hour"))
    return grid.join(counts, "hour", "left").select("hour", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def daily_sparkline(rows: DataFrame, ts: str, end: datetime, days: int = 7) -> DataFrame:
    """day, n, y: counts by day as heights of a small chart, 27 at nothing down to 4 at the most; 25 if all are zero."""
    last = F.to_date(F.lit(end).cast("timestamp_ntz"))
    counts = rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(days).select(F.date_sub(last, F.col("id").cast("int") + 1).alias("day"))
    met = grid.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    most = F.max("n").over(Window.partitionBy(F.lit(0)))  # over ``days`` rows
    return met.withColumn("y", F.round(F.when(most == 0, 25.0).otherwise(27 - F.col("n") * 23.0 / most), 6))


def expired(rows: DataFrame, ts: str, now: Column, hours: int) -> Column:
    return F.col(ts) < now - F.expr(f"interval {hours} hours")


def feedback_state(current: Column, relevance: Column, quality: Column, sources: Column, needs_approval: Column, least: int = 4) -> Column:
    """State of enrichment after a rating (1 to 5). Good ratings of an answer with sources make a candidate, or are
    approved where the policy asks for no approval or gave it before; other ratings make it none again. States beyond
    approval stay."""
    good = (sources > 0) & (relevance >= least) & (quality >= least)
    fresh = F.when(~F.coalesce(good, F.lit(False)), "NONE").when(needs_approval & (current != "APPROVED"), "CANDIDATE").otherwise("APPROVED")
    return F.when(current.isin("NONE", "CANDIDATE", "APPROVED"), fresh).otherwise(current)


def leased(items: DataFrame, now: Column, n: int, stage: str, seconds: int = 30) -> DataFrame:
    """Items after a claim of one stage: the ``n`` that it takes have a lease and one attempt more to show."""
    taken = claim(items, now, n, stage).select("item_id", F.lit(True).alias("taken"))
    met = items.join(taken, "item_id", "left")
    held = F.coalesce("taken", F.lit(False))
    until = now + F.expr(f"interval {seconds} seconds")
    return met.withColumns(
        {
            "status": F.when(held, "LEASED").otherwise(F.col("status")),
            "lease_until": F.when(held, until).otherwise(F.col("lease_until")),
            "attempts": F.col("attempts") + F.when(held, 1).otherwise(0),
        }
    ).drop("taken")


def acknowledged(items: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Leased items after their outcomes (item_id, outcome): done, retry (waiting, or dead after too many attempts), or
    fail (dead at once); other items and outcomes stay without effect."""
    met = items.join(outcomes.select("item_id", "outcome"), "item_id", "left")
    held = F.coalesce((F.col("status") == "LEASED") & F.col("outcome").isin("done", "retry", "fail"), F.lit(False))
    ended = {"done": "DONE", "fail": "DEAD_LETTER"}
    none = F.lit(None).cast(dict(items.dtypes)["lease_until"])
    closed = [met.where(held & (F.col("outcome") == o)).withColumns({"status": F.lit(s), "lease_until": none}) for o, s in ended.items()]
    out = met.where(~held).unionByName(after_failure(met.where(held & (F.col("outcome") == "retry")), now))
    for part in closed:
        out = out.unionByName(part)
    return out.drop("outcome")


def requeued(items: DataFrame, now: Column) -> DataFrame:
    """Dead letters wait again, without delay; their attempts stay counted."""
    dead = F.col("status") == "DEAD_LETTER"
    return items.withColumns({"status": F.when(dead, "PENDING").otherwise(F.col("status")), "available_at": F.when(dead, now).otherwise(F.col("available_at"))})


def queue_depth(items: DataFrame) -> DataFrame:
    """stage, waiting, leased, dead."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return items.groupBy("stage").agg(n("PENDING", "RETRY_WAITING").alias("waiting"), n("LEASED").alias("leased"), n("DEAD_LETTER").alias("dead"))


def routed(items: DataFrame, stages: list[str], tenants: DataFrame) -> DataFrame:
    """route of each item: its stage if this worker serves it, else skip; reject for tenants that are not there."""
    met = items.join(tenants.select("tenant").distinct().withColumn("there", F.lit(True)), "tenant", "left")
    return met.withColumn("route", F.when(F.col("there").isNull(), "reject").when(F.col("stage").isin(*stages), F.col("stage")).otherwise("skip")).drop("there")


def claim_due(schedules: DataFrame, now: Column, due: Column) -> DataFrame:
    """Compare and set: schedules that never ran, or ran last at or before ``due`` (now less the interval of each), are claimed and
    have run ``now``."""
    free = F.col("last_run").isNull() | (F.col("last_run") <= due)
    return schedules.withColumn("claimed", free).withColumn("last_run", F.when(F.col("claimed"), now).otherwise(F.col("last_run")))


def is_input_limit(status: Column, body: Column) -> Column:
    """Whether an endpoint's reply says that its input was too long, which is not any refusal."""
    said = F.lower(F.coalesce(body, F.lit("")))
    names = lambda *words: F.greatest(*(F.contains(said, F.lit(w)) for w in words))
    # fixed values: what such replies say
    long = names("context window", "context length", "input token", "too many tokens", "input too long")
    return (status == 400) & long & names("maximum", "exceed", "limit", "requested")


def learned_limit(replies: DataFrame, keys: list[str], start: int, least: int = 256) -> DataFrame:
    """keys, limit: the input characters that an endpoint is trusted with. Each reply (status, body) that names the input limit
    halves them, never below ``least``; other refusals teach nothing."""
    halved = F.floor(F.lit(float(start)) / F.pow(F.lit(2.0), F.least(F.count_if(is_input_limit(F.col("status"), F.col("body"))), F.lit(62))))
    return replies.groupBy(*keys).agg(F.least(F.lit(start), F.greatest(F.lit(least), halved)).cast("int").alias("limit"))


def unindexed(documents: DataFrame, run: str) -> DataFrame:
    """Work for current documents that never reached the index, under a fresh idempotency key."""
    lost = documents.where("current_version and not indexed")
    return lost.select("document_id", F.lit("INDEX").alias("stage"), F.sha2(F.concat_ws(":", F.lit("reindex"), F.lit(run), F.col("document_id").cast("string")), 256).alias("idempotency_key"))


def changed_only(snapshots: DataFrame, key: str, at: str, columns: list[str], heartbeat: int = 15) -> DataFrame:
    """Snapshots that differ from the one before by the hash of their columns, or come ``heartbeat`` seconds or more after
    the last one that was sent for a change."""
    line = Window.partitionBy(key).orderBy(at)
    rows = snapshots.withColumn("mark", F.xxhash64(*columns))
    rows = rows.withColumn("fresh", F.lag("mark").over(line).isNull() | (F.lag("mark").over(line) != F.col("mark")))
    seconds = F.unix_timestamp(F.col(at).cast("timestamp"))
    since = F.max(F.when(F.col("fresh"), seconds)).over(line.rowsBetween(Window.unboundedPreceding, 0))
    beat = F.floor((seconds - since) / heartbeat)
    rows = rows.withColumn("since", since).withColumn("beat", beat)
    run = Window.partitionBy(key, "since").orderBy(at)
    return rows.where(F.col("fresh")).unionByName(rows.withColumn("before", F.lag("beat").over(run)).where(~F.col("fresh") & (F.col("beat") > F.col("before"))).drop("before")).drop("mark", "since", "beat")


def cron_matches(expression: str, when: datetime) -> bool:
    """Five fields: minute, hour, day, month, weekday (0 or 7 is Sunday), with *, lists, ranges and steps."""
    fields = expression.split()
    if len(fields) != 5:
        raise ValueError("five fields are needed")
    bounds = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]
    values = [when.minute, when.hour, when.day, when.month, when.isoweekday() % 7]

    def allowed(field: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in field.split(","):
            body, _, step = part.partition("/")
            first, last = (low, high) if body == "*" else (int(body.split("-")[0]), int(body.split("-")[-1]))
            if "/" in part and "-" not in body and body != "*":
                last = high
            if not low <= first <= last <= high:
                raise ValueError(f"out of range: {part}")
            out |= set(range(first, last + 1, int(step) if step else 1))
        return out

    sets = [allowed(f, *b) for f, b in zip(fields, bounds)]
    if 7 in sets[4]:
        sets[4] |= {0}
    day, week = values[2] in sets[2], values[4] in sets[4]
    both = day and week if fields[2] == "*" or fields[4] == "*" else day or week
    return values[0] in sets[0] and values[1] in sets[1] and values[3] in sets[3] and both


def stream_hourly(events: DataFrame, ts: str, late: str = "1 hour") -> DataFrame:
    """Counts by hour of a stream; hours close after ``late``."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "n")


def stream_distinct(events: DataFrame, keys: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """First arrivals of each key while the watermark remembers it: idempotent inserts."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counter_sink(path: str, keys: list[str], ts: str):
    """A foreachBatch function that adds each batch to a table of counters. Each batch writes its own folder, named by
    its number, so a batch that is run again replaces itself; ``read_counters`` adds the folders up."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.groupBy(*keys).agg(F.count("*").alias("hits"), F.max(ts).alias("last_hit_at"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_counters(spark, path: str, keys: list[str]) -> DataFrame:
    return spark.read.parquet(path).groupBy(*keys).agg(F.sum("hits").alias("hits"), F.max("last_hit_at").alias("last_hit_at"))


def stream_retries(events: DataFrame, item: str = "item_id") -> DataFrame:
    """item, attempts, status, wait_seconds after each batch of outcomes (item_id, ok): the retry machine, by item."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        attempts, status = state.get if state.exists else (0, "PENDING")
        for pdf in frames:
            for ok in pdf["ok"]:
                if status in ("DONE", "DEAD_LETTER"):
                    break
                if ok:
                    status = "DONE"
                else:
                    attempts += 1
                    status = "DEAD_LETTER" if attempts >= MAX_ATTEMPTS else "RETRY_WAITING"
        state.update((int(attempts), status))
        wait = min(300, 2 ** min(attempts, 8)) if status == "RETRY_WAITING" else 0
        yield pd.DataFrame({item: [key[0]], "attempts": [attempts], "status": [status], "wait_seconds": [wait]})

    kind = dict(events.dtypes)[item]
    return events.groupBy(item).applyInPandasWithState(step, f"{item} {kind}, attempts int, status string, wait_seconds int", "attempts int, status string", "update", "NoTimeout")
