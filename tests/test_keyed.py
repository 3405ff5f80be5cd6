import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.streaming import keyed, state

pytest.importorskip("google.protobuf")
START = datetime(2024, 1, 1)
SCHEMA = "item_id string, seq long, stage string, kind string, at timestamp, worker string"


def drain(spark, stream, path):
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out").collect()


def machine(events, mark, seconds=30, most=5):
    """The rule event by event; leases that end before ``mark`` are over."""
    out, items = [], {}
    for item, _, stage, kind, at, worker in sorted(events, key=lambda e: (e[4], e[1])):
        s = items.setdefault(item, {"status": None, "n": 0, "due": None, "until": None, "worker": None})

        def change(status, when=at, item=item, s=s):
            s["status"] = status
            out.append((item, when, status, s["n"], s["worker"]))

        if s["status"] == "LEASED" and s["until"] < at:
            s["due"], s["worker"] = s["until"], None
            change("PENDING", s["until"])
        if kind == "offer" and s["status"] is None:
            s["due"] = at
            change("PENDING")
        elif kind == "claim" and s["status"] in ("PENDING", "RETRY_WAITING") and s["due"] <= at:
            s["n"] += 1
            s["until"], s["worker"] = at + timedelta(seconds=seconds), worker
            change("LEASED")
        elif kind == "done" and s["status"] == "LEASED":
            change("DONE")
        elif kind == "retry" and s["status"] == "LEASED":
            s["due"] = at + timedelta(seconds=min(300, 2 ** min(8, s["n"])))
            change("DEAD_LETTER" if s["n"] >= most else "RETRY_WAITING")
        elif kind == "fail" and s["status"] not in (None, "DONE", "DEAD_LETTER"):
            change("DEAD_LETTER")
        elif kind == "requeue" and s["status"] == "DEAD_LETTER":
            s["due"], s["worker"] = at, None
            change("PENDING")
    for item, s in items.items():
        if s["status"] == "LEASED" and s["until"] < mark:
            out.append((item, s["until"], "PENDING", s["n"], None))
    return out


def made(rng, items, steps):
    events, at = [], START
    for seq in range(steps):
        at += timedelta(seconds=rng.choice([0, 1, 5, 20]))
        kind = rng.choices(["offer", "claim", "done", "retry", "fail", "requeue"], [3, 8, 1, 4, 1, 1])[0]
        events.append((f"i{rng.randrange(items)}", seq, "FETCH", kind, at, f"w{rng.randrange(3)}"))
    return events


def test_leases_over_batches(spark, tmp_path):
    events = made(random.Random(8), 15, 600)
    for k in range(3):  # one file a batch, in the order of time
        part = events[200 * k : 200 * k + 200]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(spark, keyed.leases(stream), tmp_path)
    mark = events[-1][4] - timedelta(minutes=10)
    assert sorted((r.item_id, r.at, r.status, r.attempts, r.worker or "") for r in got) == sorted((*e[:4], e[4] or "") for e in machine(events, mark))
    assert {r.status for r in got} == {"PENDING", "LEASED", "RETRY_WAITING", "DONE", "DEAD_LETTER"}


def test_a_dead_worker_loses_its_lease_by_the_timer(spark, tmp_path):
    later = START + timedelta(hours=1)
    rows = [("a", 1, "s", "offer", START, None), ("a", 2, "s", "claim", START, "w"), ("b", 3, "s", "offer", later, None)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    got = drain(spark, keyed.leases(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), late="1 minute"), tmp_path)
    assert [(r.at, r.status, r.attempts) for r in sorted(got, key=lambda r: r.at) if r.item_id == "a"] == [(START, "PENDING", 0), (START, "LEASED", 1), (START + timedelta(seconds=30), "PENDING", 1)]


def test_hand_over_over_batches(spark, tmp_path):
    rng = random.Random(5)
    kind = "tenant string, seq long, at timestamp, kind string, case_id string, answer string, suppressed boolean"
    events = [(rng.choice("ab"), i, START + timedelta(seconds=i), rng.choices(["offer", "take"], [3, 1])[0], f"c{i}", rng.choice(["x", "x", "x", " ", None]), rng.choice([None, False, False, True])) for i in range(300)]
    for k in range(3):
        spark.createDataFrame(events[100 * k : 100 * k + 100], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = drain(spark, keyed.hand_over(stream, 7), tmp_path)
    want, queues, drops = [], {"a": [], "b": []}, {"a": 0, "b": 0}
    for tenant, seq, _, what, case, answer, hidden in events:
        q = queues[tenant]
        if what == "offer":
            if hidden or not (answer or "").strip():
                continue
            outcome = "kept" if len(q) < 7 else "dropped"
            q.append(case) if outcome == "kept" else None
            drops[tenant] += outcome == "dropped"
        elif q:
            case, outcome = q.pop(0), "taken"
        else:
            continue
        want.append((tenant, seq, case, outcome, len(q), drops[tenant]))
    assert sorted(map(tuple, got)) == sorted(want) and all(drops.values())


def test_rules_of_the_queue(spark):
    items = spark.createDataFrame([(1, "A", "PENDING", 0), (2, "B", "PENDING", 0), (3, "A", "LEASED", 4), (4, "A", "LEASED", 5), (5, "A", "DEAD_LETTER", 5), (6, "A", "LEASED", 1)], "item_id long, stage string, status string, attempts int")
    now = F.lit(START)
    items = items.withColumns({"priority": F.lit(1), "created_at": now, "available_at": now, "lease_until": F.when(F.col("item_id") == 3, now - F.expr("interval 1 second")).otherwise(now)})
    got = {r.item_id: (r.status, r.attempts) for r in state.leased(items, now, 9, "A").collect()}
    assert got == {1: ("LEASED", 1), 2: ("PENDING", 0), 3: ("LEASED", 5), 4: ("LEASED", 5), 5: ("DEAD_LETTER", 5), 6: ("LEASED", 1)}
    outcomes = spark.createDataFrame([(3, "retry"), (4, "retry"), (6, "fail"), (1, "done"), (5, "done")], "item_id long, outcome string")
    got = {r.item_id: r.status for r in state.acknowledged(items, outcomes, now).collect()}
    assert got == {1: "PENDING", 2: "PENDING", 3: "RETRY_WAITING", 4: "DEAD_LETTER", 5: "DEAD_LETTER", 6: "DEAD_LETTER"}
    assert {r.item_id: (r.status, r.attempts) for r in state.requeued(items, now).collect()}[5] == ("PENDING", 5)
    replies = spark.createDataFrame([("e", 400, "context length exceeded")] * 9 + [("f", 400, "input too long, limit 9"), ("f", 500, "context length exceeded"), ("f", 400, "context length")], "key string, status int, body string")
    assert {r.key: r.limit for r in state.learned_limit(replies, ["key"], 8000).collect()} == {"e": 256, "f": 4000}
