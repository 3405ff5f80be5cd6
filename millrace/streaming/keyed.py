"""Operators that keep a state for each key of a stream: leases with timers, and a bounded hand-over.

Both take events of a key in the order of their time; a batch is sorted by key, events behind the watermark are dropped
by Spark. State lives in the state store, a value or a bounded list for each key, so keys spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .state import MAX_ATTEMPTS

LEASE_SECONDS = 30
#: How long a finished item is remembered, so that repeated events of it stay without effect.
KEEP = timedelta(days=1)
HAND_OVER = 200


def use_keyed_state(spark: SparkSession) -> None:
    """The state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _millis(at: datetime) -> int:
    return int(pd.Timestamp(at).timestamp() * 1000)


class Leases(StatefulProcessor):
    """Work items of a queue: offered, claimed under a lease, done, retried, failed or brought back."""

    def __init__(self, seconds: int = LEASE_SECONDS, attempts: int = MAX_ATTEMPTS) -> None:
        self.lease, self.most = timedelta(seconds=seconds), attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "status string, attempts int, available_at timestamp, lease_until timestamp, worker string, stage string")

    def _row(self, key: tuple, at: datetime, state: list) -> dict:
        return {"item_id": key[0], "at": at, "stage": state[5], "status": state[0], "attempts": state[1], "worker": state[4]}

    def _expire(self, key: tuple, state: list) -> dict:
        """The lease ended without an outcome: whoever asks next gets the item; the attempt stays counted."""
        ended = state[3]
        state[0], state[2], state[3], state[4] = "PENDING", ended, None, None
        return self._row(key, ended, state)

    def _step(self, state: list, kind: str, at: datetime, worker: str | None, stage: str | None) -> bool:
        """Whether the event changes the item."""
        status = state[0]
        if kind == "offer" and status is None:
            state[:] = ["PENDING", 0, at, None, None, stage]
        elif kind == "claim" and status in ("PENDING", "RETRY_WAITING") and state[2] <= at:
            state[0], state[1], state[3], state[4] = "LEASED", state[1] + 1, at + self.lease, worker
        elif kind == "done" and status == "LEASED":
            state[0], state[3] = "DONE", None
        elif kind == "retry" and status == "LEASED":
            state[3] = None
            if state[1] >= self.most:
                state[0] = "DEAD_LETTER"
            else:
                state[0], state[2] = "RETRY_WAITING", at + timedelta(seconds=min(300, 2 ** min(8, state[1])))
        elif kind == "fail" and status not in (None, "DONE", "DEAD_LETTER"):
            state[0], state[3] = "DEAD_LETTER", None
        elif kind == "requeue" and status == "DEAD_LETTER":
            state[0], state[2], state[4] = "PENDING", at, None
        else:
            return False
        return True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = list(self.item.get() if self.item.exists() else (None,) * 6)
        events = pd.concat(rows).sort_values(["at", "seq"], kind="stable")
        out = []
        for kind, at, worker, stage in zip(events["kind"], events["at"].dt.to_pydatetime() if len(events) else (), events["worker"], events["stage"]):
            if state[0] == "LEASED" and state[3] < at:
                out.append(self._expire(key, state))
            if self._step(state, kind, at, worker, stage):
                out.append(self._row(key, at, state))
        if state[0] is not None:
            self.item.update(tuple(state))
            until = state[3] if state[0] == "LEASED" else events["at"].max() + KEEP if state[0] in ("DONE", "DEAD_LETTER") else None
            if until is not None and _millis(until) > timerValues.getCurrentWatermarkInMs():
                self.handle.registerTimer(_millis(until) + 1)
        if out:
            yield pd.DataFrame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.item.exists():
            return
        state, now = list(self.item.get()), expiredTimerInfo.getExpiryTimeInMs()
        if state[0] == "LEASED" and _millis(state[3]) < now:
            row = self._expire(key, state)
            self.item.update(tuple(state))
            yield pd.DataFrame([row])
        elif state[0] == "DONE":
            self.item.clear()

    def close(self) -> None:
        pass


LEASE_ROWS = "stage string, status string, attempts int, worker string"


def leases(events: DataFrame, seconds: int = LEASE_SECONDS, attempts: int = MAX_ATTEMPTS, late: str = "10 minutes") -> DataFrame:
    """``events`` of a stream: item_id, seq (order of events of one time), stage, kind, at (timestamp), worker. A row for each
    change of an item: item_id, at, stage, status, attempts, worker.

    offer makes an item PENDING; claim takes it if it waits and is due: LEASED for ``seconds``, with one attempt more; done
    ends it; retry lets it wait (2 ** attempts seconds, at most 300), or makes it a DEAD_LETTER once ``attempts`` were
    claimed; fail does so at once; requeue makes a dead letter PENDING, its attempts stay. A lease that ends without an
    outcome makes the item PENDING at that time, by the next event of the item or by a timer once the watermark is beyond it.
    Events that do not fit the item's status change nothing. Finished items are forgotten after KEEP."""
    use_keyed_state(events.sparkSession)
    rows = events.select("item_id", "seq", "stage", "kind", F.col("at").cast("timestamp").alias("at"), "worker").withWatermark("at", late)
    kind = f"item_id {dict(events.dtypes)['item_id']}, at timestamp, {LEASE_ROWS}"
    return rows.groupBy("item_id").transformWithStateInPandas(Leases(seconds, attempts), kind, "Append", "EventTime")


class HandOver(StatefulProcessor):
    """A queue of bounded length for each tenant: what does not fit is dropped and counted, nobody waits."""

    def __init__(self, capacity: int = HAND_OVER) -> None:
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "case_id string")
        self.dropped = handle.getValueState("dropped", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        dropped = self.dropped.get()[0] if self.dropped.exists() else 0
        events = pd.concat(rows).sort_values(["at", "seq"], kind="stable")
        out = []
        for seq, kind, case in zip(events["seq"], events["kind"], events["case_id"]):
            if kind == "take":
                if not waiting:
                    continue
                case, outcome = waiting.pop(0), "taken"
            elif len(waiting) < self.capacity:
                waiting.append(case)
                outcome = "kept"
            else:
                dropped += 1
                outcome = "dropped"
            out.append({"tenant": key[0], "seq": seq, "case_id": case, "outcome": outcome, "waiting": len(waiting), "dropped": dropped})
        if waiting:
            self.waiting.put([(c,) for c in waiting])
        else:
            self.waiting.clear()
        self.dropped.update((dropped,))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def hand_over(events: DataFrame, capacity: int = HAND_OVER) -> DataFrame:
    """``events`` of a stream: tenant, seq, at, kind (offer or take), case_id, answer, suppressed. A row for each event with an
    effect: tenant, seq, case_id, outcome (kept, dropped, taken), waiting (length of the queue after it), dropped (the
    tenant's count so far).

    An offer is kept while fewer than ``capacity`` cases of its tenant wait, else dropped; a take gets the oldest of them.
    Offers that are suppressed, or whose answer is null or blank, are no offers."""
    use_keyed_state(events.sparkSession)
    offered = (F.col("kind") == "offer") & ~F.coalesce("suppressed", F.lit(False)) & (F.trim(F.coalesce("answer", F.lit(""))) != "")
    rows = events.where(offered | (F.col("kind") == "take")).select("tenant", "seq", F.col("at").cast("timestamp").alias("at"), "kind", F.col("case_id").cast("string").alias("case_id"))
    kind = f"tenant {dict(events.dtypes)['tenant']}, seq long, case_id string, outcome string, waiting long, dropped long"
    return rows.groupBy("tenant").transformWithStateInPandas(HandOver(capacity), kind, "Append", "None")
