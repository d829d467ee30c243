"""Rules with memory on streams: held alerts, rate limits and outages as stateful processors, last labels as joins.

Rows wait in list state until the watermark has passed them and are then taken in the order of their time, so results
do not depend on the order of arrival or the cut of the micro-batches: they are those of the batch forms for all rows
behind the watermark. Timers wake a key and let its state go when it can no longer matter. The state lies in RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.replay import HALF, OPEN, breaker_replay, bucket_replay, bucket_units

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


class Ordered(StatefulProcessor):
    """Rows (us, tie, value) of a key in order; subclasses say how they change the ``memory``."""

    memory_schema = ""

    def __init__(self, forget_us: int):
        self.forget_us = forget_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us long, tie long, value boolean")
        self.memory = handle.getValueState("memory", self.memory_schema)
        self.alarm = handle.getValueState("alarm", "ms long")

    def take(self, key: tuple, us: np.ndarray, tie: np.ndarray, value: np.ndarray, memory: tuple | None) -> tuple[tuple | None, int | None, pd.DataFrame]:
        """New memory, the time until which it matters (``None``: for ``forget_us``), and rows to emit."""
        raise NotImplementedError

    def set_alarm(self, ms: int) -> None:
        """One timer a key: the earliest time at which it has something to do."""
        if self.alarm.exists():
            (old,) = self.alarm.get()
            if old <= ms:
                return
            self.handle.deleteTimer(old)
        self.handle.registerTimer(ms)
        self.alarm.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            us = frame["us"].astype("int64")
            self.waiting.appendList(list(zip(us.tolist(), frame["tie"].astype("int64").tolist(), frame["value"].astype(bool).tolist())))
            self.set_alarm(int(us.min()) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.alarm.clear()
        rows = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r[0], r[1], r[2]) for r in rows if r[0] < now)
        late = [tuple(r) for r in rows if r[0] >= now]
        if late:
            self.waiting.put(late)
            self.set_alarm(min(r[0] for r in late) // 1000)
        elif rows:
            self.waiting.clear()
        memory = tuple(self.memory.get()) if self.memory.exists() else None
        if due:
            us, tie, value = (np.array(c) for c in zip(*due))
            memory, until, out = self.take(key, us, tie, value, memory)
            until = int(us[-1]) + self.forget_us if until is None else until
            if memory is None or until < now:
                self.memory.clear()
            else:
                self.memory.update((*memory, until))
                self.set_alarm(until // 1000 + 1)
            if len(out):
                yield out
        elif memory is not None:
            if memory[-1] < now:
                self.memory.clear()
            else:
                self.set_alarm(memory[-1] // 1000 + 1)


class RateLimits(Ordered):
    """Token buckets; a bucket that has filled up again is as good as a new one and is let go."""

    memory_schema = "tokens long, last long, until long"

    def __init__(self, client: str, scope: str):
        super().__init__(0)
        self.names = (client, scope)

    def take(self, key, us, tie, value, memory):
        capacity, rate = bucket_units(key[1])
        tokens = capacity
        if memory is not None:
            tokens = min(capacity, memory[0] + (int(us[0]) - memory[1]) * rate)
        allowed, tokens = bucket_replay(us, tokens, capacity, rate)
        out = pd.DataFrame({self.names[0]: key[0], self.names[1]: key[1], "tie": tie, "us": us, "allowed": allowed})
        return (int(tokens), int(us[-1])), int(us[-1]) + -(-(capacity - int(tokens)) // rate), out


class Outages(Ordered):
    """Circuit breakers: an interval once it ends. A closed breaker without failures needs no memory, others go after ``forget_us`` of silence."""

    memory_schema = "state int, failed_at long, opened_us long, until long"

    def __init__(self, service: str, forget_us: int):
        super().__init__(forget_us)
        self.name = service

    def take(self, key, us, tie, value, memory):
        state, failed_at, opened = memory[:3] if memory is not None else (0, 0, 0)
        states, _, state, failed_at = breaker_replay(us, value, state, failed_at)
        closed = states < HALF
        out = []
        for i in np.flatnonzero(closed[1:] != closed[:-1]):
            if closed[i + 1]:
                out.append((key[0], opened, int(us[i])))
            else:
                opened = int(us[i])
        return (None if state == 0 else (int(state), int(failed_at), opened)), None, pd.DataFrame(out, columns=[self.name, "opened_us", "closed_us"])


class HeldAlerts(Ordered):
    """Islands of windows that meet the condition: a row when one has lasted for the hold time. A missing window ends an island."""

    memory_schema = "since long, last long, fired boolean, until long"

    def __init__(self, name: str, step_us: int, hold_us: int):
        super().__init__(step_us)
        self.name, self.step_us, self.hold_us = name, step_us, hold_us

    def take(self, key, us, tie, value, memory):
        since, last, fired = memory[:3] if memory is not None else (None, None, False)
        out = []
        for at, on in zip(us.tolist(), value.tolist()):
            if not on:
                since = None
                continue
            if since is None or at - last > self.step_us:
                since, fired = at, False
            last = at
            if not fired and at - since >= self.hold_us:
                fired = True
                out.append((key[0], since // 1_000_000, (since + self.hold_us) // 1_000_000))
        return (None if since is None else (since, last, fired)), None, pd.DataFrame(out, columns=[self.name, "since", "fires_at"])


def _run(rows: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    return rows.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "eventTime")


def rate_limits(log: DataFrame, client: str, scope: str, stamp: str, tie: str, delay: str = "10 minutes") -> DataFrame:
    """Streaming token buckets per (client, scope), with the rows of ``replay.token_bucket``."""
    rows = log.withWatermark(stamp, delay).select(*[F.col(k).cast("string").alias(k) for k in (client, scope)], stamp, F.unix_micros(stamp).alias("us"), F.col(tie).cast("long").alias("tie"), F.lit(True).alias("value"))
    return _run(rows, [client, scope], RateLimits(client, scope), f"`{client}` string, `{scope}` string, tie long, us long, allowed boolean")


def outage_stream(calls: DataFrame, service: str, stamp: str, tie: str, ok: str, delay: str = "10 minutes", forget_seconds: int = 7 * 86_400) -> DataFrame:
    """Streaming circuit breakers: (service, opened_us, closed_us) of every outage when it ends."""
    rows = calls.withWatermark(stamp, delay).select(F.col(service).cast("string").alias(service), stamp, F.unix_micros(stamp).alias("us"), F.col(tie).cast("long").alias("tie"), F.col(ok).cast("boolean").alias("value"))
    return _run(rows, [service], Outages(service, forget_seconds * 1_000_000), f"`{service}` string, opened_us long, closed_us long")


def held_alert_stream(windows: DataFrame, key: str, stamp: str, on: str, step_seconds: int, hold_seconds: int, delay: str = "10 minutes") -> DataFrame:
    """Streaming alerts with a hold time: (key, since, fires_at) when an island of windows has lasted ``hold_seconds``."""
    rows = windows.withWatermark(stamp, delay).select(F.col(key).cast("string").alias(key), stamp, F.unix_micros(stamp).alias("us"), F.lit(0).cast("long").alias("tie"), F.coalesce(F.col(on).cast("boolean"), F.lit(False)).alias("value"))
    return _run(rows, [key], HeldAlerts(key, step_seconds * 1_000_000, hold_seconds * 1_000_000), f"`{key}` string, since long, fires_at long")


def last_label_stream(predictions: DataFrame, feedback: DataFrame, horizon_seconds: int = 7 * 86_400, delay: str = "1 hour") -> DataFrame:
    """Predictions with the last label of their horizon, predictions without one, and labels without a prediction, each once it is settled.

    A prediction is settled when the watermark passes the end of its horizon, a label that no prediction covers when it passes
    the label. Joins and an aggregate of the stream do the work, request by request on the executors, and let settled rows go.
    Rows without a time never settle and are left out. ``last_unmatched`` keeps one label without a prediction a request.
    """
    p = predictions.withWatermark("timestamp", delay).where("timestamp IS NOT NULL").select("request_id", "timestamp", F.col("prediction").cast("int").alias("prediction"), "model_version")
    f = feedback.withWatermark("feedback_at", delay).where("feedback_at IS NOT NULL").select(F.col("request_id").alias("label_id"), "feedback_at", F.col("ground_truth").cast("int").alias("ground_truth"))
    within = F.expr(f"request_id = label_id AND feedback_at >= timestamp AND feedback_at <= timestamp + INTERVAL {int(horizon_seconds)} SECONDS")
    label = F.when(F.col("label_id").isNotNull(), F.struct("feedback_at", F.col("ground_truth").isNotNull().alias("known"), "ground_truth"))
    settled = p.join(f, within, "left_outer").groupBy("request_id", "prediction", "model_version", "timestamp").agg(F.max(label).alias("last"))
    settled = settled.select(
        "request_id", "prediction", "model_version", F.unix_micros("timestamp").alias("us"), "last.ground_truth", F.unix_micros("last.feedback_at").alias("feedback_us"),
        F.when(F.col("last").isNull(), "unlabelled").otherwise("matched").alias("status"),
    )
    alone = f.join(p, within, "left_outer").where("request_id IS NULL")
    nothing = lambda kind, name: F.lit(None).cast(kind).alias(name)
    return settled.union(
        alone.select(
            F.col("label_id").alias("request_id"), nothing("int", "prediction"), nothing("string", "model_version"), nothing("long", "us"), "ground_truth",
            F.unix_micros("feedback_at").alias("feedback_us"), F.lit("unmatched_feedback").alias("status"),
        )
    )


def last_unmatched(rows: DataFrame) -> DataFrame:
    """The written rows of ``last_label_stream`` with the last of a request's labels without a prediction, as in batch."""
    lone = F.col("status") == "unmatched_feedback"
    last = rows.where(lone).groupBy("request_id").agg(F.max(F.struct("feedback_us", F.col("ground_truth").isNotNull().alias("known"), "ground_truth")).alias("last"))
    none = rows.schema
    columns = [F.col("request_id") if c == "request_id" else F.col(f"last.{c}") if c in ("ground_truth", "feedback_us") else F.lit("unmatched_feedback").alias(c) if c == "status" else F.lit(None).cast(none[c].dataType).alias(c) for c in rows.columns]
    return rows.where(~lone).union(last.select(*columns))
