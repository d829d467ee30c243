"""Structured Streaming forms of the monitors. Windows and joins carry watermarks, so state stays bounded."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators import monitor
from ..operators.replay import bucket_replay, bucket_units
from ..session import scratch_path
from .stateful import rocksdb_state


def read_stream(spark: SparkSession, path: str, schema: StructType, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as they arrive; zone-less timestamps become timestamps so that they can carry a watermark."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    df = reader.parquet(path)
    zoneless = [f.name for f in schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless}) if zoneless else df


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once append to Parquet over all available input; state is kept in RocksDB."""
    with rocksdb_state(stream.sparkSession):
        return (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
        )


def drain(stream: DataFrame, label: str = "stream") -> DataFrame:
    """Run over all available input and give the written rows as a batch table."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    append_to(stream, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def match_stream(predictions: DataFrame, feedback: DataFrame, horizon: str = "7 days", delay: str = "1 hour") -> DataFrame:
    """Late labels joined to predictions; a prediction without a label comes out once the horizon has passed."""
    return monitor.match_feedback(
        predictions.withWatermark("timestamp", delay), feedback.withWatermark("feedback_at", delay), horizon
    )


def window_cells(log: DataFrame, stamp: str = "timestamp", hours: int = 24, step_hours: int = 6, delay: str = "1 hour") -> DataFrame:
    """Label/prediction counts per sliding window and model version, emitted when a window closes.

    ``monitor.metrics_from_cells`` turns the written counts into the same metrics as the batch form.
    """
    win = F.window(stamp, f"{hours} hours", f"{step_hours} hours")
    return (
        log.withWatermark(stamp, delay)
        .groupBy(win.alias("w"), "model_version", F.col("ground_truth").alias("y"), F.col("prediction").alias("pred"))
        .agg(F.count("*").alias("n"))
        .select(F.unix_seconds("w.start").alias("window_start"), "model_version", "y", "pred", "n")
    )


def error_rate_stream(log: DataFrame, by: Sequence[str], stamp: str, is_error: Column, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return monitor.error_rate(log.withWatermark(stamp, delay), by, stamp, is_error, width)


def latency_stream(log: DataFrame, by: Sequence[str], stamp: str, latency: str, q: float = 0.99, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return monitor.latency_quantile(log.withWatermark(stamp, delay), by, stamp, latency, q, width)


def usage_stream(audit: DataFrame, client: str, stamp: str, is_error: Column, latency: str, delay: str = "10 minutes") -> DataFrame:
    return monitor.client_usage(audit.withWatermark(stamp, delay), client, stamp, is_error, latency)


def counter_stream(events: DataFrame, labels: Sequence[str], table: str, checkpoint: str) -> StreamingQuery:
    """Running counters: each batch appends its increments, readers sum them; a replayed batch overwrites itself."""

    return each_batch(events, lambda batch, _: monitor.counters(batch, labels), table, checkpoint)


def read_counters(spark: SparkSession, table: str, labels: Sequence[str]) -> DataFrame:
    return spark.read.parquet(table).groupBy(*labels).agg(F.sum("total").alias("total"))


def each_batch(stream: DataFrame, rows_of, table: str, checkpoint: str) -> StreamingQuery:
    """Write ``rows_of(batch)`` of every micro-batch below ``table``; a replayed batch overwrites itself."""

    def add(batch: DataFrame, epoch: int) -> None:
        rows_of(batch, epoch).write.mode("overwrite").parquet(f"{table}/batch={epoch}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gauge_stream(events: DataFrame, labels: Sequence[str], value: str, stamp: str, tie: str, table: str, checkpoint: str) -> StreamingQuery:
    """Latest values: each batch appends its newest value per label set, readers take the newest of those."""
    newest = F.struct(stamp, tie, F.col(value).alias("value"))
    return each_batch(events, lambda batch, _: batch.groupBy(*labels).agg(F.max(newest).alias("newest")), table, checkpoint)


def read_gauges(spark: SparkSession, table: str, labels: Sequence[str], stamp: str) -> DataFrame:
    last = spark.read.parquet(table).groupBy(*labels).agg(F.max("newest").alias("newest"))
    return last.select(*labels, F.col("newest.value").alias("value"), F.col(f"newest.{stamp}").alias("updated_at"))


def histogram_stream(events: DataFrame, labels: Sequence[str], value: str, table: str, checkpoint: str, bounds: Sequence[float] = monitor.LATENCY_BUCKETS) -> StreamingQuery:
    """Cumulative bucket counts: each batch appends its own, readers add them up."""
    return each_batch(events, lambda batch, _: monitor.histograms(batch, labels, value, bounds), table, checkpoint)


def read_histograms(spark: SparkSession, table: str, labels: Sequence[str]) -> DataFrame:
    return spark.read.parquet(table).groupBy(*labels, "le").agg(F.sum("cumulative").alias("cumulative"), F.sum("total_value").alias("total_value"))


def newest_stream(log: DataFrame, n: int, table: str, checkpoint: str, stamp: str = "timestamp", tie: str = "request_id") -> StreamingQuery:
    """The bounded buffer: after every batch ``table/batch=<number>`` holds the newest ``n`` rows so far.

    A batch starts from the buffer of the batch before it, so a replayed one gives the same rows.
    """

    def merged(batch: DataFrame, epoch: int) -> DataFrame:
        if epoch:
            batch = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{table}/batch={epoch - 1}"))
        return monitor.newest(batch, n, stamp, tie)

    return each_batch(log, merged, table, checkpoint)


def read_newest(spark: SparkSession, table: str) -> DataFrame:
    rows = spark.read.parquet(table)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def alert_stream(cells: DataFrame, baselines: DataFrame, table: str, checkpoint: str, threshold: float = 0.05, hours: int = 24) -> StreamingQuery:
    """Degradation of every window that closes, and its alerts by channel, from the stream of window counts (``window_cells``).

    All counts of a window leave the aggregation in the micro-batch that closes it, so each batch holds whole windows.
    """

    def alerts(batch: DataFrame, _: int) -> DataFrame:
        windows = monitor.metrics_from_cells(batch, ["window_start", "model_version"]).withColumn("window_end", F.col("window_start") + hours * 3600)
        return monitor.route_alerts(monitor.performance_alerts(monitor.degradation(windows, baselines, threshold=threshold)))

    return each_batch(cells, alerts, table, checkpoint)


def rate_limit_stream(log: DataFrame, client: str, scope: str, stamp: str, tie: str) -> DataFrame:
    """Token buckets as state per (client, scope): tokens and the time of the last request.

    The rows of a key inside one micro-batch are sorted before they are replayed; the trigger bounds them.
    """
    keys = [client, scope]
    rows = log.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(tie).cast("long").alias("tie"), F.unix_micros(F.col(stamp)).alias("us"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values(["us", "tie"], kind="stable")
        capacity, rate = bucket_units(key[1])
        us = pdf["us"].to_numpy()
        if state.exists:
            tokens, last = state.get
            us = np.maximum(us, last)
            tokens = min(capacity, tokens + (int(us[0]) - last) * rate)
        else:
            tokens = capacity
        allowed, tokens = bucket_replay(us, tokens, capacity, rate)
        state.update((tokens, int(us[-1])))
        yield pd.DataFrame({client: key[0], scope: key[1], "tie": pdf["tie"].to_numpy(), "us": us, "allowed": allowed})

    return rows.groupBy(*keys).applyInPandasWithState(
        step,
        f"`{client}` string, `{scope}` string, tie long, us long, allowed boolean",
        "tokens long, last long",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def hold_stream(windows: DataFrame, key: str, stamp: str, on: str, step_seconds: int, hold_seconds: int) -> DataFrame:
    """Alerts with a hold time over a stream of window rows: state is the start and end of the current island."""
    rows = windows.select(F.col(key).cast("string").alias(key), F.unix_seconds(F.col(stamp)).alias("tick"), F.col(on).cast("boolean").alias("on"))

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches)).sort_values("tick", kind="stable")
        since, last, fired = state.get if state.exists else (None, None, False)
        out = []
        for tick, flag in zip(pdf["tick"].tolist(), pdf["on"].tolist()):
            if not flag:
                since, last, fired = None, None, False
                continue
            if last is None or tick - last > step_seconds:
                since, fired = tick, False
            last = tick
            if not fired and tick - since >= hold_seconds:
                fired = True
                out.append((name[0], since, since + hold_seconds))
        state.update((since, last, fired))
        yield pd.DataFrame(out, columns=[key, "since", "fires_at"])

    return rows.groupBy(key).applyInPandasWithState(
        step, f"`{key}` string, since long, fires_at long", "since long, last long, fired boolean", "append", GroupStateTimeout.NoTimeout
    )


def quality_stream(stream: DataFrame, suite, sink: str, checkpoint: str) -> StreamingQuery:
    from ..operators.validate import monitor_stream

    return monitor_stream(stream, suite, sink, checkpoint)
