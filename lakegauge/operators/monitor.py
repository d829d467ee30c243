"""Monitoring of prediction, feedback, request and audit logs.

The functions that take a log work on batch and streaming tables alike unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quantiles import order_statistics
from . import evaluate
from .decide import relative_change
from .evaluate import split_point

# Latency buckets (ms), stage duration buckets (s), training duration buckets (s).
LATENCY_BUCKETS = [1, 5, 10, 25, 50, 100, 200, 500, 1000]
STAGE_BUCKETS = [1, 5, 15, 30, 60, 120, 300, 600]
TRAINING_BUCKETS = [10, 30, 60, 120, 300, 600, 1800, 3600]
ROLLOUT_STAGES = [10, 25, 50, 75, 100]
MIN_LABELLED = 30
ERROR_RATE_LIMIT = 0.01
P99_LIMIT_MS = 500.0


# ---- predictions and late labels --------------------------------------------------------------------------


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """Batch: the last feedback per request. Feedback without a time comes before all other; at one time the larger label counts."""
    label = F.struct("ground_truth", "feedback_at")
    last = F.max_by(label, F.struct(F.col("feedback_at").isNotNull(), "feedback_at", F.col("ground_truth").isNotNull(), "ground_truth")).alias("f")
    return feedback.groupBy("request_id").agg(last).select("request_id", "f.ground_truth", "f.feedback_at")


def match_feedback(predictions: DataFrame, feedback: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Full outer match by request id within the horizon; ``status`` tells the three outcomes apart.

    On streams both sides need a watermark; the horizon bounds the state.
    """
    p, f = predictions.alias("p"), feedback.alias("f")
    within = F.expr(
        f"p.request_id = f.request_id AND f.feedback_at >= p.timestamp AND f.feedback_at <= p.timestamp + INTERVAL {horizon}"
    )
    status = F.when(F.col("p.request_id").isNull(), "unmatched_feedback").when(F.col("f.request_id").isNull(), "unlabelled").otherwise("matched")
    return p.join(f, within, "full_outer").select(
        F.coalesce("p.request_id", "f.request_id").alias("request_id"),
        "p.prediction",
        "p.model_version",
        "p.timestamp",
        "f.ground_truth",
        "f.feedback_at",
        status.alias("status"),
    )


def newest(log: DataFrame, n: int = 100_000, stamp: str = "timestamp", tie: str = "request_id", small_rows: int = 5_000_000) -> DataFrame:
    """The newest ``n`` rows: the bounded buffer. Rows without a time come last, as many as there is room for.

    A top-k keeps ``n`` rows in every task and merges them in one. On a large log the exact time of the n-th
    newest row is found first; only rows at that very time still compete.
    """
    known = log.where(F.col(stamp).isNotNull())
    total = known.count()
    nameless = log.where(F.col(stamp).isNull()).orderBy(F.desc(tie))
    if total <= n:
        return known.unionByName(nameless.limit(n - total))
    if total <= small_rows:
        return known.orderBy(F.desc(stamp), F.desc(tie)).limit(n)
    at = F.unix_micros(F.col(stamp)).cast("double")
    edge = order_statistics(known.select(at.alias("us")), {"us": {total - n}}, {"us": total})["us"][total - n]
    later = known.where(at > edge)
    left = n - later.count()
    return later.unionByName(known.where(at == edge).orderBy(F.desc(tie)).limit(left))


def window_metrics(
    log: DataFrame,
    hours: int = 24,
    step_hours: int = 6,
    min_labelled: int = MIN_LABELLED,
    version: str | None = None,
    pos_label=1,
) -> DataFrame:
    """Batch: rolling metrics per (window, model version) over the matched log.

    Counts go into panes of ``step_hours`` first; a window adds its panes, so the rows are shuffled once.
    """
    if version is not None:
        log = log.where(F.col("model_version") == version)
    step, span = step_hours * 3600, hours * 3600
    pane = (F.floor(F.unix_seconds("timestamp") / step) * step).alias("pane")
    panes = log.groupBy(pane, "model_version", F.col("ground_truth").alias("y"), F.col("prediction").alias("pred")).agg(F.count("*").alias("n"))
    starts = F.sequence(F.col("pane") - span + step, F.col("pane"), F.lit(step).cast("long"))
    cells = (
        panes.withColumn("window_start", F.explode(starts))
        .groupBy("window_start", "model_version", "y", "pred")
        .agg(F.sum("n").alias("n"))
    )
    return metrics_from_cells(cells, ["window_start", "model_version"], min_labelled, pos_label).withColumn("window_end", F.col("window_start") + span)


def metrics_from_cells(cells: DataFrame, by: Sequence[str], min_labelled: int = MIN_LABELLED, pos_label=1) -> DataFrame:
    """Metrics from (by..., y, pred, n); rows without a label only count as samples."""
    samples = cells.groupBy(*by).agg(
        F.sum("n").alias("sample_count"), F.coalesce(F.sum(F.when(F.col("y").isNotNull(), F.col("n"))), F.lit(0)).alias("labeled_count")
    )
    scores = evaluate.classification_from(cells.where("y IS NOT NULL"), by, pos_label).drop("n", "classes")
    return (
        samples.where(F.col("labeled_count") >= min_labelled)
        .join(scores, list(by))
        .withColumn("label_rate", F.col("labeled_count") / F.col("sample_count"))
    )


def window_regression_metrics(log: DataFrame, hours: int = 24, step_hours: int = 6, min_labelled: int = MIN_LABELLED) -> DataFrame:
    """RMSE and MAE per window from sums per pane."""
    step, span = step_hours * 3600, hours * 3600
    err = F.col("ground_truth").cast("double") - F.col("prediction").cast("double")
    pane = (F.floor(F.unix_seconds("timestamp") / step) * step).alias("pane")
    panes = log.groupBy(pane, "model_version").agg(
        F.count("*").alias("s"), F.count(err).alias("l"), F.sum(err * err).alias("q"), F.sum(F.abs(err)).alias("a")
    )
    starts = F.sequence(F.col("pane") - span + step, F.col("pane"), F.lit(step).cast("long"))
    sums = panes.withColumn("window_start", F.explode(starts)).groupBy("window_start", "model_version").agg(
        F.sum("s").alias("sample_count"), F.sum("l").alias("labeled_count"), F.sum("q").alias("q"), F.sum("a").alias("a")
    )
    return sums.where(F.col("labeled_count") >= min_labelled).select(
        "window_start", "model_version", "sample_count", "labeled_count", F.sqrt(F.col("q") / F.col("labeled_count")).alias("rmse"), (F.col("a") / F.col("labeled_count")).alias("mae")
    )


def degradation(windows: DataFrame, baselines: DataFrame, metric: str = "f1", threshold: float = 0.05) -> DataFrame:
    """Relative change against the baseline per model version (``model_version, baseline``: one row per model)."""
    change = relative_change(F.lit("rmse" if metric in ("rmse", "mae", "log_loss") else metric), F.col(metric), F.col("baseline"))
    return windows.join(baselines, "model_version").withColumn("relative_change", change).withColumn("is_degraded", F.col("relative_change") > threshold)


def monitor_summary(log: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    aggs = [F.count("*").alias("total"), F.count("ground_truth").alias("labeled"), F.coalesce(F.try_divide(F.count("ground_truth"), F.count("*")), F.lit(0.0)).alias("label_rate")]
    return log.groupBy(*by).agg(*aggs) if by else log.agg(*aggs)


# ---- alerts -----------------------------------------------------------------------------------------------


def performance_alerts(degraded: DataFrame, metric: str = "f1") -> DataFrame:
    """One alert row per degraded window: critical above 15 %, else warning."""
    drop = (F.col("baseline") - F.col(metric)) / F.greatest(F.abs("baseline"), F.lit(1e-8))
    return degraded.where("is_degraded").select(
        F.col("model_version").alias("model_id"),
        F.lit("performance_monitor").alias("source"),
        F.when(drop > 0.15, "critical").otherwise("warning").alias("severity"),
        drop.alias("change"),
        F.col("window_end").alias("triggered_at"),
    )


def drift_alert_severity(dataset_drift: Column, share: Column) -> Column:
    return F.when(dataset_drift & (share > 0.5), "critical").when(share > 0.3, "warning").otherwise("info")


def route_alerts(alerts: DataFrame) -> DataFrame:
    """One row per alert and channel; sending is left to the consumer."""
    channels = (
        F.when(F.col("severity") == "critical", F.array(F.lit("annotation"), F.lit("chat"), F.lit("page"), F.lit("retrain_trigger")))
        .when(F.col("severity") == "warning", F.array(F.lit("annotation"), F.lit("chat")))
        .otherwise(F.array(F.lit("annotation")))
    )
    return alerts.withColumn("channel", F.explode(channels))


def combined_run(quality: DataFrame, drift: DataFrame, performance: DataFrame) -> DataFrame:
    """One verdict from the three reports (``is_valid``, ``dataset_drift``, ``is_degraded``).

    Each report is reduced to one row with its own status; a report without rows shows as ``missing``.
    """
    part = lambda df, name, bad: df.agg(F.count("*").alias("rows"), F.count(F.when(bad, 1)).alias("bad")).select(F.lit(name).alias("monitor"), "rows", "bad")
    parts = (
        part(quality, "quality", ~F.col("is_valid"))
        .unionAll(part(drift, "drift", F.col("dataset_drift")))
        .unionAll(part(performance, "performance", F.col("is_degraded")))
    )
    status = F.when(F.col("rows") == 0, "missing").when(F.col("bad") > 0, "alert").otherwise("ok")
    pick = lambda name: F.max(F.when(F.col("monitor") == name, F.col("status")))
    return parts.withColumn("status", status).agg(
        pick("quality").alias("quality"),
        pick("drift").alias("drift"),
        pick("performance").alias("performance"),
        F.max((F.col("status") == "alert").cast("int")).cast("boolean").alias("any_alert"),
        F.max(((F.col("status") == "alert") & F.col("monitor").isin("drift", "performance")).cast("int")).cast("boolean").alias("retrain_recommended"),
    )


# ---- request log ------------------------------------------------------------------------------------------


def error_rate(log: DataFrame, by: Sequence[str], stamp: str, is_error: Column, width: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Requests, errors and error rate per window."""
    win = F.window(stamp, width, slide) if slide else F.window(stamp, width)
    return log.groupBy(*by, win.alias("w")).agg(
        F.count("*").alias("requests"), F.count(F.when(is_error, 1)).alias("errors"), F.avg(is_error.cast("double")).alias("error_rate")
    ).select(*by, F.col("w.start").alias("window_start"), "requests", "errors", "error_rate")


def histogram_counts(value: Column, bounds: Sequence[float]) -> list[Column]:
    """Cumulative bucket counts as aggregates, plus the total under ``le_inf``."""
    return [F.count(F.when(value <= b, 1)).alias(f"le_{b}") for b in bounds] + [F.count(value).alias("le_inf")]


def quantile_from_buckets(bounds: Sequence[float], q: float) -> Column:
    """Linear interpolation inside the bucket that holds the rank; beyond the last bound that bound."""
    cum = [F.col(f"le_{b}") for b in bounds]
    rank = q * F.col("le_inf")
    out = None
    for i, b in enumerate(bounds):
        low, below = (bounds[i - 1], cum[i - 1]) if i else (0, F.lit(0))
        inside = low + (b - low) * F.coalesce(F.try_divide(rank - below, cum[i] - below), F.lit(0.0))
        out = F.when(cum[i] >= rank, inside) if out is None else out.when(cum[i] >= rank, inside)
    return F.when(F.col("le_inf") > 0, out.otherwise(F.lit(float(bounds[-1]))))


def latency_quantile(log: DataFrame, by: Sequence[str], stamp: str, latency: str, q: float = 0.99, width: str = "5 minutes") -> DataFrame:
    """Quantile per window from fixed buckets: constant state per window and group."""
    counts = log.groupBy(*by, F.window(stamp, width).alias("w")).agg(*histogram_counts(F.col(latency), LATENCY_BUCKETS))
    return counts.select(*by, F.col("w.start").alias("window_start"), F.col("le_inf").alias("requests"), quantile_from_buckets(LATENCY_BUCKETS, q).alias("latency_ms"))


def held_alerts(windows: DataFrame, by: Sequence[str], stamp: str, condition: Column, step_seconds: int, hold_seconds: int) -> DataFrame:
    """Batch: islands of consecutive windows that meet the condition, and when the alert fires.

    The input is one row per window and key, so a key's rows are bounded by the covered time. A missing
    window ends an island.
    """
    w = Window.partitionBy(*by).orderBy("at")
    rows = windows.select(*by, F.unix_seconds(F.col(stamp)).alias("at"), condition.alias("on"))
    fresh = F.coalesce(~F.lag("on").over(w) | (F.col("at") - F.lag("at").over(w) > step_seconds), F.lit(True))
    rows = rows.withColumn("island", F.sum(fresh.cast("int")).over(w)).where("on")
    out = rows.groupBy(*by, "island").agg(F.min("at").alias("since"), F.max("at").alias("until"), F.count("*").alias("windows"))
    return out.drop("island").withColumn("fires_at", F.when(F.col("until") - F.col("since") >= hold_seconds, F.col("since") + hold_seconds))


def health_verdict(windows: DataFrame, by: Sequence[str], stamp: str, limit_run: int = 3) -> DataFrame:
    """Batch: per key the checks, failures, longest failure run and verdict.

    ``windows`` has ``error_rate`` and ``p99_ms`` per check; a p99 of 0 counts as not measured.
    """
    p99 = F.coalesce(F.col("p99_ms"), F.lit(0.0))
    healthy = (F.col("error_rate") <= ERROR_RATE_LIMIT) & ((p99 == 0) | (p99 <= P99_LIMIT_MS))
    w = Window.partitionBy(*by).orderBy(stamp)
    runs = windows.select(*by, stamp, healthy.alias("ok")).withColumn("passed_before", F.sum(F.col("ok").cast("int")).over(w))
    lengths = runs.groupBy(*by, "passed_before").agg(F.count("*").alias("checks"), F.count(F.when(~F.col("ok"), 1)).alias("failed"))
    out = lengths.groupBy(*by).agg(F.sum("checks").alias("checks"), F.sum("failed").alias("failed"), F.max("failed").alias("longest_run"))
    verdict = (
        F.when(F.col("longest_run") >= limit_run, "rollback")
        .when((F.col("failed") == 0) | (F.col("failed") < F.col("checks") * 0.1), "pass")
        .otherwise("fail")
    )
    return out.withColumn("verdict", verdict)


def rollout_stage(stamp: Column, start: Column, stage_seconds: int) -> Column:
    """Index of the rollout stage at a time, the last one open-ended."""
    i = F.floor((F.unix_seconds(stamp) - F.unix_seconds(start)) / stage_seconds)
    return F.greatest(F.least(i, F.lit(len(ROLLOUT_STAGES) - 1)), F.lit(0)).cast("int")


def rollout_analysis(log: DataFrame, key: str, stamp: str, start: Column, stage_seconds: int, is_error: Column, latency: str, seed: int = 0) -> DataFrame:
    """Share, errors and latency of both variants per rollout stage; a request keeps its variant point."""
    stage = rollout_stage(F.col(stamp), start, stage_seconds)
    share = F.element_at(F.array(*[F.lit(p) for p in ROLLOUT_STAGES]), stage + 1)
    variant = F.when(split_point([key], seed) * 100 < share, "challenger").otherwise("champion")
    return (
        log.select(share.alias("stage_pct"), variant.alias("variant"), is_error.cast("double").alias("e"), F.col(latency).alias("l"))
        .groupBy("stage_pct", "variant")
        .agg(F.count("*").alias("requests"), F.avg("e").alias("error_rate"), F.avg("l").alias("mean_latency_ms"))
    )


def shadow_comparison(log: DataFrame, key: str, variant: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Requests scored by both models and how often they disagree; one shuffle instead of a self-join."""
    pick = lambda v: F.max(F.when(F.col(variant) == v, F.col(prediction)))
    pairs = log.groupBy(*by, key).agg(pick("champion").alias("a"), pick("challenger").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    aggs = [F.count("*").alias("pairs"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("disagreements"), F.avg((F.col("a") != F.col("b")).cast("double")).alias("disagreement_rate")]
    return pairs.groupBy(*by).agg(*aggs) if by else pairs.agg(*aggs)


# ---- event table ------------------------------------------------------------------------------------------


def counters(events: DataFrame, labels: Sequence[str]) -> DataFrame:
    return events.groupBy(*labels).agg(F.count("*").alias("total"))


def gauges(events: DataFrame, labels: Sequence[str], value: str, stamp: str, tie: str) -> DataFrame:
    """Latest value per label set."""
    return events.groupBy(*labels).agg(F.max_by(value, F.struct(stamp, tie)).alias("value"), F.max(stamp).alias("updated_at"))


def histograms(events: DataFrame, labels: Sequence[str], value: str, bounds: Sequence[float] = LATENCY_BUCKETS) -> DataFrame:
    """Cumulative counts per bucket bound, with the sum and count."""
    wide = events.groupBy(*labels).agg(*histogram_counts(F.col(value), bounds), F.sum(value).alias("total_value"))
    cells = [F.struct(F.lit(str(b)).alias("le"), F.col(f"le_{b}").alias("cumulative")) for b in bounds] + [F.struct(F.lit("inf").alias("le"), F.col("le_inf").alias("cumulative"))]
    return wide.select(*labels, "total_value", F.inline(F.array(*cells)))


def run_report(events: DataFrame, run: str, step: str, seconds: str, status: str, steps: Sequence[str]) -> DataFrame:
    """One row per run: duration per step (pivot with known steps), total and outcome."""
    per = events.groupBy(run).pivot(step, list(steps)).agg(F.sum(seconds))
    totals = events.groupBy(run).agg(
        F.sum(seconds).alias("total_seconds"),
        F.count("*").alias("stage_events"),
        F.when(F.count(F.when(F.col(status) == "failed", 1)) > 0, "failed").otherwise("succeeded").alias("outcome"),
    )
    return totals.join(per, run)


def client_usage(audit: DataFrame, client: str, stamp: str, is_error: Column, latency: str, width: str = "1 hour") -> DataFrame:
    return audit.groupBy(client, F.window(stamp, width).alias("w")).agg(
        F.count("*").alias("requests"), F.count(F.when(is_error, 1)).alias("errors"), F.avg(latency).alias("mean_latency_ms"), F.max(latency).alias("max_latency_ms")
    ).select(client, F.col("w.start").alias("window_start"), "requests", "errors", "mean_latency_ms", "max_latency_ms")


def request_key(features: Column, version: Column) -> Column:
    """SHA-256 over the sorted features and the model version."""
    items = F.array_sort(F.transform(F.map_entries(features), lambda e: F.concat_ws("=", e["key"], F.coalesce(e["value"].cast("string"), F.lit("null")))))
    return F.sha2(F.concat(F.concat_ws("|", items), F.lit("#"), version), 256)


def repeat_requests(log: DataFrame, key: Column, by: Sequence[str]) -> DataFrame:
    """Repeats per group: all but the first request of a key would be cache hits.

    Counted per key with map-side sums, so a request that makes up a third of the log is one row per task.
    """
    per_key = log.select(*by, key.alias("k")).groupBy(*by, "k").agg(F.count("*").alias("n"))
    return per_key.groupBy(*by).agg(
        F.sum("n").alias("requests"), F.count("*").alias("distinct_requests"), F.sum(F.col("n") - 1).alias("hits"), (F.sum(F.col("n") - 1) / F.sum("n")).alias("hit_rate")
    )


def serving_summary(log: DataFrame, by: Sequence[str], is_error: Column, latency: str) -> DataFrame:
    ok = ~is_error
    return log.groupBy(*by).agg(
        F.count(F.when(ok, 1)).alias("predictions"),
        F.count(F.when(is_error, 1)).alias("errors"),
        (F.count(F.when(is_error, 1)) / F.greatest(F.count("*"), F.lit(1))).alias("error_rate"),
        F.avg(F.when(ok, F.col(latency))).alias("mean_latency_ms"),
    )
