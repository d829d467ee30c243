"""Scheduled monitoring: quality, drift and performance as one table of verdicts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import local_frame
from ..operators import drift, monitor, validate


def run_monitors(spark, parts: dict[str, Callable[[], tuple[str, str, str]]]) -> DataFrame:
    """``(monitor, status, severity, detail)``; a monitor that fails becomes a row with status ``error``.

    One failing monitor does not stop the others, and its failure stays visible.
    """
    rows = []
    for name, part in parts.items():
        try:
            rows.append((name, *part()))
        except Exception as exc:  # the point of this table is to show any failure
            rows.append((name, "error", "warning", f"{type(exc).__name__}: {exc}"))
    out = local_frame(spark, rows, "monitor string, status string, severity string, detail string")
    return out.withColumn("retrain_recommended", (F.col("status") == "alert") & F.col("monitor").isin("drift", "performance"))


def monitoring_run(
    reference: DataFrame,
    current: DataFrame,
    matched: DataFrame,
    baselines: DataFrame,
    suite: Sequence[validate.Expectation] | None = None,
    categorical: Sequence[str] = (),
) -> DataFrame:
    """Data quality of the current table, its drift against the reference, and the latest window's performance."""

    def quality() -> tuple[str, str, str]:
        row = validate.score_suite(validate.run_suite(current, validate.choose_suite(suite, ref=reference))).first()
        return ("ok" if row["is_valid"] else "alert", "info" if row["is_valid"] else "warning", f"success_rate={row['success_rate']:.4f}")

    def drifted() -> tuple[str, str, str]:
        _, summary = drift.monitor_drift(reference, current, categorical=categorical)
        level = monitor.drift_alert_severity(F.col("dataset_drift"), F.col("drift_share"))
        row = summary.withColumn("level", level).first()
        bad = row["dataset_drift"] or row["drift_share"] > 0.3
        return ("alert" if bad else "ok", row["level"], f"{row['n_features_drifted']}/{row['n_features_total']} columns")

    def performance() -> tuple[str, str, str]:
        windows = monitor.window_metrics(matched)
        latest = monitor.degradation(windows, baselines).groupBy("model_version").agg(F.max_by(F.struct("relative_change", "is_degraded"), "window_start").alias("w"))
        row = latest.agg(F.max("w.relative_change").alias("worst"), F.count(F.when(F.col("w.is_degraded"), 1)).alias("bad"), F.count("*").alias("n")).first()
        if row["n"] == 0:
            return ("missing", "info", "no window with enough labels")
        level = "info" if not row["bad"] else "critical" if row["worst"] > 0.15 else "warning"
        return ("alert" if row["bad"] else "ok", level, f"{row['bad']}/{row['n']} versions degraded")

    return run_monitors(current.sparkSession, {"quality": quality, "drift": drifted, "performance": performance})
