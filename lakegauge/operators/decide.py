"""Retraining decision from performance, drift, staleness and data readiness, one row per model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

LOWER_IS_BETTER = ["rmse", "mae", "mse", "loss", "error"]


@dataclass(frozen=True)
class RetrainSettings:
    degradation: float = 0.05
    max_staleness_days: int = 90
    approval_required: bool = True
    auto_retrain: bool = False
    min_samples: int = 1000


def relative_change(metric: Column, current: Column, baseline: Column) -> Column:
    """How much worse than the baseline, relative; 0 for a zero baseline."""
    lower = F.lower(metric).isin(LOWER_IS_BETTER)
    worse = F.when(lower, current - baseline).otherwise(baseline - current)
    return F.when(baseline == 0, 0.0).otherwise(F.try_divide(worse, F.abs(baseline)))


def performance_signal(metric: Column, current: Column, baseline: Column, s: RetrainSettings = RetrainSettings()) -> Column:
    return F.greatest(F.least(relative_change(metric, current, baseline) / (3 * s.degradation), F.lit(1.0)), F.lit(0.0))


def drift_signal(severity: Column, concept: Column) -> Column:
    base = (
        F.when(severity == "critical", 1.0).when(severity == "high", 0.8).when(severity == "moderate", 0.5).when(severity == "low", 0.2).when(severity.isNotNull(), 0.0)
    )
    return F.when(F.coalesce(concept, F.lit(False)), F.greatest(base, F.lit(0.8))).otherwise(base)


def staleness_signal(trained_at: Column, as_of: Column, s: RetrainSettings = RetrainSettings()) -> Column:
    """Whole days since training over the allowed days, at most 1."""
    return F.least(F.datediff(as_of, trained_at) / F.lit(float(s.max_staleness_days)), F.lit(1.0))


def data_readiness(new_data: DataFrame, by: str, label: str, stamp: str, as_of: Column, quality: str | None = None, s: RetrainSettings = RetrainSettings()) -> DataFrame:
    """Samples, label rate, freshness and quality of the new data per model."""
    score = F.avg(quality) if quality else F.lit(None).cast("double")
    return (
        new_data.groupBy(by)
        .agg(
            F.count("*").alias("new_samples"),
            F.avg(F.col(label).isNotNull().cast("double")).alias("label_rate"),
            F.datediff(F.first(as_of), F.max(stamp)).alias("freshness_days"),
            score.alias("quality_score"),
        )
        .withColumn("min_samples", F.lit(s.min_samples))
        .withColumn("is_sufficient", F.col("new_samples") >= s.min_samples)
    )


# signal column and its weight; NULL signals drop out and the weights are renormalised
SIGNAL_WEIGHTS = {"performance": 0.35, "drift": 0.30, "staleness": 0.15, "readiness": 0.20}


def priority(signals: dict[str, Column]) -> Column:
    top, bottom = F.lit(0.0), F.lit(0.0)
    for name, weight in SIGNAL_WEIGHTS.items():
        col = signals[name]
        top = top + F.when(col.isNotNull(), col * weight).otherwise(0.0)
        bottom = bottom + F.when(col.isNotNull(), F.lit(weight)).otherwise(0.0)
    return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))


def assess(models: DataFrame, s: RetrainSettings = RetrainSettings()) -> DataFrame:
    """Decision per model from the signal columns ``performance, drift, staleness, ready, concept_drift``."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ready = F.coalesce(F.col("ready"), F.lit(True))
    readiness = F.when(F.col("ready").isNotNull(), F.col("ready").cast("double"))
    out = models.withColumn(
        "priority", priority({"performance": F.col("performance"), "drift": F.col("drift"), "staleness": F.col("staleness"), "readiness": readiness})
    )
    concept = F.coalesce(F.col("concept_drift"), F.lit(False))
    # the first rule that holds decides
    rules = [
        (~ready, "not_needed", 0.70, "collect_more_labelled_data"),
        ((zero("performance") > 0.7) & (zero("drift") > 0.7), "urgent", 0.95, "retrain_immediately"),
        (zero("performance") > 0.5, "required", 0.85, "retrain_for_performance"),
        (concept, "required", 0.80, "retrain_for_concept_drift"),
        (zero("drift") > 0.5, "recommended", 0.70, "retrain_for_data_drift"),
        (zero("staleness") >= 1.0, "recommended", 0.60, "retrain_stale_model"),
        (F.col("priority") > 0.5, "recommended", 0.55, "retrain_on_combined_signals"),
    ]
    verdict = None
    for cond, decision, confidence, action in rules:
        value = F.struct(F.lit(decision).alias("decision"), F.lit(confidence).alias("confidence"), F.lit(action).alias("action"))
        verdict = F.when(cond, value) if verdict is None else verdict.when(cond, value)
    verdict = verdict.otherwise(F.struct(F.lit("not_needed").alias("decision"), F.lit(0.80).alias("confidence"), F.lit("keep_monitoring").alias("action")))
    out = out.withColumn("__v", verdict).select("*", "__v.decision", "__v.confidence", "__v.action").drop("__v")
    needs = F.lit(s.approval_required) & F.col("decision").isin("recommended", "required")
    return out.withColumn("requires_approval", needs & ~((F.col("decision") == "urgent") & F.lit(s.auto_retrain)))


def route(assessed: DataFrame) -> DataFrame:
    """Retrain or skip."""
    return assessed.withColumn("next_step", F.when(F.col("decision").isin("urgent", "required", "recommended"), "retrain").otherwise("skip"))


def approval_route(assessed: DataFrame, challenger_wins: Column) -> DataFrame:
    """Automatic if no approval is required, the case is urgent or the challenger lost anyway."""
    auto = ~F.col("requires_approval") | (F.col("decision") == "urgent") | ~challenger_wins
    return assessed.withColumn("approval", F.when(auto, "auto").otherwise("human"))
