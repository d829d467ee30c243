"""Dataset profile for training: problem type, class balance, category, strategy."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import IntegralType, StringType

from ..functions.frames import local_frame

SEVERITY = {
    "extreme_imbalance": 4,
    "severe_imbalance": 3,
    "moderate_imbalance": 2,
    "mild_imbalance": 1,
    "balanced_binary": 0,
    "multiclass_balanced": 0,
    "multiclass_imbalanced": 2,
}


def category(is_classification: Column, n_classes: Column, balance: Column, n: Column) -> Column:
    """The ten dataset categories."""
    return (
        F.when(~is_classification & (n < 5_000), "regression_small")
        .when(~is_classification & (n < 50_000), "regression_medium")
        .when(~is_classification, "regression_large")
        .when(n_classes.isNull() | (n_classes < 2), "balanced_binary")
        .when((n_classes > 2) & (balance < 0.45), "multiclass_imbalanced")
        .when(n_classes > 2, "multiclass_balanced")
        .when(balance < 0.01, "extreme_imbalance")
        .when(balance < 0.05, "severe_imbalance")
        .when(balance < 0.20, "moderate_imbalance")
        .when(balance < 0.45, "mild_imbalance")
        .otherwise("balanced_binary")
    )


def imbalance_severity(cat: Column) -> Column:
    out = F.when(cat.startswith("regression"), -1)
    for name, level in SEVERITY.items():
        out = out.when(cat == name, level)
    return out


def is_classification(df: DataFrame, target: str) -> DataFrame:
    """One row: number of distinct target values and whether they make classes."""
    kind = df.schema[target].dataType
    counts = df.where(F.col(target).isNotNull()).groupBy(target).count().agg(F.count("*").alias("n_unique"))
    k = F.col("n_unique")
    by_type = F.lit(isinstance(kind, StringType)) | (F.lit(isinstance(kind, IntegralType)) & (k <= 20)) | (k == 2)
    return counts.select("n_unique", by_type.alias("is_classification"))


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return df.where(F.col(target).isNotNull()).groupBy(F.col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))


def families(is_class: Column, n: Column) -> Column:
    """Recommended model families, limited to those the Spark ML library has."""
    return F.when(
        is_class,
        F.array_compact(F.array(F.lit("random_forest"), F.when(n > 500, "gradient_boosting"), F.when(n < 100_000, "logistic_regression"))),
    ).otherwise(
        F.array_compact(
            F.array(F.lit("random_forest"), F.lit("ridge_regression"), F.when(n > 500, "gradient_boosting"), F.when(n < 50_000, "elasticnet_regression"))
        )
    )


def profile(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """One row that describes the table for training."""
    counts = df.groupBy(F.col(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    kind = df.schema[target].dataType
    text, whole = isinstance(kind, StringType), isinstance(kind, IntegralType)
    k = F.col("n_classes")
    known = F.when(F.col("label").isNotNull(), F.col("n"))
    base = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_samples"), F.count("label").alias("n_classes"), F.min(known).alias("smallest"), F.max(known).alias("largest")
    )
    is_class = F.lit(text) | (F.lit(whole) & (k <= 20)) | (k == 2)
    ratio = F.when(F.col("is_classification") & (k >= 2), F.col("smallest") / F.col("largest")).otherwise(1.0)
    types = F.create_map(
        *[
            e
            for c in features
            for e in (F.lit(c), F.lit("categorical" if isinstance(df.schema[c].dataType, StringType) else "numeric"))
        ]
    )
    out = base.withColumn("is_classification", is_class).withColumn("balance_ratio", ratio)
    cat = category(F.col("is_classification"), k, F.col("balance_ratio"), F.col("n_samples"))
    out = out.withColumn("category", cat)
    multi = F.col("is_classification") & (k != 2)
    scoring = F.when(~F.col("is_classification"), "neg_root_mean_squared_error").when(k == 2, "f1").otherwise("f1_macro")
    return out.select(
        "n_samples",
        F.lit(len(features)).cast("long").alias("n_features"),
        F.when(F.col("is_classification"), k).alias("n_classes"),
        "is_classification",
        "balance_ratio",
        (F.col("is_classification") & (k >= 2) & (F.col("balance_ratio") < 0.45)).alias("is_imbalanced"),
        F.when(F.col("is_classification") & (k >= 2), F.col("largest") / F.col("smallest")).otherwise(1.0).alias("scale_pos_weight"),
        "category",
        F.when(~F.col("is_classification"), F.col("category")).when(k == 2, "binary").otherwise("multiclass").alias("problem_subtype"),
        scoring.alias("scoring"),
        F.when(multi, "macro").otherwise("binary").alias("average"),
        imbalance_severity(F.col("category")).alias("severity"),
        families(F.col("is_classification"), F.col("n_samples")).alias("families"),
        types.alias("feature_types"),
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Per class: count, majority ratio, balanced weight ``n / (classes * count)`` and binary sample weight ``n / (2 * count)``."""
    counts = class_counts(df, target)
    whole = counts.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.max("n").alias("top")).first()
    total, k, top = (F.lit(whole[name]) for name in ("total", "k", "top"))
    return counts.select(
        "label",
        "n",
        (top / F.col("n")).alias("majority_ratio"),
        (total / (k * F.col("n"))).alias("balanced_weight"),
        (total / (2.0 * F.col("n"))).alias("sample_weight"),
    )


def with_class_weights(df: DataFrame, target: str, column: str = "sample_weight", out: str = "weight") -> DataFrame:
    """Attach the class weight to every row; the weights are one row per class.

    The join side is broadcast only while the classes are few; a target with many classes joins by shuffle.
    """
    weights = class_weights(df, target).select(F.col("label").alias("__label"), F.col(column).alias(out))
    few = weights.limit(10_001).count() <= 10_000
    side = F.broadcast(weights) if few else weights
    return df.join(side, df[target].cast("string") == F.col("__label"), "left").drop("__label")


# Training strategy per category.
# (families, scoring, folds, class weight, use scale_pos_weight, use sample weights, early stopping rounds, extra techniques)
STRATEGIES = {
    "extreme_imbalance": (["random_forest", "gradient_boosting"], "pr_auc", 3, "balanced_subsample", True, True, 30, True),
    "severe_imbalance": (["random_forest", "gradient_boosting", "logistic_regression"], "f1", 4, "balanced_subsample", True, True, 20, True),
    "moderate_imbalance": (["random_forest", "gradient_boosting", "logistic_regression"], "f1_weighted", 5, "balanced", False, False, None, False),
    "mild_imbalance": (["logistic_regression", "random_forest", "gradient_boosting"], "f1_weighted", 5, "balanced", False, False, None, False),
    "balanced_binary": (["logistic_regression", "random_forest", "gradient_boosting"], "accuracy", 5, None, False, False, None, False),
    "multiclass_balanced": (["random_forest", "gradient_boosting", "logistic_regression"], "f1_macro", 5, None, False, False, None, False),
    "multiclass_imbalanced": (["random_forest", "gradient_boosting"], "f1_macro", 4, "balanced", True, True, 20, False),
    "regression_small": (["ridge_regression", "random_forest", "elasticnet_regression", "gradient_boosting"], "neg_root_mean_squared_error", 5, None, False, False, None, False),
    "regression_medium": (["random_forest", "gradient_boosting", "ridge_regression"], "neg_root_mean_squared_error", 5, None, False, False, None, False),
    "regression_large": (["random_forest", "gradient_boosting"], "neg_root_mean_squared_error", 3, None, False, False, None, False),
}

# Changes to the search spaces per category and family.
OVERRIDES = {
    "extreme_imbalance": {
        "random_forest": {"class_weight": ["balanced_subsample"], "min_samples_leaf": [1, 2, 5]},
        "gradient_boosting": {"subsample": [1.0], "min_samples_leaf": [1, 2, 5]},
        "logistic_regression": {"class_weight": ["balanced"], "C": [0.01, 0.05, 0.1, 0.5, 1.0]},
    },
    "severe_imbalance": {
        "random_forest": {"class_weight": ["balanced_subsample", "balanced"]},
        "logistic_regression": {"class_weight": ["balanced"], "C": [0.1, 0.5, 1.0, 2.0, 5.0]},
    },
    "moderate_imbalance": {
        "random_forest": {"class_weight": ["balanced", None]},
        "logistic_regression": {"class_weight": ["balanced", None], "C": [0.5, 1.0, 2.0, 5.0, 10.0]},
    },
    "mild_imbalance": {
        "random_forest": {"class_weight": ["balanced", None]},
        "logistic_regression": {"class_weight": [None, "balanced"], "C": [0.1, 0.5, 1.0, 2.0, 5.0, 10.0]},
    },
    "balanced_binary": {"logistic_regression": {"class_weight": [None]}, "random_forest": {"class_weight": [None]}},
    "multiclass_balanced": {"logistic_regression": {"class_weight": [None, "balanced"]}},
    "multiclass_imbalanced": {"random_forest": {"class_weight": ["balanced"]}},
    "regression_small": {
        "random_forest": {"max_depth": [3, 5, 7, 10], "n_estimators": [50, 100, 200]},
        "gradient_boosting": {"max_depth": [3, 4, 5], "n_estimators": [50, 100, 200]},
    },
    "regression_medium": {},
    "regression_large": {},
}


def weight_candidates(scale_pos_weight: float, high: float) -> list[int]:
    """Positive-class weights to try around the class ratio: half, square root, ratio, ``high`` times."""
    return sorted({max(1, int(scale_pos_weight * 0.5)), max(1, int(math.sqrt(scale_pos_weight))), max(1, int(scale_pos_weight)), max(1, int(scale_pos_weight * high))})


def strategies(spark) -> DataFrame:
    rows = [(c, *values) for c, values in STRATEGIES.items()]
    return local_frame(
        spark,
        rows,
        "category string, families array<string>, scoring string, cv_folds int, class_weight string, use_scale_pos_weight boolean, "
        "use_sample_weight boolean, early_stopping_rounds int, extra_techniques boolean",
    )


def with_strategy(profiles: DataFrame) -> DataFrame:
    """Join the ten-row strategy table on the category."""
    table = strategies(profiles.sparkSession).withColumnRenamed("scoring", "strategy_scoring").withColumnRenamed("families", "strategy_families")
    joined = profiles.join(F.broadcast(table), "category")
    return joined.withColumn("strategy_spw", F.when(F.col("use_scale_pos_weight"), F.col("scale_pos_weight")).otherwise(1.0)).drop("use_scale_pos_weight")
