"""Synthetic reference and production samples for trials and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.quantiles import exact_quantiles


def sample(spark: SparkSession, rows: int, drift: float = 0.0, seed: int = 42, with_target: bool = True) -> DataFrame:
    """Normal, exponential, categorical and uniform columns; ``drift`` moves them; the target is a logit above its median."""
    base = spark.range(rows)
    df = base.select(
        "id",
        (F.lit(10 + drift) + 2.0 * F.randn(seed)).alias("feature_1"),
        (F.lit(5 + drift * 0.5) + 1.5 * F.randn(seed + 1)).alias("feature_2"),
        (-F.lit(2 + drift * 0.3) * F.log(1.0 - F.rand(seed + 2))).alias("feature_3"),
        F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.floor(F.rand(seed + 3) * 4) + 1).cast("int")).alias("feature_4"),
        (F.rand(seed + 4) * (100 + drift * 15)).alias("feature_5"),
    )
    if not with_target:
        return df
    logit = 0.3 * F.col("feature_1") - 0.5 * F.col("feature_2")
    middle = exact_quantiles(df.select(logit.alias("logit")), {"logit": [0.5]})["logit"]
    return df.withColumn("target", (logit > F.lit(middle[0] if middle else 0.0)).cast("int"))
