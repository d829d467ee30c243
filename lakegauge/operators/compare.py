"""Champion against challenger: gates, composite score, paired bootstrap, decision."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from . import evaluate

# A model snapshot is one row per (model_id, role) with these columns; a missing measurement is NULL.
SNAPSHOT_COLUMNS = ["f1", "recall", "roc_auc", "r2", "rmse", "rmse_relative", "ece", "p99_ms", "memory_mb", "size_mb", "slices", "slice_regressions"]

# Gate limits and score weights.
P99_LIMIT_MS = 500.0
MEMORY_LIMIT_MB = 500.0
SIZE_LIMIT_MB = 500.0
P99_RATIO_LIMIT = 2.0
F1_FLOOR, R2_FLOOR = 0.50, 0.20
RECALL_DROP_LIMIT = 0.05
ECE_LIMIT = 0.15
WEIGHTS = {"predictive": 0.50, "operational": 0.25, "calibration": 0.15, "slice": 0.10}
UNMEASURED = 0.8
MIN_IMPROVEMENT = 0.01
ALPHA = 0.05


def snapshot_row(df: DataFrame) -> DataFrame:
    """Fill in the snapshot columns a table does not have."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast("double") for c in SNAPSHOT_COLUMNS if c not in have})


def pair(champion: DataFrame, challenger: DataFrame) -> DataFrame:
    """One row per model with both snapshots as structs; without a champion its struct is NULL."""
    side = lambda df, name: snapshot_row(df).select("model_id", F.struct(*SNAPSHOT_COLUMNS).alias(name))
    return side(challenger, "b").join(side(champion, "a"), "model_id", "left")


def _measured(col: Column) -> Column:
    return F.coalesce(col, F.lit(0.0))


def gate_columns(classification: bool = True) -> list[tuple[str, Column, Column, Column]]:
    """(name, passed, champion value, challenger value) over the paired row; 0 or NULL means not measured."""
    a, b = (lambda c: _measured(F.col(f"a.{c}"))), (lambda c: _measured(F.col(f"b.{c}")))
    none, yes = F.lit(None).cast("double"), F.lit(True)
    floor, metric = (F1_FLOOR, "f1") if classification else (R2_FLOOR, "r2")
    skipped = (a("p99_ms") == 0) | (b("p99_ms") == 0)
    drop = F.try_divide(a("recall") - b("recall"), a("recall"))
    no_slices = (a("slices") == 0) | (b("slices") == 0)
    return [
        ("p99_latency_absolute", (b("p99_ms") <= P99_LIMIT_MS), a("p99_ms"), b("p99_ms")),
        ("p99_latency_regression", skipped | (F.try_divide(b("p99_ms"), a("p99_ms")) <= P99_RATIO_LIMIT), a("p99_ms"), b("p99_ms")),
        ("memory_ceiling", b("memory_mb") <= MEMORY_LIMIT_MB, a("memory_mb"), b("memory_mb")),
        (f"{metric}_floor", b(metric) >= floor, none, b(metric)),
        ("recall_regression", (a("recall") == 0) | (drop <= RECALL_DROP_LIMIT) if classification else yes, a("recall"), b("recall")),
        ("calibration_ece", b("ece") <= ECE_LIMIT if classification else yes, a("ece"), b("ece")),
        ("slice_regression", no_slices | (b("slice_regressions") == 0), none, b("slice_regressions")),
        ("model_size", b("size_mb") <= SIZE_LIMIT_MB, a("size_mb"), b("size_mb")),
    ]


def gates(paired: DataFrame, classification: bool = True) -> DataFrame:
    """Eight rows per model."""
    cells = [
        F.struct(F.lit(name).alias("gate"), ok.alias("passed"), x.cast("double").alias("champion_value"), y.cast("double").alias("challenger_value"))
        for name, ok, x, y in gate_columns(classification)
    ]
    return paired.select("model_id", F.inline(F.array(*cells)))


def composite(side: str, classification: bool = True) -> Column:
    """Weighted score of a paired row's side (``a`` champion, ``b`` challenger); unmeasured parts count 0.8."""
    col = lambda c: F.col(f"{side}.{c}")
    if classification:
        f1 = _measured(col("f1"))
        predictive = (f1 + F.coalesce(col("roc_auc"), f1)) / 2
    else:
        predictive = (F.greatest(_measured(col("r2")), F.lit(0.0)) + F.greatest(1.0 - F.coalesce(col("rmse_relative"), F.lit(1.0)), F.lit(0.0))) / 2

    def score(value: Column, limit: float, slope: float = 1.0) -> Column:
        return F.when(_measured(value) > 0, F.greatest(1.0 - value * slope / limit, F.lit(0.0))).otherwise(UNMEASURED)

    operational = (score(col("p99_ms"), P99_LIMIT_MS) + score(col("memory_mb"), MEMORY_LIMIT_MB)) / 2
    calibrated = score(col("ece"), 1.0, 5.0)
    slices = F.when(_measured(col("slices")) > 0, 1.0 - _measured(col("slice_regressions")) / col("slices")).otherwise(UNMEASURED)
    w = WEIGHTS
    return w["predictive"] * predictive + w["operational"] * operational + w["calibration"] * calibrated + w["slice"] * slices


def improvement(classification: bool = True) -> Column:
    metric = "f1" if classification else "rmse"
    a, b = _measured(F.col(f"a.{metric}")), _measured(F.col(f"b.{metric}"))
    change = b - a if classification else a - b
    return change / F.greatest(F.abs(a), F.lit(1e-8))


# ---- paired bootstrap -------------------------------------------------------------------------------------


#: Classes whose sums a task holds before it passes them on.
HELD_CLASSES = 2_000


def uniform(text: str) -> float:
    """A number in [0, 1) from a text: the first 52 bits of its MD5, which any engine can draw again."""
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / 2**52


def poisson_draws(mean: int, points: np.ndarray) -> np.ndarray:
    """Poisson numbers by inversion: the smallest k whose cumulative probability reaches the point."""
    wide = 10 * math.sqrt(mean) + 20
    k = np.arange(max(0, math.floor(mean - wide)), math.ceil(mean + wide) + 1)
    # log k! by running sums from one exact value
    logs = np.empty(len(k))
    logs[0] = math.lgamma(k[0] + 1)
    logs[1:] = logs[0] + np.cumsum(np.log(k[1:]))
    cumulative = np.cumsum(np.exp(k * math.log(mean) - mean - logs))
    return k[np.minimum(np.searchsorted(cumulative, points), len(k) - 1)]


def bootstrap_f1(scored: DataFrame, y: str, pred_a: str, pred_b: str, metric: str = "f1", pos_label=1, replicates: int = 500, seed: int = 42) -> DataFrame:
    """``(replicate, diff)`` of the paired Poisson bootstrap for F1 or accuracy, champion ``a`` against challenger ``b``.

    The metrics depend only on how often each (label, prediction, prediction) occurs, so the rows are read once and every
    replicate draws a Poisson number for each such cell: by inversion at the MD5 of "y:a:b:seed:replicate" (a null is "null"),
    whatever the number of classes and tasks. F1 is that of ``pos_label`` in a replicate with two classes, else the mean
    weighted by support.
    """
    names = [y, pred_a, pred_b]
    texts = any(isinstance(scored.schema[c].dataType, StringType) for c in names)
    three = F.array(*[F.col(c).cast("string") if texts else F.col(c) for c in names])
    kind = scored.select(three.alias("v")).schema["v"].dataType.elementType
    v = three.cast("array<string>")
    cells = scored.groupBy(v[0].alias("y"), v[1].alias("a"), v[2].alias("b")).agg(F.count("*").alias("n"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # label -> (replicate, [support, predicted a, hit a, predicted b, hit b])
        sums: dict[str | None, np.ndarray] = {}

        def flush() -> Iterator[pd.DataFrame]:
            for label, s in sums.items():
                yield pd.DataFrame({"replicate": np.arange(replicates), "label": pd.Series([label] * replicates, dtype=object), **dict(zip(("s", "pa", "ha", "pb", "hb"), s.T))})
            sums.clear()

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                name = ":".join("null" if x is None else x for x in (row.y, row.a, row.b))
                n = poisson_draws(row.n, np.array([uniform(f"{name}:{seed}:{r}") for r in range(replicates)]))
                for label, flags in ((row.y, (1, 0, row.y == row.a, 0, row.y == row.b)), (row.a, (0, 1, 0, 0, 0)), (row.b, (0, 0, 0, 1, 0))):
                    sums.setdefault(label, np.zeros((replicates, 5), dtype=np.int64))[:] += n[:, None] * np.array(flags, dtype=np.int64)
                if len(sums) >= HELD_CLASSES:
                    yield from flush()
        yield from flush()

    sums = (
        cells.mapInPandas(draw, "replicate long, label string, s long, pa long, ha long, pb long, hb long")
        .groupBy("replicate", "label")
        .agg(*[F.sum(c).alias(c) for c in ("s", "pa", "ha", "pb", "hb")])
    )
    if metric == "accuracy":
        return sums.groupBy("replicate").agg(F.try_divide(F.sum("hb") - F.sum("ha"), F.sum("s")).alias("diff"))
    gain = _f1("pb", "hb") - _f1("pa", "ha")
    positive = F.max(F.when(F.col("label") == F.lit(pos_label).try_cast(kind).cast("string"), gain))
    weighted = F.try_divide(F.sum(gain * F.col("s")), F.sum("s"))
    two = F.count(F.when(F.col("s") > 0, 1)) == 2
    return sums.groupBy("replicate").agg(F.when(two, F.coalesce(positive, weighted)).otherwise(weighted).alias("diff"))


def _f1(predicted: str, hit: str) -> Column:
    return F.coalesce(F.try_divide(2.0 * F.col(hit), F.col("s") + F.col(predicted)), F.lit(0.0))


# Cumulative Poisson(1) probabilities up to 12 events.
POISSON_CDF = np.cumsum([np.exp(-1.0) / float(np.prod(np.arange(1, i + 1))) for i in range(13)])

PRIME = 2**31 - 1


def replicate_lines(replicates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A slope and a shift modulo ``PRIME`` for each replicate."""
    slopes = [1 + int(uniform(f"slope:{seed}:{r}") * (PRIME - 1)) for r in range(replicates)]
    shifts = [int(uniform(f"shift:{seed}:{r}") * PRIME) for r in range(replicates)]
    return np.array(slopes, dtype=np.int64), np.array(shifts, dtype=np.int64)


def bootstrap_rmse(scored: DataFrame, key: Sequence[str], y: str, pred_a: str, pred_b: str, replicates: int = 500, seed: int = 42) -> DataFrame:
    """``(replicate, diff)`` with diff = champion RMSE - challenger RMSE under Poisson(1) row weights.

    The weight of a row in a replicate is drawn at (h * slope + shift) mod ``PRIME``, with h the first 32 bits of the MD5 of
    "key:...:seed": whole numbers that depend neither on the partitioning nor on the engine. Each task adds up all replicates over
    its rows and emits one line per replicate.
    """
    name = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key], F.lit(str(seed)))
    rows = scored.select(
        (F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") % PRIME).alias("h"),
        F.pow(F.col(y).cast("double") - F.col(pred_a), 2).alias("ea"),
        F.pow(F.col(y).cast("double") - F.col(pred_b), 2).alias("eb"),
    )
    slope, shift = replicate_lines(replicates, seed)

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((replicates, 3))
        for pdf in batches:
            h = pdf["h"].to_numpy()
            errors = np.column_stack([np.ones(len(pdf)), pdf["ea"], pdf["eb"]])
            for start in range(0, len(h), 2000):
                u = (h[start : start + 2000, None] * slope + shift) % PRIME / float(PRIME)
                weights = np.searchsorted(POISSON_CDF, u.ravel()).reshape(u.shape)
                total += weights.T @ errors[start : start + 2000]
        yield pd.DataFrame({"replicate": np.arange(replicates), "w": total[:, 0], "a": total[:, 1], "b": total[:, 2]})

    sums = rows.mapInPandas(add, "replicate long, w double, a double, b double").groupBy("replicate").agg(
        F.sum("w").alias("w"), F.sum("a").alias("a"), F.sum("b").alias("b")
    )
    return sums.select("replicate", (F.sqrt(F.try_divide(F.col("a"), F.col("w"))) - F.sqrt(F.try_divide(F.col("b"), F.col("w")))).alias("diff"))


def significance(diffs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """p = share of replicates without improvement; significant below ``alpha``."""
    p = F.avg((F.col("diff") <= 0).cast("double"))
    return diffs.agg(F.count("*").alias("replicates"), F.avg("diff").alias("mean_diff"), p.alias("p_value")).withColumn(
        "is_significant", F.col("p_value") < alpha
    )


# ---- decision ---------------------------------------------------------------------------------------------


def decide(paired: DataFrame, p_values: DataFrame, classification: bool = True, min_improvement: float = MIN_IMPROVEMENT, alpha: float = ALPHA) -> DataFrame:
    """One verdict per model: all gates, enough improvement, significant and a higher composite score.

    ``p_values`` has (model_id, p_value). A model without a champion is approved as a first deployment.
    """
    checks = gate_columns(classification)
    failed = F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok, _, _ in checks]))
    first = F.col("a").isNull()
    out = paired.join(p_values.select("model_id", "p_value"), "model_id", "left").select(
        "model_id",
        first.alias("first_deployment"),
        failed.alias("failed_gates"),
        F.when(first, 1.0).otherwise(improvement(classification)).alias("improvement"),
        "p_value",
        F.when(~first, composite("a", classification)).alias("champion_score"),
        composite("b", classification).alias("challenger_score"),
    )
    enough = F.col("improvement") >= min_improvement
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    higher = F.coalesce(F.col("challenger_score") > F.col("champion_score"), F.lit(False))
    wins = F.col("first_deployment") | ((F.size("failed_gates") == 0) & enough & significant & higher)
    reasons = F.when(F.col("first_deployment"), F.array(F.lit("first_deployment"))).otherwise(
        F.array_compact(
            F.array(
                F.when(F.size("failed_gates") == 0, "all_gates_passed").otherwise(F.concat(F.lit("failed:"), F.concat_ws("+", "failed_gates"))),
                F.when(enough, "improvement_meets_threshold").otherwise("improvement_below_threshold"),
                F.when(significant, "significant").otherwise("not_significant"),
                F.when(higher, "composite_higher").otherwise("composite_not_higher"),
            )
        )
    )
    status = F.when(F.col("first_deployment"), "auto_approved_first_deployment").when(wins, "auto_approved").otherwise("rejected")
    return out.withColumn("challenger_wins", wins).withColumn("approval_status", status).withColumn("reasons", reasons)


def snapshot_of(scored: DataFrame, model_id: str, y: str, pred: str, prob: str, slices: Sequence[str] = (), latency: Column | None = None) -> DataFrame:
    """Snapshot row of a binary model from its scored table."""
    row = evaluate.classification_metrics(scored, y, pred).first()
    auc = evaluate.ranking_metrics(scored, y, {prob: 1}).first()["roc_auc"]
    confidence = F.greatest(F.col(prob), 1 - F.col(prob))
    ece = evaluate.calibration(scored, confidence, F.col(pred) == F.col(y)).first()["ece"]
    from ..functions.frames import local_frame

    values = (model_id, row["f1"], row["recall"], auc, ece, float(len(slices)))
    return snapshot_row(local_frame(scored.sparkSession, [values], "model_id string, f1 double, recall double, roc_auc double, ece double, slices double"))
