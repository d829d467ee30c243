"""Metrics of scored tables: everything is an aggregate over (label, prediction, probabilities)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.prefix import bucket_cuts, bucket_totals, running_totals, value_counts
from ..functions.quantiles import SMALL_ROWS, clean_double, grouped_quantiles, with_buckets

EPS = 2.220446049250313e-16
THRESHOLDS = [0.05 + i * 0.05 for i in range(19)]


# ---- confusion counts -------------------------------------------------------------------------------------


def confusion(scored: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """``(by..., y, pred, n)``: the only pass over the rows."""
    return scored.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))


def per_class(conf: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, predicted count, hits, precision, recall and F1 per class; division by zero gives 0."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    both = conf.select(
        *by,
        F.inline(
            F.array(
                F.struct(F.col("y").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"), hit.cast("long").alias("tp")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
            )
        ),
    )
    sums = both.groupBy(*by, "label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("tp").alias("tp"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return sums.select(
        "*",
        ratio(F.col("tp"), F.col("predicted")).alias("precision"),
        ratio(F.col("tp"), F.col("support")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def classification_from(conf: DataFrame, by: Sequence[str] = (), pos_label=1, multi: str = "weighted", macro: bool = False, binary: bool | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 per group.

    Two classes among the labels give the scores of ``pos_label``, more give the ``multi`` average. ``binary``
    fixes the choice instead, as slices take it from the whole table. ``macro`` adds the unweighted F1.
    """
    classes = per_class(conf, by)
    weight = F.col("support") if multi == "weighted" else F.lit(1)
    aggs = [
        F.sum("support").alias("n"),
        F.count(F.when(F.col("support") > 0, 1)).alias("classes"),
        F.coalesce(F.try_divide(F.sum("tp"), F.sum("support")), F.lit(0.0)).alias("accuracy"),
    ]
    for m in ("precision", "recall", "f1"):
        aggs.append(F.coalesce(F.sum(F.when(F.col("label") == pos_label, F.col(m))), F.lit(0.0)).alias(f"{m}_pos"))
        aggs.append(F.coalesce(F.try_divide(F.sum(F.col(m) * weight), F.sum(weight)), F.lit(0.0)).alias(f"{m}_avg"))
    if macro:
        aggs.append(F.avg("f1").alias("f1_macro"))
    sums = classes.groupBy(*by).agg(*aggs) if by else classes.agg(*aggs)
    two = F.col("classes") == 2 if binary is None else F.lit(binary)
    pick = [F.when(two, F.col(f"{m}_pos")).otherwise(F.col(f"{m}_avg")).alias(m) for m in ("precision", "recall", "f1")]
    return sums.select(*by, "n", "classes", "accuracy", *pick, *(["f1_macro"] if macro else []))


def classification_metrics(scored: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = (), pos_label=1, multi: str = "weighted", macro: bool = False) -> DataFrame:
    return classification_from(confusion(scored, y, pred, by), by, pos_label, multi, macro)


# ---- ranking metrics --------------------------------------------------------------------------------------


def ranking_metrics(scored: DataFrame, y: str, scores: Mapping[str, object]) -> DataFrame:
    """ROC AUC and average precision per score column against its class: ``(feature, support, negatives, roc_auc, pr_auc)``.

    ``scores`` maps a column to the label it scores. Equal scores form one group. The sums run over value
    counts with the two-level running totals, so no task sorts a whole score column.
    """
    cols = list(scores)
    kind = scored.schema[y].dataType
    df = scored.select(F.col(y).alias("__y"), *[clean_double(F.col(c)).alias(c) for c in cols])
    hits = {c: F.coalesce(F.col("__y") == F.lit(v).cast(kind), F.lit(False)).cast("long") for c, v in scores.items()}
    own = {"pos": hits, "neg": {c: 1 - hit for c, hit in hits.items()}}
    cuts = bucket_cuts(df, cols)
    totals = bucket_totals(df, cols, {}, cuts, own)
    run = running_totals(value_counts(df, cols, {}, cuts, own), list(own), totals)
    pos_ge, neg_ge = F.col("all_pos") - F.col("before_pos"), F.col("all_neg") - F.col("before_neg")
    area = F.sum(F.col("pos").cast("double") * (F.col("before_neg") + F.col("neg") / 2.0))
    precision = F.sum(F.col("pos") * (pos_ge / (pos_ge + neg_ge)))
    return run.groupBy("feature").agg(
        F.sum("pos").alias("support"),
        F.sum("neg").alias("negatives"),
        F.try_divide(area, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"),
        F.try_divide(precision, F.sum("pos")).alias("pr_auc"),
    )


def one_vs_rest_auc(scored: DataFrame, y: str, scores: Mapping[str, object]) -> DataFrame:
    """Weighted and macro one-vs-rest AUC in one row."""
    each = ranking_metrics(scored, y, scores)
    return each.agg(F.try_divide(F.sum(F.col("roc_auc") * F.col("support")), F.sum("support")).alias("auc_weighted"), F.avg("roc_auc").alias("auc_macro"))


def log_loss(p_true: Column) -> Column:
    return F.avg(-F.log(F.least(F.greatest(p_true, F.lit(EPS)), F.lit(1.0 - EPS))))


def true_probability(y: str, probs: Mapping[object, str]) -> Column:
    out = None
    for label, col in probs.items():
        out = F.when(F.col(y) == label, F.col(col)) if out is None else out.when(F.col(y) == label, F.col(col))
    return out


def threshold_scan(scored: DataFrame, y: str = "y", prob: str = "prob") -> DataFrame:
    """F1 at each of the 19 thresholds from counts per threshold interval, with the best one flagged.

    A score that is null or not a number is never at or above a threshold.
    """
    score = F.coalesce(F.nanvl(F.col(prob).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    df = with_buckets(scored.select(F.col(y).alias("y"), score.alias("p")), {"p": THRESHOLDS})
    counts = df.groupBy(F.col("p__b").alias("k")).agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("pos"), F.count("*").alias("n"))
    positives = F.sum("pos")
    scan = counts.agg(F.collect_list(F.struct("k", "pos", "n")).alias("c"), positives.alias("positives")).select(
        "positives", "c", F.posexplode(F.array(*[F.lit(t) for t in THRESHOLDS])).alias("i", "threshold")
    )
    above = lambda name: F.aggregate(F.filter("c", lambda e: e["k"] > F.col("i")), F.lit(0).cast("long"), lambda a, e: a + e[name])
    scan = scan.select("threshold", "positives", above("pos").alias("tp"), above("n").alias("flagged"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("positives") + F.col("flagged")), F.lit(0.0))
    scan = scan.select("threshold", "tp", "flagged", f1.alias("f1"))
    # 19 rows: one window group is fine here
    best = F.max_by("threshold", F.struct("f1", -F.col("threshold"))).over(Window.partitionBy(F.lit(0)))
    return scan.withColumn("is_best", F.col("threshold") == best)


# ---- regression -------------------------------------------------------------------------------------------


def regression_metrics(scored: DataFrame, y: str = "y", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE, R2 and RMSE over the label range in one aggregate."""
    a, b = F.col(y).cast("double"), F.col(pred).cast("double")
    aggs = [
        F.count("*").alias("n"),
        F.sqrt(F.avg((a - b) * (a - b))).alias("rmse"),
        F.avg(F.abs(a - b)).alias("mae"),
        (1.0 - F.try_divide(F.avg((a - b) * (a - b)), F.var_pop(a))).alias("r2"),
        (F.max(a) - F.min(a)).alias("span"),
    ]
    out = scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)
    return out.withColumn("rmse_relative", F.when(F.col("span") > 0, F.col("rmse") / F.col("span"))).drop("span")


# ---- calibration ------------------------------------------------------------------------------------------


def calibration(scored: DataFrame, confidence: Column, correct: Column, bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Expected and maximum calibration error over equal-width bins, the last one closed."""
    bin_no = F.lit(0)
    for i in range(1, bins):
        bin_no = bin_no + (confidence >= i * (1.0 / bins)).cast("int")
    cells = scored.groupBy(*by, bin_no.alias("bin")).agg(F.count("*").alias("n"), F.avg(correct.cast("double")).alias("acc"), F.avg(confidence).alias("conf"))
    gap = F.abs(F.col("acc") - F.col("conf"))
    aggs = [F.sum("n").alias("n"), F.try_divide(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"), F.max(gap).alias("mce")]
    return cells.groupBy(*by).agg(*aggs) if by else cells.agg(*aggs)


def brier(y: str, probs: Mapping[object, str]) -> Column:
    """Binary (one class given): squared error of its probability; else summed over the classes."""
    total = F.lit(0.0)
    for label, col in probs.items():
        d = F.col(col) - F.when(F.col(y) == label, 1.0).otherwise(0.0)
        total = total + d * d
    return F.avg(total)


# ---- slices -----------------------------------------------------------------------------------------------


def slice_long(scored: DataFrame, slices: Sequence[str], keep: Sequence[str]) -> DataFrame:
    cells = ", ".join(f"`{c}`" for c in slices)
    wide = scored.select(*[F.col(c).alias(f"__{c}") for c in keep], *[F.col(c).cast("string").alias(c) for c in slices])
    names = ", ".join(f"`__{c}` AS `{c}`" for c in keep)
    return scored.sparkSession.sql(f"SELECT {names}, slice_column, slice_value FROM {{t}} UNPIVOT (slice_value FOR slice_column IN ({cells}))", t=wide)


def slice_metrics(scored: DataFrame, slices: Sequence[str], y: str = "y", pred: str = "pred", min_rows: int = 20, binary: bool | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 per (column, value) with at least ``min_rows`` rows.

    Whether the scores are binary follows from the labels of the whole table.
    """
    if binary is None:
        binary = scored.select(y).distinct().limit(3).count() == 2
    keys = [*by, "slice_column", "slice_value"]
    conf = confusion(slice_long(scored, slices, [*by, y, pred]), y, pred, keys)
    return classification_from(conf, keys, binary=binary).where(F.col("n") >= min_rows).drop("classes")


def slice_regression_metrics(scored: DataFrame, slices: Sequence[str], y: str = "y", pred: str = "pred", min_rows: int = 20) -> DataFrame:
    long = slice_long(scored, slices, [y, pred])
    out = regression_metrics(long, y, pred, ["slice_column", "slice_value"])
    return out.where(F.col("n") >= min_rows).select("slice_column", "slice_value", "n", "rmse", "mae")


def slice_regressions(champion: DataFrame, challenger: DataFrame, metric: str = "f1", limit: float = 0.10) -> DataFrame:
    """Slices where the challenger is worse by more than ``limit``, relative; slices with a zero champion value pass."""
    lower_is_better = metric == "rmse"
    a = champion.select("slice_column", "slice_value", F.col(metric).alias("champion"))
    b = challenger.select("slice_column", "slice_value", F.col(metric).alias("challenger"))
    change = F.col("challenger") - F.col("champion") if lower_is_better else F.col("champion") - F.col("challenger")
    rel = F.when(F.col("champion") != 0, change / F.abs("champion"))
    return a.join(b, ["slice_column", "slice_value"]).withColumn("regression", rel).withColumn(
        "is_regression", F.coalesce(F.col("regression") > limit, F.lit(False))
    )


# ---- latency ----------------------------------------------------------------------------------------------


def latency_profile(log: DataFrame, latency: str, by: str, small_rows: int = SMALL_ROWS) -> DataFrame:
    """Percentiles, moments and throughput (requests per second of latency) per group of the serving log, groups of any size and number."""
    groups = log.groupBy(by).agg(
        F.count(latency).alias("n"), F.avg(latency).alias("mean_ms"), F.stddev_pop(latency).alias("std_ms"), F.min(latency).alias("min_ms"), F.max(latency).alias("max_ms")
    )
    return _with_percentiles(groups, grouped_quantiles(log, by, latency, [0.5, 0.75, 0.95, 0.99], small_rows), by)


def _with_percentiles(groups: DataFrame, q: DataFrame, by: str) -> DataFrame:
    same = F.col(f"g.{by}").eqNullSafe(F.col("q.__by"))
    joined = groups.alias("g").join(q.withColumnRenamed(by, "__by").alias("q"), same, "left").drop("__by")
    pcts = [F.get("q", F.lit(i)).alias(f"p{p}_ms") for i, p in enumerate((50, 75, 95, 99))]
    return joined.select(by, "n", *pcts, "mean_ms", "std_ms", "min_ms", "max_ms", F.try_divide(F.lit(1000.0), F.col("mean_ms")).alias("throughput_rps"))


def holdout(df: DataFrame, key: Sequence[str], share: float = 0.20, seed: int = 42, noted: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Seeded split by a hash of the key, to be taken before training: (training, evaluation).

    ``noted`` names a column that holds ``held_out`` of the rows already; it is left out of both sides.
    """
    side = held_out(key, share, seed) if noted is None else F.col(noted)
    training, evaluation = df.where(~side), df.where(side)
    return (training, evaluation) if noted is None else (training.drop(noted), evaluation.drop(noted))


def held_out(key: Sequence[str], share: float = 0.20, seed: int = 42) -> Column:
    """Whether ``holdout`` keeps a row for the evaluation."""
    return split_point(key, seed) < share


def split_point(key: Sequence[str], seed: int) -> Column:
    """A number in [0, 1) from the key and the seed, the same on every run and partitioning."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(2**32)


