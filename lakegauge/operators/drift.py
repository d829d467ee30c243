"""Two-sample statistics and drift reports between a reference and a production table."""

from __future__ import annotations

import bisect
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, NumericType

from ..functions.frames import local_frame
from ..functions.prefix import ROWS_PER_BUCKET, bucket_cuts, bucket_totals, running_totals, value_counts
from ..functions.pvalues import chi2_sf, ks_pvalue
from ..functions.quantiles import clean_double, exact_quantiles

EPS = 1e-8


@dataclass(frozen=True)
class DriftThresholds:
    ks_p: float = 0.05
    psi: float = 0.2
    binary_diff: float = 0.10
    concept_ks_p: float = 0.01
    concept_psi: float = 0.15
    min_values: int = 10
    bins: int = 20


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (NumericType, BooleanType)) and f.name not in exclude
    ]


def shared_features(ref: DataFrame, prod: DataFrame, target: str | None = None) -> list[str]:
    """Numeric columns of the reference that production has too, without the target."""
    return [c for c in numeric_columns(ref, exclude=[target] if target else []) if c in prod.columns]


def _tagged(ref: DataFrame, prod: DataFrame, cols: Sequence[str]) -> DataFrame:
    doubles = [clean_double(F.col(c)).alias(c) for c in cols]
    return ref.select(*doubles, F.lit(True).alias("is_ref")).unionAll(prod.select(*doubles, F.lit(False).alias("is_ref")))


def sample_moments(both: DataFrame, cols: Sequence[str]) -> dict[bool, dict[str, dict[str, float]]]:
    """Count, mean, population std and number of non-0/1 values per side and column: two rows to the driver."""
    aggs = []
    for c in cols:
        x = F.col(c)
        aggs += [
            F.count(x).alias(f"n|{c}"),
            F.avg(x).alias(f"mean|{c}"),
            F.stddev_pop(x).alias(f"std|{c}"),
            F.count(F.when(~x.isin(0.0, 1.0), 1)).alias(f"other|{c}"),
        ]
    empty = {c: {"n": 0, "mean": None, "std": None, "other": 0} for c in cols}
    out = {True: empty, False: dict(empty)}
    for row in both.groupBy("is_ref").agg(*aggs).collect():
        out[row.is_ref] = {c: {k: row[f"{k}|{c}"] for k in ("n", "mean", "std", "other")} for c in cols}
    return out


def usable_features(moments, cols: Sequence[str], min_values: int = 10) -> list[str]:
    return [c for c in cols if moments[True][c]["n"] >= min_values and moments[False][c]["n"] >= min_values]


def _moments_frame(spark, moments, cols: Sequence[str]) -> DataFrame:
    rows = [
        (c, m["n"], p["n"], m["mean"], p["mean"], m["std"], p["std"])
        for c in cols
        for m, p in [(moments[True][c], moments[False][c])]
    ]
    return local_frame(
        spark, rows, "feature string, n_ref long, n_prod long, ref_mean double, cur_mean double, ref_std double, cur_std double"
    )


def reference_breakpoints(ref: DataFrame, cols: Sequence[str], bins: int, n: dict[str, int]) -> dict[str, list[float]]:
    """Distinct reference percentiles; at most ``bins + 1`` numbers per column."""
    found = exact_quantiles(ref, {c: [i / bins for i in range(bins + 1)] for c in cols}, n=n)
    return {c: sorted({v + 0.0 for v in found[c]}) for c in cols}


def distances(both: DataFrame, cols: Sequence[str], moments, breakpoints: dict[str, list[float]] | None = None) -> DataFrame:
    """KS and Wasserstein-1 (not normalised) and, with breakpoints, PSI and JSD per feature.

    The value counts are shuffled once. The bucket edges contain the breakpoints, so the histograms follow
    from the bucket totals alone.
    """
    n = {c: moments[True][c]["n"] + moments[False][c]["n"] for c in cols}
    sums = {"ref": F.col("is_ref").cast("long"), "prod": (~F.col("is_ref")).cast("long")}
    # The breakpoints already are about equal-count buckets; more cuts are for large tables.
    parts = max((len(b) for b in (breakpoints or {}).values()), default=1)
    cuts = bucket_cuts(both, cols, n=n) if max(n.values()) > parts * ROWS_PER_BUCKET else {c: [] for c in cols}
    if breakpoints:
        cuts = {c: sorted({*cuts[c], *bin_cuts(breakpoints[c])}) for c in cols}
    if any(cuts.values()):
        totals = bucket_totals(both, cols, sums, cuts)
    else:
        totals = {c: {0: {"ref": moments[True][c]["n"], "prod": moments[False][c]["n"], "lo": None, "hi": None}} for c in cols}
    run = running_totals(value_counts(both, cols, sums, cuts), list(sums), totals)
    gap = F.abs(
        (F.col("before_ref") + F.col("ref")) / F.col("all_ref") - (F.col("before_prod") + F.col("prod")) / F.col("all_prod")
    )
    shape = run.groupBy("feature").agg(
        F.max(gap).alias("ks"), F.sum(gap * (F.coalesce(F.col("next_x"), F.col("x")) - F.col("x"))).alias("w1")
    )
    if not breakpoints:
        return shape
    hist = _histogram_rows(cols, totals, cuts, breakpoints)
    return shape.join(F.broadcast(local_frame(both.sparkSession, hist, "feature string, psi double, jsd double")), "feature")


def _histogram_rows(cols, totals, cuts, breakpoints) -> list[tuple]:
    rows = []
    for c in cols:
        r, p = histograms(totals[c], cuts[c], breakpoints[c])
        rows.append((c, population_stability(r, p), jensen_shannon(r, p)))
    return rows


def histogram_divergences(ref: DataFrame, prod: DataFrame, cols: Sequence[str], limits: DriftThresholds = DriftThresholds()) -> DataFrame:
    """``(feature, psi, jsd)`` alone: bin counts only, so nothing but one row per bin and task is shuffled."""
    both = _tagged(ref, prod, cols)
    moments = sample_moments(both, cols)
    cols = usable_features(moments, cols, limits.min_values)
    breakpoints = reference_breakpoints(ref, cols, limits.bins, {c: moments[True][c]["n"] for c in cols})
    cuts = {c: bin_cuts(breakpoints[c]) for c in cols}
    sums = {"ref": F.col("is_ref").cast("long"), "prod": (~F.col("is_ref")).cast("long")}
    hist = _histogram_rows(cols, bucket_totals(both, cols, sums, cuts), cuts, breakpoints)
    return local_frame(ref.sparkSession, hist, "feature string, psi double, jsd double")


def bin_cuts(breakpoints: Sequence[float]) -> list[float]:
    """Cut points whose buckets never straddle a bin edge; the last edge is a bucket of its own."""
    return sorted({*breakpoints, float(np.nextafter(breakpoints[-1], np.inf))})


def histograms(totals: dict[int, dict], cuts: Sequence[float], breakpoints: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Counts per bin of both sides: half-open bins, last bin closed, values outside dropped."""
    r, p = np.zeros(len(breakpoints) - 1), np.zeros(len(breakpoints) - 1)
    for bucket, t in totals.items():
        start = cuts[bucket - 1] if bucket else -math.inf
        if len(r) and breakpoints[0] <= start <= breakpoints[-1]:
            at = min(bisect.bisect_right(breakpoints, start) - 1, len(r) - 1)
            r[at] += t["ref"]
            p[at] += t["prod"]
    return r, p


def population_stability(r: np.ndarray, p: np.ndarray) -> float | None:
    """``None`` where a side has no value in any bin: its shares are undefined."""
    if not r.sum() or not p.sum():
        return None
    r, p = r / r.sum() + EPS, p / p.sum() + EPS
    return float(((p - r) * np.log(p / r)).sum())


def jensen_shannon(r: np.ndarray, p: np.ndarray) -> float | None:
    if not len(r):
        return None
    r, p = (r + EPS) / (r + EPS).sum(), (p + EPS) / (p + EPS).sum()
    mid = (r + p) / 2
    return float(0.5 * (r * np.log(r / mid)).sum() + 0.5 * (p * np.log(p / mid)).sum())


def two_sample_statistics(ref: DataFrame, prod: DataFrame, cols: Sequence[str], limits: DriftThresholds = DriftThresholds()) -> DataFrame:
    """One row per feature: sizes, moments, KS with p-value, PSI, JSD and normalised Wasserstein distance."""
    both = _tagged(ref, prod, cols)
    moments = sample_moments(both, cols)
    cols = usable_features(moments, cols, limits.min_values)
    return _continuous(ref, both, cols, moments, limits)


def _continuous(ref, both, cols, moments, limits: DriftThresholds) -> DataFrame:
    params = _moments_frame(ref.sparkSession, moments, cols)
    if not cols:
        return params.selectExpr(
            "*", "0D AS ks", "0D AS ks_p", "0D AS psi", "0D AS jsd", "0D AS wasserstein"
        )
    breakpoints = reference_breakpoints(ref, cols, limits.bins, {c: moments[True][c]["n"] for c in cols})
    stats = distances(both, cols, moments, breakpoints)
    joined = stats.join(F.broadcast(params), "feature")
    return joined.select(
        *params.columns,
        "ks",
        ks_pvalue(F.col("ks"), F.col("n_ref"), F.col("n_prod")).alias("ks_p"),
        "psi",
        "jsd",
        F.when(F.col("ref_std") > 0, F.col("w1") / F.col("ref_std")).otherwise(F.col("w1")).alias("wasserstein"),
    )


def ks_two_sample(ref: DataFrame, prod: DataFrame, cols: Sequence[str]) -> DataFrame:
    """KS statistic and p-value only."""
    both = _tagged(ref, prod, cols)
    moments = sample_moments(both, cols)
    params = _moments_frame(ref.sparkSession, moments, cols)
    stats = distances(both, cols, moments).join(F.broadcast(params), "feature")
    return stats.select(
        "feature", "n_ref", "n_prod", "ref_mean", "cur_mean", "ks", ks_pvalue(F.col("ks"), F.col("n_ref"), F.col("n_prod")).alias("ks_p")
    )


def feature_drift(ref: DataFrame, prod: DataFrame, cols: Sequence[str] | None = None, target: str | None = None, limits: DriftThresholds = DriftThresholds()) -> DataFrame:
    """The per-feature drift verdicts: 0/1 features by proportion, all others by KS and PSI."""
    cols = list(cols) if cols is not None else shared_features(ref, prod, target)
    both = _tagged(ref, prod, cols)
    moments = sample_moments(both, cols)
    usable = usable_features(moments, cols, limits.min_values)
    binary = [c for c in usable if moments[True][c]["other"] == 0 and moments[False][c]["other"] == 0]
    continuous = [c for c in usable if c not in binary]
    parts = []
    if continuous:
        stats = _continuous(ref, both, continuous, moments, limits)
        score = 0.4 * F.least(F.col("ks") * 2, F.lit(1.0)) + 0.6 * F.least(F.col("psi") / 0.5, F.lit(1.0))
        parts.append(
            stats.select(
                "feature",
                F.lit("ks+psi").alias("test"),
                F.col("ks").alias("statistic"),
                F.col("ks_p").alias("p_value"),
                score.alias("drift_score"),
                ((F.col("ks_p") < limits.ks_p) | F.coalesce(F.col("psi") > limits.psi, F.lit(False))).alias("is_drifted"),
                "ref_mean",
                "cur_mean",
                "ref_std",
                "cur_std",
                "psi",
                "wasserstein",
            )
        )
    if binary:
        parts.append(binary_drift(_moments_frame(ref.sparkSession, moments, binary), limits))
    if not parts:
        raise ValueError("no feature has enough values on both sides")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def binary_drift(moments: DataFrame, limits: DriftThresholds = DriftThresholds()) -> DataFrame:
    """Proportion test of 0/1 features from their means."""
    r, p = F.col("ref_mean"), F.col("cur_mean")
    diff = F.abs(p - r)
    psi = F.abs((p + EPS) - (r + EPS)) * F.abs(F.log((p + EPS) / (r + EPS)))
    return moments.select(
        "feature",
        F.lit("proportion+psi").alias("test"),
        diff.alias("statistic"),
        F.lit(None).cast("double").alias("p_value"),
        F.least(diff * 2, F.lit(1.0)).alias("drift_score"),
        ((psi > limits.psi) | (diff > limits.binary_diff)).alias("is_drifted"),
        "ref_mean",
        "cur_mean",
        F.lit(0.0).alias("ref_std"),
        F.lit(0.0).alias("cur_std"),
        psi.alias("psi"),
        F.lit(None).cast("double").alias("wasserstein"),
    )


# ---- categorical features ---------------------------------------------------------------------------------


def category_counts(ref: DataFrame, prod: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(feature, value, ref, prod)`` over the union of categories; the counts are summed map-side."""

    def side(df: DataFrame, is_ref: int) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])
        return df.select(F.inline(cells)).where("value IS NOT NULL").select(
            "feature", "value", F.lit(is_ref).cast("long").alias("r"), F.lit(1 - is_ref).cast("long").alias("p")
        )

    both = side(ref, 1).unionAll(side(prod, 0))
    return both.groupBy("feature", "value").agg(F.sum("r").alias("ref"), F.sum("p").alias("prod"))


def _with_totals(counts: DataFrame) -> DataFrame:
    """Totals per feature by aggregate and broadcast: a window would gather every category of a feature."""
    totals = counts.groupBy("feature").agg(F.sum("ref").alias("all_ref"), F.sum("prod").alias("all_prod"))
    return counts.join(F.broadcast(totals), "feature")


def categorical_psi(ref: DataFrame, prod: DataFrame, cols: Sequence[str]) -> DataFrame:
    shares = _with_totals(category_counts(ref, prod, cols)).select(
        "feature",
        (F.try_divide(F.col("ref"), F.col("all_ref")) + EPS).alias("r"),
        (F.try_divide(F.col("prod"), F.col("all_prod")) + EPS).alias("p"),
    )
    return shares.groupBy("feature").agg(
        F.count("*").alias("categories"), F.sum((F.col("p") - F.col("r")) * F.log(F.col("p") / F.col("r"))).alias("psi")
    )


def chi_square(ref: DataFrame, prod: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Goodness of fit of production counts to the reference shares scaled to production size."""
    counts = _with_totals(category_counts(ref, prod, cols))
    expected = F.try_divide(F.col("ref"), F.col("all_ref")) * F.col("all_prod")
    parts = counts.select("feature", F.col("prod").alias("o"), expected.alias("e")).where("e > 0")
    found = parts.groupBy("feature").agg(
        F.count("*").alias("k"), F.sum((F.col("o") - F.col("e")) * (F.col("o") - F.col("e")) / F.col("e")).alias("chi2")
    )
    names = local_frame(ref.sparkSession, [(c,) for c in cols], "feature string")
    few = F.coalesce(F.col("k"), F.lit(0)) < 2
    return names.join(found, "feature", "left").select(
        "feature",
        F.when(few, 0.0).otherwise(F.col("chi2")).alias("chi2"),
        F.when(few, 0).otherwise(F.col("k") - 1).cast("long").alias("dof"),
        F.when(few, 1.0).otherwise(chi2_sf(F.col("chi2"), (F.col("k") - 1).cast("double"))).alias("p_value"),
    )


# ---- target drift, aggregation, report --------------------------------------------------------------------


def top_categories(ref: DataFrame, prod: DataFrame, col: str, k: int = 10) -> DataFrame:
    """The ``k`` largest shares of each side, ties by value."""
    counts = _with_totals(category_counts(ref, prod, [col]))
    sides = counts.select(
        F.inline(
            F.array(
                F.struct(F.lit("reference").alias("side"), F.col("value"), (F.col("ref")).alias("n"), F.try_divide(F.col("ref"), F.col("all_ref")).alias("share")),
                F.struct(F.lit("production").alias("side"), F.col("value"), (F.col("prod")).alias("n"), F.try_divide(F.col("prod"), F.col("all_prod")).alias("share")),
            )
        )
    ).where("n > 0")
    rank = F.row_number().over(Window.partitionBy("side").orderBy(F.desc("n"), F.asc("value")))
    return sides.withColumn("rank", rank).where(F.col("rank") <= k)


def target_drift(ref: DataFrame, prod: DataFrame, target: str, limits: DriftThresholds = DriftThresholds()) -> DataFrame:
    """Concept drift of the target: KS for numbers, PSI for categories."""
    if target in numeric_columns(ref):
        stats = ks_two_sample(ref, prod, [target])
        return stats.select(
            F.lit(target).alias("target"),
            F.lit("ks_2samp").alias("test"),
            F.col("ks").alias("statistic"),
            F.col("ks_p").alias("p_value"),
            (F.col("ks_p") < limits.concept_ks_p).alias("concept_drift"),
        )
    return categorical_psi(ref, prod, [target]).select(
        F.lit(target).alias("target"),
        F.lit("psi").alias("test"),
        F.col("psi").alias("statistic"),
        F.lit(None).cast("double").alias("p_value"),
        (F.col("psi") > limits.concept_psi).alias("concept_drift"),
    )


def severity(proportion: Column, score: Column, concept: Column) -> Column:
    return (
        F.when(concept & (proportion > 0.5), "critical")
        .when(concept | (proportion > 0.6), "high")
        .when((proportion > 0.3) | (score > 0.5), "moderate")
        .when(proportion > 0.1, "low")
        .otherwise("none")
    )


def drift_summary(features: DataFrame, concept: Column | bool = False) -> DataFrame:
    """Drifted count, share, mean score, severity, the five worst features and recommendations: one row."""
    concept = F.lit(concept) if isinstance(concept, bool) else concept
    worst = F.transform(
        F.slice(F.sort_array(F.collect_list(F.when(F.col("is_drifted"), F.struct((-F.col("drift_score")).alias("s"), F.col("feature").alias("f"))))), 1, 5),
        lambda e: e["f"],
    )
    base = features.agg(
        F.count(F.when(F.col("is_drifted"), 1)).alias("features_drifted"),
        F.count("*").alias("features_total"),
        F.coalesce(F.avg("drift_score"), F.lit(0.0)).alias("drift_score"),
        worst.alias("top_features"),
        F.first(concept).alias("concept_drift"),
    ).withColumn("drift_proportion", F.coalesce(F.try_divide(F.col("features_drifted"), F.col("features_total")), F.lit(0.0)))
    base = base.withColumn("severity", severity(F.col("drift_proportion"), F.col("drift_score"), F.col("concept_drift")))
    level = F.col("severity")
    advice = F.array_compact(
        F.array(
            F.when(level == "critical", "retrain_immediately"),
            F.when(F.col("concept_drift"), "target_distribution_changed"),
            F.when(level.isin("high", "critical"), "retrain_on_production"),
            F.when(level == "moderate", "watch_and_schedule_retraining"),
            F.when(F.size("top_features") > 0, F.concat(F.lit("top_drifted:"), F.concat_ws(",", "top_features"))),
        )
    )
    return base.withColumn("recommendations", advice)


def alignment(ref: DataFrame, new: DataFrame, cols: Sequence[str] | None = None, min_values: int = 10) -> DataFrame:
    """Raw-column check: misaligned only if significant (p < 0.01) and large (D > 0.10)."""
    cols = list(cols) if cols is not None else shared_features(new, ref)
    stats = ks_two_sample(ref, new, cols).where((F.col("n_ref") >= min_values) & (F.col("n_prod") >= min_values))
    off = (F.col("ks_p") < 0.01) & (F.col("ks") > 0.10)
    return stats.select(
        F.col("feature").alias("column"),
        F.col("ks").alias("ks_stat"),
        F.col("ks_p").alias("p_value"),
        (~off).alias("aligned"),
        F.when(~off, "info").when(F.col("ks") < 0.20, "warning").otherwise("error").alias("drift_severity"),
        "ref_mean",
        F.col("cur_mean").alias("new_mean"),
        F.when(F.col("ref_mean") != 0, F.abs(F.col("ref_mean") - F.col("cur_mean")) / F.abs(F.col("ref_mean")) * 100).alias("mean_diff_pct"),
    )


def monitor_drift(ref: DataFrame, current: DataFrame, limits: DriftThresholds = DriftThresholds(), categorical: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Scheduled monitor: per-column verdicts and one summary row with the dataset flag (more than half drifted)."""
    details = feature_drift(ref, current, [c for c in shared_features(ref, current) if c not in categorical], limits=limits).select(
        F.col("feature").alias("column"), "test", "statistic", "p_value", "drift_score", F.col("is_drifted").alias("drifted")
    )
    if categorical:
        chi = chi_square(ref, current, categorical)
        details = details.unionByName(
            chi.select(
                F.col("feature").alias("column"),
                F.lit("chi_square").alias("test"),
                F.col("chi2").alias("statistic"),
                "p_value",
                (1.0 - F.col("p_value")).alias("drift_score"),
                (F.col("p_value") < limits.ks_p).alias("drifted"),
            )
        )
    share = F.try_divide(F.count(F.when(F.col("drifted"), 1)), F.count("*"))
    summary = details.agg(
        F.count(F.when(F.col("drifted"), 1)).alias("n_features_drifted"),
        F.count("*").alias("n_features_total"),
        F.coalesce(share, F.lit(0.0)).alias("drift_share"),
    ).withColumn("dataset_drift", F.col("drift_share") > 0.5)
    return details, summary.withColumn(
        "severity",
        F.when(F.col("dataset_drift"), "high").when(F.col("drift_share") > 0.3, "moderate").when(F.col("drift_share") > 0.1, "low").otherwise("none"),
    )


def append_history(report: DataFrame, path: str, run_date: str) -> None:
    """Add a report to the history table, one partition per run date."""
    report.withColumn("run_date", F.lit(run_date)).write.mode("append").partitionBy("run_date").parquet(path)


def read_history(spark, path: str) -> DataFrame:
    return spark.read.parquet(path)
