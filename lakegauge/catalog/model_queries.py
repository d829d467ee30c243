"""Dataset profiles, model metrics, champion-challenger comparison, retraining decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, dataset, decide, evaluate
from .base import Tables, query, rounded
from .inputs import MULTI_SQL, REGRESSION_SQL, SCORED_SQL, from_sql

# ---- dataset profile --------------------------------------------------------------------------------------

CATEGORY_SQL = """CASE WHEN NOT is_class THEN CASE WHEN n < 5000 THEN 'regression_small' WHEN n < 50000 THEN 'regression_medium' ELSE 'regression_large' END
  WHEN k < 2 THEN 'balanced_binary' WHEN k > 2 THEN CASE WHEN ratio < 0.45 THEN 'multiclass_imbalanced' ELSE 'multiclass_balanced' END
  WHEN ratio < 0.01 THEN 'extreme_imbalance' WHEN ratio < 0.05 THEN 'severe_imbalance' WHEN ratio < 0.2 THEN 'moderate_imbalance' WHEN ratio < 0.45 THEN 'mild_imbalance' ELSE 'balanced_binary' END"""


def profile_sql(table: str, target: str, whole: bool, text: bool = False) -> str:
    rule = "true" if text else f"({'k <= 20 OR ' if whole else ''}k = 2)"
    return f"""c AS (SELECT {target} AS v, count(*) AS c FROM {table} WHERE {target} IS NOT NULL GROUP BY 1),
    s AS (SELECT count(*) AS k, min(c) AS lo, max(c) AS hi, (SELECT count(*) FROM {table}) AS n FROM c),
    p AS (SELECT *, {rule} AS is_class, CASE WHEN {rule} AND k >= 2 THEN lo / hi ELSE 1.0 END AS ratio FROM s)"""


PROFILE_OUT = f"""SELECT n AS n_samples, CASE WHEN is_class THEN k END AS n_classes, is_class AS is_classification, round(ratio, 6)::DOUBLE AS balance_ratio,
  is_class AND k >= 2 AND ratio < 0.45 AS is_imbalanced, round(CASE WHEN is_class AND k >= 2 THEN hi / lo ELSE 1.0 END, 6)::DOUBLE AS scale_pos_weight, {CATEGORY_SQL} AS category FROM p"""


def profile_out(df, features, target):
    out = dataset.profile(df, features, target)
    return rounded(out.select("n_samples", "n_classes", "is_classification", "balance_ratio", "is_imbalanced", "scale_pos_weight", "category"))


@query("profile_binary_target", f"WITH {profile_sql('labels', 'toxic', True)} {PROFILE_OUT}")
def profile_binary_target(t: Tables):
    return profile_out(t.labels, ["quality"], "toxic")


@query("profile_multiclass_target", f"WITH {profile_sql('documents', 'lang', False, True)} {PROFILE_OUT}")
def profile_multiclass_target(t: Tables):
    return profile_out(t.documents, ["n_chars", "source"], "lang")


@query("profile_regression_target", f"WITH {profile_sql('orders', 'o_totalprice', False)} {PROFILE_OUT}")
def profile_regression_target(t: Tables):
    return profile_out(t.orders, ["o_custkey", "o_orderstatus"], "o_totalprice")


@query(
    "problem_type",
    "SELECT 'l_linenumber' AS target, count(DISTINCT l_linenumber) AS n_unique, count(DISTINCT l_linenumber) <= 20 AS is_classification FROM lineitem "
    "UNION ALL SELECT 'l_partkey', count(DISTINCT l_partkey), count(DISTINCT l_partkey) <= 20 FROM lineitem "
    "UNION ALL SELECT 'l_discount', count(DISTINCT l_discount), count(DISTINCT l_discount) = 2 FROM lineitem "
    "UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus), true FROM lineitem",
)
def problem_type(t: Tables):
    out = None
    for c in ("l_linenumber", "l_partkey", "l_discount", "l_linestatus"):
        part = dataset.is_classification(t.lineitem, c).select(F.lit(c).alias("target"), "n_unique", "is_classification")
        out = part if out is None else out.unionAll(part)
    return out


@query(
    "dataset_category_by_source",
    f"""WITH s AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS k, true AS is_class FROM documents GROUP BY 1),
    r AS (SELECT source, min(c) / max(c) AS ratio FROM (SELECT source, lang, count(*) AS c FROM documents GROUP BY ALL) GROUP BY 1)
    SELECT source, n, {CATEGORY_SQL} AS category FROM s JOIN r USING (source)""",
)
def dataset_category_by_source(t: Tables):
    per = t.documents.groupBy("source", "lang").agg(F.count("*").alias("c")).groupBy("source")
    out = per.agg(F.sum("c").alias("n"), F.count("*").alias("k"), (F.min("c") / F.max("c")).alias("ratio"))
    return out.select("source", "n", dataset.category(F.lit(True), F.col("k"), F.col("ratio"), F.col("n")).alias("category"))


@query(
    "training_strategy",
    f"""WITH {profile_sql('labels', 'toxic', True)}, x AS (SELECT hi / lo AS spw, {CATEGORY_SQL} AS category FROM p)
    SELECT category, CASE category WHEN 'extreme_imbalance' THEN 'pr_auc' WHEN 'severe_imbalance' THEN 'f1' WHEN 'balanced_binary' THEN 'accuracy' ELSE 'f1_weighted' END AS scoring,
      CASE category WHEN 'extreme_imbalance' THEN 3 WHEN 'severe_imbalance' THEN 4 ELSE 5 END AS cv_folds,
      round(CASE WHEN category IN ('extreme_imbalance', 'severe_imbalance') THEN spw ELSE 1.0 END, 6)::DOUBLE AS spw FROM x""",
)
def training_strategy(t: Tables):
    out = dataset.with_strategy(dataset.profile(t.labels, ["quality"], "toxic"))
    return rounded(out.select("category", F.col("strategy_scoring").alias("scoring"), "cv_folds", F.col("strategy_spw").alias("spw")))


@query(
    "model_families",
    """WITH s AS (SELECT 'labels' AS name, count(*) AS n, true AS c FROM labels UNION ALL SELECT 'orders', count(*), false FROM orders UNION ALL SELECT 'lineitem', count(*), true FROM lineitem)
    SELECT name, CASE WHEN c THEN concat_ws(',', 'random_forest', CASE WHEN n > 500 THEN 'gradient_boosting' END, CASE WHEN n < 100000 THEN 'logistic_regression' END)
      ELSE concat_ws(',', 'random_forest', 'ridge_regression', CASE WHEN n > 500 THEN 'gradient_boosting' END, CASE WHEN n < 50000 THEN 'elasticnet_regression' END) END AS families FROM s""",
)
def model_families(t: Tables):
    counts = None
    for name, c in (("labels", True), ("orders", False), ("lineitem", True)):
        part = getattr(t, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n", F.lit(c).alias("c"))
        counts = part if counts is None else counts.unionAll(part)
    return counts.select("name", F.concat_ws(",", dataset.families(F.col("c"), F.col("n"))).alias("families"))


@query(
    "class_weights",
    "WITH c AS (SELECT lang AS label, count(*) AS n FROM documents GROUP BY 1) SELECT label, n, round((SELECT max(n) FROM c) / n, 6) AS majority_ratio, "
    "round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS balanced_weight, round((SELECT sum(n) FROM c) / (2.0 * n), 6)::DOUBLE AS sample_weight FROM c",
)
def class_weights(t: Tables):
    return rounded(dataset.class_weights(t.documents, "lang"))


# ---- metrics ----------------------------------------------------------------------------------------------

PRF = "round(accuracy, 6)::DOUBLE AS accuracy, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1"
BINARY_METRICS = """(SELECT count(*) AS n, avg((y = a)::INT) AS accuracy, coalesce(sum(y * a) / nullif(sum(a), 0), 0) AS precision,
  coalesce(sum(y * a) / nullif(sum(y), 0), 0) AS recall, coalesce(2 * sum(y * a) / nullif(sum(a) + sum(y), 0), 0) AS f1 FROM {src} {group})"""


def scored(t: Tables):
    return from_sql(t, SCORED_SQL, "scored")


def multi(t: Tables):
    return from_sql(t, MULTI_SQL, "multi")


def reg(t: Tables):
    return from_sql(t, REGRESSION_SQL, "reg")


@query("accuracy", f"WITH {SCORED_SQL} SELECT round(avg((y = a)::INT), 6) AS accuracy FROM scored")
def accuracy(t: Tables):
    return rounded(evaluate.classification_metrics(scored(t), "y", "a").select("accuracy"))


@query("binary_precision_recall_f1", f"WITH {SCORED_SQL} SELECT n, {PRF} FROM " + BINARY_METRICS.format(src="scored", group=""))
def binary_precision_recall_f1(t: Tables):
    return rounded(evaluate.classification_metrics(scored(t), "y", "a").drop("classes"))


CLASSES_SQL = """cls AS (SELECT k AS label, count(*) FILTER (y = k) AS support, count(*) FILTER (pred = k) AS predicted, count(*) FILTER (y = k AND pred = k) AS tp FROM multi, range(3) r(k) GROUP BY 1),
prf AS (SELECT label, support, predicted, tp, coalesce(tp / nullif(predicted, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted, 0), 0) AS f1 FROM cls)"""


@query(
    "weighted_precision_recall_f1",
    f"WITH {MULTI_SQL}, {CLASSES_SQL} SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 6) AS accuracy, round(sum(precision * support) / sum(support), 6) AS precision, "
    "round(sum(recall * support) / sum(support), 6) AS recall, round(sum(f1 * support) / sum(support), 6) AS f1 FROM prf",
)
def weighted_precision_recall_f1(t: Tables):
    return rounded(evaluate.classification_metrics(multi(t), "y", "pred").drop("classes"))


@query(
    "macro_precision_recall_f1",
    f"WITH {MULTI_SQL}, {CLASSES_SQL} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(f1), 6) AS f1_macro FROM prf",
)
def macro_precision_recall_f1(t: Tables):
    return rounded(evaluate.classification_metrics(multi(t), "y", "pred", multi="macro", macro=True).select("precision", "recall", "f1", "f1_macro"))


@query(
    "per_class_precision_recall",
    f"WITH {MULTI_SQL}, {CLASSES_SQL} SELECT label::INT AS label, support, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall FROM prf",
)
def per_class_precision_recall(t: Tables):
    return rounded(evaluate.per_class(evaluate.confusion(multi(t), "y", "pred")).select("label", "support", "precision", "recall"))


def auc_sql(src: str, y: str, p: str) -> str:
    """Area from value counts: pairs ranked right plus half the ties; average precision over thresholds."""
    return f"""(SELECT sum(pos * (cn - neg + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc, sum(pos * ((tp - cp + pos) / ((tp - cp + pos) + (tn - cn + neg)))) / sum(pos) AS ap, sum(pos) AS support FROM (
      SELECT pos, neg, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS tp, sum(neg) OVER () AS tn FROM (
        SELECT {p} AS p, count(*) FILTER ({y})::DOUBLE AS pos, count(*) FILTER (NOT {y})::DOUBLE AS neg FROM {src} GROUP BY 1) WINDOW w AS (ORDER BY p)))"""


@query("roc_auc_binary", f"WITH {SCORED_SQL} SELECT 'pa' AS feature, round(auc, 6) AS roc_auc FROM {auc_sql('scored', 'y = 1', 'pa')} UNION ALL SELECT 'pb', round(auc, 6) FROM {auc_sql('scored', 'y = 1', 'pb')}")
def roc_auc_binary(t: Tables):
    return rounded(evaluate.ranking_metrics(scored(t), "y", {"pa": 1, "pb": 1}).select("feature", "roc_auc"))


@query(
    "roc_auc_one_vs_rest",
    f"WITH {MULTI_SQL}, e AS (" + " UNION ALL ".join(f"SELECT auc, support FROM {auc_sql('multi', f'y = {k}', f'p{k}')}" for k in range(3)) + ") "
    "SELECT round(sum(auc * support) / sum(support), 6) AS auc_weighted, round(avg(auc), 6) AS auc_macro FROM e",
)
def roc_auc_one_vs_rest(t: Tables):
    return rounded(evaluate.one_vs_rest_auc(multi(t), "y", {"p0": 0, "p1": 1, "p2": 2}))


@query("average_precision", f"WITH {SCORED_SQL} SELECT 'pa' AS feature, round(ap, 6) AS pr_auc FROM {auc_sql('scored', 'y = 1', 'pa')} UNION ALL SELECT 'pb', round(ap, 6) FROM {auc_sql('scored', 'y = 1', 'pb')}")
def average_precision(t: Tables):
    return rounded(evaluate.ranking_metrics(scored(t), "y", {"pa": 1, "pb": 1}).select("feature", "pr_auc"))


@query(
    "log_loss",
    f"WITH {SCORED_SQL}, {MULTI_SQL} SELECT (SELECT round(avg(-ln(CASE WHEN y = 1 THEN pa ELSE 1 - pa END)), 6) FROM scored) AS log_loss_binary, "
    "(SELECT round(avg(-ln(CASE y WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)), 6) FROM multi) AS log_loss_multi",
)
def log_loss(t: Tables):
    binary = scored(t).agg(evaluate.log_loss(F.when(F.col("y") == 1, F.col("pa")).otherwise(1 - F.col("pa"))).alias("v")).select(F.lit("log_loss_binary").alias("k"), "v")
    three = multi(t).agg(evaluate.log_loss(evaluate.true_probability("y", {0: "p0", 1: "p1", 2: "p2"})).alias("v")).select(F.lit("log_loss_multi").alias("k"), "v")
    both = binary.unionAll(three)
    pick = lambda k: F.max(F.when(F.col("k") == k, F.col("v"))).alias(k)
    return rounded(both.agg(pick("log_loss_binary"), pick("log_loss_multi")))


@query(
    "regression_metrics",
    f"WITH {REGRESSION_SQL} SELECT count(*) AS n, round(sqrt(avg((y - pa) ** 2)), 4) AS rmse, round(avg(abs(y - pa)), 4) AS mae, round(1 - avg((y - pa) ** 2) / var_pop(y), 6) AS r2, "
    "round(sqrt(avg((y - pa) ** 2)) / (max(y) - min(y)), 6) AS rmse_relative FROM reg",
)
def regression_metrics(t: Tables):
    return rounded(evaluate.regression_metrics(reg(t), "y", "pa"), 6, rmse=4, mae=4)


@query(
    "calibration_error",
    f"WITH {SCORED_SQL}, c AS (SELECT greatest(pa, 1 - pa) AS conf, (y = a)::INT AS ok FROM scored), "
    "b AS (SELECT least(9, list_sum([(conf >= i * 0.1::DOUBLE)::INT FOR i IN range(1, 11)])) AS bin, count(*) AS n, avg(ok) AS acc, avg(conf) AS conf FROM c GROUP BY 1) "
    "SELECT sum(n)::BIGINT AS n, round(sum(n * abs(acc - conf)) / sum(n), 6) AS ece, round(max(abs(acc - conf)), 6) AS mce FROM b",
)
def calibration_error(t: Tables):
    out = evaluate.calibration(scored(t), F.greatest(F.col("pa"), 1 - F.col("pa")), F.col("y") == F.col("a"))
    return rounded(out)


@query(
    "brier_score",
    f"WITH {SCORED_SQL}, {MULTI_SQL} SELECT 'binary' AS kind, round(avg((pa - y) ** 2), 6) AS brier FROM scored "
    "UNION ALL SELECT 'multi', round(avg((p0 - (y = 0)::INT) ** 2 + (p1 - (y = 1)::INT) ** 2 + (p2 - (y = 2)::INT) ** 2), 6) FROM multi",
)
def brier_score(t: Tables):
    one = scored(t).agg(evaluate.brier("y", {1: "pa"}).alias("brier")).select(F.lit("binary").alias("kind"), "brier")
    three = multi(t).agg(evaluate.brier("y", {0: "p0", 1: "p1", 2: "p2"}).alias("brier")).select(F.lit("multi").alias("kind"), "brier")
    return rounded(one.unionAll(three))


@query(
    "threshold_tuning",
    f"""WITH {SCORED_SQL}, th AS (SELECT 0.05::DOUBLE + i * 0.05::DOUBLE AS threshold FROM range(19) r(i)),
    s AS (SELECT threshold, count(*) FILTER (pb >= threshold AND y = 1) AS tp, count(*) FILTER (pb >= threshold) AS flagged, 2.0 * count(*) FILTER (pb >= threshold AND y = 1) / (count(*) FILTER (pb >= threshold) + sum(y)) AS f1
      FROM th, scored GROUP BY 1)
    SELECT round(threshold, 4) AS threshold, tp, flagged, round(f1, 6)::DOUBLE AS f1, threshold = (SELECT threshold FROM s ORDER BY f1 DESC, threshold LIMIT 1) AS is_best FROM s""",
)
def threshold_tuning(t: Tables):
    return rounded(evaluate.threshold_scan(scored(t), "y", "pb"), 6, threshold=4)


SLICES = ["l_returnflag", "l_linestatus", "l_linenumber"]


def slices_sql(pred: str) -> str:
    return f"""(SELECT slice_column, slice_value, n, precision, recall, f1 FROM (SELECT slice_column, slice_value, count(*) AS n, coalesce(sum(y * p) / nullif(sum(p), 0), 0) AS precision,
      coalesce(sum(y * p) / nullif(sum(y), 0), 0) AS recall, coalesce(2 * sum(y * p) / nullif(sum(p) + sum(y), 0), 0) AS f1 FROM (
        SELECT y, {pred} AS p, 'l_returnflag' AS slice_column, l_returnflag AS slice_value FROM scored UNION ALL SELECT y, {pred}, 'l_linestatus', l_linestatus FROM scored
        UNION ALL SELECT y, {pred}, 'l_linenumber', l_linenumber::VARCHAR FROM scored) GROUP BY ALL) WHERE n >= 20)"""


@query(
    "slice_metrics",
    f"WITH {SCORED_SQL} SELECT slice_column, slice_value, n, round(precision, 6)::DOUBLE AS precision, round(recall, 6)::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1 FROM {slices_sql('a')}",
)
def slice_metrics(t: Tables):
    return rounded(evaluate.slice_metrics(scored(t), SLICES, "y", "a").drop("accuracy"))


@query(
    "slice_regression_errors",
    f"WITH {REGRESSION_SQL}, l AS (SELECT y, pa, 'l_returnflag' AS slice_column, l_returnflag AS slice_value FROM reg UNION ALL SELECT y, pa, 'l_linestatus', l_linestatus FROM reg) "
    "SELECT slice_column, slice_value, count(*) AS n, round(sqrt(avg((y - pa) ** 2)), 3) AS rmse, round(avg(abs(y - pa)), 3) AS mae FROM l GROUP BY ALL HAVING count(*) >= 20",
)
def slice_regression_errors(t: Tables):
    return rounded(evaluate.slice_regression_metrics(reg(t), ["l_returnflag", "l_linestatus"], "y", "pa"), 3)


@query(
    "slice_regressions",
    f"""WITH {SCORED_SQL}, j AS (SELECT slice_column, slice_value, x.f1 AS champion, z.f1 AS challenger FROM {slices_sql('b')} x JOIN {slices_sql('a')} z USING (slice_column, slice_value))
    SELECT slice_column, slice_value, round(champion, 6)::DOUBLE AS champion, round(challenger, 6)::DOUBLE AS challenger, round(CASE WHEN champion <> 0 THEN (champion - challenger) / abs(champion) END, 6)::DOUBLE AS regression,
      coalesce(CASE WHEN champion <> 0 THEN (champion - challenger) / abs(champion) END > 0.1, false) AS is_regression FROM j""",
)
def slice_regressions(t: Tables):
    s = scored(t)
    return rounded(evaluate.slice_regressions(evaluate.slice_metrics(s, SLICES, "y", "b"), evaluate.slice_metrics(s, SLICES, "y", "a")))


@query(
    "latency_profile",
    "SELECT event_type, count(value) AS n, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 4) AS p{p}_ms" for p in (50, 75, 95, 99)) + ", round(avg(value), 4) AS mean_ms, round(stddev_pop(value), 4) AS std_ms, "
    "min(value) AS min_ms, max(value) AS max_ms, round(1000.0 / avg(value), 4) AS throughput_rps FROM events GROUP BY 1",
)
def latency_profile(t: Tables):
    return rounded(evaluate.latency_profile(t.events, "value", "event_type"), 4)


@query("holdout_split", "SELECT o_orderstatus, count(*) FILTER (s >= 0.2) AS train, count(*) FILTER (s < 0.2) AS held_out FROM (SELECT o_orderstatus, ('0x' || substr(md5(o_orderkey::VARCHAR || ':42'), 1, 8))::BIGINT / 4294967296.0 AS s FROM orders) GROUP BY 1")
def holdout_split(t: Tables):
    train, held = evaluate.holdout(t.orders, ["o_orderkey"])
    both = train.select("o_orderstatus", F.lit(0).alias("h")).unionAll(held.select("o_orderstatus", F.lit(1)))
    return both.groupBy("o_orderstatus").agg(F.count(F.when(F.col("h") == 0, 1)).alias("train"), F.count(F.when(F.col("h") == 1, 1)).alias("held_out"))


# ---- champion and challenger: one model per return flag, champion = a, challenger = b ----------------------



SNAP_SQL = """snap AS (SELECT l_returnflag AS model_id, 2 * sum(y * a) / (sum(a) + sum(y)) AS f1_a, 2 * sum(y * b) / (sum(b) + sum(y)) AS f1_b, sum(y * a) / sum(y) AS rec_a, sum(y * b) / sum(y) AS rec_b,
  avg((y - pa) ** 2) AS ece_a, avg((y - pb) ** 2) AS ece_b, 400 * avg(pa) AS p99_a, CASE WHEN l_returnflag = 'N' THEN 1100 ELSE 500 END * avg(pb) AS p99_b, CASE WHEN l_returnflag = 'R' THEN 640.0 ELSE 120.0 END AS mem_b,
  7.0 AS slices, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS bad_slices FROM scored GROUP BY 1)"""


def snapshots(t: Tables):
    s = scored(t).groupBy(F.col("l_returnflag").alias("model_id"))
    y = F.col("y")

    def side(p: str, scale, memory, bad):
        hit = F.sum(y * F.col(p))
        f1 = 2 * hit / (F.sum(p) + F.sum("y"))
        return s.agg(f1.alias("f1"), (hit / F.sum("y")).alias("recall"), F.avg(F.pow(y - F.col(f"p{p}"), 2)).alias("ece"), F.avg(f"p{p}").alias("m")).select(
            "model_id", "f1", "recall", "ece", (scale * F.col("m")).alias("p99_ms"), memory.alias("memory_mb"), F.lit(7.0).alias("slices"), bad.alias("slice_regressions")
        )

    champion = side("a", F.lit(400), F.lit(120.0), F.lit(0.0))
    challenger = side(
        "b", F.when(F.col("model_id") == "N", 1100).otherwise(500), F.when(F.col("model_id") == "R", 640.0).otherwise(120.0), F.when(F.col("model_id") == "A", 1.0).otherwise(0.0)
    )
    return champion, challenger


@query(
    "approval_gates",
    f"""WITH {SCORED_SQL}, {SNAP_SQL} SELECT model_id, unnest(['p99_latency_absolute', 'p99_latency_regression', 'memory_ceiling', 'f1_floor', 'recall_regression', 'calibration_ece', 'slice_regression', 'model_size']) AS gate,
      unnest([p99_b <= 500, p99_b / p99_a <= 2, mem_b <= 500, f1_b >= 0.5, (rec_a - rec_b) / rec_a <= 0.05, ece_b <= 0.15, bad_slices = 0, true]) AS passed,
      round(unnest([p99_a, p99_a, 120.0, NULL, rec_a, ece_a, NULL, 0.0])::DOUBLE, 4) AS champion_value, round(unnest([p99_b, p99_b, mem_b, f1_b, rec_b, ece_b, bad_slices, 0.0])::DOUBLE, 4) AS challenger_value FROM snap""",
)
def approval_gates(t: Tables):
    return rounded(compare.gates(compare.pair(*snapshots(t))), 4)


SCORE_SQL = """(0.5 * f1_{s} + 0.25 * (greatest(1 - p99_{s} / 500, 0) + greatest(1 - {mem} / 500, 0)) / 2 + 0.15 * CASE WHEN ece_{s} > 0 THEN greatest(1 - ece_{s} * 5, 0) ELSE 0.8 END + 0.1 * (1 - {bad} / 7.0))"""


@query(
    "composite_score",
    f"WITH {SCORED_SQL}, {SNAP_SQL} SELECT model_id, round({SCORE_SQL.format(s='a', mem='120.0', bad='0')}, 6)::DOUBLE AS champion_score, round({SCORE_SQL.format(s='b', mem='mem_b', bad='bad_slices')}, 6)::DOUBLE AS challenger_score FROM snap",
)
def composite_score(t: Tables):
    paired = compare.pair(*snapshots(t))
    return rounded(paired.select("model_id", compare.composite("a").alias("champion_score"), compare.composite("b").alias("challenger_score")))


P_SQL = "CASE model_id WHEN 'N' THEN 0.2 ELSE 0.01 END"


@query(
    "champion_challenger_decision",
    f"""WITH {SCORED_SQL}, {SNAP_SQL}, v AS (SELECT model_id, (f1_b - f1_a) / f1_a AS imp, {P_SQL} AS p, {SCORE_SQL.format(s='a', mem='120.0', bad='0')} AS ca, {SCORE_SQL.format(s='b', mem='mem_b', bad='bad_slices')} AS cb,
      concat_ws('+', CASE WHEN p99_b > 500 THEN 'p99_latency_absolute' END, CASE WHEN p99_b / p99_a > 2 THEN 'p99_latency_regression' END, CASE WHEN mem_b > 500 THEN 'memory_ceiling' END, CASE WHEN f1_b < 0.5 THEN 'f1_floor' END,
        CASE WHEN (rec_a - rec_b) / rec_a > 0.05 THEN 'recall_regression' END, CASE WHEN ece_b > 0.15 THEN 'calibration_ece' END, CASE WHEN bad_slices <> 0 THEN 'slice_regression' END) AS failed FROM snap)
    SELECT model_id, failed AS failed_gates, round(imp, 6)::DOUBLE AS improvement, failed = '' AND imp >= 0.01 AND p < 0.05 AND cb > ca AS challenger_wins,
      CASE WHEN failed = '' AND imp >= 0.01 AND p < 0.05 AND cb > ca THEN 'auto_approved' ELSE 'rejected' END AS approval_status,
      concat_ws('|', CASE WHEN failed = '' THEN 'all_gates_passed' ELSE 'failed:' || failed END, CASE WHEN imp >= 0.01 THEN 'improvement_meets_threshold' ELSE 'improvement_below_threshold' END,
        CASE WHEN p < 0.05 THEN 'significant' ELSE 'not_significant' END, CASE WHEN cb > ca THEN 'composite_higher' ELSE 'composite_not_higher' END) AS reasons FROM v""",
)
def champion_challenger_decision(t: Tables):
    paired = compare.pair(*snapshots(t))
    p = paired.select("model_id", F.when(F.col("model_id") == "N", 0.2).otherwise(0.01).alias("p_value"))
    out = compare.decide(paired, p)
    return rounded(out.select("model_id", F.concat_ws("+", "failed_gates").alias("failed_gates"), "improvement", "challenger_wins", "approval_status", F.concat_ws("|", "reasons").alias("reasons")))


@query("first_deployment", f"WITH {SCORED_SQL} SELECT DISTINCT l_returnflag AS model_id, true AS first_deployment, true AS challenger_wins, 'auto_approved_first_deployment' AS approval_status FROM scored WHERE l_returnflag <> 'A' UNION ALL SELECT 'A', false, false, 'rejected' FROM (SELECT 1)")
def first_deployment(t: Tables):
    champion, challenger = snapshots(t)
    paired = compare.pair(champion.where("model_id = 'A'"), challenger)
    p = paired.select("model_id", F.lit(0.01).alias("p_value"))
    return compare.decide(paired, p).select("model_id", "first_deployment", "challenger_wins", "approval_status")


DIFFS_SQL = "SELECT count(*) AS replicates, round(avg(diff), 6) AS mean_diff, round(avg((diff <= 0)::INT), 6)::DOUBLE AS p_value, avg((diff <= 0)::INT) < 0.05 AS is_significant FROM d"

# Every cell's Poisson number by inversion at the MD5 of its name and the replicate.
F1_SQL = f"""{SCORED_SQL}, cells AS (SELECT y, a, b, count(*) AS n FROM scored GROUP BY ALL),
  cdf AS (SELECT y, a, b, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY y, a, b ORDER BY k) AS c FROM cells, LATERAL (SELECT unnest(range(greatest(0, floor(n - 10 * sqrt(n) - 20))::BIGINT, ceil(n + 10 * sqrt(n) + 20)::BIGINT + 1)) AS k)),
  points AS (SELECT y, a, b, r AS replicate, ('0x' || substr(md5(concat_ws(':', y, a, b, 42, r)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM cells, (SELECT unnest(range(500)) AS r)),
  drawn AS (SELECT p.y, p.a, p.b, p.replicate, cdf.k AS m FROM points p ASOF JOIN cdf ON p.y = cdf.y AND p.a = cdf.a AND p.b = cdf.b AND p.u <= cdf.c),
  s AS (SELECT replicate, sum(m) FILTER (y = 1) AS pos, sum(m) FILTER (a = 1) AS pa, sum(m) FILTER (a = 1 AND y = 1) AS ha, sum(m) FILTER (b = 1) AS pb, sum(m) FILTER (b = 1 AND y = 1) AS hb FROM drawn GROUP BY 1),
  d AS (SELECT replicate, 2 * hb / (pos + pb) - 2 * ha / (pos + pa) AS diff FROM s)"""


@query("bootstrap_f1", f"WITH {F1_SQL} {DIFFS_SQL}")
def bootstrap_f1(t: Tables):
    return rounded(compare.significance(compare.bootstrap_f1(scored(t), "y", "a", "b")))


# A row's Poisson(1) weight in each replicate, from the replicate's line.
SLOPES, SHIFTS = (x.tolist() for x in compare.replicate_lines(500, 42))
RMSE_SQL = f"""{REGRESSION_SQL}, keyed AS (SELECT ('0x' || substr(md5(concat_ws(':', l_orderkey, l_linenumber, round(y * 100)::BIGINT, 42)), 1, 8))::BIGINT % {compare.PRIME} AS h, (y - pa) * (y - pa) AS ea, (y - pb) * (y - pb) AS eb FROM reg),
  lines AS (SELECT unnest(range(500)) AS replicate, unnest({SLOPES}) AS slope, unnest({SHIFTS}) AS shift),
  points AS (SELECT replicate, ea, eb, ((h * slope + shift) % {compare.PRIME})::DOUBLE / {compare.PRIME} AS u FROM keyed, lines),
  weighed AS (SELECT replicate, ea, eb, {' + '.join(f'(u > {float(c)!r}::DOUBLE)::INT' for c in compare.POISSON_CDF)} AS w FROM points),
  d AS (SELECT replicate, sqrt(sum(w * ea) / sum(w)) - sqrt(sum(w * eb) / sum(w)) AS diff FROM weighed GROUP BY 1)"""


@query("bootstrap_rmse", f"WITH {RMSE_SQL} {DIFFS_SQL}")
def bootstrap_rmse(t: Tables):
    rows = reg(t).withColumn("cents", F.round(F.col("y") * 100).cast("long"))
    return rounded(compare.significance(compare.bootstrap_rmse(rows, ["l_orderkey", "l_linenumber", "cents"], "y", "pa", "pb")))


# ---- retraining decision: one model per customer market segment --------------------------------------------

SIGNALS_SQL = """base AS (SELECT o_orderpriority AS model_id, avg(o_totalprice) FILTER (o_orderdate < timestamp '1998-07-01 00:00:00') AS baseline, avg(o_totalprice) FILTER (o_orderdate >= timestamp '1998-07-01 00:00:00') AS current,
  count(*) AS n, count(*) FILTER (o_orderstatus = 'F') / count(*) AS share, max(o_orderdate) AS newest, min(o_orderdate) AS trained FROM orders GROUP BY 1)"""
PERF_SQL = "greatest(least(CASE WHEN model_id < '3' THEN (current - baseline) ELSE (baseline - current) END / abs(baseline) / (3 * 0.05), 1.0), 0.0)"


def base(t: Tables):
    early = "o_orderdate < timestamp '1998-07-01 00:00:00'"
    late = "o_orderdate >= timestamp '1998-07-01 00:00:00'"
    return t.orders.groupBy(F.col("o_orderpriority").alias("model_id")).agg(
        F.avg(F.when(F.expr(early), F.col("o_totalprice"))).alias("baseline"),
        F.avg(F.when(F.expr(late), F.col("o_totalprice"))).alias("current"),
        F.count("*").alias("n"),
        (F.count(F.when(F.col("o_orderstatus") == "F", 1)) / F.count("*")).alias("share"),
        F.max("o_orderdate").alias("newest"),
        F.min("o_orderdate").alias("trained"),
    )


def metric_name():
    return F.when(F.col("model_id") < "3", "rmse").otherwise("f1_score")



@query("performance_signal", f"WITH {SIGNALS_SQL} SELECT model_id, round({PERF_SQL}, 6)::DOUBLE AS performance FROM base")
def performance_signal(t: Tables):
    return rounded(base(t).select("model_id", decide.performance_signal(metric_name(), F.col("current"), F.col("baseline")).alias("performance")))


LEVEL_SQL = "CASE substr(model_id, 1, 1) WHEN '1' THEN 'critical' WHEN '2' THEN 'high' WHEN '3' THEN 'moderate' WHEN '4' THEN 'low' ELSE 'none' END"
DRIFT_VALUE_SQL = "CASE substr(model_id, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.8 WHEN '3' THEN 0.5 WHEN '4' THEN 0.8 ELSE 0.0 END"


def level():
    names = {"1": "critical", "2": "high", "3": "moderate", "4": "low", "5": "none"}
    return F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.substring("model_id", 1, 1))



@query("drift_signal", f"WITH {SIGNALS_SQL} SELECT model_id, {DRIFT_VALUE_SQL}::DOUBLE AS drift FROM base")
def drift_signal(t: Tables):
    return base(t).select("model_id", decide.drift_signal(level(), F.col("model_id").startswith("4")).alias("drift"))


@query("staleness_signal", f"WITH {SIGNALS_SQL} SELECT model_id, round(least(date_diff('day', newest, timestamp '2001-09-15 00:00:00') / 90.0, 1.0), 6)::DOUBLE AS staleness FROM base")
def staleness_signal(t: Tables):
    as_of = F.lit("2001-09-15 00:00:00").cast("timestamp")
    return rounded(base(t).select("model_id", decide.staleness_signal(F.col("newest"), as_of).alias("staleness")))


@query(
    "data_readiness",
    "SELECT lang AS model_id, count(*) AS new_samples, round(count(quality) / count(*), 6) AS label_rate, count(*) >= 1000 AS is_sufficient FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1",
)
def data_readiness(t: Tables):
    joined = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    out = decide.data_readiness(joined, "lang", "quality", "ts", F.lit("2024-01-31").cast("timestamp"))
    return rounded(out.select(F.col("lang").alias("model_id"), "new_samples", "label_rate", "is_sufficient"))


ASSESS_SQL = f"""sig AS (SELECT model_id, {PERF_SQL} AS performance, {DRIFT_VALUE_SQL} AS drift, CASE WHEN share > 0.33 THEN least(date_diff('day', trained, timestamp '1995-02-15 00:00:00') / 90.0, 1.0) END AS staleness,
  n >= 1000 AS ready, model_id LIKE '4%' AS concept FROM base),
pri AS (SELECT *, (0.35 * performance + 0.3 * drift + 0.15 * coalesce(staleness, 0) + 0.2 * ready::INT) / (0.85 + CASE WHEN staleness IS NULL THEN 0 ELSE 0.15 END) AS priority FROM sig),
verdict AS (SELECT *, CASE WHEN NOT ready THEN 'not_needed|0.7|collect_more_labelled_data' WHEN performance > 0.7 AND drift > 0.7 THEN 'urgent|0.95|retrain_immediately' WHEN performance > 0.5 THEN 'required|0.85|retrain_for_performance'
  WHEN concept THEN 'required|0.8|retrain_for_concept_drift' WHEN drift > 0.5 THEN 'recommended|0.7|retrain_for_data_drift' WHEN coalesce(staleness, 0) >= 1 THEN 'recommended|0.6|retrain_stale_model'
  WHEN priority > 0.5 THEN 'recommended|0.55|retrain_on_combined_signals' ELSE 'not_needed|0.8|keep_monitoring' END AS v FROM pri),
dec AS (SELECT *, split_part(v, '|', 1) AS decision, split_part(v, '|', 2)::DOUBLE AS confidence, split_part(v, '|', 3) AS action FROM verdict)"""


def assessed(t: Tables):
    trained = F.lit("1995-02-15 00:00:00").cast("timestamp")
    signals = base(t).select(
        "model_id",
        decide.performance_signal(metric_name(), F.col("current"), F.col("baseline")).alias("performance"),
        decide.drift_signal(level(), F.col("model_id").startswith("4")).alias("drift"),
        F.when(F.col("share") > 0.33, decide.staleness_signal(F.col("trained"), trained)).alias("staleness"),
        (F.col("n") >= 1000).alias("ready"),
        F.col("model_id").startswith("4").alias("concept_drift"),
    )
    return decide.assess(signals)


@query("retrain_priority", f"WITH {SIGNALS_SQL}, {ASSESS_SQL} SELECT model_id, round(priority, 6)::DOUBLE AS priority FROM dec")
def retrain_priority(t: Tables):
    return rounded(assessed(t).select("model_id", "priority"))


@query("retrain_decision", f"WITH {SIGNALS_SQL}, {ASSESS_SQL} SELECT model_id, decision, confidence, action, decision IN ('recommended', 'required') AS requires_approval FROM dec")
def retrain_decision(t: Tables):
    return assessed(t).select("model_id", "decision", "confidence", "action", "requires_approval")


@query(
    "retrain_routing",
    f"WITH {SIGNALS_SQL}, {ASSESS_SQL} SELECT model_id, CASE WHEN decision = 'not_needed' THEN 'skip' ELSE 'retrain' END AS next_step, "
    "CASE WHEN decision IN ('recommended', 'required') AND share > 0.33 THEN 'human' ELSE 'auto' END AS approval FROM dec JOIN base USING (model_id)",
)
def retrain_routing(t: Tables):
    out = decide.route(assessed(t)).join(base(t).select("model_id", "share"), "model_id")
    return decide.approval_route(out, F.col("share") > 0.33).select("model_id", "next_step", "approval")
