"""Splits, folds, training."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluate, train
from .base import Tables, query, rounded
from .inputs import SCORED_SQL, from_sql

ORDER_SQL = "row_number() OVER (PARTITION BY {by} ORDER BY md5(o_orderkey::VARCHAR || ':42'), o_orderkey)"


@query(
    "train_validation_split",
    f"""SELECT o_orderstatus, sum(o_orderkey) FILTER (v)::BIGINT AS validation_keys, count(*) FILTER (v) AS validation, count(*) FILTER (NOT v) AS training FROM (
      SELECT *, {ORDER_SQL.format(by='o_orderstatus')} <= round(count(*) OVER (PARTITION BY o_orderstatus) * 0.2) AS v FROM orders) GROUP BY 1""",
)
def train_validation_split(t: Tables):
    out = train.train_validation_split(t.orders, ["o_orderkey"], "o_orderstatus")
    v = F.col("is_validation")
    return out.groupBy("o_orderstatus").agg(
        F.sum(F.when(v, F.col("o_orderkey"))).alias("validation_keys"), F.count(F.when(v, 1)).alias("validation"), F.count(F.when(~v, 1)).alias("training")
    )


@query(
    "stratified_folds",
    f"SELECT o_orderstatus, ((rn - 1) % 5)::INT AS fold, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT *, {ORDER_SQL.format(by='o_orderstatus')} AS rn FROM orders) GROUP BY ALL",
)
def stratified_folds(t: Tables):
    folds = train.fold_count(train.minority_count(t.orders, "o_orderstatus"), 5)
    out = train.with_folds(t.orders, ["o_orderkey"], folds, "o_orderstatus")
    return out.groupBy("o_orderstatus", "fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("plain_folds", f"SELECT ((rn - 1) % 4)::INT AS fold, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM (SELECT *, {ORDER_SQL.format(by='1')} AS rn FROM orders) GROUP BY ALL")
def plain_folds(t: Tables):
    return train.with_folds(t.orders, ["o_orderkey"], 4).groupBy("fold").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    "row_class_weights",
    "WITH c AS (SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderstatus, round(sum((SELECT sum(n) FROM c) / (2.0 * c.n)), 3)::DOUBLE AS total_weight FROM orders JOIN c USING (o_orderstatus) GROUP BY 1",
)
def row_class_weights(t: Tables):
    from ..operators import dataset

    out = dataset.with_class_weights(t.orders, "o_orderstatus")
    return rounded(out.groupBy("o_orderstatus").agg(F.sum("weight").alias("total_weight")), 3)


@query(
    "cv_summary",
    f"WITH f AS (SELECT o_orderstatus AS model, (rn - 1) % 5 AS fold, avg(o_totalprice) AS score FROM (SELECT *, {ORDER_SQL.format(by='o_orderstatus')} AS rn FROM orders) GROUP BY ALL) "
    "SELECT model, count(*) FILTER (fold > 0) AS folds, round(avg(score) FILTER (fold > 0), 4) AS cv_mean, round(stddev_pop(score) FILTER (fold > 0), 4) AS cv_std FROM f GROUP BY 1",
)
def cv_summary(t: Tables):
    folded = train.with_folds(t.orders, ["o_orderkey"], 5, "o_orderstatus")
    scores = folded.groupBy(F.col("o_orderstatus").alias("model"), "fold").agg(F.avg("o_totalprice").alias("score"))
    broken = scores.withColumn("score", F.when(F.col("fold") == 0, float("nan")).otherwise(F.col("score")))
    return rounded(train.cv_summary(broken, ["model"]), 4)


@query(
    "best_family",
    "WITH s AS (SELECT l_returnflag AS family, l_linenumber AS trial, avg(l_discount) AS cv_mean, stddev_pop(l_discount) AS cv_std FROM lineitem GROUP BY ALL) "
    "SELECT family, trial, round(cv_mean, 9) AS cv_mean FROM s ORDER BY s.cv_mean DESC, cv_std, family, trial LIMIT 1",
)
def best_family(t: Tables):
    trials = t.lineitem.groupBy(F.col("l_returnflag").alias("family"), F.col("l_linenumber").alias("trial")).agg(F.avg("l_discount").alias("cv_mean"), F.stddev_pop("l_discount").alias("cv_std"))
    return rounded(train.best_family(trials).select("family", "trial", "cv_mean"), 9)


COEF_SQL = """WITH m AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c1, covar_pop(l_tax, l_extendedprice) AS c2, covar_pop(l_quantity, l_tax) AS c12, var_pop(l_quantity) AS v1, var_pop(l_tax) AS v2 FROM lineitem)
SELECT unnest(['l_quantity', 'l_tax']) AS feature, round(unnest([abs((c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12)), abs((c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12))]), 3) AS importance FROM m"""


@query("feature_importance_linear", COEF_SQL)
def feature_importance_linear(t: Tables):
    model = train.fit(t.lineitem, ["l_quantity", "l_tax"], "l_extendedprice", "ridge_regression", {"alpha": 0.0}, False)
    return rounded(train.importance(model, ["l_quantity", "l_tax"], t.spark), 3)


@query(
    "batch_scoring",
    """WITH m AS (SELECT regr_slope(l_extendedprice, l_quantity) AS a, regr_intercept(l_extendedprice, l_quantity) AS b FROM lineitem)
    SELECT l_linenumber, count(*) AS n, round(avg(a * l_quantity + b), 2) AS mean_prediction, round(sqrt(avg((a * l_quantity + b - l_extendedprice) ** 2)), 2) AS rmse FROM lineitem, m GROUP BY 1""",
)
def batch_scoring(t: Tables):
    model = train.fit(t.lineitem, ["l_quantity"], "l_extendedprice", "ridge_regression", {"alpha": 0.0}, False)
    scored = train.score_rows(model, t.lineitem, classification=False)
    return rounded(
        scored.groupBy("l_linenumber").agg(
            F.count("*").alias("n"), F.avg("pred").alias("mean_prediction"), F.sqrt(F.avg(F.pow(F.col("pred") - F.col("l_extendedprice"), 2))).alias("rmse")
        ),
        2,
    )


FEATURES = ["l_quantity", "l_tax", "l_extendedprice"]


def labelled(t: Tables):
    """Line items with the 0/1 label of the scored table."""
    y = F.when(F.col("l_quantity") + 100 * F.col("l_tax") >= 30, 1).otherwise(0)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", *FEATURES, y.alias("y"))


KEY = ["l_orderkey", "l_linenumber", "l_partkey"]


@query("scoring_with_probabilities")
def scoring_with_probabilities(t: Tables):
    df = labelled(t)
    model = train.fit(df, FEATURES, "y", "logistic_regression", {"C": 1.0}, True)
    scored = train.score_rows(model, df, probabilities=True)
    return rounded(scored.groupBy("y").agg(F.count("*").alias("n"), F.avg("prob_1").alias("mean_probability"), F.avg("pred").alias("flagged")), 3)


@query("family_models")
def family_models(t: Tables):
    """One model per family on the whole table, scored in sample."""
    df, out = labelled(t), None
    trees = {"n_estimators": 100, "max_depth": 5}
    for family, params in (("random_forest", trees), ("gradient_boosting", trees), ("logistic_regression", {"C": 1.0})):
        scored = train.score_rows(train.fit(df, FEATURES, "y", family, params, True), df)
        part = evaluate.classification_metrics(scored, "y", "pred").select(F.lit(family).alias("family"), "n", "accuracy", "f1")
        out = part if out is None else out.unionByName(part)
    return rounded(out, 3)


@query("random_search")
def random_search(t: Tables):
    folded = train.with_folds(labelled(t), KEY, 3, "y")
    found = train.search(folded, FEATURES, "y", "logistic_regression", True, "accuracy")
    return rounded(train.trial_table(t.spark, found), 3)


@query("auto_train")
def auto_train(t: Tables):
    _, trials, metrics, threshold = train.auto_train(labelled(t), FEATURES, "y", KEY, families=["logistic_regression"], budget=60)
    best = train.best_family(trials).first()
    out = metrics.select("n", "accuracy", "f1", "f1_macro", F.lit(best["family"]).alias("family"), F.lit(float(threshold)).alias("threshold"))
    return rounded(out, 3)


@query("balanced_bags")
def balanced_bags(t: Tables):
    df = labelled(t)
    scored = train.bagged_probability(df, df, FEATURES, "y", KEY, 10, {"C": 1.0})
    return rounded(scored.groupBy("y").agg(F.count("*").alias("n"), F.avg("prob").alias("mean_probability")), 3)


@query("probability_calibration")
def probability_calibration(t: Tables):
    s = from_sql(t, SCORED_SQL, "scored").select("y", "pa")
    fixed = train.calibrated(train.calibrator(s, "pa", "y"), s, "pa")
    before = evaluate.calibration(s, F.col("pa"), F.col("y")).select(F.lit("raw").alias("kind"), "n", "ece")
    after = evaluate.calibration(fixed, F.col("prob_calibrated"), F.col("y")).select(F.lit("calibrated").alias("kind"), "n", "ece")
    return rounded(before.unionByName(after))


@query("product_features", "SELECT round(avg(l_quantity * l_tax), 6) AS \"l_quantity_x_l_tax\", round(avg(l_quantity * l_discount), 6) AS \"l_quantity_x_l_discount\", round(avg(l_tax * l_discount), 8) AS \"l_tax_x_l_discount\" FROM lineitem")
def product_features(t: Tables):
    df, names = train.product_features(t.lineitem, ["l_quantity", "l_tax", "l_discount"])
    return rounded(df.agg(*[F.avg(c).alias(c) for c in names]), 6, l_tax_x_l_discount=8)


@query("first_champion")
def first_champion(t: Tables):
    from .monitor_queries import at, stage_log

    log = stage_log(t)
    train_it = lambda: train.fit(t.lineitem, ["l_quantity"], "l_extendedprice", "ridge_regression", {"alpha": 0.0}, False)
    rows, _ = train.first_champion(log, "m-new", "v1", at(), train_it)
    skipped, _ = train.first_champion(log, "m1", "v1", at(), train_it)
    return rows.select("model_id", "version", "stage", F.lit(skipped is None).alias("existing_model_skipped"))
