"""Logistic regressions fitted side by side against Spark's own, budgets, and the size of training tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegauge.operators import logistic, train


def noisy(spark, rows=600):
    df = spark.range(rows).select("id", F.randn(1).alias("a"), (3 * F.randn(2) + 5).alias("b"), F.lit(2.0).alias("flat"))
    return df.withColumn("y", (F.col("a") + 0.2 * F.col("b") + F.randn(3) > 1).cast("int")).withColumn("fold", (F.col("id") % 3).cast("int")).cache()


@pytest.mark.parametrize("penalty", ["l2", "l1", "elasticnet"])
def test_side_by_side_fits_equal_sparks(spark, penalty):
    df, names = noisy(spark), ["a", "b", "flat"]
    draws = [{"C": 0.02, "penalty": penalty, "l1_ratio": 0.3, "max_iter": 500}, {"C": 5.0, "penalty": penalty, "l1_ratio": 0.3, "max_iter": 500}]
    data, mix = logistic.packed(df, names, "y", "fold"), {"l1": 1.0, "l2": 0.0}.get(penalty, 0.3)
    got = logistic.fit_many(data, 3, lambda g: np.stack([g != 0, g != 1]), [logistic.Problem(d["C"], mix, 500) for d in draws])
    for i, params in enumerate(draws):
        own = train.assemble(df.where(F.col("fold") != i), names)
        want = train.estimator("logistic_regression", params, True, own.count(), "y").setTol(1e-10).fit(own)
        assert np.allclose(got[i][0], want.coefficients.toArray(), atol=2e-3) and got[i][1] == pytest.approx(want.intercept, abs=5e-3)


def test_the_first_draws_outlast_the_budget(spark):
    over = {"logistic_regression": {"penalty": ["l1"]}}
    _, trials, metrics, _ = train.auto_train(noisy(spark), ["a", "b"], "y", ["id"], families=["logistic_regression"], overrides=over, budget=0.01)
    assert trials.count() >= 1 and metrics.first().accuracy > 0.7


def test_a_search_reads_the_table_as_often_for_many_draws_as_for_one(spark, monkeypatch):
    passes, real = [], logistic.totals
    monkeypatch.setattr(logistic, "totals", lambda *a: passes.append(1) or real(*a))
    found = train.search(noisy(spark), ["a", "b"], "y", "logistic_regression", True, "f1", 8, patience=10)
    assert len(found) == 8 and 0 < len(passes) < 40


def test_bags_equal_models_fitted_one_by_one(spark, monkeypatch):
    df = noisy(spark).where("y = 1 or id % 4 = 0")
    got = train.bagged_probability(df, df, ["a", "b"], "y", ["id"], 3, {"C": 1.0}).toPandas().set_index("id")["prob"]
    parts = [train.score_rows(train.fit(train.balanced_bag(df, "y", ["id"], b), ["a", "b"], "y", "logistic_regression", {"C": 1.0}, True), df) for b in range(3)]
    want = sum(p.toPandas().set_index("id")["prob"] for p in parts) / 3
    assert np.allclose(got.sort_index(), want.sort_index(), atol=2e-3)
    monkeypatch.setattr(train, "fit", None)  # no fit for each bag
    assert train.bagged_probability(df, df, ["a", "b"], "y", ["id"], 3, {"C": 1.0}).count() == df.count()


def test_training_tasks_keep_their_size(spark, monkeypatch):
    monkeypatch.setattr(train, "TASK_ROWS", 50)
    assert train.spread(noisy(spark)).rdd.getNumPartitions() == 12
