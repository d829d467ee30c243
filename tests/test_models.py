"""Dataset profile, metrics, comparison, decisions."""

import time

import numpy as np
import pyarrow as pa
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakegauge.operators import compare, dataset, decide, evaluate, train

CATEGORY_CASES = [
    (True, 2, 0.001, 1000, "extreme_imbalance"), (True, 2, 0.009, 1000, "extreme_imbalance"), (True, 2, 0.01, 1000, "severe_imbalance"),
    (True, 2, 0.049, 1000, "severe_imbalance"), (True, 2, 0.05, 1000, "moderate_imbalance"), (True, 2, 0.19, 1000, "moderate_imbalance"),
    (True, 2, 0.20, 1000, "mild_imbalance"), (True, 2, 0.44, 1000, "mild_imbalance"), (True, 2, 0.45, 1000, "balanced_binary"), (True, 2, 1.0, 1000, "balanced_binary"),
    (True, 5, 0.60, 1000, "multiclass_balanced"), (True, 5, 0.20, 1000, "multiclass_imbalanced"), (True, 3, 0.10, 1000, "multiclass_imbalanced"),
    (True, None, 1.0, 1000, "balanced_binary"), (True, 1, 1.0, 1000, "balanced_binary"),
    (False, None, 1.0, 1000, "regression_small"), (False, None, 1.0, 4999, "regression_small"), (False, None, 1.0, 5000, "regression_medium"),
    (False, None, 1.0, 49999, "regression_medium"), (False, None, 1.0, 50000, "regression_large"), (False, None, 1.0, 100000, "regression_large"),
]


def test_category_boundaries(spark):
    df = spark.createDataFrame(CATEGORY_CASES, "c boolean, k int, b double, n long, want string")
    for r in df.withColumn("got", dataset.category(F.col("c"), F.col("k"), F.col("b"), F.col("n"))).collect():
        assert r.got == r.want, r


def test_extreme_profile(spark):
    df = spark.range(10_000).select((F.col("id") < 10).cast("int").alias("y"), F.rand(1).alias("f0"))
    row = dataset.with_strategy(dataset.profile(df, ["f0"], "y")).first()
    assert row.category == "extreme_imbalance" and row.severity == 4 and row.scale_pos_weight == 999.0
    assert (row.strategy_scoring, row.cv_folds, row.class_weight, row.strategy_spw) == ("pr_auc", 3, "balanced_subsample", 999.0)
    assert dataset.weight_candidates(999.0, 1.5) == [31, 499, 999, 1498]


def test_class_weights(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, 0).when(F.col("id") < 900, 1).otherwise(2).alias("y"))
    got = {r.label: r.majority_ratio for r in dataset.class_weights(df, "y").collect()}
    assert got == {"0": 1.0, "1": 3.5, "2": 7.0}


def test_price_is_regression(spark):
    df = spark.range(10_000).select((50_000 + 1000 * F.randn(3)).alias("price"), F.rand(1).alias("f"))
    row = dataset.profile(df, ["f"], "price").first()
    assert not row.is_classification and row.category == "regression_medium" and row.n_classes is None


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 400), rng.random(400).round(2)
    got = evaluate.ranking_metrics(spark.createDataFrame(pd.DataFrame({"y": y, "p": p})), "y", {"p": 1}).first()
    a, b = p[y == 1], p[y == 0]
    assert got.roc_auc == pytest.approx(np.mean((a[:, None] > b[None, :]) + 0.5 * (a[:, None] == b[None, :])))
    ap, last = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        recall = (a >= t).mean()
        ap += (recall - last) * y[p >= t].mean()
        last = recall
    assert got.pr_auc == pytest.approx(ap)


def test_zero_division_is_zero(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y int, pred int")
    row = evaluate.classification_metrics(df).first()
    assert (row.precision, row.recall, row.f1) == (0.0, 0.0, 0.0)


def test_confidence_of_one_counts(spark):
    df = spark.createDataFrame([(1.0, True), (1.0, False)], "c double, ok boolean")
    assert evaluate.calibration(df, F.col("c"), F.col("ok")).first().ece == 0.5


def test_bootstrap_matches_row_resampling(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 500)
    a = np.where(rng.random(500) < 0.70, y, 1 - y)
    b = np.where(rng.random(500) < 0.74, y, 1 - y)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": a, "b": b}))
    got = compare.bootstrap_f1(df, "y", "a", "b", metric="accuracy", replicates=800).toPandas()["diff"]
    draws = []
    for _ in range(800):
        i = rng.integers(0, 500, 500)
        draws.append((b[i] == y[i]).mean() - (a[i] == y[i]).mean())
    assert got.mean() == pytest.approx(np.mean(draws), abs=0.006) and got.std() == pytest.approx(np.std(draws), rel=0.15)
    again = compare.bootstrap_f1(df.repartition(5), "y", "a", "b", metric="accuracy", replicates=800).toPandas()["diff"]
    assert sorted(got) == sorted(again)


def f1_gain(y, a, b, pos):
    """Plain F1 of ``b`` less that of ``a``: of ``pos`` with two classes, else weighted by support."""
    classes = np.unique(y)

    def f1(pred, c):
        return 2 * ((y == c) & (pred == c)).sum() / max(1, (y == c).sum() + (pred == c).sum())

    if len(classes) == 2:
        return f1(b, pos) - f1(a, pos)
    return sum((f1(b, c) - f1(a, c)) * (y == c).mean() for c in classes)


@pytest.mark.parametrize("classes", [2, 6])
def test_bootstrap_f1_is_one_method_for_few_and_many_classes(spark, monkeypatch, classes):
    rng = np.random.default_rng(7)
    y = rng.integers(0, classes, 900)
    a, b = np.where(rng.random(900) < 0.5, y, 0), np.where(rng.random(900) < 0.6, y, 0)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "a": a, "b": b.astype(float)}))
    got = compare.bootstrap_f1(df, "y", "a", "b", replicates=300).toPandas().sort_values("replicate")["diff"].tolist()
    draws = []
    for _ in range(300):
        i = rng.integers(0, 900, 900)
        draws.append(f1_gain(y[i], a[i], b[i], 1))
    assert np.mean(got) == pytest.approx(np.mean(draws), abs=0.01) and np.std(got) == pytest.approx(np.std(draws), rel=0.2)
    monkeypatch.setattr(compare, "HELD_CLASSES", 1)
    held = compare.bootstrap_f1(df.repartition(3), "y", "a", "b", replicates=300).toPandas().sort_values("replicate")["diff"].tolist()
    assert held == pytest.approx(got)


def test_bootstrap_rmse(spark):
    rng = np.random.default_rng(8)
    n = 3000
    y = rng.normal(size=n)
    pdf = pd.DataFrame({"id": range(n), "y": y, "a": y + rng.normal(0, 1.0, n), "b": y + rng.normal(0, 0.9, n)})
    df = spark.createDataFrame(pdf)
    got = compare.bootstrap_rmse(df, ["id"], "y", "a", "b", replicates=200).toPandas()["diff"]
    exact = np.sqrt(((pdf.y - pdf.a) ** 2).mean()) - np.sqrt(((pdf.y - pdf.b) ** 2).mean())
    assert got.mean() == pytest.approx(exact, abs=0.01)
    again = compare.bootstrap_rmse(df.repartition(7), ["id"], "y", "a", "b", replicates=200).toPandas()["diff"]
    assert np.allclose(sorted(got), sorted(again))


def test_composite_stays_between_zero_and_one(spark):
    rows = [("m", 1.0, 1.0, 1.0, 0.01, 1.0), ("n", 0.0, 0.0, 0.0, 0.9, 5000.0)]
    snap = spark.createDataFrame(rows, "model_id string, f1 double, recall double, roc_auc double, ece double, p99_ms double")
    got = compare.pair(snap, snap).select(compare.composite("b").alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in got)


def test_decision_rules_in_order(spark):
    rows = [
        ("a", 0.9, 1.0, 0.1, False, False, "not_needed", 0.7), ("b", 0.8, 0.8, 0.1, True, False, "urgent", 0.95), ("c", 0.6, 0.0, 0.1, True, True, "required", 0.85),
        ("d", 0.0, 0.8, 0.1, True, True, "required", 0.80), ("e", 0.0, 0.8, 0.1, True, False, "recommended", 0.70), ("f", 0.0, 0.5, 1.0, True, False, "recommended", 0.60),
        ("g", 0.5, 0.5, 0.9, True, False, "recommended", 0.55), ("h", 0.0, 0.0, 0.1, True, False, "not_needed", 0.80),
    ]
    df = spark.createDataFrame(rows, "model_id string, performance double, drift double, staleness double, ready boolean, concept_drift boolean, want string, conf double")
    for r in decide.assess(df).collect():
        assert (r.decision, r.confidence) == (r.want, r.conf), r


def test_missing_signals_drop_out(spark):
    df = spark.createDataFrame([("a", None, 0.5, None, None, False)], "model_id string, performance double, drift double, staleness double, ready boolean, concept_drift boolean")
    assert decide.assess(df).first().priority == pytest.approx(0.5)


def test_folds_are_even_inside_a_hot_class(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, 0).otherwise(1).alias("y"))
    got = {(r.y, r.fold): r["count"] for r in train.with_folds(df, ["id"], 5, "y").groupBy("y", "fold").count().collect()}
    assert set(got.values()) == {180, 20} and len(got) == 10
    assert train.fold_count(5, 5) == 2 and train.fold_count(1, 5) == 2 and train.fold_count(100, 4) == 4


def test_auto_train_picks_a_threshold(spark):
    df = spark.range(600).select("id", F.randn(1).alias("a"), F.randn(2).alias("b"))
    df = df.withColumn("y", (F.col("a") + 0.3 * F.randn(3) > 0).cast("int"))
    over = {"logistic_regression": {"max_iter": [10], "penalty": ["l2"], "C": [1.0]}}
    model, trials, metrics, threshold = train.auto_train(df, ["a", "b"], "y", ["id"], trials=1, families=["logistic_regression"], overrides=over)
    assert trials.count() == 1 and metrics.first().accuracy > 0.8 and 0.05 <= threshold <= 0.95


def test_ranks_follow_the_hash_in_classes_that_need_three_digits(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") < 2600, "big").when(F.col("id") < 2990, "small").when(F.col("id") < 2999, "tiny").alias("c"))
    got = train.ranked(df, "c", ["id"], 7, bucket_rows=2)  # 2600 rows: three digits
    assert "collect_list" not in got._jdf.queryExecution().toString()
    rows = got.withColumn("h", train.hash_order(["id"], 7)).toPandas()
    for c, own in rows.groupby(rows["c"].fillna("none")):
        want = own.sort_values(["h", "id"]).reset_index(drop=True)
        assert (want["__rank"] == np.arange(1, len(own) + 1)).all() and (own["__size"] == len(own)).all(), c
    plain = train.ranked(df, None, ["id"], 7).toPandas().set_index("id")["__rank"]
    cut = train.ranked(df, None, ["id"], 7, bucket_rows=5).toPandas().set_index("id")["__rank"]
    assert plain.sort_index().equals(cut.sort_index()) and train.digits_for(2600, 2) == 3 and train.digits_for(0, 2) == 0
    assert train.ranked(df.limit(0), "c", ["id"], 7).count() == 0


def search_table(spark):
    rows = [(float(i % 7), float(i % 5), int(i % 7 + i % 5 > 5), i % 3) for i in range(200)]
    return spark.createDataFrame(rows, "a double, b double, y int, fold int").cache()


def test_trials_side_by_side_find_what_one_after_another_finds(spark):
    over = {"max_iter": [5], "penalty": ["l2"]}
    one, four = (train.search(search_table(spark), ["a", "b"], "y", "logistic_regression", True, "accuracy", 5, over, patience=2, parallel=p) for p in (1, 4))
    assert [(t.number, t.params, t.mean) for t in one] == [(t.number, t.params, t.mean) for t in four] and one


def test_a_budget_ends_a_family(spark):
    df, over = search_table(spark), {"n_estimators": [400], "max_depth": [5]}
    start = time.monotonic()
    found = train.search(df, ["a", "b"], "y", "gradient_boosting", True, "accuracy", 30, over, budget=2.0)
    assert len(found) < 30 and time.monotonic() - start < 60
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert spark.range(10).count() == 10  # the session goes on
    with pytest.raises(TimeoutError):
        train.auto_train(df.withColumn("id", F.monotonically_increasing_id()), ["a", "b"], "y", ["id"], families=["gradient_boosting"], overrides={"gradient_boosting": over}, budget=0.01)


def test_boosting_stops_early(spark):
    noisy = F.when(F.pmod(F.xxhash64("a", "b", "y", F.monotonically_increasing_id()), F.lit(3)) == 0, 1 - F.col("y")).otherwise(F.col("y"))
    df = search_table(spark).withColumn("y", noisy).withColumn("stop", F.col("fold") == 0)
    grown, stopped = (train.fit(df, ["a", "b"], "y", "gradient_boosting", {"n_estimators": 60, "max_depth": 3}, True, stop=s).stages[-1].getNumTrees for s in (None, "stop"))
    assert stopped < grown == 60


def test_boosting_reads_bins_instead_of_rows(spark, monkeypatch):
    """Equal rows are one of their weight: as many fitted rows as cells, the predictions of a fit on all rows."""
    noisy = F.when(F.pmod(F.xxhash64("a", "b", "id"), F.lit(4)) == 0, 1).otherwise(F.col("y"))
    df = search_table(spark).crossJoin(spark.range(5)).withColumn("y", noisy)
    fitted, spread = [], train.spread
    monkeypatch.setattr(train, "spread", lambda d, rows=None: fitted.append(d.count()) or spread(d, rows))
    params = {"n_estimators": 10, "max_depth": 3}
    merged = train.fit(df, ["a", "b"], "y", "gradient_boosting", params, True)
    monkeypatch.setattr(train, "by_weight", lambda *a: False)
    plain = train.fit(df, ["a", "b"], "y", "gradient_boosting", params, True)
    assert fitted[0] <= 7 * 5 * 2 and fitted[1] == 1000
    got, want = (train.score_rows(m, df).groupBy("a", "b").agg(F.avg("prob").alias("p")).orderBy("a", "b").toPandas()["p"].to_numpy() for m in (merged, plain))
    assert np.allclose(got, want)


def test_forest_reads_cells_instead_of_rows(spark, monkeypatch):
    """A forest of many rows grows on their cells, weighs them as its bags of rows would and gives rows the model's own answers."""
    noisy = F.when(F.pmod(F.xxhash64("a", "b", "id"), F.lit(4)) == 0, 1).otherwise(F.col("y"))
    df = search_table(spark).crossJoin(spark.range(20)).withColumn("y", noisy).cache()
    params = {"n_estimators": 12, "max_depth": 3}
    plain = train.fit(df, ["a", "b"], "y", "random_forest", params, True)
    fitted, spread = [], train.spread
    monkeypatch.setattr(train, "spread", lambda d, rows=None: fitted.append(d.count()) or spread(d, rows))
    monkeypatch.setattr(train, "FOREST_ROWS", 100)
    cells = train.fit(df, ["a", "b"], "y", "random_forest", params, True)
    assert not fitted and cells.stages[-1].getNumTrees == 12 and len(cells.stages[-1].trees) == 12
    assert len({t.toDebugString for t in cells.stages[-1].trees}) > 1
    got, want = (train.score_rows(m, df).groupBy("a", "b").agg(F.avg("prob").alias("p")).orderBy("a", "b").toPandas()["p"].to_numpy() for m in (cells, plain))
    assert np.abs(got - want).max() < 0.2 and np.abs(got - want).mean() < 0.05
    odd = df.select("id", "a", "b").limit(5).union(spark.createDataFrame([(101, None, 1.0), (102, float("nan"), 2.0), (103, 9.0, float("inf"))], "id long, a double, b double"))
    looked = train.score_rows(cells, odd, probabilities=True)
    assert looked.columns == ["id", "a", "b", "pred", "prob", "prob_0", "prob_1"] and "BroadcastHashJoin" in looked._jdf.queryExecution().toString()
    monkeypatch.setattr(train, "ANSWERS", 1)
    assert sorted(map(repr, looked.collect())) == sorted(map(repr, train.score_rows(cells, odd, probabilities=True).collect()))
    # too many cells: the rows again
    monkeypatch.setattr(train, "FOREST_CELLS", 1)
    train.fit(df, ["a", "b"], "y", "random_forest", {"n_estimators": 2, "max_depth": 2}, True)
    assert fitted == [4000]


def test_a_bag_draws_a_cell_as_its_rows():
    cells = pa.table({"__bin_a": [0.0, 1.0], "__label": [1.0, 0.0], "__each": [1.0, 0.5], "__n": [7, 90000], "__hash": [-5, 11]}).to_batches()[0]
    (got,), (again,) = (list(train.bags(4000, 3)(iter([c]))) for c in (cells, cells.slice(1)))
    few, many = (np.array(x) for x in got.column("__draws").to_pylist())
    assert got.column("__draws").to_pylist()[1] == again.column("__draws").to_pylist()[0]
    assert abs(few.mean() - 7) < 0.2 and abs(few.var() - 7) < 0.8
    assert abs(many.mean() - 45000) < 20 and abs((many / 0.5).var() / 90000 - 1) < 0.1
