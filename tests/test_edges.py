"""Cases in which large and small tables, ties and nulls used to part ways."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakegauge.functions.quantiles import exact_quantiles
from lakegauge.operators import evaluate, monitor, registry, train, transform, validate
from lakegauge.operators.profile import ColumnConfig


def test_newest_is_the_same_on_both_paths(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"r{i:04d}", start + timedelta(seconds=i // 3) if i % 2 else None) for i in range(600)]
    log = spark.createDataFrame(rows, "request_id string, timestamp timestamp")
    for n in (1, 100, 299, 300, 450, 600, 900):
        small = sorted(r["request_id"] for r in monitor.newest(log, n).collect())
        large = sorted(r["request_id"] for r in monitor.newest(log, n, small_rows=10).collect())
        assert small == large and len(small) == min(n, 600)
        times = [r["timestamp"] for r in monitor.newest(log, n, small_rows=10).collect()]
        assert sum(t is None for t in times) == max(0, min(n, 600) - 300)


def test_champion_survives_events_at_one_time(spark):
    at = datetime(2024, 1, 1)
    rows = [("m", "1", "development", at, None), ("m", "1", "champion", at, None)]
    for order in (rows, rows[::-1]):
        log = spark.createDataFrame(order, "model_id string, version string, stage string, at timestamp, parent_version string")
        assert [r["version"] for r in registry.champions(log).collect()] == ["1"]


def test_scores_that_are_no_numbers_are_not_flagged(spark):
    rows = [(1, 0.9), (0, float("nan")), (0, None), (1, 0.1)]
    scan = evaluate.threshold_scan(spark.createDataFrame(rows, "y int, prob double")).where("abs(threshold - 0.5) < 1e-9").first()
    assert (scan["tp"], scan["flagged"]) == (1, 1)


def test_latency_of_the_null_group(spark):
    rows = [("a", float(i)) for i in range(50)] + [(None, float(i)) for i in range(80)] + [("b", 1.0)]
    log = spark.createDataFrame(rows, "model string, ms double")
    small = sorted(map(repr, evaluate.latency_profile(log, "ms", "model").collect()))
    large = sorted(map(repr, evaluate.latency_profile(log, "ms", "model", small_rows=40).collect()))
    assert small == large and len(small) == 3


def test_null_class_is_not_the_class_called_tilde(spark):
    df = spark.createDataFrame([(i, "~" if i % 2 else None) for i in range(40)], "id long, c string")
    sizes = {(r["c"], r["__size"]) for r in train.ranked(df, "c", ["id"], 1).collect()}
    assert sizes == {("~", 20), (None, 20)}


def test_batches_are_held_against_the_whole_suite(spark):
    rows = [(1, 1, "a"), (1, 1, "b"), (2, 1, "a"), (2, 2, "b"), (None, 5, "a"), (None, 5, "a")]
    df = spark.createDataFrame(rows, "batch int, id int, c string")
    suite = [validate.Expectation(validate.COLUMN_SET, kwargs={"column_set": ["id", "c"]}), validate.Expectation(validate.UNIQUE, "id")]
    out = {r["batch"]: r for r in validate.monitor_batches(df, "batch", suite).collect()}
    assert out[2]["failed_checks"] == [] and len(out[1]["failed_checks"]) == len(out[None]["failed_checks"]) == 1
    assert out[1]["success_rate"] == 0.5
    fewer = validate.monitor_batches(df.drop("c"), "batch", suite).where("batch = 2").first()
    assert len(fewer["failed_checks"]) == 1
    assert df.where(F.col("batch").isNull()).count() == 2


@pytest.mark.parametrize("low, high", [(0, 0), (10, 2900), (2900, 10), (1500, 1500)])
def test_quantiles_of_many_infinite_values(spark, low, high):
    rng = np.random.default_rng(low)
    values = [-np.inf] * low + [np.inf] * high + rng.normal(size=3000 - low - high).tolist() + [float("nan"), None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    probs = {"x": [0.0, 0.01, 0.25, 0.49, 0.75, 0.99, 1.0]}
    small, large = exact_quantiles(df, probs)["x"], exact_quantiles(df, probs, small_rows=100)["x"]
    assert large == pytest.approx(small, nan_ok=True)


def test_ordinal_positions_of_any_number_of_categories(spark):
    df = spark.createDataFrame([(f"k{i * 7 % 300}",) for i in range(900)] + [(None,), ("ü",), ("",)], "c string")
    small = transform.fit_ordinal(df, "c")
    large = transform.fit_ordinal(df, "c", limit=10, range_keys=20)
    want = sorted({r["c"] for r in df.collect() if r["c"] is not None})
    assert [r[0] for r in sorted(small.rows, key=lambda r: r[1])] == want and large.rows is None
    assert sorted((r["lk"], r["lv"]) for r in large.frame(spark).collect()) == sorted((c, float(i)) for i, c in enumerate(want))


def test_saved_preparation_stands_on_its_own(spark, tmp_path):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(f"k{i % 40}", float(v) if i % 9 else None, float(v) * 2 + 1) for i, v in enumerate(rng.normal(size=200))], "c string, a double, b double")
    configs = {"c": ColumnConfig("c", expected_dtype="object", imputation="mode", outlier="none", scaling="none", encoding="frequency"), "a": ColumnConfig("a", imputation="knn"), "b": ColumnConfig("b", imputation="knn")}
    prep = transform.fit_preparation(df, configs)
    for c in list(prep.lookups):
        prep.lookups[c] = transform.fit_frequency(df, c, limit=5)
    prep.save(spark, str(tmp_path / "one"))
    (tmp_path / "one").rename(tmp_path / "two")
    again = transform.Preparation.load(spark, str(tmp_path / "two"))
    named = [v.path for v in again.lookups.values() if v.path] + [again.donors or str(tmp_path / "two")]
    assert len(named) > 1 and all(p.startswith(str(tmp_path / "two")) for p in named)
    out, same = prep.transform(df), again.transform(df)
    assert out.exceptAll(same).isEmpty() and same.exceptAll(out).isEmpty()
