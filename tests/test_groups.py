"""Order statistics of many groups, distinct counts of many columns, draws that can be repeated, labels without a time."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lakegauge.functions.quantiles import grouped_quantiles
from lakegauge.operators import compare, monitor, profile

PROBS = [0.0, 0.3, 0.5, 0.95, 1.0]


def values():
    rng = np.random.default_rng(2)
    rows = []
    for g in [None, *range(12)]:
        n = 30 if g in (3, 4) else 700
        x = rng.normal(size=n) if g != 5 else rng.integers(0, 3, n).astype(float)
        if g == 6:
            x[: n * 2 // 3] = 1.5
        if g == 7:
            x[:] = 2.0
        rows += [(g, float(v)) for v in x]
    return [*rows, (1, None), (20, None)]


def test_grouped_quantiles_equal_numpy(spark):
    rows = values()
    df = spark.createDataFrame(rows, "g int, x double").repartition(4)
    got = {r.g: r.q for r in grouped_quantiles(df, "g", "x", PROBS, small_rows=40).collect()}
    for g in {r[0] for r in rows if r[1] is not None}:
        np.testing.assert_allclose(got[g], np.percentile([x for k, x in rows if k == g and x is not None], [100 * p for p in PROBS]), rtol=1e-12)
    assert set(got) == {r[0] for r in rows if r[1] is not None}


def jobs(spark, run):
    name = f"count-{id(run)}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        run()
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))


def test_jobs_do_not_grow_with_the_groups(spark):
    def made(groups):
        df = spark.range(groups * 200).select((F.col("id") % groups).alias("g"), F.rand(1).alias("x"))
        return jobs(spark, lambda: grouped_quantiles(df, "g", "x", [0.5], small_rows=50).collect())

    assert abs(made(60) - made(3)) <= 4


def test_distinct_counts(spark):
    pdf = pd.DataFrame({"k": range(600), "few": [i % 7 for i in range(600)], "text": [f"t{i % 150}" for i in range(600)], "gap": [None if i % 2 else f"v{i}" for i in range(600)], "empty": pd.Series([None] * 600, dtype="object")})
    df = spark.createDataFrame(pdf, "k long, few int, text string, gap string, empty string").withColumn("arr", F.array("few"))
    want = {"k": 600, "few": 7, "text": 150, "gap": 300, "empty": 0, "arr": 7}
    assert profile.exact_distinct(df) == want
    old, profile.SET_LIMIT = profile.SET_LIMIT, 100
    try:
        assert profile.exact_distinct(df) == want
    finally:
        profile.SET_LIMIT = old
    assert profile.distinct_up_to(df, df.columns, 10) == {"k": 11, "few": 7, "text": 11, "gap": 11, "empty": 0, "arr": 7}
    assert profile.all_distinct(df, "k") and profile.all_distinct(df, "gap") and not profile.all_distinct(df, "text")


def test_distincts_of_500_columns_need_no_shuffle_of_values(spark):
    df = spark.range(300).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(500)])
    assert jobs(spark, lambda: profile.distinct_up_to(df, df.columns, 10)) <= 6
    got = profile.distinct_up_to(df, df.columns, 10)
    assert got == {f"c{i}": min(i + 1, 11) for i in range(500)}


def test_poisson_draws_follow_the_distribution():
    points = (np.arange(20_000) + 0.5) / 20_000
    for mean in (1, 7, 400, 50_000):
        k = compare.poisson_draws(mean, points)
        assert abs(k.mean() - mean) < 0.01 * math.sqrt(mean) + 0.01 and abs(k.var() / mean - 1) < 0.02
    assert compare.uniform("a:b") == compare.uniform("a:b") and 0 <= compare.uniform("x") < 1


def test_bootstraps_do_not_depend_on_partitions(spark):
    df = spark.range(400).select("id", (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 2).alias("a"), (F.col("id") % 5 == 0).cast("int").alias("b"))
    for run in (lambda d: compare.bootstrap_f1(d, "y", "a", "b", replicates=40), lambda d: compare.bootstrap_rmse(d, ["id"], "y", "a", "b", replicates=40)):
        one, more = (sorted((r.replicate, round(r["diff"], 9)) for r in run(df.repartition(n)).collect()) for n in (1, 7))
        assert one == more and len(one) == 40


def test_feedback_without_a_time_keeps_its_label(spark):
    at = dt.datetime(2024, 1, 1)
    rows = [("a", 1, None), ("b", 0, at), ("b", 1, None), ("c", 0, at), ("c", 1, at), ("d", None, at)]
    got = {r.request_id: r.ground_truth for r in monitor.latest_feedback(spark.createDataFrame(rows, "request_id string, ground_truth int, feedback_at timestamp")).collect()}
    assert got == {"a": 1, "b": 0, "c": 1, "d": None}
