"""Quantiles, running totals and two-sample statistics against NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakegauge.functions import prefix, quantiles
from lakegauge.functions.pvalues import chi2_sf, ks_pvalue
from lakegauge.operators import drift


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


def skewed(rng, n):
    """A third of the values are equal, the rest has a long tail."""
    x = rng.exponential(2.0, n)
    x[rng.random(n) < 0.34] = 1.5
    return x


@pytest.mark.parametrize("small_rows", [10**9, 100, 5])
def test_exact_quantiles(spark, small_rows):
    rng = np.random.default_rng(0)
    a, b = skewed(rng, 4000), rng.normal(size=4000)
    df = frame(spark, a=a, b=b).repartition(3)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = quantiles.exact_quantiles(df, {"a": probs, "b": probs}, small_rows=small_rows)
    assert np.allclose(got["a"], np.quantile(a, probs), atol=1e-12)
    assert np.allclose(got["b"], np.quantile(b, probs), atol=1e-12)


def test_quantiles_of_missing_and_constant_columns(spark):
    df = spark.createDataFrame([(None, 2.0), (float("nan"), 2.0)], "a double, b double")
    assert quantiles.exact_quantiles(df, {"a": [0.5], "b": [0.1, 0.9]}) == {"a": None, "b": [2.0, 2.0]}


@pytest.mark.parametrize("rows_per_bucket", [10**9, 50])
def test_running_totals_equal_plain_window(spark, rows_per_bucket):
    rng = np.random.default_rng(1)
    x = skewed(rng, 2000).round(2)
    df = frame(spark, v=x)
    cuts = prefix.bucket_cuts(df, ["v"], rows_per_bucket)
    one = {"n": F.lit(1).cast("long")}
    totals = prefix.bucket_totals(df, ["v"], one, cuts)
    got = prefix.running_totals(prefix.value_counts(df, ["v"], one, cuts), ["n"], totals).orderBy("x").toPandas()
    values, counts = np.unique(x, return_counts=True)
    assert np.array_equal(got.x, values) and np.array_equal(got.n, counts)
    assert np.array_equal(got.before_n, np.cumsum(counts) - counts)
    assert np.array_equal(got.next_x.to_numpy()[:-1], values[1:]) and np.isnan(got.next_x.iloc[-1])


def reference_statistics(r, p, bins=20):
    grid = np.unique(np.concatenate([r, p]))
    fr = np.searchsorted(np.sort(r), grid, side="right") / len(r)
    fp = np.searchsorted(np.sort(p), grid, side="right") / len(p)
    w1 = (np.abs(fr - fp)[:-1] * np.diff(grid)).sum() / np.std(r)
    edges = np.unique(np.percentile(r, np.linspace(0, 100, bins + 1)))
    hr, hp = np.histogram(r, edges)[0].astype(float), np.histogram(p, edges)[0].astype(float)
    sr, sp = hr / hr.sum() + 1e-8, hp / hp.sum() + 1e-8
    psi = ((sp - sr) * np.log(sp / sr)).sum()
    jr, jp = (hr + 1e-8) / (hr + 1e-8).sum(), (hp + 1e-8) / (hp + 1e-8).sum()
    m = (jr + jp) / 2
    jsd = 0.5 * (jr * np.log(jr / m)).sum() + 0.5 * (jp * np.log(jp / m)).sum()
    return np.abs(fr - fp).max(), w1, psi, jsd


@pytest.mark.parametrize("rows_per_bucket", [250_000, 60])
def test_two_sample_statistics(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(prefix.bucket_cuts, "__defaults__", (rows_per_bucket, None))
    monkeypatch.setattr(drift, "ROWS_PER_BUCKET", rows_per_bucket)
    rng = np.random.default_rng(2)
    r = {"a": skewed(rng, 1500), "b": rng.integers(0, 30, 1500).astype(float)}
    p = {"a": skewed(rng, 700) * 1.2, "b": rng.integers(5, 40, 700).astype(float)}
    got = drift.two_sample_statistics(frame(spark, **r), frame(spark, **p), ["a", "b"]).toPandas().set_index("feature")
    for c in ("a", "b"):
        want = reference_statistics(r[c], p[c])
        assert np.allclose(got.loc[c, ["ks", "wasserstein", "psi", "jsd"]].astype(float), want, atol=1e-9)


def test_same_sample_and_symmetry(spark):
    rng = np.random.default_rng(3)
    a, b = frame(spark, x=rng.normal(size=400)), frame(spark, x=rng.normal(0.4, 1, 300))
    same = drift.two_sample_statistics(a, a, ["x"]).first()
    assert same.ks == 0 and same.psi == 0 and same.wasserstein == 0 and same.ks_p == 1.0
    one, two = drift.ks_two_sample(a, b, ["x"]).first(), drift.ks_two_sample(b, a, ["x"]).first()
    assert one.ks == pytest.approx(two.ks) and 0 <= one.ks <= 1


def test_production_outside_the_reference_has_no_psi(spark):
    out = drift.two_sample_statistics(frame(spark, x=np.arange(50.0)), frame(spark, x=np.arange(50.0) + 500), ["x"]).first()
    assert out.psi is None and out.ks == 1.0


def test_few_values_are_skipped(spark):
    a = frame(spark, x=np.arange(50.0), y=[1.0] * 5 + [None] * 45)
    got = [r.feature for r in drift.feature_drift(a, a).collect()]
    assert got == ["x"]


def test_p_values(spark):
    row = spark.range(1).select(
        ks_pvalue(F.lit(0.136), F.lit(100), F.lit(200)).alias("k"),
        chi2_sf(F.lit(3.84145882069412), F.lit(1.0)).alias("c1"),
        chi2_sf(F.lit(18.307038053275146), F.lit(10.0)).alias("c10"),
        chi2_sf(F.lit(1.0), F.lit(10.0)).alias("low"),
    ).first()
    lam = 0.136 * np.sqrt(100 * 200 / 300)
    assert row.k == pytest.approx(2 * sum((-1) ** (j - 1) * np.exp(-2 * j * j * lam * lam) for j in range(1, 101)))
    assert row.c1 == pytest.approx(0.05) and row.c10 == pytest.approx(0.05)
    assert row.low == pytest.approx(np.exp(-0.5) * sum(0.5**i / np.prod(np.arange(1, i + 1)) for i in range(5)))


def test_chi_square_masks_new_categories(spark):
    ref = spark.createDataFrame([("a",)] * 30 + [("b",)] * 30, "c string")
    prod = spark.createDataFrame([("a",)] * 10 + [("b",)] * 20 + [("new",)] * 5, "c string")
    row = drift.chi_square(ref, prod, ["c"]).first()
    assert row.dof == 1 and row.chi2 == pytest.approx((10 - 17.5) ** 2 / 17.5 + (20 - 17.5) ** 2 / 17.5)
    single = drift.chi_square(ref.where("c = 'a'"), prod, ["c"]).first()
    assert (single.chi2, single.p_value) == (0.0, 1.0)


def test_severity_order(spark):
    cases = [(0.6, 0.0, True, "critical"), (0.2, 0.0, True, "high"), (0.7, 0.0, False, "high"), (0.4, 0.0, False, "moderate"), (0.0, 0.6, False, "moderate"), (0.2, 0.0, False, "low"), (0.1, 0.1, False, "none")]
    df = spark.createDataFrame(cases, "p double, s double, c boolean, want string")
    for r in df.withColumn("got", drift.severity(F.col("p"), F.col("s"), F.col("c"))).collect():
        assert r.got == r.want


def test_history_grows_by_run(spark, tmp_path):
    a = spark.createDataFrame([("x", 0.1)], "feature string, score double")
    for day in ("2024-01-01", "2024-01-02"):
        drift.append_history(a, str(tmp_path / "h"), day)
    assert {str(r.run_date) for r in drift.read_history(spark, str(tmp_path / "h")).collect()} == {"2024-01-01", "2024-01-02"}
