"""Cleaning and fitted transforms."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakegauge.operators import clean, profile, transform
from lakegauge.operators.profile import ColumnConfig
from lakegauge.plans import cycle


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(0)
    n = 400
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.exponential(1, n), "c": rng.choice(list("xyz"), n), "d": rng.choice([f"k{i}" for i in range(30)], n)})
    pdf["y"] = (pdf.a + rng.normal(size=n) > 0).astype(int)
    pdf.loc[::9, "a"] = None
    pdf.loc[::7, "c"] = " Unknown "
    ref = spark.createDataFrame(pdf)
    return ref, ref.withColumn("a", F.col("a") + 1), ref.withColumn("a", F.col("a") * 50)


def test_production_does_not_change_parameters(spark, tables):
    ref, prod_a, prod_b = tables
    configs = profile.auto_config(ref, "y")
    one, _, _ = transform.prepare(ref, prod_a, configs, "y")
    two, _, _ = transform.prepare(ref, prod_b, configs, "y")
    assert (one.fills, one.scalers, one.outliers) == (two.fills, two.scalers, two.outliers)


def test_output_is_numeric_and_complete(spark, tables):
    ref, prod, _ = tables
    prep, out_ref, out_prod = transform.prepare(ref, prod, profile.auto_config(ref, "y"), "y")
    assert out_ref.columns == out_prod.columns and out_ref.columns[-1] == "y"
    kinds = {f.name: f.dataType.simpleString() for f in out_prod.schema.fields if f.name != "y"}
    assert set(kinds.values()) == {"float"}
    assert out_prod.select(sum(F.col(c).isNull().cast("int") for c in kinds).alias("n")).agg(F.sum("n")).first()[0] == 0
    onehot = [c for c in out_prod.columns if c.startswith("c_")]
    assert {r[0] for r in out_prod.select(sum(F.col(c) for c in onehot)).distinct().collect()} == {1.0}
    assert sorted(onehot) == ["c_x", "c_y", "c_z"]


def test_saved_preparation_gives_the_same_rows(spark, tables, tmp_path):
    ref, prod, _ = tables
    prep, _, out = transform.prepare(ref, prod, profile.auto_config(ref, "y"), "y")
    prep.save(spark, str(tmp_path / "p"))
    again = transform.Preparation.load(spark, str(tmp_path / "p")).transform(prod)
    assert out.exceptAll(again).isEmpty() and again.exceptAll(out).isEmpty()


def test_unknown_columns_go_and_missing_ones_come_back(spark, tables):
    ref, prod, _ = tables
    prep, _, out = transform.prepare(ref, prod, profile.auto_config(ref, "y"), "y")
    odd = prep.transform(prod.drop("b").withColumn("extra", F.lit(1)))
    assert odd.columns == out.columns


def test_clip_twice_is_clip_once(spark, tables):
    ref, prod, _ = tables
    params = transform.fit_outliers(ref, {"a": "clip", "b": "iqr_clip"})
    once = transform.apply_outliers(prod, params)
    assert once.exceptAll(transform.apply_outliers(once, params)).isEmpty()


def test_large_lookup_is_written_not_collected(spark, tables):
    ref, prod, _ = tables
    big, small = transform.fit_frequency(ref, "d", limit=5), transform.fit_frequency(ref, "d")
    assert big.path and big.rows is None and small.rows
    a = transform.apply_lookup(prod, "d", big, "v").groupBy("d").agg(F.round(F.max("v"), 9).alias("v"))
    b = transform.apply_lookup(prod, "d", small, "v").groupBy("d").agg(F.round(F.max("v"), 9).alias("v"))
    assert a.exceptAll(b).isEmpty()


def test_keep_first_takes_the_target_along(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "b", 3), (2, "c", 1)], "x int, y string, o int")
    assert sorted(clean.keep_first(df, ["x"], ["o"]).collect()) == [(1, "b", 3), (2, "c", 1)]


def test_keep_first_of_one_other_column_takes_null_first_without_sorting(spark):
    df = spark.createDataFrame([(1, "a", 5), (1, "a", 3), (2, "c", 1), (2, "c", None), (3, None, 7)], "x int, s string, y int")
    got = clean.keep_first(df, ["x", "s"], ["x", "s", "y"])
    assert sorted(got.collect(), key=lambda r: r.x) == [(1, "a", 3), (2, "c", None), (3, None, 7)]
    assert "SortAggregate" not in got._jdf.queryExecution().toString()


def test_a_cycle_computes_its_tables_once(spark):
    made = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).cast("int").alias("y"))
    prod = rows.where("id < 120").mapInArrow(seen, rows.schema)  # too few rows and another mean: the cycle ends after validation
    out = cycle.run_cycle(rows, prod.withColumn("a", F.col("a") + 100), "y", ["id"], "m", "v", rows, "2023-01-01", "2024-01-01")
    assert out.steps == [("validate", "invalid")] and made.value == 120


def test_unknown_strategy_is_refused(spark, tables):
    ref, _, _ = tables
    with pytest.raises(ValueError, match="unknown strategy"):
        transform.fit_preparation(ref, {"a": ColumnConfig("a", imputation="forward_fill")})


def test_value_fixes(spark):
    df = spark.createDataFrame([(" N/A ", "$1,200.5", "YES", "2024-01-02"), ("ok", "abc", "off", "x")], "a string, b string, c string, d string")
    row = df.select(
        clean.null_tokens(F.col("a")).alias("a"), clean.numeric_text(F.col("b")).alias("b"), clean.bool_words(F.col("c")).alias("c"), clean.date_epoch(F.col("d"), "yyyy-MM-dd").alias("d")
    ).collect()
    assert tuple(row[0]) == (None, 1200.5, 1.0, 1704153600.0) and tuple(row[1]) == ("ok", None, 0.0, None)


def test_training_rows_never_see_their_own_target(spark):
    # every category holds one row: out of fold it is unknown, so all rows of a fold get that fold's mean of the others
    rows = [(i, f"c{i}", float(i % 7)) for i in range(60)]
    ref = spark.createDataFrame(rows, "k long, c string, y double")
    configs = {
        "k": profile.ColumnConfig("k", outlier="none", scaling="none", imputation="none"),
        "c": profile.ColumnConfig("c", expected_dtype="object", imputation="mode", outlier="none", scaling="none", encoding="target"),
    }
    audit = []
    prep, training, _ = transform.prepare(ref, ref.limit(5), configs, "y", order_by=["k"], audit=audit)
    assert len({round(r.c, 4) for r in training.collect()}) <= 5
    assert len({round(r.c, 4) for r in prep.transform(ref).collect()}) >= 1 and prep.leaks == []
    report = {r.step: r for a in audit for r in a.collect()}
    assert report["deduplicate"].rows_in == 60 and report["deduplicate"].seconds > 0 and report["prepare_production"].rows_out == 5


def test_a_feature_that_is_the_target_is_named(spark):
    ref = spark.createDataFrame([(float(i), float(i * 3 % 17), float(2 * i)) for i in range(80)], "a double, b double, y double")
    configs = {c: profile.ColumnConfig(c, outlier="none", scaling="standard") for c in ("a", "b")}
    audit = []
    prep, _, _ = transform.prepare(ref, ref, configs, "y", audit=audit)
    assert prep.leaks == ["a"] and "leaks_target:a" in audit[1].first()["warnings"]
