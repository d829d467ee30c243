"""Expectations, request checks, sources, versions, model versions."""

import pytest
from pyspark.sql import functions as F

from lakegauge.operators import registry, validate
from lakegauge.operators.validate import BETWEEN, COLUMN_SET, IN_SET, MEAN_BETWEEN, NOT_NULL, OF_TYPE, ROW_COUNT, UNIQUE, Expectation, TableRules
from lakegauge.sources import synthetic, tables, versions


def run(df, *suite):
    return {(r.expectation_type, r["column"]): r for r in validate.run_suite(df, list(suite)).collect()}


def test_nulls_are_ignored_but_by_the_null_check(spark):
    df = spark.createDataFrame([(1, "a"), (None, None), (9, "z")], "x int, c string")
    got = run(df, Expectation(BETWEEN, "x", 1.0, {"min_value": 0, "max_value": 5}), Expectation(IN_SET, "c", 0.5, {"value_set": ["a"]}), Expectation(NOT_NULL, "x", 0.6))
    assert (got[BETWEEN, "x"].unexpected_count, got[BETWEEN, "x"].element_count, got[BETWEEN, "x"].success) == (1, 2, False)
    assert got[IN_SET, "c"].success and got[NOT_NULL, "x"].success


def test_every_member_of_a_duplicate_is_unexpected(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (2,), (None,)], "x int")
    row = run(df, Expectation(UNIQUE, "x"))[UNIQUE, "x"]
    assert (row.unexpected_count, row.element_count, row.success) == (3, 4, False)


def test_missing_column_fails_and_unknown_kind_is_skipped(spark):
    df = spark.createDataFrame([(1,)], "x int")
    rows = validate.run_suite(df, [Expectation(NOT_NULL, "gone"), Expectation("no_such_check", "x"), Expectation(ROW_COUNT, kwargs={"min_value": 1})]).collect()
    assert [(r["column"], r.success) for r in rows] == [("gone", False), ("dataset-level", True)]


def test_empty_table(spark):
    df = spark.createDataFrame([], "x int")
    got = run(df, Expectation(NOT_NULL, "x"), Expectation(UNIQUE, "x"), Expectation(MEAN_BETWEEN, "x", kwargs={"min_value": 0, "max_value": 1}), Expectation(COLUMN_SET, kwargs={"column_set": ["x"]}))
    assert got[NOT_NULL, "x"].success and got[UNIQUE, "x"].success and not got[MEAN_BETWEEN, "x"].success and got[COLUMN_SET, "dataset-level"].success


def test_profile_passes_on_itself(spark):
    df = synthetic.sample(spark, 2000)
    report = validate.validate(df, ref=df)
    assert report.summary.first().is_valid and all(r.aligned for r in report.alignment.collect())
    moved = validate.validate(synthetic.sample(spark, 2000, drift=4.0, seed=9), ref=df)
    assert not all(r.aligned for r in moved.alignment.collect())


def test_rules_from_dict_and_types(spark):
    rules = TableRules.from_dict({"columns": [{"name": "x", "dtype": "int64", "nullable": False}, {"name": "c", "dtype": "float64"}], "min_rows": 1})
    df = spark.createDataFrame([(1, "2.5"), (2, "bad")], "x int, c string")
    got = run(df, *validate.suite_from_rules(rules))
    assert got[OF_TYPE, "x"].success and got[OF_TYPE, "c"].unexpected_count == 1


def test_choice_of_suite(spark):
    assert validate.choose_suite([], TableRules(())) == []
    with pytest.raises(ValueError):
        validate.choose_suite()


def test_request_checks(spark):
    rows = [("ok", {"a": 1.0}, None), (" ", {"a": 1.0}, "20240101_000000"), ("x" * 129, {"a": None}, "v1"), ("n", {}, None), ("i", {"a": float("inf")}, None)]
    df = spark.createDataFrame(rows, "request_id string, features map<string,double>, model_version string")
    checked = validate.check_requests(df, required=["a"])
    good, bad = validate.split_requests(checked)
    assert [r.request_id for r in good.collect()] == ["ok"]
    reasons = {r.request_id[:1]: set(r.reject_reasons) for r in bad.collect()}
    assert reasons[" "] == {"request_id_empty"} and reasons["x"] == {"features_all_null", "null:a", "bad_version", "request_id_too_long"}
    assert reasons["n"] == {"features_empty", "missing:a"} and reasons["i"] == {"feature_not_finite"}


def test_format_inference():
    assert [tables.infer_format(p) for p in ("a.csv", "s3://b/x.TSV", "gs://b/y.jsonl?v=1", "hdfs:///z.orc", "folder/part", "postgresql+psycopg2://h/db")] == ["csv", "csv", "json", "orc", "parquet", "jdbc"]
    assert tables.infer_format("a.csv", "parquet") == "parquet"


def test_database_options():
    src = tables.Source.from_dict({"source": "postgresql://u:p@h:5432/db", "sql": "SELECT * FROM t WHERE a = :a AND b = :b", "params": {"a": 1, "b": "it's"}})
    opts = tables.jdbc_options(src)
    assert opts["url"] == "jdbc:postgresql://h:5432/db" and opts["user"] == "u" and opts["query"] == "SELECT * FROM t WHERE a = 1 AND b = 'it''s'"
    split = tables.jdbc_options(tables.Source("mysql://h/db", sql="SELECT 1", options={"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}))
    assert "query" not in split and split["dbtable"].startswith("(SELECT 1)")
    with pytest.raises(ValueError):
        tables.jdbc_options(tables.Source("mysql://h/db"))


def test_tab_separated_files_use_tabs(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("a\tb\n1\tx,y\n")
    assert tables.read(spark, str(tmp_path / "t.tsv")).collect() == [(1, "x,y")]


def test_pointer_names_the_reference(spark, tmp_path):
    root = str(tmp_path / "r")
    a, b = spark.range(3), spark.range(5)
    with pytest.raises(ValueError):
        versions.load_reference(spark, root)
    versions.shift_reference(a, root, "v1", "2024-01-01")
    versions.shift_reference(b, root, "v2", "2024-01-02")
    df, origin = versions.load_reference(spark, root)
    assert origin == "previous_cycle" and df.count() == 5 and not versions.save_version(a, f"{root}/data", "v2")


def test_synthetic_target_is_balanced(spark):
    df = synthetic.sample(spark, 4000)
    assert df.agg(F.avg("target")).first()[0] == pytest.approx(0.5, abs=0.001)
    assert df.agg(F.avg("feature_3")).first()[0] == pytest.approx(2.0, abs=0.15)


def test_version_life_cycle(spark):
    day = lambda d: F.lit(f"2024-01-{d:02d}").cast("timestamp")
    log = spark.createDataFrame([], "model_id string, version string, stage string, at timestamp, parent_version string")
    pick = lambda v: spark.createDataFrame([("m", v)], "model_id string, version string")
    for i, v in enumerate(("v1", "v2", "v3")):
        log = log.unionByName(registry.register(log, pick(v), day(2 * i + 1)))
        log = log.unionByName(registry.promote(log, pick(v), day(2 * i + 2)))
    log = spark.createDataFrame(log.collect(), log.schema)
    assert registry.champions(log).first().version == "v3"
    assert {r.version: r.stage for r in registry.current(log).collect()} == {"v1": "archived", "v2": "archived", "v3": "champion"}
    assert registry.get_version(log, "m", "v3").first().parent_version == "v2"
    log = log.unionByName(registry.rollback(log, pick("v3"), day(9)))
    assert {r.version: r.stage for r in registry.current(log).collect()} == {"v1": "archived", "v2": "champion", "v3": "rejected"}
    assert registry.unknown_versions(log, pick("v9")).count() == 1 and registry.promote(log, pick("v9"), day(10)).count() == 0
    assert [r.version for r in registry.list_versions(log).collect()] == ["v3", "v2", "v1"]
