"""Expectations on a table: declared or profiled, all counted in one aggregate."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType, StringType, TimestampNTZType, TimestampType

from ..functions.frames import local_frame
from .drift import alignment
from .profile import snapshot

ROW_COUNT = "row_count_between"
COLUMN_SET = "columns_match_set"
NOT_NULL = "values_not_null"
OF_TYPE = "values_of_type"
IN_SET = "values_in_set"
BETWEEN = "values_between"
MEAN_BETWEEN = "mean_between"
UNIQUE = "values_unique"
KNOWN = {ROW_COUNT, COLUMN_SET, NOT_NULL, OF_TYPE, IN_SET, BETWEEN, MEAN_BETWEEN, UNIQUE}

# Declared type name -> Spark type names that satisfy it.
TYPE_NAMES = {
    "int": {"tinyint", "smallint", "int", "bigint"},
    "int64": {"tinyint", "smallint", "int", "bigint"},
    "float": {"float", "double", "decimal"},
    "float64": {"float", "double", "decimal"},
    "object": {"string"},
    "str": {"string"},
    "string": {"string"},
    "category": {"string"},
    "bool": {"boolean"},
    "boolean": {"boolean"},
    "datetime": {"timestamp", "timestamp_ntz", "date"},
    "datetime64": {"timestamp", "timestamp_ntz", "date"},
}
CAST_FOR = {"int": "bigint", "int64": "bigint", "float": "double", "float64": "double", "bool": "boolean", "boolean": "boolean", "datetime": "timestamp"}


@dataclass(frozen=True)
class ColumnRule:
    name: str
    dtype: str = ""
    nullable: bool = True
    unique: bool = False
    min_value: float | None = None
    max_value: float | None = None
    allowed_values: tuple | None = None
    tolerance_factor: float | None = None
    null_budget: float | None = None
    sensitive: bool = False


@dataclass(frozen=True)
class TableRules:
    columns: tuple[ColumnRule, ...]
    min_rows: int = 100
    max_rows: int | None = None

    @classmethod
    def from_dict(cls, data: dict) -> "TableRules":
        cols = []
        for c in data["columns"]:
            c = dict(c)
            if c.get("allowed_values") is not None:
                c["allowed_values"] = tuple(c["allowed_values"])
            cols.append(ColumnRule(**c))
        return cls(tuple(cols), data.get("min_rows", 100), data.get("max_rows"))


@dataclass(frozen=True)
class Expectation:
    kind: str
    column: str | None = None
    mostly: float = 1.0
    kwargs: dict = field(default_factory=dict)


# ---- building suites --------------------------------------------------------------------------------------


def suite_from_rules(rules: TableRules) -> list[Expectation]:
    suite = [
        Expectation(ROW_COUNT, kwargs={"min_value": rules.min_rows, "max_value": rules.max_rows}),
        Expectation(COLUMN_SET, kwargs={"column_set": [c.name for c in rules.columns]}),
    ]
    for c in rules.columns:
        if not c.nullable:
            mostly = 1.0
        elif c.null_budget is not None:
            mostly = round(1.0 - c.null_budget, 4)
        else:
            mostly = 0.95
        suite.append(Expectation(NOT_NULL, c.name, mostly))
        if c.dtype:
            suite.append(Expectation(OF_TYPE, c.name, kwargs={"type": c.dtype}))
        if c.allowed_values:
            suite.append(Expectation(IN_SET, c.name, kwargs={"value_set": list(c.allowed_values)}))
        if c.dtype in ("int", "float", "int64", "float64") and c.min_value is not None and c.max_value is not None:
            suite.append(Expectation(BETWEEN, c.name, kwargs={"min_value": c.min_value, "max_value": c.max_value}))
        if c.unique:
            suite.append(Expectation(UNIQUE, c.name))
    return suite


def top_values(df: DataFrame, cols: Sequence[str], k: int, distinct: str | None = None) -> DataFrame:
    """The ``k`` most frequent values per column, ties by value: ``(column, value, count, rank)``, and under the name
    ``distinct`` how many values the column has."""
    cells = ", ".join(f"`{c}`" for c in cols)
    long = df.sparkSession.sql(
        f"SELECT column, value FROM {{t}} UNPIVOT (value FOR column IN ({cells}))",
        t=df.select(*[F.col(c).cast("string").alias(c) for c in cols]),
    )
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value")))
    counts = long.groupBy("column", "value").count()
    if distinct is not None:
        counts = counts.withColumn(distinct, F.count("*").over(Window.partitionBy("column")))
    return counts.withColumn("rank", rank).where(F.col("rank") <= k)


def suite_from_profile(
    ref: DataFrame, rules: TableRules | None = None, tolerance: float = 3.0, max_categories: int = 50
) -> list[Expectation]:
    """Expectations learned from a reference table: two passes over it, parameters to the driver."""
    overrides = {c.name: c for c in rules.columns} if rules else {}
    kinds = {f.name: f.dataType for f in ref.schema.fields}
    numeric = [c for c, k in kinds.items() if isinstance(k, NumericType)]
    stamps = [c for c, k in kinds.items() if isinstance(k, (TimestampType, TimestampNTZType))]
    texts = [c for c, k in kinds.items() if isinstance(k, StringType)]
    aggs = [F.count("*").alias("rows")] + [F.count(F.col(c)).alias(f"n|{c}") for c in kinds]
    aggs += [e for c in numeric for e in (F.avg(c).alias(f"mean|{c}"), F.stddev_samp(c).alias(f"std|{c}"))]
    aggs += [e for c in stamps for e in (F.min(c).cast("string").alias(f"min|{c}"), F.max(c).cast("string").alias(f"max|{c}"))]
    aggs += [F.approx_count_distinct(c).alias(f"approx|{c}") for c in texts]
    row = ref.agg(*aggs).first().asDict()
    rows = row["rows"]
    # The estimate only rules columns out that are far above the limit; the rest is counted exactly.
    few = [c for c in texts if 0 < row[f"approx|{c}"] <= 4 * max_categories]
    sets: dict[str, list[str]] = {}
    if few:
        for r in top_values(ref, few, 20, "distinct").where(F.col("distinct") <= max_categories).orderBy("column", "rank").collect():
            sets.setdefault(r["column"], []).append(r["value"])
    suite = [
        Expectation(ROW_COUNT, kwargs={"min_value": max(1, int(rows * 0.5)), "max_value": int(rows * 2.0)}),
        Expectation(COLUMN_SET, kwargs={"column_set": list(kinds)}),
    ]
    for c in kinds:
        present = row[f"n|{c}"]
        if present == 0:
            continue
        rule = overrides.get(c)
        if rule is not None and rule.null_budget is not None:
            budget = rule.null_budget
        else:
            budget = min(1.0 - present / rows + 0.10, 0.50)
        suite.append(Expectation(NOT_NULL, c, round(1.0 - budget, 4)))
        if c in numeric and present >= 5:
            factor = rule.tolerance_factor if rule is not None and rule.tolerance_factor is not None else tolerance
            mean, std = row[f"mean|{c}"], row[f"std|{c}"]
            spread = factor * (std if std > 0 else 1e-6)
            bounds = {"min_value": round(mean - spread, 4), "max_value": round(mean + spread, 4)}
            suite += [Expectation(BETWEEN, c, 0.95, bounds), Expectation(MEAN_BETWEEN, c, kwargs=bounds)]
        elif c in stamps:
            suite.append(Expectation(BETWEEN, c, 0.95, {"min_value": row[f"min|{c}"], "max_value": row[f"max|{c}"]}))
        elif c in sets:
            suite.append(Expectation(IN_SET, c, 0.90, {"value_set": sets[c]}))
    return suite


def choose_suite(expectations: list[Expectation] | None = None, rules: TableRules | None = None, ref: DataFrame | None = None) -> list[Expectation]:
    """Caller's list first, then declared rules, then a profile of the reference."""
    if expectations is not None:
        return expectations
    if rules is not None:
        return suite_from_rules(rules)
    if ref is None:
        raise ValueError("give expectations, rules or a reference table")
    return suite_from_profile(ref)


# ---- running suites ---------------------------------------------------------------------------------------


def _bound(value, kind) -> Column:
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.lit(value).cast(kind)
    return F.lit(value)


def _unexpected(e: Expectation, df: DataFrame) -> Column:
    """Condition of a value that breaks a row-level expectation."""
    col, kind = F.col(e.column), df.schema[e.column].dataType
    if e.kind == NOT_NULL:
        return col.isNull()
    if e.kind == IN_SET:
        return col.isNotNull() & ~col.isin(e.kwargs["value_set"])
    if e.kind == BETWEEN:
        broken = F.lit(False)
        if e.kwargs.get("min_value") is not None:
            broken = broken | (col < _bound(e.kwargs["min_value"], kind))
        if e.kwargs.get("max_value") is not None:
            broken = broken | (col > _bound(e.kwargs["max_value"], kind))
        return col.isNotNull() & broken
    if e.kind == OF_TYPE:
        declared = e.kwargs["type"]
        actual = kind.simpleString().split("(")[0]
        if actual in TYPE_NAMES.get(declared, {declared}):
            return F.lit(False)
        if isinstance(kind, StringType) and declared in CAST_FOR:
            return col.isNotNull() & col.try_cast(CAST_FOR[declared]).isNull()
        return col.isNotNull()
    raise ValueError(e.kind)


def run_suite(df: DataFrame, suite: Sequence[Expectation]) -> DataFrame:
    """One row per expectation; unknown kinds are skipped, a missing column is a failed check.

    Row-level checks share one aggregate. Each uniqueness check is a count per value summed map-side, so a
    value that fills a third of the table stays one row per task in the shuffle.
    """
    suite = [e for e in suite if e.kind in KNOWN]
    have = set(df.columns)
    aggs: dict[str, Column] = {"rows": F.count("*")}
    for i, e in enumerate(suite):
        if e.column is not None and e.column not in have:
            continue
        if e.kind in (NOT_NULL, IN_SET, BETWEEN, OF_TYPE):
            aggs[f"bad{i}"] = F.count(F.when(_unexpected(e, df), 1))
            aggs[f"n|{e.column}"] = F.count(F.col(e.column))
        elif e.kind == MEAN_BETWEEN:
            aggs[f"mean{i}"] = F.avg(F.col(e.column))
            aggs[f"n|{e.column}"] = F.count(F.col(e.column))
    counted = df.agg(*[a.alias(k) for k, a in aggs.items()])

    def record(i: int, e: Expectation, success: Column, observed: Column, bad: Column, n: Column) -> Column:
        return F.struct(
            F.lit(i).alias("position"),
            F.lit(e.kind).alias("expectation_type"),
            F.lit(e.column or "dataset-level").alias("column"),
            F.coalesce(success, F.lit(False)).alias("success"),
            observed.cast("double").alias("observed"),
            bad.cast("long").alias("unexpected_count"),
            n.cast("long").alias("element_count"),
            F.lit(json.dumps({"mostly": e.mostly, **e.kwargs}, default=str, sort_keys=True)).alias("kwargs"),
        )

    none, records, unique = F.lit(None), [], []
    for i, e in enumerate(suite):
        if e.column is not None and e.column not in have:
            records.append(record(i, e, F.lit(False), none, none, none))
        elif e.kind == ROW_COUNT:
            low, high = e.kwargs.get("min_value"), e.kwargs.get("max_value")
            ok = F.col("rows") >= (low or 0)
            ok = ok & (F.col("rows") <= high) if high is not None else ok
            records.append(record(i, e, ok, F.col("rows"), none, F.col("rows")))
        elif e.kind == COLUMN_SET:
            off = have ^ set(e.kwargs["column_set"])
            records.append(record(i, e, F.lit(not off), F.lit(len(have)), F.lit(len(off)), F.lit(len(have))))
        elif e.kind == MEAN_BETWEEN:
            mean = F.col(f"mean{i}")
            ok = mean.between(e.kwargs["min_value"], e.kwargs["max_value"])
            records.append(record(i, e, ok, mean, none, F.col(f"n|{e.column}")))
        elif e.kind == UNIQUE:
            unique.append((i, e))
        else:
            bad = F.col(f"bad{i}")
            n = F.col("rows") if e.kind == NOT_NULL else F.col(f"n|{e.column}")
            share = F.coalesce(F.try_divide(n - bad, n), F.lit(1.0))
            records.append(record(i, e, share >= e.mostly, share, bad, n))
    out = counted.select(F.inline(F.array(*records))) if records else None
    for i, e in unique:
        dup = (
            df.where(F.col(e.column).isNotNull())
            .groupBy(e.column)
            .count()
            .agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("bad"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"))
        )
        share = F.coalesce(F.try_divide(F.col("n") - F.col("bad"), F.col("n")), F.lit(1.0))
        part = dup.select(F.inline(F.array(record(i, e, share >= e.mostly, share, F.col("bad"), F.col("n")))))
        out = part if out is None else out.unionByName(part)
    return out


def schema_errors(df: DataFrame, rules: TableRules) -> DataFrame:
    """Checks to run before the suite: too few rows, missing columns."""
    missing = sorted({c.name for c in rules.columns} - set(df.columns))
    return df.agg(F.count("*").alias("rows")).select(
        "rows",
        (F.col("rows") < rules.min_rows).alias("too_few_rows"),
        F.array(*[F.lit(c) for c in missing]).cast("array<string>").alias("missing_columns"),
        ((F.col("rows") >= rules.min_rows) & F.lit(not missing)).alias("schema_ok"),
    )


def score_suite(checks: DataFrame, schema_ok: Column | None = None) -> DataFrame:
    """Success rate and verdict: valid without failures or from a rate of 0.90; ``schema_ok`` stays separate."""
    passed = F.count(F.when(F.col("success"), 1))
    total = F.count("*")
    out = checks.agg(
        total.alias("evaluated_expectations"),
        passed.alias("successful_expectations"),
        (total - passed).alias("unsuccessful_expectations"),
        F.coalesce(F.try_divide(passed, total), F.lit(0.0)).alias("success_rate"),
        F.sort_array(
            F.collect_list(F.when(~F.col("success"), F.concat(F.col("expectation_type"), F.lit(" on "), F.col("column"))))
        ).alias("failed_checks"),
    )
    out = out.withColumn("is_valid", (F.col("unsuccessful_expectations") == 0) | (F.col("success_rate") >= 0.90))
    return out if schema_ok is None else out.withColumn("schema_ok", schema_ok)


@dataclass
class ValidationReport:
    checks: DataFrame
    summary: DataFrame
    snapshot: DataFrame
    alignment: DataFrame | None


def validate(df: DataFrame, ref: DataFrame | None = None, rules: TableRules | None = None, expectations: list[Expectation] | None = None) -> ValidationReport:
    """Suite, score, snapshot and, with a reference, distribution alignment."""
    checks = run_suite(df, choose_suite(expectations, rules, ref))
    sensitive = [c.name for c in rules.columns if c.sensitive] if rules else []
    return ValidationReport(checks, score_suite(checks), snapshot(df, sensitive), alignment(ref, df) if ref is not None else None)


def monitor_batches(batches: DataFrame, batch_col: str, suite: Sequence[Expectation]) -> DataFrame:
    """The whole suite per batch: rate, failed checks, alert flag.

    Checks of rows share one aggregate. A uniqueness check counts values within their batch first, so a value that many
    rows share is one row per task.
    """
    have = set(batches.columns) - {batch_col}
    aggs, verdicts = [F.count("*").alias("rows")], []
    for i, e in enumerate(suite):
        label = f"{e.kind} on {e.column or 'dataset-level'}"
        if e.kind == COLUMN_SET:
            ok = F.lit(have == set(e.kwargs["column_set"]) - {batch_col})
        elif e.kind == UNIQUE:
            n = F.coalesce(F.col(f"n{i}"), F.lit(0))
            ok = F.coalesce(F.try_divide(n - F.col(f"bad{i}"), n), F.lit(1.0)) >= e.mostly
        elif e.kind == ROW_COUNT:
            ok = (F.col("rows") >= (e.kwargs.get("min_value") or 0)) & (F.col("rows") <= (e.kwargs.get("max_value") or 2**62))
        elif e.kind == MEAN_BETWEEN:
            aggs.append(F.avg(e.column).alias(f"mean{i}"))
            ok = F.coalesce(F.col(f"mean{i}").between(e.kwargs["min_value"], e.kwargs["max_value"]), F.lit(False))
        else:
            aggs += [F.count(F.when(_unexpected(e, batches), 1)).alias(f"bad{i}"), F.count(F.col(e.column)).alias(f"n{i}")]
            n = F.col("rows") if e.kind == NOT_NULL else F.col(f"n{i}")
            ok = F.coalesce(F.try_divide(n - F.col(f"bad{i}"), n), F.lit(1.0)) >= e.mostly
        verdicts.append(F.when(~ok, F.lit(label)))
    failed = F.sort_array(F.array_compact(F.array(*verdicts)))
    rate = 1.0 - F.size("failed_checks") / F.lit(float(len(suite)))
    counted = batches.groupBy(batch_col).agg(*aggs)
    for i, e in enumerate(suite):
        if e.kind == UNIQUE:
            values = batches.where(F.col(e.column).isNotNull()).groupBy(batch_col, e.column).agg(F.count("*").alias("k"))
            found = values.groupBy(F.col(batch_col).alias("__batch")).agg(F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias(f"bad{i}"), F.sum("k").alias(f"n{i}"))
            counted = counted.join(found, F.col(batch_col).eqNullSafe(F.col("__batch")), "left").drop("__batch")
    return (
        counted.select(batch_col, "rows", failed.alias("failed_checks"))
        .withColumn("success_rate", rate)
        .withColumn("alert", ~((F.size("failed_checks") == 0) | (F.col("success_rate") >= 0.90)))
    )


def monitor_stream(stream: DataFrame, suite: Sequence[Expectation], sink: str, checkpoint: str):
    """Score each micro-batch with the suite and append one row per batch to ``sink``."""

    def score(batch: DataFrame, epoch: int) -> None:
        rows = score_suite(run_suite(batch, suite)).withColumn("batch_id", F.lit(epoch))
        rows.write.mode("overwrite").parquet(f"{sink}/batch={epoch}")

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- request rows -----------------------------------------------------------------------------------------

VERSION_PATTERN = r"^\d{8}_\d{6}$"
MAX_REQUEST_ID = 128


def check_requests(
    requests: DataFrame,
    features: str = "features",
    required: Sequence[str] = (),
    request_id: str | None = "request_id",
    version: str | None = "model_version",
    batch_size: str | None = None,
) -> DataFrame:
    """Add ``reject_reasons`` to request rows with a ``map<string,double>`` of features."""
    values = F.map_values(F.col(features))
    reasons = [
        F.when(F.col(features).isNull() | (F.size(features) == 0), "features_empty"),
        F.when((F.size(features) > 0) & F.forall(values, lambda v: v.isNull()), "features_all_null"),
        F.when(F.exists(values, lambda v: F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))), "feature_not_finite"),
    ]
    for name in required:
        reasons += [
            F.when(~F.coalesce(F.map_contains_key(features, F.lit(name)), F.lit(False)), f"missing:{name}"),
            F.when(F.map_contains_key(features, F.lit(name)) & F.col(features)[name].isNull(), f"null:{name}"),
        ]
    if version:
        reasons.append(F.when(F.col(version).isNotNull() & ~F.col(version).rlike(VERSION_PATTERN), "bad_version"))
    if request_id:
        reasons += [
            F.when(F.trim(F.col(request_id)) == "", "request_id_empty"),
            F.when(F.length(F.col(request_id)) > MAX_REQUEST_ID, "request_id_too_long"),
        ]
    if batch_size:
        reasons.append(F.when(~F.col(batch_size).between(1, 1000), "batch_size"))
    return requests.withColumn("reject_reasons", F.array_compact(F.array(*reasons)))


def split_requests(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.size("reject_reasons") == 0
    return checked.where(ok).drop("reject_reasons"), checked.where(~ok)


def rules_to_json(rules: TableRules) -> str:
    return json.dumps(asdict(rules), default=str)


def suite_frame(spark, suite: Sequence[Expectation]) -> DataFrame:
    rows = [(i, e.kind, e.column or "dataset-level", e.mostly, json.dumps(e.kwargs, default=str, sort_keys=True)) for i, e in enumerate(suite)]
    return local_frame(spark, rows, "position int, expectation_type string, column string, mostly double, kwargs string")
