"""Expectations, snapshots, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile, validate
from ..operators.validate import BETWEEN, IN_SET, MEAN_BETWEEN, NOT_NULL, OF_TYPE, ROW_COUNT, UNIQUE, ColumnRule, Expectation, TableRules
from .base import Tables, query, rounded
from .inputs import order_sides, order_sides_sql

# orders with missing and odd values put in by fixed rules
DIRTY = (
    "o_orderkey, CASE WHEN o_custkey % 25 = 0 THEN NULL ELSE o_custkey END AS o_custkey, "
    "CASE WHEN o_orderkey % 40 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, "
    "CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 23 = 0 THEN -o_totalprice ELSE o_totalprice END AS o_totalprice, "
    "o_orderdate, o_orderpriority, CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR(20)) END AS code"
)
DIRTY_SQL = f"d AS (SELECT {DIRTY} FROM orders)"


def dirty(t: Tables):
    t.orders.createOrReplaceTempView("lg_orders")
    return t.spark.sql(f"SELECT {DIRTY} FROM lg_orders")


def checks(df, *suite):
    out = validate.run_suite(df, list(suite))
    return rounded(out.select("expectation_type", "column", "success", "observed", "unexpected_count", "element_count"))


def check_sql(kind: str, column: str, observed: str, bad: str, n: str, success: str, where: str = "d") -> str:
    return (
        f"SELECT '{kind}' AS expectation_type, '{column}' AS column, {success} AS success, round({observed}, 6) AS observed, "
        f"({bad})::BIGINT AS unexpected_count, ({n})::BIGINT AS element_count FROM {where}"
    )


def share_sql(kind: str, column: str, bad: str, n: str, mostly: float) -> str:
    observed = f"(({n}) - ({bad})) / ({n})"
    return check_sql(kind, column, observed, bad, n, f"{observed} >= {mostly}")


@query("expect_row_count", f"WITH {DIRTY_SQL} SELECT 'row_count_between' AS expectation_type, 'dataset-level' AS column, count(*) BETWEEN 100 AND 10000000 AS success, count(*)::DOUBLE AS observed, NULL::BIGINT AS unexpected_count, count(*) AS element_count FROM d")
def expect_row_count(t: Tables):
    return checks(dirty(t), Expectation(ROW_COUNT, kwargs={"min_value": 100, "max_value": 10_000_000}))


@query("expect_column_set", "SELECT 'columns_match_set' AS expectation_type, 'dataset-level' AS column, false AS success, count(*)::DOUBLE AS observed, 2::BIGINT AS unexpected_count, count(*) AS element_count FROM (DESCRIBE SELECT * FROM orders)")
def expect_column_set(t: Tables):
    names = [c for c in t.orders.columns if c != "o_orderdate"] + ["o_clerk"]
    return checks(t.orders, Expectation(validate.COLUMN_SET, kwargs={"column_set": names}))


@query("expect_not_null", f"WITH {DIRTY_SQL} " + share_sql("values_not_null", "o_totalprice", "count(*) - count(o_totalprice)", "count(*)", 0.95) + " UNION ALL " + share_sql("values_not_null", "o_custkey", "count(*) - count(o_custkey)", "count(*)", 0.95))
def expect_not_null(t: Tables):
    return checks(dirty(t), Expectation(NOT_NULL, "o_totalprice", 0.95), Expectation(NOT_NULL, "o_custkey", 0.95))


@query(
    "expect_type",
    f"WITH {DIRTY_SQL} "
    + share_sql("values_of_type", "o_totalprice", "0", "count(o_totalprice)", 1)
    + " UNION ALL "
    + share_sql("values_of_type", "code", "count(*) FILTER (try_cast(code AS BIGINT) IS NULL AND code IS NOT NULL)", "count(code)", 1),
)
def expect_type(t: Tables):
    return checks(dirty(t), Expectation(OF_TYPE, "o_totalprice", kwargs={"type": "float64"}), Expectation(OF_TYPE, "code", kwargs={"type": "int64"}))


@query("expect_in_set", f"WITH {DIRTY_SQL} " + share_sql("values_in_set", "o_orderstatus", "count(*) FILTER (o_orderstatus NOT IN ('F', 'O', 'P'))", "count(o_orderstatus)", 0.9))
def expect_in_set(t: Tables):
    return checks(dirty(t), Expectation(IN_SET, "o_orderstatus", 0.9, {"value_set": ["F", "O", "P"]}))


@query("expect_between", f"WITH {DIRTY_SQL} " + share_sql("values_between", "o_totalprice", "count(*) FILTER (o_totalprice NOT BETWEEN 0 AND 450000)", "count(o_totalprice)", 0.95))
def expect_between(t: Tables):
    return checks(dirty(t), Expectation(BETWEEN, "o_totalprice", 0.95, {"min_value": 0, "max_value": 450000}))


@query("expect_datetime_between", f"WITH {DIRTY_SQL} " + share_sql("values_between", "o_orderdate", "count(*) FILTER (o_orderdate NOT BETWEEN timestamp '1995-02-01' AND timestamp '2001-06-30')", "count(o_orderdate)", 0.95))
def expect_datetime_between(t: Tables):
    return checks(dirty(t), Expectation(BETWEEN, "o_orderdate", 0.95, {"min_value": "1995-02-01 00:00:00", "max_value": "2001-06-30 00:00:00"}))


@query("expect_mean_between", f"WITH {DIRTY_SQL} SELECT 'mean_between' AS expectation_type, 'o_totalprice' AS column, avg(o_totalprice) BETWEEN 100000 AND 300000 AS success, round(avg(o_totalprice), 4) AS observed, NULL::BIGINT AS unexpected_count, count(o_totalprice) AS element_count FROM d")
def expect_mean_between(t: Tables):
    out = checks(dirty(t), Expectation(MEAN_BETWEEN, "o_totalprice", kwargs={"min_value": 100000, "max_value": 300000}))
    return out.withColumn("observed", F.round("observed", 4))


def unique_sql(col: str) -> str:
    return (
        f"(SELECT 'values_unique' AS expectation_type, '{col}' AS column, sum(CASE WHEN c > 1 THEN c ELSE 0 END) = 0 AS success, "
        f"round((sum(c) - sum(CASE WHEN c > 1 THEN c ELSE 0 END)) / sum(c), 6) AS observed, sum(CASE WHEN c > 1 THEN c ELSE 0 END)::BIGINT AS unexpected_count, "
        f"sum(c)::BIGINT AS element_count FROM (SELECT count(*) AS c FROM d WHERE {col} IS NOT NULL GROUP BY {col}))"
    )


@query("expect_unique", f"WITH {DIRTY_SQL} {unique_sql('o_orderkey')} UNION ALL {unique_sql('o_custkey')}")
def expect_unique(t: Tables):
    return checks(dirty(t), Expectation(UNIQUE, "o_orderkey"), Expectation(UNIQUE, "o_custkey"))


RULES = TableRules(
    (
        ColumnRule("o_orderkey", "int64", nullable=False, unique=True),
        ColumnRule("o_custkey", "int64", null_budget=0.05),
        ColumnRule("o_orderstatus", "object", allowed_values=("F", "O", "P", "X")),
        ColumnRule("o_totalprice", "float64", min_value=0, max_value=600000),
        ColumnRule("o_clerk", "object"),
    ),
    min_rows=50_000,
)


@query("schema_checks", f"WITH {DIRTY_SQL} SELECT count(*) AS rows, count(*) < 50000 AS too_few_rows, 'o_clerk' AS missing_columns, false AS schema_ok FROM d")
def schema_checks(t: Tables):
    out = validate.schema_errors(dirty(t), RULES)
    return out.withColumn("missing_columns", F.concat_ws(",", "missing_columns"))


RULE_TYPED = {
    "o_orderkey": ("0", "count(o_orderkey)"),
    "o_custkey": ("0", "count(o_custkey)"),
    "o_orderstatus": ("0", "count(o_orderstatus)"),
    "o_totalprice": ("0", "count(o_totalprice)"),
}


def rules_sql() -> str:
    parts = [
        "SELECT 'row_count_between' AS expectation_type, 'dataset-level' AS column, count(*) >= 50000 AS success, round(count(*), 6)::DOUBLE AS observed, NULL::BIGINT AS unexpected_count, count(*) AS element_count FROM d",
        "SELECT 'columns_match_set', 'dataset-level', false, 7.0, 4, 7 FROM (SELECT 1)",
        share_sql("values_not_null", "o_orderkey", "count(*) - count(o_orderkey)", "count(*)", 1),
        share_sql("values_not_null", "o_custkey", "count(*) - count(o_custkey)", "count(*)", 0.95),
        share_sql("values_not_null", "o_orderstatus", "count(*) - count(o_orderstatus)", "count(*)", 0.95),
        share_sql("values_not_null", "o_totalprice", "count(*) - count(o_totalprice)", "count(*)", 0.95),
        *[share_sql("values_of_type", c, bad, n, 1) for c, (bad, n) in RULE_TYPED.items()],
        share_sql("values_in_set", "o_orderstatus", "0", "count(o_orderstatus)", 1),
        share_sql("values_between", "o_totalprice", "count(*) FILTER (o_totalprice NOT BETWEEN 0 AND 600000)", "count(o_totalprice)", 1),
        unique_sql("o_orderkey"),
        "SELECT 'values_not_null', 'o_clerk', false, NULL, NULL, NULL FROM (SELECT 1)",
        "SELECT 'values_of_type', 'o_clerk', false, NULL, NULL, NULL FROM (SELECT 1)",
    ]
    return " UNION ALL ".join(parts)


@query("suite_from_rules", f"WITH {DIRTY_SQL} {rules_sql()}")
def suite_from_rules(t: Tables):
    return checks(dirty(t), *validate.suite_from_rules(RULES))


@query(
    "suite_score",
    f"WITH {DIRTY_SQL}, c AS ({rules_sql()}) SELECT count(*) AS evaluated_expectations, count(*) FILTER (success) AS successful_expectations, "
    "count(*) FILTER (NOT success) AS unsuccessful_expectations, round((count(*) FILTER (success)) / count(*), 6) AS success_rate, "
    "string_agg(CASE WHEN NOT success THEN expectation_type || ' on ' || \"column\" END, ',' ORDER BY expectation_type || ' on ' || \"column\") AS failed_checks, "
    "(count(*) FILTER (success)) / count(*) >= 0.9 AS is_valid FROM c",
)
def suite_score(t: Tables):
    out = validate.score_suite(validate.run_suite(dirty(t), validate.suite_from_rules(RULES)))
    return rounded(out.withColumn("failed_checks", F.concat_ws(",", "failed_checks")))


PROFILED = "o_custkey, o_totalprice, o_orderstatus, o_orderdate"


@query(
    "profile_reference_suite",
    f"""WITH {order_sides_sql(PROFILED)},
    p AS (SELECT count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s, avg(o_custkey) AS mc, stddev_samp(o_custkey) AS sc FROM ref)
    SELECT expectation_type, "column", mostly::DOUBLE AS mostly, lo, hi, value_set FROM (
      SELECT 'row_count_between' AS expectation_type, 'dataset-level' AS column, 1.0 AS mostly, round(greatest(1, floor(n * 0.5)), 2) AS lo, round(floor(n * 2.0), 2) AS hi, NULL AS value_set FROM p
      UNION ALL SELECT 'columns_match_set', 'dataset-level', 1.0, NULL, NULL, NULL FROM p
      UNION ALL SELECT 'values_not_null', unnest(['o_custkey', 'o_totalprice', 'o_orderstatus', 'o_orderdate']), 0.9, NULL, NULL, NULL FROM p
      UNION ALL SELECT unnest(['values_between', 'mean_between']), 'o_totalprice', unnest([0.95, 1.0]), round(m - 3 * s, 2), round(m + 3 * s, 2), NULL FROM p
      UNION ALL SELECT unnest(['values_between', 'mean_between']), 'o_custkey', unnest([0.95, 1.0]), round(mc - 3 * sc, 2), round(mc + 3 * sc, 2), NULL FROM p
      UNION ALL SELECT 'values_between', 'o_orderdate', 0.95, NULL, NULL, NULL FROM p
      UNION ALL SELECT 'values_in_set', 'o_orderstatus', 0.9, NULL, NULL,
        (SELECT string_agg('"' || v || '"', ', ' ORDER BY c DESC, v) FROM (SELECT o_orderstatus AS v, count(*) AS c FROM ref GROUP BY 1)) FROM p)""",
)
def profile_reference_suite(t: Tables):
    ref, _ = order_sides(t, PROFILED)
    frame = validate.suite_frame(t.spark, validate.suite_from_profile(ref))
    number = F.round(F.get_json_object("kwargs", "$.min_value").try_cast("double"), 2)
    upper = F.round(F.get_json_object("kwargs", "$.max_value").try_cast("double"), 2)
    values = F.regexp_extract("kwargs", r'"value_set": \[(.*)\]', 1)
    return frame.select("expectation_type", "column", "mostly", number.alias("lo"), upper.alias("hi"), F.when(values != "", values).alias("value_set"))


@query(
    "validate_against_reference",
    f"""WITH {order_sides_sql("o_totalprice, o_orderstatus")}, p AS (SELECT count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM ref),
    c AS (SELECT count(*) AS n, avg(o_totalprice) AS m, count(*) FILTER (o_totalprice NOT BETWEEN round((SELECT m - 3 * s FROM p), 4) AND round((SELECT m + 3 * s FROM p), 4)) AS bad FROM prod),
    k AS (SELECT unnest([c.n BETWEEN floor(p.n * 0.5) AND floor(p.n * 2.0), true, true, (c.n - c.bad) / c.n >= 0.95, abs(c.m - p.m) <= 3 * p.s, true, true]) AS ok FROM c, p)
    SELECT count(*) AS evaluated_expectations, count(*) FILTER (ok) AS successful_expectations, round((count(*) FILTER (ok)) / count(*), 6) AS success_rate,
      (count(*) FILTER (ok)) / count(*) >= 0.9 AS is_valid FROM k""",
)
def validate_against_reference(t: Tables):
    ref, prod = order_sides(t, "o_totalprice, o_orderstatus")
    out = validate.score_suite(validate.run_suite(prod, validate.choose_suite(ref=ref)))
    return rounded(out.select("evaluated_expectations", "successful_expectations", "success_rate", "is_valid"))


@query(
    "quality_monitor_batches",
    f"""WITH {DIRTY_SQL}, b AS (SELECT year(o_orderdate) AS batch, count(*) AS rows,
      (count(o_totalprice) / count(*)) >= 0.95 AS k1, (count(o_totalprice) - count(*) FILTER (o_totalprice < 0)) / count(o_totalprice) >= 0.96 AS k2,
      avg(o_totalprice) BETWEEN 210000 AND 230000 AS k3, count(*) >= 2000 AS k4 FROM d GROUP BY 1)
    SELECT batch, rows, concat_ws(',', CASE WHEN NOT k3 THEN 'mean_between on o_totalprice' END, CASE WHEN NOT k4 THEN 'row_count_between on dataset-level' END,
       CASE WHEN NOT k2 THEN 'values_between on o_totalprice' END, CASE WHEN NOT k1 THEN 'values_not_null on o_totalprice' END) AS failed_checks,
       round((k1::INT + k2::INT + k3::INT + k4::INT) / 4.0, 6) AS success_rate, (k1::INT + k2::INT + k3::INT + k4::INT) / 4.0 < 0.9 AS alert FROM b""",
)
def quality_monitor_batches(t: Tables):
    suite = [
        Expectation(NOT_NULL, "o_totalprice", 0.95),
        Expectation(BETWEEN, "o_totalprice", 0.96, {"min_value": 0}),
        Expectation(MEAN_BETWEEN, "o_totalprice", kwargs={"min_value": 210000, "max_value": 230000}),
        Expectation(ROW_COUNT, kwargs={"min_value": 2000}),
    ]
    out = validate.monitor_batches(dirty(t).withColumn("batch", F.year("o_orderdate").cast("long")), "batch", suite)
    return rounded(out.withColumn("failed_checks", F.concat_ws(",", "failed_checks")))


REQUEST_SQL = """req AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN '  ' ELSE event_id::VARCHAR END AS request_id,
  CASE WHEN user_id < 20 THEN 'latest' WHEN user_id < 75 THEN '20240115_120000' END AS model_version,
  CASE WHEN event_type = 'view' THEN NULL ELSE value END AS v, event_type = 'error' AS broken, event_type = 'click' AS no_k,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""


@query(
    "request_validation",
    f"""WITH {REQUEST_SQL}, r AS (SELECT event_id, concat_ws(',', CASE WHEN broken THEN 'feature_not_finite' END, CASE WHEN no_k THEN 'missing:k' END,
       CASE WHEN v IS NULL THEN 'null:value' END, CASE WHEN model_version = 'latest' THEN 'bad_version' END, CASE WHEN trim(request_id) = '' THEN 'request_id_empty' END) AS reasons FROM req)
    SELECT reasons, count(*) AS n FROM r GROUP BY 1""",
)
def request_validation(t: Tables):
    e = t.events
    v = F.when(F.col("event_type") == "error", F.lit(float("inf"))).when(F.col("event_type") != "view", F.col("value"))
    k = F.get_json_object("props", "$.k").cast("double")
    requests = e.select(
        F.when(F.col("event_type") == "signup", "  ").otherwise(F.col("event_id").cast("string")).alias("request_id"),
        F.when(F.col("user_id") < 20, "latest").when(F.col("user_id") < 75, "20240115_120000").alias("model_version"),
        F.when(F.col("event_type") == "click", F.create_map(F.lit("value"), v)).otherwise(F.create_map(F.lit("value"), v, F.lit("k"), k)).alias("features"),
    )
    out = validate.check_requests(requests, required=["k", "value"])
    reasons = F.concat_ws(",", "reject_reasons").alias("reasons")
    return out.groupBy(reasons).agg(F.count("*").alias("n"))


SNAP = ["o_orderkey", "o_custkey", "o_totalprice"]


def snap_sql(col: str, dtype: str) -> str:
    return (
        f"SELECT '{col}' AS column, '{dtype}' AS dtype, count(*) - count({col}) AS null_count, round((count(*) - count({col})) / count(*) * 100, 4) AS null_pct, "
        f"count(DISTINCT {col}) AS \"unique\" FROM d"
    )


@query("column_snapshot", f"WITH {DIRTY_SQL} " + " UNION ALL ".join(snap_sql(c, k) for c, k in [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string"), ("code", "string")]))
def column_snapshot(t: Tables):
    out = profile.snapshot(dirty(t)).select("column", F.regexp_replace("dtype", r"varchar\(\d+\)", "string").alias("dtype"), "null_count", "null_pct", "unique")
    return rounded(out, 4)


@query(
    "numeric_describe",
    f"WITH {DIRTY_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c})::DOUBLE AS min, round(quantile_cont({c}::DOUBLE, 0.25), 4) AS p25, "
        f"round(quantile_cont({c}::DOUBLE, 0.5), 4) AS median, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS p75, max({c})::DOUBLE AS max FROM d"
        for c in SNAP
    ),
)
def numeric_describe(t: Tables):
    out = profile.snapshot(dirty(t).select(*SNAP))
    return rounded(out.select("column", "mean", "std", "min", "p25", "median", "p75", "max"), 4)


@query(
    "top_values",
    f"""WITH {DIRTY_SQL}, l AS (SELECT 'o_orderstatus' AS column, o_orderstatus AS value FROM d UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM d UNION ALL SELECT 'code', code FROM d)
    SELECT "column", value, count, rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY count DESC, value) AS rank
      FROM (SELECT "column", value, count(*) AS count FROM l WHERE value IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5""",
)
def top_values(t: Tables):
    out = profile.top5(dirty(t).select("o_orderstatus", "o_orderpriority", "code", "o_totalprice"))
    return out.withColumn("rank", F.col("rank").cast("long"))


@query(
    "sensitive_snapshot",
    f"WITH {DIRTY_SQL} SELECT 'o_custkey' AS column, count(*) - count(o_custkey) AS null_count, count(DISTINCT o_custkey) AS \"unique\", NULL::DOUBLE AS mean FROM d "
    "UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice), count(DISTINCT o_totalprice), round(avg(o_totalprice), 4) FROM d",
)
def sensitive_snapshot(t: Tables):
    out = profile.snapshot(dirty(t).select("o_custkey", "o_totalprice"), sensitive=["o_custkey"])
    return rounded(out.select("column", "null_count", "unique", "mean"), 4)


HASH_TEXT = " || ".join(f"coalesce(length({c}) || ':' || {c}, '~')" for c in ("k", "c", "s", "p", "d", "o"))


@query(
    "content_hash",
    "WITH r AS (SELECT o_orderkey::VARCHAR AS k, o_custkey::VARCHAR AS c, o_orderstatus AS s, o_totalprice::DECIMAL(18, 2)::VARCHAR AS p, o_orderdate::VARCHAR AS d, o_orderpriority AS o FROM orders), "
    f"h AS (SELECT md5({HASH_TEXT}) AS h FROM r), q AS (SELECT count(*) AS n, " + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT) AS q{i}" for i in range(4)) + " FROM h) "
    "SELECT n, substr(sha256(concat_ws('|', n, q0, q1, q2, q3)), 1, 16) AS data_hash FROM q",
)
def content_hash(t: Tables):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    return profile.content_hash(t.orders.select(*names).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)")))


MIXED = "c_name, c_nationkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, c_mktsegment, CASE WHEN c_nationkey < 12 THEN 'low' ELSE 'high' END AS half, CAST(c_nationkey AS VARCHAR(9)) AS nation_text, c_acctbal * c_acctbal * c_acctbal * c_acctbal * c_acctbal * c_acctbal * c_acctbal * c_acctbal * c_acctbal * c_acctbal AS tail"
MIXED_SQL = f"m AS (SELECT {MIXED} FROM customer)"


def mixed(t: Tables):
    t.customer.createOrReplaceTempView("lg_customer")
    return t.spark.sql(f"SELECT {MIXED} FROM lg_customer")


def skew_sql(c: str) -> str:
    return f"(avg(({c} - a_{c}) ** 3) / avg(({c} - a_{c}) ** 2) ** 1.5)"


@query(
    "auto_column_config",
    f"""WITH {MIXED_SQL}, a AS (SELECT *, avg(c_nationkey) OVER () AS a_c_nationkey, avg(c_acctbal) OVER () AS a_c_acctbal, avg(tail) OVER () AS a_tail FROM m),
    n AS (SELECT unnest(['c_nationkey', 'c_acctbal', 'tail']) AS column, unnest([1 - count(c_nationkey) / count(*), 1 - count(c_acctbal) / count(*), 1 - count(tail) / count(*)]) AS nulls,
       unnest([{skew_sql('c_nationkey')}, {skew_sql('c_acctbal')}, {skew_sql('tail')}]) AS skew, unnest([min(c_nationkey)::DOUBLE, min(c_acctbal), min(tail)]) AS low FROM a),
    s AS (SELECT count(*) AS rows, count(DISTINCT c_name) AS k1, count(DISTINCT c_mktsegment) AS k2, count(DISTINCT half) AS k3, count(DISTINCT nation_text) AS k4 FROM m),
    c AS (SELECT unnest(['c_name', 'c_mktsegment', 'half', 'nation_text']) AS column, unnest([k1, k2, k3, k4]) AS k, rows FROM s)
    SELECT "column", false AS is_id, CASE WHEN nulls > 0.2 THEN 'knn' ELSE 'median' END AS imputation, CASE WHEN abs(skew) > 2 AND low >= 0 THEN 'log' ELSE 'clip' END AS outlier,
       CASE WHEN abs(skew) > 2 AND low >= 0 THEN 'standard' ELSE 'robust' END AS scaling, 'none' AS encoding, CASE WHEN low >= 0 THEN 0.0 END::DOUBLE AS min_value FROM n
    UNION ALL SELECT "column", k = rows AND k > 100, CASE WHEN k = rows AND k > 100 THEN 'median' ELSE 'mode' END, CASE WHEN k = rows AND k > 100 THEN 'clip' ELSE 'none' END,
       CASE WHEN k = rows AND k > 100 THEN 'robust' ELSE 'none' END,
       CASE WHEN k = rows AND k > 100 THEN 'none' WHEN k <= 2 THEN 'ordinal' WHEN k <= 10 THEN 'onehot' ELSE 'frequency' END, NULL FROM c""",
)
def auto_column_config(t: Tables):
    return profile.config_frame(t.spark, profile.auto_config(mixed(t)))


@query(
    "column_routing",
    f"""WITH {MIXED_SQL}, s AS (SELECT count(*) AS rows, count(DISTINCT c_mktsegment) AS k2, count(DISTINCT half) AS k3, count(DISTINCT nation_text) AS k4, 1 - count(c_acctbal) / count(*) AS nulls FROM m)
    SELECT 'c_name' AS column, 'dropped' AS route FROM s UNION ALL SELECT 'c_nationkey', 'numeric' FROM s UNION ALL SELECT 'tail', 'numeric' FROM s
    UNION ALL SELECT 'c_acctbal', CASE WHEN nulls > 0.2 THEN 'knn' ELSE 'numeric' END FROM s
    UNION ALL SELECT unnest(['c_mktsegment', 'half', 'nation_text']), unnest([CASE WHEN k <= 2 THEN 'ordinal' WHEN k <= 10 THEN 'onehot' ELSE 'frequency' END FOR k IN [k2, k3, k4]]) FROM s""",
)
def column_routing(t: Tables):
    from ..functions.frames import local_frame

    df = mixed(t)
    routes = profile.route_columns(df, profile.auto_config(df))
    return local_frame(t.spark, [(c, r) for r, cols in routes.items() for c in cols], "column string, route string")


@query(
    "slice_column_choice",
    """WITH k AS (SELECT count(DISTINCT l_linenumber) AS a, count(DISTINCT l_quantity) AS b, count(DISTINCT l_returnflag) AS c, count(DISTINCT l_linestatus) AS d, count(DISTINCT l_tax) AS e FROM lineitem)
    SELECT "column" FROM (SELECT unnest(['l_linenumber', 'l_quantity', 'l_returnflag', 'l_linestatus', 'l_tax']) AS column, unnest([a, b, c, d, e]) AS n, unnest(range(5)) AS i FROM k)
    WHERE n BETWEEN 2 AND 10 ORDER BY i LIMIT 3""",
)
def slice_column_choice(t: Tables):
    from ..functions.frames import local_frame

    names = profile.slice_columns(t.lineitem, ["l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_tax"])
    return local_frame(t.spark, [(c,) for c in names], "column string")


@query(
    "processing_audit",
    "SELECT 'dedup' AS step, (SELECT count(*) FROM lineitem) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)) AS rows_out, "
    "4::BIGINT AS columns_in, 4::BIGINT AS columns_out, '' AS dropped_columns, 'rows_removed' AS warnings FROM (SELECT 1)",
)
def processing_audit(t: Tables):
    before = t.lineitem.select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    out = profile.processing_audit(before, before.distinct(), "dedup")
    return out.select("step", "rows_in", "rows_out", "columns_in", "columns_out", F.concat_ws(",", "dropped_columns").alias("dropped_columns"), F.concat_ws(",", "warnings").alias("warnings"))
