"""Sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor
from ..session import scratch_path
from ..sources import tables, versions
from ..streaming import stateful, streams
from .base import ORACLES, Tables, query, rounded
from .monitor_queries import BREAKER_SQL, BUCKET_SQL, FEED_SQL, HOUR_SQL, INTERP_SQL, MATCH_SQL, PRED_SQL, RATE_SQL, hourly, is_error

TOTALS_SQL = "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


def totals(df):
    return rounded(df.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.sum("o_custkey").cast("long").alias("keys"), F.sum("o_totalprice").alias("total")), 2)


def round_trip(t: Tables, name: str, **options):
    path = scratch_path(t.spark, "orders") + name
    tables.write(t.orders.drop("o_orderdate"), path)
    return totals(tables.read(t.spark, {"source": path, "options": options}))


query("csv_round_trip", TOTALS_SQL)(lambda t: round_trip(t, ".csv"))
query("tsv_round_trip", TOTALS_SQL)(lambda t: round_trip(t, ".tsv"))
query("json_round_trip", TOTALS_SQL)(lambda t: round_trip(t, ".jsonl"))
query("orc_round_trip", TOTALS_SQL)(lambda t: round_trip(t, ".orc"))
query("parquet_round_trip", TOTALS_SQL)(lambda t: round_trip(t, ".parquet"))


@query("read_by_inferred_format", TOTALS_SQL)
def read_by_inferred_format(t: Tables):
    return totals(tables.read(t.spark, f"{t.folder}/orders.parquet"))


@query("read_in_splits", f"SELECT *, true AS in_splits, true AS setting_unchanged FROM ({TOTALS_SQL})")
def read_in_splits(t: Tables):
    before = t.spark.conf.get("spark.sql.files.maxPartitionBytes")
    rows = tables.read_in_splits(t.spark, f"{t.folder}/orders.parquet", 1 << 16)
    whole = t.orders.rdd.getNumPartitions()
    unchanged = t.spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    return totals(rows).withColumn("in_splits", F.lit(rows.rdd.getNumPartitions() > whole)).withColumn("setting_unchanged", F.lit(unchanged))


@query("versioned_snapshot", "SELECT true AS first_write, false AS second_write, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders")
def versioned_snapshot(t: Tables):
    root = scratch_path(t.spark, "versions")
    late = t.orders.where("o_orderdate >= timestamp '1998-07-01'")
    first, second = versions.save_version(t.orders, root, "20240101_000000"), versions.save_version(late, root, "20240101_000000")
    out = versions.read_version(t.spark, root, "20240101_000000").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return rounded(out.select(F.lit(first).alias("first_write"), F.lit(second).alias("second_write"), "n", "total"), 2)


@query(
    "reference_shift",
    "SELECT 'initial' AS origin, count(*) AS n, 0 AS step FROM orders WHERE o_orderdate < timestamp '1998-07-01' UNION ALL SELECT 'previous_cycle', count(*), 1 FROM orders WHERE o_orderdate >= timestamp '1998-07-01' "
    "UNION ALL SELECT 'configured', count(*), 2 FROM orders",
)
def reference_shift(t: Tables):
    root = scratch_path(t.spark, "reference")
    early, late = t.orders.where("o_orderdate < timestamp '1998-07-01'"), t.orders.where("o_orderdate >= timestamp '1998-07-01'")
    first, a = versions.load_reference(t.spark, root, fallback=lambda: early)
    versions.shift_reference(early, root, "20240101_000000", "2024-01-01T00:00:00")
    versions.shift_reference(late, root, "20240201_000000", "2024-02-01T00:00:00")
    second, b = versions.load_reference(t.spark, root, fallback=lambda: early)
    third, c = versions.load_reference(t.spark, root, configured=t.orders)
    out = None
    for i, (df, origin) in enumerate(((first, a), (second, b), (third, c))):
        part = df.agg(F.count("*").alias("n")).select(F.lit(origin).alias("origin"), "n", F.lit(i).alias("step"))
        out = part if out is None else out.unionAll(part)
    return out


# ---- streams ----------------------------------------------------------------------------------------------


def event_stream(t: Tables):
    schema = t.spark.read.parquet(f"{t.folder}/events.parquet").schema
    return streams.read_stream(t.spark, t.folder, schema, pattern="events.parquet")


def prediction_stream(t: Tables):
    return event_stream(t).select(
        F.col("event_id").cast("string").alias("request_id"),
        F.when(F.col("value") > 40, 1).otherwise(0).alias("prediction"),
        F.concat(F.lit("v"), F.col("user_id") % 3).alias("model_version"),
        F.col("ts").alias("timestamp"),
    )


def feedback_stream(t: Tables):
    e = event_stream(t).where("event_type <> 'signup'")
    key = F.col("event_id").cast("string")
    hours = F.when(F.col("user_id") % 10 == 0, F.expr("INTERVAL 200 HOURS")).otherwise(F.expr("INTERVAL 30 HOURS"))
    return e.select(
        F.when(is_error(), F.concat(F.lit("x"), key)).otherwise(key).alias("request_id"),
        F.when(F.col("value") + F.col("user_id") * 0.2 > 55, 1).otherwise(0).alias("ground_truth"),
        (F.col("ts") + hours).alias("feedback_at"),
    )


@query("stream_record_predictions", f"WITH {PRED_SQL} SELECT model_version, count(*) AS n, sum(prediction)::BIGINT AS positives FROM pred GROUP BY 1")
def stream_record_predictions(t: Tables):
    return streams.drain(prediction_stream(t), "predictions").groupBy("model_version").agg(F.count("*").alias("n"), F.sum("prediction").alias("positives"))


@query("stream_match_feedback", f"WITH {MATCH_SQL} SELECT model_version, prediction, ground_truth, count(*) AS n FROM matched WHERE status = 'matched' GROUP BY ALL")
def stream_match_feedback(t: Tables):
    out = streams.drain(streams.match_stream(prediction_stream(t), feedback_stream(t)), "matched")
    return out.where("status = 'matched'").groupBy("model_version", "prediction", "ground_truth").agg(F.count("*").alias("n"))


@query(
    "stream_error_rate",
    "WITH w AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS ws, 'm' || (user_id % 2) AS model, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL) "
    "SELECT epoch(ws)::BIGINT AS window_start, model, requests, errors FROM w WHERE ws + INTERVAL '5 minutes' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)",
)
def stream_error_rate(t: Tables):
    log = event_stream(t).withColumn("model", F.concat(F.lit("m"), F.col("user_id") % 2))
    out = streams.drain(streams.error_rate_stream(log, ["model"], "ts", is_error()), "errors")
    return out.select(F.unix_seconds("window_start").alias("window_start"), "model", "requests", "errors")


CELLS_SQL = f"""{PRED_SQL}, c AS (SELECT ws, model_version, CASE WHEN prediction = 1 AND model_version <> 'v1' THEN 1 WHEN model_version = 'v2' THEN 0 END AS y, prediction AS p
  FROM pred, LATERAL (SELECT unnest(generate_series(floor(epoch("timestamp") / 21600)::BIGINT * 21600 - 64800, floor(epoch("timestamp") / 21600)::BIGINT * 21600, 21600)) AS ws)),
  m AS (SELECT ws AS window_start, model_version, count(*) AS sample_count, count(y) AS labeled_count, round(avg((y = p)::INT), 6) AS accuracy FROM c GROUP BY ALL HAVING count(y) >= 30)"""


@query("stream_window_metrics", f"WITH {CELLS_SQL} SELECT * FROM m WHERE window_start + 86400 <= (SELECT epoch(max(ts)) - 3600 FROM events)")
def stream_window_metrics(t: Tables):
    label = F.when((F.col("prediction") == 1) & (F.col("model_version") != "v1"), 1).when(F.col("model_version") == "v2", 0)
    cells = streams.drain(streams.window_cells(prediction_stream(t).withColumn("ground_truth", label)), "cells")
    out = monitor.metrics_from_cells(cells, ["window_start", "model_version"])
    return rounded(out.select("window_start", "model_version", "sample_count", "labeled_count", "accuracy"))


@query("stream_counters", "SELECT 'm' || (user_id % 5) AS model_id, event_type AS status, count(*) AS total FROM events GROUP BY ALL")
def stream_counters(t: Tables):
    e = event_stream(t).select(F.concat(F.lit("m"), F.col("user_id") % 5).alias("model_id"), F.col("event_type").alias("status"))
    path = scratch_path(t.spark, "counters")
    streams.counter_stream(e, ["model_id", "status"], f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return streams.read_counters(t.spark, f"{path}/rows", ["model_id", "status"])


@query("stream_gauges", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, floor(epoch(max(ts)))::BIGINT AS updated_at FROM events GROUP BY ALL")
def stream_gauges(t: Tables):
    path = scratch_path(t.spark, "gauges")
    streams.gauge_stream(event_stream(t), ["user_id", "event_type"], "value", "ts", "event_id", f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return streams.read_gauges(t.spark, f"{path}/rows", ["user_id", "event_type"], "ts").withColumn("updated_at", F.unix_seconds("updated_at"))


@query("stream_histograms", ORACLES["event_histograms"])
def stream_histograms(t: Tables):
    path = scratch_path(t.spark, "histograms")
    streams.histogram_stream(event_stream(t), ["event_type"], "value", f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return rounded(streams.read_histograms(t.spark, f"{path}/rows", ["event_type"]), 2)


@query("stream_newest", f"WITH {PRED_SQL} SELECT request_id, model_version FROM pred ORDER BY \"timestamp\" DESC, request_id DESC LIMIT 5000")
def stream_newest(t: Tables):
    path = scratch_path(t.spark, "newest")
    streams.newest_stream(prediction_stream(t), 5000, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return streams.read_newest(t.spark, f"{path}/rows").select("request_id", "model_version")


ALERT_CELLS_SQL = f"""{PRED_SQL}, c AS (SELECT ws, model_version, CASE WHEN prediction = 1 AND model_version <> 'v1' THEN 1 ELSE 0 END AS y, prediction AS p
  FROM pred, LATERAL (SELECT unnest(generate_series(floor(epoch("timestamp") / 21600)::BIGINT * 21600 - 64800, floor(epoch("timestamp") / 21600)::BIGINT * 21600, 21600)) AS ws)),
  k AS (SELECT ws AS window_start, model_version, count(DISTINCT y) AS k, sum(y * p) AS tp, sum(p) AS pp, sum(y) AS pos, count(*) AS n, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (p = 0) AS pn FROM c GROUP BY ALL HAVING count(*) >= 30),
  s AS (SELECT window_start, model_version, CASE WHEN k = 2 THEN coalesce(2 * tp / nullif(pp + pos, 0), 0)
    ELSE (coalesce(2 * tp / nullif(pp + pos, 0), 0) * pos + coalesce(2 * tn / nullif(pn + n - pos, 0), 0) * (n - pos)) / n END AS f1 FROM k WHERE window_start + 86400 <= (SELECT epoch(max(ts)) - 3600 FROM events)),
  d AS (SELECT *, (0.95 - f1) / 0.95 AS change FROM s)"""


@query(
    "stream_alerts",
    f"WITH {ALERT_CELLS_SQL} SELECT model_id, severity, channel, count(*) AS n, round(max(change), 6)::DOUBLE AS worst FROM (SELECT model_version AS model_id, change, CASE WHEN change > 0.15 THEN 'critical' ELSE 'warning' END AS severity, "
    "unnest(CASE WHEN change > 0.15 THEN ['annotation', 'chat', 'page', 'retrain_trigger'] ELSE ['annotation', 'chat'] END) AS channel FROM d WHERE change > 0.05) GROUP BY ALL",
)
def stream_alerts(t: Tables):
    path = scratch_path(t.spark, "alerts")
    label = F.when((F.col("prediction") == 1) & (F.col("model_version") != "v1"), 1).otherwise(0)
    cells = streams.window_cells(prediction_stream(t).withColumn("ground_truth", label))
    baselines = t.spark.createDataFrame([(f"v{i}", 0.95) for i in range(3)], "model_version string, baseline double")
    streams.alert_stream(cells, baselines, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    rows = t.spark.read.parquet(f"{path}/rows").groupBy("model_id", "severity", "channel")
    return rounded(rows.agg(F.count("*").alias("n"), F.max("change").alias("worst")))


@query("stream_rate_limits", f"WITH {RATE_SQL} SELECT client, count(*) AS requests, count(*) FILTER (NOT allowed) AS violations FROM r GROUP BY 1")
def stream_rate_limits(t: Tables):
    paced = F.timestamp_micros(F.expr("unix_micros(ts) div 1000"))
    log = event_stream(t).select("event_id", F.lit("anonymous").alias("scope"), F.concat(F.lit("c"), F.col("user_id") % 10).alias("client"), paced.alias("paced"))
    out = streams.drain(streams.rate_limit_stream(log, "client", "scope", "paced", "event_id"), "limits")
    return out.groupBy("client").agg(F.count("*").alias("requests"), F.count(F.when(~F.col("allowed"), 1)).alias("violations"))


# ---- stateful rules: all rows behind the watermark, which follows the newest row by the delay, in whole milliseconds


def behind_sql(newest_us: str, delay_ms: int) -> str:
    return f"(({newest_us}) // 1000 - {delay_ms}) * 1000"


@query(
    "stream_token_buckets",
    f"WITH {RATE_SQL} SELECT client, 'anonymous' AS scope, count(*) AS requests, count(*) FILTER (NOT allowed) AS violations, min(us) FILTER (NOT allowed) AS first_violation_us FROM r "
    f"WHERE us < {behind_sql('SELECT max(us) FROM e', 60_000)} GROUP BY 1",
)
def stream_token_buckets(t: Tables):
    paced = F.timestamp_micros(F.expr("unix_micros(ts) div 1000"))
    log = event_stream(t).select("event_id", F.lit("anonymous").alias("scope"), F.concat(F.lit("c"), F.col("user_id") % 10).alias("client"), paced.alias("paced"))
    out = streams.drain(stateful.rate_limits(log, "client", "scope", "paced", "event_id", "1 minute"), "buckets")
    return out.groupBy("client", "scope").agg(
        F.count("*").alias("requests"), F.count(F.when(~F.col("allowed"), 1)).alias("violations"), F.min(F.when(~F.col("allowed"), F.col("us"))).alias("first_violation_us")
    )


@query("stream_outages", f"WITH {BREAKER_SQL} SELECT service, us AS opened_us, closed_us FROM turns WHERE NOT closes AND closed_us < {behind_sql('SELECT max(us) FROM e', 60_000)}")
def stream_outages(t: Tables):
    paced = F.timestamp_micros(F.expr("unix_micros(ts) div 100"))
    calls = event_stream(t).select("event_id", paced.alias("paced"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("service"), (~is_error() & (F.col("value") < 60)).alias("ok"))
    return streams.drain(stateful.outage_stream(calls, "service", "paced", "event_id", "ok", "1 minute"), "outages")


@query(
    "stream_held_alerts",
    f"""WITH {HOUR_SQL}, f AS (SELECT *, error_rate > 0.2 AS is_on, lag(error_rate > 0.2) OVER w AS was, lag(tick) OVER w AS prev FROM h WINDOW w AS (PARTITION BY model ORDER BY tick)),
    i AS (SELECT *, sum(CASE WHEN was IS NULL OR NOT was OR tick - prev > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY tick) AS island FROM f),
    g AS (SELECT model, min(tick) AS since, max(tick) AS until FROM i WHERE is_on AND tick < (SELECT max(tick) FROM h) - 600 GROUP BY model, island)
    SELECT model, since, since + 7200 AS fires_at FROM g WHERE until - since >= 7200""",
)
def stream_held_alerts(t: Tables):
    path = scratch_path(t.spark, "hours")
    hourly(t).select("model", "window_start", (F.col("error_rate") > 0.2).alias("bad")).write.parquet(path)
    windows = streams.read_stream(t.spark, path, t.spark.read.parquet(path).schema)
    return streams.drain(stateful.held_alert_stream(windows, "model", "window_start", "bad", 3600, 7200), "alerts")


# A second label an hour after the first for a part of the requests; the last one counts.
LABELS_SQL = f"""{PRED_SQL}, {FEED_SQL}, labels AS (SELECT * FROM feed UNION ALL SELECT request_id, 1 - ground_truth, feedback_at + INTERVAL '1' HOUR FROM feed WHERE right(request_id, 1) = '3'),
  newest AS (SELECT (epoch_us(max(ts)) // 1000 - 3600000) * 1000 AS us FROM events),
  matched AS (SELECT p.request_id, p."timestamp", p.prediction, p.model_version, arg_max(f.ground_truth, f.feedback_at) AS ground_truth, count(f.request_id) AS n FROM pred p
    LEFT JOIN labels f ON p.request_id = f.request_id AND f.feedback_at BETWEEN p."timestamp" AND p."timestamp" + INTERVAL '7' DAY GROUP BY ALL),
  alone AS (SELECT f.request_id, max(f.feedback_at) AS feedback_at FROM labels f WHERE NOT EXISTS (SELECT 1 FROM pred p WHERE p.request_id = f.request_id AND f.feedback_at BETWEEN p."timestamp" AND p."timestamp" + INTERVAL '7' DAY) AND epoch_us(f.feedback_at) < (SELECT us FROM newest) GROUP BY 1)"""


@query(
    "stream_last_labels",
    f"""WITH {LABELS_SQL} SELECT CASE WHEN n > 0 THEN 'matched' ELSE 'unlabelled' END AS status, model_version, prediction, ground_truth, count(*) AS n FROM matched
    WHERE epoch_us("timestamp") + 604800000000 < (SELECT us FROM newest) GROUP BY ALL UNION ALL SELECT 'unmatched_feedback', NULL, NULL, NULL, count(*) FROM alone""",
)
def stream_last_labels(t: Tables):
    first = feedback_stream(t)
    again = feedback_stream(t).where(F.col("request_id").endswith("3")).select("request_id", (1 - F.col("ground_truth")).alias("ground_truth"), (F.col("feedback_at") + F.expr("INTERVAL 1 HOUR")).alias("feedback_at"))
    out = stateful.last_unmatched(streams.drain(stateful.last_label_stream(prediction_stream(t), first.unionByName(again)), "labels"))
    alone = F.col("status") == "unmatched_feedback"
    return out.withColumn("ground_truth", F.when(~alone, F.col("ground_truth"))).groupBy("status", "model_version", "prediction", "ground_truth").agg(F.count("*").alias("n"))


@query(
    "stream_latency_p99",
    f"WITH b AS (SELECT time_bucket(INTERVAL '5 minutes', ts) AS ws, count(*) AS n, {BUCKET_SQL} FROM (SELECT ts, value * 4 AS lat FROM events) GROUP BY 1) "
    f"SELECT epoch(ws)::BIGINT AS window_start, n AS requests, round({INTERP_SQL}, 4)::DOUBLE AS latency_ms FROM b WHERE ws + INTERVAL '5 minutes' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)",
)
def stream_latency_p99(t: Tables):
    out = streams.drain(streams.latency_stream(event_stream(t).withColumn("lat", F.col("value") * 4), [], "ts", "lat"), "latency")
    return rounded(out.withColumn("window_start", F.unix_seconds("window_start")), 4)


@query(
    "stream_client_usage",
    "WITH w AS (SELECT user_id, time_bucket(INTERVAL '1 hour', ts) AS ws, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 4) AS mean_latency_ms, max(value) AS max_latency_ms FROM events GROUP BY ALL) "
    "SELECT user_id, epoch(ws)::BIGINT AS window_start, requests, errors, mean_latency_ms, max_latency_ms FROM w WHERE ws + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)",
)
def stream_client_usage(t: Tables):
    out = streams.drain(streams.usage_stream(event_stream(t), "user_id", "ts", is_error(), "value"), "usage")
    return rounded(out.withColumn("window_start", F.unix_seconds("window_start")), 4)


@query(
    "stream_batch_quality",
    "SELECT 2::BIGINT AS evaluated_expectations, (1 + (max(value) <= 400)::INT)::BIGINT AS successful_expectations, max(value) <= 400 AS is_valid FROM events",
)
def stream_batch_quality(t: Tables):
    from ..operators.validate import BETWEEN, NOT_NULL, Expectation

    path = scratch_path(t.spark, "quality")
    suite = [Expectation(NOT_NULL, "ts"), Expectation(BETWEEN, "value", 1.0, {"min_value": 0, "max_value": 400})]
    streams.quality_stream(event_stream(t), suite, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return t.spark.read.parquet(f"{path}/rows").select("evaluated_expectations", "successful_expectations", "is_valid")
