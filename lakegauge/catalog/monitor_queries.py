"""Prediction, feedback, request and audit logs; model versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import monitor, registry, replay
from .base import Tables, query, rounded
from .inputs import from_sql

# Events as a prediction log; the label comes one to six days later, never for a signup; an error row carries a wrong id.
PRED_SQL = """pred AS (SELECT CAST(event_id AS VARCHAR(20)) AS request_id, CASE WHEN value > 40 THEN 1 ELSE 0 END AS prediction, concat('v', CAST(user_id % 3 AS VARCHAR(5))) AS model_version, ts AS "timestamp" FROM events)"""
FEED_SQL = """feed AS (SELECT CASE WHEN event_type = 'error' THEN concat('x', CAST(event_id AS VARCHAR(20))) ELSE CAST(event_id AS VARCHAR(20)) END AS request_id,
  CASE WHEN value + user_id * 0.2 > 55 THEN 1 ELSE 0 END AS ground_truth, CASE WHEN user_id % 10 = 0 THEN ts + INTERVAL '200' HOUR ELSE ts + INTERVAL '30' HOUR END AS feedback_at FROM events WHERE event_type <> 'signup')"""
MATCH_SQL = f"""{PRED_SQL}, {FEED_SQL}, matched AS (SELECT coalesce(p.request_id, f.request_id) AS request_id, prediction, model_version, p."timestamp", ground_truth, feedback_at,
  CASE WHEN p.request_id IS NULL THEN 'unmatched_feedback' WHEN f.request_id IS NULL THEN 'unlabelled' ELSE 'matched' END AS status
  FROM pred p FULL JOIN feed f ON p.request_id = f.request_id AND f.feedback_at BETWEEN p."timestamp" AND p."timestamp" + INTERVAL '7' DAY)"""


def predictions(t: Tables):
    return from_sql(t, PRED_SQL, "pred")


def feedback(t: Tables):
    return from_sql(t, FEED_SQL, "feed")


def matched(t: Tables):
    return monitor.match_feedback(predictions(t), monitor.latest_feedback(feedback(t)))


@query("record_predictions", f"WITH {PRED_SQL} SELECT model_version, count(*) AS n, sum(prediction)::BIGINT AS positives, floor(epoch(max(\"timestamp\")))::BIGINT AS latest FROM pred GROUP BY 1")
def record_predictions(t: Tables):
    return predictions(t).groupBy("model_version").agg(F.count("*").alias("n"), F.sum("prediction").alias("positives"), F.unix_seconds(F.max("timestamp")).alias("latest"))


@query("match_feedback", f"WITH {MATCH_SQL} SELECT status, count(*) AS n, count(prediction) AS predictions, count(ground_truth) AS labels FROM matched GROUP BY 1")
def match_feedback(t: Tables):
    return matched(t).groupBy("status").agg(F.count("*").alias("n"), F.count("prediction").alias("predictions"), F.count("ground_truth").alias("labels"))


@query("newest_predictions", f"WITH {PRED_SQL} SELECT request_id, model_version FROM pred ORDER BY \"timestamp\" DESC, request_id DESC LIMIT 5000")
def newest_predictions(t: Tables):
    return monitor.newest(predictions(t), 5000).select("request_id", "model_version")


WINDOW_SQL = f"""{MATCH_SQL}, w AS (SELECT ws AS window_start, model_version, ground_truth AS y, prediction AS p FROM matched, LATERAL (SELECT unnest(generate_series(floor(epoch("timestamp") / 21600)::BIGINT * 21600 - 64800, floor(epoch("timestamp") / 21600)::BIGINT * 21600, 21600)) AS ws)
    WHERE status <> 'unmatched_feedback'),
  m AS (SELECT window_start, model_version, count(*) AS sample_count, count(y) AS labeled_count, count(y) / count(*) AS label_rate, avg((y = p)::INT) AS accuracy, count(DISTINCT y) AS k,
    sum(y * p) AS tp, sum(p) FILTER (y IS NOT NULL) AS pp, sum(y) AS pos, count(*) FILTER (y = 0 AND p = 0) AS tn, count(*) FILTER (y IS NOT NULL AND p = 0) AS pn, count(*) FILTER (y = 0) AS neg FROM w GROUP BY ALL HAVING count(y) >= 30),
  win AS (SELECT *, CASE WHEN k = 2 THEN coalesce(tp / nullif(pp, 0), 0) ELSE coalesce(tp / nullif(pp, 0), 0) * pos / (pos + neg) + coalesce(tn / nullif(pn, 0), 0) * neg / (pos + neg) END AS precision,
    CASE WHEN k = 2 THEN coalesce(tp / nullif(pos, 0), 0) ELSE coalesce(tp / nullif(pos, 0), 0) * pos / (pos + neg) + coalesce(tn / nullif(neg, 0), 0) * neg / (pos + neg) END AS recall,
    CASE WHEN k = 2 THEN coalesce(2 * tp / nullif(pp + pos, 0), 0) ELSE coalesce(2 * tp / nullif(pp + pos, 0), 0) * pos / (pos + neg) + coalesce(2 * tn / nullif(pn + neg, 0), 0) * neg / (pos + neg) END AS f1 FROM m)"""


def windows(t: Tables):
    return monitor.window_metrics(matched(t).where("status <> 'unmatched_feedback'"))


@query(
    "rolling_window_metrics",
    f"WITH {WINDOW_SQL} SELECT window_start, model_version, sample_count, labeled_count, round(label_rate, 6) AS label_rate, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM win",
)
def rolling_window_metrics(t: Tables):
    return rounded(windows(t).drop("window_end"))


@query(
    "rolling_regression_metrics",
    """WITH w AS (SELECT ws AS window_start, event_type, value AS p, (user_id % 50)::DOUBLE AS y FROM events, LATERAL (SELECT unnest(generate_series(floor(epoch(ts) / 21600)::BIGINT * 21600 - 64800, floor(epoch(ts) / 21600)::BIGINT * 21600, 21600)) AS ws))
    SELECT window_start, event_type AS model_version, count(*) AS sample_count, count(y) AS labeled_count, round(sqrt(avg((y - p) ** 2)), 9) AS rmse, round(avg(abs(y - p)), 9) AS mae FROM w GROUP BY ALL HAVING count(y) >= 30""",
)
def rolling_regression_metrics(t: Tables):
    log = t.events.select(F.col("event_type").alias("model_version"), F.col("ts").alias("timestamp"), F.col("value").alias("prediction"), (F.col("user_id") % 50).cast("double").alias("ground_truth"))
    return rounded(monitor.window_regression_metrics(log), 9)


DEGRADED_SQL = f"{WINDOW_SQL}, d AS (SELECT *, (0.8 - f1) / 0.8 AS change FROM win)"


def degraded(t: Tables):
    base = predictions(t).select("model_version").distinct().withColumn("baseline", F.lit(0.8))
    return monitor.degradation(windows(t), base)


@query("degradation_check", f"WITH {DEGRADED_SQL} SELECT window_start, model_version, round(change, 6)::DOUBLE AS relative_change, change > 0.05 AS is_degraded FROM d")
def degradation_check(t: Tables):
    return rounded(degraded(t).select("window_start", "model_version", "relative_change", "is_degraded"))


@query("monitor_summary", f"WITH {MATCH_SQL} SELECT model_version, count(*) AS total, count(ground_truth) AS labeled, round(count(ground_truth) / count(*), 6) AS label_rate FROM matched WHERE status <> 'unmatched_feedback' GROUP BY 1")
def monitor_summary(t: Tables):
    return rounded(monitor.monitor_summary(matched(t).where("status <> 'unmatched_feedback'"), ["model_version"]))


@query(
    "performance_alerts",
    f"WITH {DEGRADED_SQL} SELECT model_version AS model_id, 'performance_monitor' AS source, CASE WHEN change > 0.15 THEN 'critical' ELSE 'warning' END AS severity, round(change, 6)::DOUBLE AS change, window_start + 86400 AS triggered_at FROM d WHERE change > 0.05",
)
def performance_alerts(t: Tables):
    return rounded(monitor.performance_alerts(degraded(t)))


@query(
    "drift_alert_severity",
    "WITH s AS (SELECT year(o_orderdate) AS yr, avg((o_orderstatus = 'F')::INT) AS share FROM orders GROUP BY 1) SELECT yr, CASE WHEN share > 0.34 AND share > 0.5 THEN 'critical' WHEN share > 0.3 THEN 'warning' ELSE 'info' END AS severity FROM s",
)
def drift_alert_severity(t: Tables):
    s = t.orders.groupBy(F.year("o_orderdate").cast("long").alias("yr")).agg(F.avg((F.col("o_orderstatus") == "F").cast("int")).alias("share"))
    return s.select("yr", monitor.drift_alert_severity(F.col("share") > 0.34, F.col("share")).alias("severity"))


@query(
    "alert_routing",
    f"WITH {DEGRADED_SQL}, a AS (SELECT CASE WHEN change > 0.15 THEN 'critical' ELSE 'warning' END AS severity FROM d WHERE change > 0.05) "
    "SELECT severity, channel, count(*) AS n FROM (SELECT severity, unnest(CASE severity WHEN 'critical' THEN ['annotation', 'chat', 'page', 'retrain_trigger'] ELSE ['annotation', 'chat'] END) AS channel FROM a) GROUP BY ALL",
)
def alert_routing(t: Tables):
    return monitor.route_alerts(monitor.performance_alerts(degraded(t))).groupBy("severity", "channel").agg(F.count("*").alias("n"))


@query(
    "combined_monitoring",
    f"""WITH {DEGRADED_SQL}, q AS (SELECT count(*) FILTER (o_totalprice IS NULL) = 0 AND count(*) >= 100 AS ok FROM orders), s AS (SELECT avg((l_returnflag = 'A')::INT) > 0.5 AS drifted FROM lineitem)
    SELECT CASE WHEN ok THEN 'ok' ELSE 'alert' END AS quality, CASE WHEN drifted THEN 'alert' ELSE 'ok' END AS drift, CASE WHEN (SELECT count(*) FROM d) = 0 THEN 'missing' WHEN (SELECT count(*) FROM d WHERE change > 0.05) > 0 THEN 'alert' ELSE 'ok' END AS performance,
      NOT ok OR drifted OR (SELECT count(*) FROM d WHERE change > 0.05) > 0 AS any_alert, drifted OR (SELECT count(*) FROM d WHERE change > 0.05) > 0 AS retrain_recommended FROM q, s""",
)
def combined_monitoring(t: Tables):
    from ..operators import validate

    suite = [validate.Expectation(validate.NOT_NULL, "o_totalprice"), validate.Expectation(validate.ROW_COUNT, kwargs={"min_value": 100})]
    quality = validate.score_suite(validate.run_suite(t.orders, suite))
    drift = t.lineitem.agg((F.avg((F.col("l_returnflag") == "A").cast("int")) > 0.5).alias("dataset_drift"))
    return monitor.combined_run(quality, drift, degraded(t))


# ---- request log: event type 'error' = failed request, value = latency in ms, user = client -----------------


def is_error():
    return F.col("event_type") == "error"


@query(
    "error_rate_windows",
    "SELECT epoch(time_bucket(INTERVAL '5 minutes', ts))::BIGINT AS window_start, 'm' || (user_id % 2) AS model, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg((event_type = 'error')::INT), 6) AS error_rate FROM events GROUP BY ALL",
)
def error_rate_windows(t: Tables):
    log = t.events.withColumn("model", F.concat(F.lit("m"), F.col("user_id") % 2))
    out = monitor.error_rate(log, ["model"], "ts", is_error())
    return rounded(out.withColumn("window_start", F.unix_seconds("window_start")))


BUCKET_SQL = ", ".join(f"count(*) FILTER (lat <= {b}) AS c{i}" for i, b in enumerate(monitor.LATENCY_BUCKETS))
INTERP_SQL = "CASE " + " ".join(
    f"WHEN c{i} >= 0.99 * n THEN {monitor.LATENCY_BUCKETS[i - 1] if i else 0} + {b - (monitor.LATENCY_BUCKETS[i - 1] if i else 0)} * coalesce((0.99 * n - {f'c{i - 1}' if i else 0}) / nullif(c{i} - {f'c{i - 1}' if i else 0}, 0), 0)"
    for i, b in enumerate(monitor.LATENCY_BUCKETS)
) + " ELSE 1000.0 END"


@query(
    "latency_p99_windows",
    f"WITH b AS (SELECT epoch(time_bucket(INTERVAL '5 minutes', ts))::BIGINT AS window_start, count(*) AS n, {BUCKET_SQL} FROM (SELECT ts, value * 4 AS lat FROM events) GROUP BY 1) SELECT window_start, n AS requests, round({INTERP_SQL}, 4)::DOUBLE AS latency_ms FROM b",
)
def latency_p99_windows(t: Tables):
    out = monitor.latency_quantile(t.events.withColumn("lat", F.col("value") * 4), [], "ts", "lat")
    return rounded(out.withColumn("window_start", F.unix_seconds("window_start")), 4)


HOUR_SQL = "h AS (SELECT 'm' || (user_id % 2) AS model, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS tick, avg((event_type = 'error')::INT) AS error_rate, max(value) * 2 AS p99_ms FROM events GROUP BY ALL)"


def hourly(t: Tables):
    log = t.events.withColumn("model", F.concat(F.lit("m"), F.col("user_id") % 2))
    return monitor.error_rate(log, ["model"], "ts", is_error(), "1 hour")


@query(
    "held_alerts",
    f"""WITH {HOUR_SQL}, f AS (SELECT *, error_rate > 0.2 AS is_on, lag(error_rate > 0.2) OVER w AS was, lag(tick) OVER w AS prev FROM h WINDOW w AS (PARTITION BY model ORDER BY tick)),
    i AS (SELECT *, sum(CASE WHEN was IS NULL OR NOT was OR tick - prev > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY model ORDER BY tick) AS island FROM f),
    g AS (SELECT model, min(tick) AS since, max(tick) AS until, count(*) AS windows FROM i WHERE is_on GROUP BY model, island)
    SELECT model, since, until, windows, CASE WHEN until - since >= 7200 THEN since + 7200 END AS fires_at FROM g""",
)
def held_alerts(t: Tables):
    return monitor.held_alerts(hourly(t), ["model"], "window_start", F.col("error_rate") > 0.2, 3600, 7200)


@query(
    "health_verdict",
    """WITH h AS (SELECT 'u' || user_id AS client, epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT AS tick, avg((event_type = 'error')::INT) AS error_rate, max(value) * 6 AS p99_ms FROM events GROUP BY ALL),
    k AS (SELECT client, tick, error_rate <= 0.01 AND (p99_ms = 0 OR p99_ms <= 500) AS ok FROM h),
    r AS (SELECT client, ok, sum(ok::INT) OVER (PARTITION BY client ORDER BY tick) AS pb FROM k),
    l AS (SELECT client, pb, count(*) AS checks, count(*) FILTER (NOT ok) AS failed FROM r GROUP BY ALL),
    v AS (SELECT client, sum(checks)::BIGINT AS checks, sum(failed)::BIGINT AS failed, max(failed) AS longest_run FROM l GROUP BY 1)
    SELECT *, CASE WHEN longest_run >= 3 THEN 'rollback' WHEN failed = 0 OR failed < checks * 0.1 THEN 'pass' ELSE 'fail' END AS verdict FROM v""",
)
def health_verdict(t: Tables):
    log = t.events.withColumn("client", F.concat(F.lit("u"), F.col("user_id")))
    checks = log.groupBy("client", F.window("ts", "1 day").alias("w")).agg(F.avg(is_error().cast("double")).alias("error_rate"), (F.max("value") * 6).alias("p99_ms"))
    return monitor.health_verdict(checks.withColumn("at", F.col("w.start")), ["client"], "at")


@query(
    "rollout_stages",
    """WITH s AS (SELECT [10, 25, 50, 75, 100][least(4, floor((epoch(ts)::BIGINT - 1704067200) / 518400.0))::INT + 1] AS stage_pct, ('0x' || substr(md5(event_id::VARCHAR || ':0'), 1, 8))::BIGINT / 4294967296.0 AS point, event_type, value FROM events)
    SELECT stage_pct, CASE WHEN point * 100 < stage_pct THEN 'challenger' ELSE 'champion' END AS variant, count(*) AS requests, round(avg((event_type = 'error')::INT), 6) AS error_rate, round(avg(value), 4) AS mean_latency_ms FROM s GROUP BY ALL""",
)
def rollout_stages(t: Tables):
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return rounded(monitor.rollout_analysis(t.events, "event_id", "ts", start, 518400, is_error(), "value"), 6, mean_latency_ms=4)


@query(
    "shadow_comparison",
    "SELECT 'v' || (user_id % 3) AS model_version, count(*) AS pairs, count(*) FILTER ((value > 40) <> (value > 30 + user_id * 0.15)) AS disagreements, round(avg(((value > 40) <> (value > 30 + user_id * 0.15))::INT), 6) AS disagreement_rate FROM events GROUP BY 1",
)
def shadow_comparison(t: Tables):
    e = t.events.withColumn("model_version", F.concat(F.lit("v"), F.col("user_id") % 3))
    a = e.select("event_id", "model_version", F.lit("champion").alias("variant"), (F.col("value") > 40).cast("int").alias("prediction"))
    b = e.select("event_id", "model_version", F.lit("challenger").alias("variant"), (F.col("value") > 30 + F.col("user_id") * 0.15).cast("int").alias("prediction"))
    return rounded(monitor.shadow_comparison(a.unionAll(b), "event_id", "variant", "prediction", ["model_version"]))


@query("event_counters", "SELECT 'm' || (user_id % 5) AS model_id, event_type AS status, count(*) AS total FROM events GROUP BY ALL")
def event_counters(t: Tables):
    e = t.events.select(F.concat(F.lit("m"), F.col("user_id") % 5).alias("model_id"), F.col("event_type").alias("status"))
    return monitor.counters(e, ["model_id", "status"])


@query("event_gauges", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value, floor(epoch(max(ts)))::BIGINT AS updated_at FROM events GROUP BY ALL")
def event_gauges(t: Tables):
    out = monitor.gauges(t.events, ["user_id", "event_type"], "value", "ts", "event_id")
    return out.withColumn("updated_at", F.unix_seconds("updated_at"))


@query(
    "event_histograms",
    "WITH b AS (SELECT event_type, unnest(["
    + ", ".join(f"'{b}'" for b in monitor.LATENCY_BUCKETS)
    + ", 'inf']) AS le, unnest(["
    + ", ".join(f"count(*) FILTER (value <= {b})" for b in monitor.LATENCY_BUCKETS)
    + ", count(value)]) AS cumulative, round(sum(value), 2) AS total_value FROM events GROUP BY 1) SELECT * FROM b",
)
def event_histograms(t: Tables):
    return rounded(monitor.histograms(t.events, ["event_type"], "value"), 2)


@query(
    "run_stage_durations",
    """SELECT run, round(sum(value), 3) AS total_seconds, count(*) AS stage_events, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE 'succeeded' END AS outcome,
      round(sum(value) FILTER (event_type = 'click'), 3) AS click, round(sum(value) FILTER (event_type = 'view'), 3) AS "view", round(sum(value) FILTER (event_type = 'purchase'), 3) AS purchase FROM (SELECT *, event_id // 8 AS run FROM events) GROUP BY 1""",
)
def run_stage_durations(t: Tables):
    e = t.events.select(F.floor(F.col("event_id") / 8).alias("run"), "event_type", "value", F.when(is_error(), "failed").otherwise("ok").alias("status"))
    return rounded(monitor.run_report(e, "run", "event_type", "value", "status", ["click", "view", "purchase"]), 3)


@query(
    "client_usage",
    "SELECT user_id, epoch(time_bucket(INTERVAL '1 hour', ts))::BIGINT AS window_start, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(avg(value), 4) AS mean_latency_ms, max(value) AS max_latency_ms FROM events GROUP BY ALL",
)
def client_usage(t: Tables):
    out = monitor.client_usage(t.events, "user_id", "ts", is_error(), "value")
    return rounded(out.withColumn("window_start", F.unix_seconds("window_start")), 4)


# Requests at 1000 times the pace, so that the clients run into the limit.
RATE_SQL = """RECURSIVE e AS (SELECT 'c' || (user_id % 10) AS client, epoch_us(ts) // 1000 AS us, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) // 1000, event_id) AS rn FROM events),
r AS (SELECT client, rn, us, 400000000::BIGINT AS tokens, true AS allowed FROM e WHERE rn = 1
  UNION ALL SELECT e.client, e.rn, e.us, CASE WHEN least(500000000, r.tokens + (e.us - r.us) * 17) >= 100000000 THEN least(500000000, r.tokens + (e.us - r.us) * 17) - 100000000 ELSE least(500000000, r.tokens + (e.us - r.us) * 17) END,
    least(500000000, r.tokens + (e.us - r.us) * 17) >= 100000000 FROM r JOIN e ON e.client = r.client AND e.rn = r.rn + 1)"""


@query("rate_limit_replay", f"WITH {RATE_SQL} SELECT client, 'anonymous' AS scope, count(*) AS requests, count(*) FILTER (NOT allowed) AS violations, min(us) FILTER (NOT allowed) AS first_violation_us FROM r GROUP BY 1")
def rate_limit_replay(t: Tables):
    paced = F.timestamp_micros(F.expr("unix_micros(ts) div 1000"))
    log = t.events.select("event_id", F.lit("anonymous").alias("scope"), F.concat(F.lit("c"), F.col("user_id") % 10).alias("client"), paced.alias("paced"))
    out = replay.token_bucket(log, "client", "scope", "paced", "event_id")
    return out.groupBy("client", "scope").agg(
        F.count("*").alias("requests"), F.count(F.when(~F.col("allowed"), 1)).alias("violations"), F.min(F.when(~F.col("allowed"), F.col("us"))).alias("first_violation_us")
    )


BREAKER_SQL = """RECURSIVE e AS (SELECT 's' || (user_id % 10) AS service, epoch_us(ts) // 100 AS us, event_type <> 'error' AND value < 60 AS ok, row_number() OVER (PARTITION BY user_id % 10 ORDER BY epoch_us(ts) // 100, event_id) AS rn FROM events),
r AS (SELECT service, rn, us, 0 AS before, CASE WHEN ok THEN 0 ELSE 1 END AS state, 0::BIGINT AS failed FROM e WHERE rn = 1
  UNION ALL SELECT service, rn, us, prev, CASE WHEN eff = 7 THEN 7 WHEN ok THEN CASE eff WHEN 5 THEN 6 ELSE 0 END WHEN eff >= 4 THEN 7 ELSE eff + 1 END, CASE WHEN NOT ok AND eff BETWEEN 4 AND 6 THEN us ELSE failed END
    FROM (SELECT e.service, e.rn, e.us, e.ok, r.failed, r.state AS prev, CASE WHEN r.state = 7 AND e.us - r.failed >= 30000000 THEN 5 ELSE r.state END AS eff FROM r JOIN e ON e.service = r.service AND e.rn = r.rn + 1)),
turns AS (SELECT service, us, state < 5 AS closes, lead(us) OVER (PARTITION BY service ORDER BY rn) AS closed_us FROM r WHERE (before < 5) <> (state < 5))"""


@query("outage_intervals", f"WITH {BREAKER_SQL} SELECT service, us AS opened_us, closed_us FROM turns WHERE NOT closes")
def outage_intervals(t: Tables):
    paced = F.timestamp_micros(F.expr("unix_micros(ts) div 100"))
    log = t.events.select("event_id", paced.alias("paced"), F.concat(F.lit("s"), F.col("user_id") % 10).alias("service"), (~is_error() & (F.col("value") < 60)).alias("ok"))
    return replay.outages(replay.circuit_breaker(log, "service", "paced", "event_id", "ok"), "service")


@query(
    "repeat_requests",
    "WITH k AS (SELECT 'v' || (user_id % 3) AS model_version, props, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT model_version, sum(n)::BIGINT AS requests, count(*) AS distinct_requests, sum(n - 1)::BIGINT AS hits, round(sum(n - 1) / sum(n), 6) AS hit_rate FROM k GROUP BY 1",
)
def repeat_requests(t: Tables):
    features = F.create_map(F.lit("k"), F.get_json_object("props", "$.k"), F.lit("type"), F.col("event_type"))
    log = t.events.select(F.concat(F.lit("v"), F.col("user_id") % 3).alias("model_version"), features.alias("features"))
    return rounded(monitor.repeat_requests(log, monitor.request_key(F.col("features"), F.col("model_version")), ["model_version"]))


@query(
    "serving_summary",
    "SELECT 'm' || (user_id % 2) AS model, count(*) FILTER (event_type <> 'error') AS predictions, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_rate, round(avg(value) FILTER (event_type <> 'error'), 4) AS mean_latency_ms FROM events GROUP BY 1",
)
def serving_summary(t: Tables):
    log = t.events.withColumn("model", F.concat(F.lit("m"), F.col("user_id") % 2))
    return rounded(monitor.serving_summary(log, ["model"], is_error(), "value"), 6, mean_latency_ms=4)


# ---- model versions: signup = registered, view = staging, purchase = promoted to champion --------------------

LOG_SQL = """base AS (SELECT concat('m', CAST(user_id % 20 AS VARCHAR(5))) AS model_id, concat('v', CAST(event_id AS VARCHAR(20))) AS version, event_type, ts FROM events WHERE event_type IN ('signup', 'view', 'purchase')),
turns AS (SELECT model_id, version, ts, lead(ts) OVER (PARTITION BY model_id ORDER BY ts) AS until FROM base WHERE event_type = 'purchase'),
stages AS (SELECT model_id, version, CASE event_type WHEN 'signup' THEN 'development' WHEN 'view' THEN 'staging' ELSE 'champion' END AS stage, ts AS "at", CAST(NULL AS VARCHAR(20)) AS parent_version FROM base
  UNION ALL SELECT model_id, version, 'archived', until, CAST(NULL AS VARCHAR(20)) FROM turns WHERE until IS NOT NULL)"""
STATE_SQL = f"""{LOG_SQL}, state AS (SELECT model_id, version, arg_max(stage, "at") AS stage, min("at") AS created_at, max("at") AS updated_at FROM stages GROUP BY ALL),
champ AS (SELECT model_id, version FROM state WHERE stage = 'champion')"""


def stage_log(t: Tables):
    return from_sql(t, LOG_SQL, "stages")


def at():
    return F.lit("2024-03-01 00:00:00").cast("timestamp")


@query("current_champions", f"WITH {STATE_SQL} SELECT model_id, version FROM champ")
def current_champions(t: Tables):
    return registry.champions(stage_log(t)).select("model_id", "version")


@query("register_versions", f"WITH {STATE_SQL} SELECT m.model_id, m.model_id || '-new' AS version, 'development' AS stage, champ.version AS parent_version FROM (SELECT DISTINCT model_id FROM base) m LEFT JOIN champ USING (model_id)")
def register_versions(t: Tables):
    log = stage_log(t)
    new = log.select("model_id").distinct().withColumn("version", F.concat("model_id", F.lit("-new")))
    return registry.register(log, new, at()).select("model_id", "version", "stage", "parent_version")


PICKS_SQL = "picks AS (SELECT model_id, max(version) AS version FROM state WHERE stage = 'staging' GROUP BY 1)"


def picks(log):
    return registry.current(log).where("stage = 'staging'").groupBy("model_id").agg(F.max("version").alias("version"))


@query(
    "promote_versions",
    f"WITH {STATE_SQL}, {PICKS_SQL} SELECT model_id, version, 'champion' AS stage FROM picks UNION ALL SELECT c.model_id, c.version, 'archived' FROM champ c JOIN picks p ON c.model_id = p.model_id AND c.version <> p.version",
)
def promote_versions(t: Tables):
    log = stage_log(t)
    wanted = picks(log).unionAll(picks(log).withColumn("version", F.lit("v-unknown")))
    return registry.promote(log, wanted, at()).select("model_id", "version", "stage")


@query("unknown_versions", f"WITH {STATE_SQL} SELECT DISTINCT model_id, 'v-unknown' AS version FROM state WHERE stage = 'staging'")
def unknown_versions(t: Tables):
    log = stage_log(t)
    return registry.unknown_versions(log, picks(log).unionAll(picks(log).withColumn("version", F.lit("v-unknown"))))


@query(
    "rollback_versions",
    f"WITH {STATE_SQL}, r AS (SELECT model_id, arg_max(version, (updated_at, version)) AS version FROM state WHERE stage = 'archived' GROUP BY 1) SELECT model_id, version, 'champion' AS stage FROM r UNION ALL SELECT c.model_id, c.version, 'rejected' FROM champ c JOIN r USING (model_id)",
)
def rollback_versions(t: Tables):
    log = stage_log(t)
    return registry.rollback(log, log.select("model_id").distinct(), at()).select("model_id", "version", "stage")


@query("list_versions", f"WITH {STATE_SQL} SELECT model_id, version, stage, floor(epoch(created_at))::BIGINT AS created FROM state WHERE stage IN ('champion', 'archived')")
def list_versions(t: Tables):
    return registry.list_versions(stage_log(t), ["champion", "archived"]).select("model_id", "version", "stage", F.unix_seconds("created_at").alias("created"))
