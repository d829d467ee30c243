"""Whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, registry
from ..plans.cycle import run_cycle
from ..plans.monitoring import monitoring_run
from ..session import scratch_path
from .base import Tables, query, rounded
from .drift_queries import HIST, KS_P, SHAPE
from .inputs import order_sides, order_sides_sql
from .monitor_queries import STATE_SQL, WINDOW_SQL, matched, predictions, stage_log


@query(
    "monitoring_run",
    f"""WITH {WINDOW_SQL}, latest AS (SELECT model_version, arg_max(f1, window_start) AS f1 FROM win GROUP BY 1), {order_sides_sql("o_totalprice, o_orderstatus")}, both_long AS (SELECT 'o_totalprice' AS feature, o_totalprice AS x, 1 AS is_ref FROM ref UNION ALL SELECT 'o_totalprice', o_totalprice, 0 FROM prod),
    {SHAPE}, {HIST}, num AS (SELECT {KS_P} < 0.05 OR psi > 0.2 AS drifted FROM shape JOIN mom USING (feature) JOIN div USING (feature)),
    st AS (SELECT o_orderstatus, sum(r) AS r, sum(p) AS p FROM (SELECT o_orderstatus, 1 AS r, 0 AS p FROM ref UNION ALL SELECT o_orderstatus, 0, 1 FROM prod) GROUP BY 1),
    cat AS (SELECT exp(-sum((p - e) ** 2 / e) / 2) < 0.05 AS drifted FROM (SELECT p, r / sum(r) OVER () * sum(p) OVER () AS e FROM st)),
    share AS (SELECT avg(drifted::INT) AS s FROM (SELECT * FROM num UNION ALL SELECT * FROM cat)),
    p AS (SELECT count(*) AS n, avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM ref), c AS (SELECT count(*) AS n, avg(o_totalprice) AS m FROM prod)
    SELECT 'quality' AS monitor, CASE WHEN c.n BETWEEN floor(p.n * 0.5) AND floor(p.n * 2.0) AND abs(c.m - p.m) <= 3 * p.s THEN 'ok' ELSE 'alert' END AS status, false AS retrain_recommended FROM c, p
    UNION ALL SELECT 'drift', CASE WHEN s > 0.3 THEN 'alert' ELSE 'ok' END, s > 0.3 FROM share UNION ALL SELECT 'performance', CASE WHEN count(*) = 0 THEN 'missing' WHEN count(*) FILTER (f1 < 0.99 * 0.95) > 0 THEN 'alert' ELSE 'ok' END, count(*) FILTER (f1 < 0.99 * 0.95) > 0 FROM latest""",
)
def monitoring(t: Tables):
    ref, prod = order_sides(t, "o_totalprice, o_orderstatus")
    base = predictions(t).select("model_version").distinct().withColumn("baseline", F.lit(0.99))
    out = monitoring_run(ref, prod, matched(t).where("status <> 'unmatched_feedback'"), base, categorical=["o_orderstatus"])
    return out.select("monitor", "status", "retrain_recommended")


@query(
    "drift_history",
    f"""WITH {order_sides_sql("o_orderstatus, o_orderpriority")}, long AS (SELECT feature, v, is_ref FROM (SELECT *, 1 AS is_ref FROM ref UNION ALL SELECT *, 0 AS is_ref FROM prod) UNPIVOT (v FOR feature IN (o_orderstatus, o_orderpriority))),
    vc AS (SELECT feature, v, sum(is_ref) AS r, sum(1 - is_ref) AS p FROM long GROUP BY ALL), s AS (SELECT *, r / sum(r) OVER w AS sr, p / sum(p) OVER w AS sp FROM vc WINDOW w AS (PARTITION BY feature))
    SELECT unnest(['2024-01-01', '2024-01-02']) AS run_date, feature, round(psi, 6) AS psi FROM (SELECT feature, sum((sp - sr) * ln((sp + 1e-8) / (sr + 1e-8))) AS psi FROM s GROUP BY 1)""",
)
def drift_history(t: Tables):
    path = scratch_path(t.spark, "history")
    report = drift.categorical_psi(*order_sides(t, "o_orderstatus, o_orderpriority"), ["o_orderstatus", "o_orderpriority"])
    for day in ("2024-01-01", "2024-01-02"):
        drift.append_history(report, path, day)
    return rounded(drift.read_history(t.spark, path).select(F.col("run_date").cast("string").alias("run_date"), "feature", "psi"))


@query("get_version", f"WITH {STATE_SQL}, pick AS (SELECT min(version) AS v FROM state WHERE model_id = 'm3') SELECT model_id, version, stage FROM state, pick WHERE model_id = 'm3' AND version = pick.v")
def get_version(t: Tables):
    log = stage_log(t)
    first = log.where("model_id = 'm3'").agg(F.min("version").alias("v")).first()["v"]
    return registry.get_version(log, "m3", first).select("model_id", "version", "stage")


@query("daily_cycle")
def daily_cycle(t: Tables):
    y = F.when(F.col("l_quantity") + 100 * F.col("l_tax") + 3 * (F.col("l_returnflag") == "R").cast("int") >= 30, 1).otherwise(0)
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax", "l_extendedprice", "l_returnflag", "l_shipdate", y.alias("y"))
    late = F.col("l_shipdate") >= F.lit("1998-07-01").cast("timestamp")
    # the later side is moved so that the cycle goes on to training
    ref = df.where(~late).drop("l_shipdate")
    prod = df.where(late).drop("l_shipdate").withColumn("l_extendedprice", F.col("l_extendedprice") * 1.3).withColumn("l_tax", F.col("l_tax") * 1.5)
    over = {"logistic_regression": {"max_iter": [10], "penalty": ["l2"], "C": [1.0], "class_weight": [None]}}
    out = run_cycle(
        ref, prod, "y", ["l_orderkey", "l_linenumber", "l_partkey"], "m-cycle", "20240101_000000", stage_log(t), "2023-01-01", "2024-01-01",
        reference_root=scratch_path(t.spark, "cycle"), trials=1, families=["logistic_regression"], overrides=over,
    )
    return out.report(t.spark)
