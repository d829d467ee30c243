"""Two-sample statistics and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift
from .base import Tables, query, rounded
from .inputs import FEATURES, order_sides, order_sides_sql, sides, sides_sql

LONG = (
    "both_long AS (SELECT feature, x, is_ref FROM (SELECT *, 1 AS is_ref FROM ref UNION ALL SELECT *, 0 AS is_ref FROM prod) "
    "UNPIVOT (x FOR feature IN ({cols})))"
)
# value counts and cumulative shares per feature
SHAPE = """
vc AS (SELECT feature, x, sum(is_ref) AS r, sum(1 - is_ref) AS p FROM both_long GROUP BY ALL),
cdf AS (SELECT feature, x, lead(x) OVER w AS nx,
               sum(r) OVER w / sum(r) OVER (PARTITION BY feature) AS fr,
               sum(p) OVER w / sum(p) OVER (PARTITION BY feature) AS fp
        FROM vc WINDOW w AS (PARTITION BY feature ORDER BY x)),
shape AS (SELECT feature, max(abs(fr - fp)) AS ks, sum(abs(fr - fp) * (coalesce(nx, x) - x)) AS w1 FROM cdf GROUP BY feature),
mom AS (SELECT feature, sum(is_ref) AS n, sum(1 - is_ref) AS m,
               avg(x) FILTER (is_ref = 1) AS ref_mean, avg(x) FILTER (is_ref = 0) AS cur_mean,
               stddev_pop(x) FILTER (is_ref = 1) AS ref_std, stddev_pop(x) FILTER (is_ref = 0) AS cur_std
        FROM both_long GROUP BY feature)
"""
KS_P = """CASE WHEN ks * sqrt(n * m / (n + m)) < 0.2 THEN 1.0 ELSE greatest(0.0, least(1.0, 2 * list_sum([(CASE WHEN j % 2 = 1 THEN 1.0 ELSE -1.0 END) * exp(-2.0 * j * j * ks * ks * n * m / (n + m))
 FOR j IN range(1, 101)]))) END"""
HIST = """
bp AS (SELECT feature, list_sort(list_distinct(quantile_cont(x, [i / 20.0 FOR i IN range(0, 21)]))) AS b
       FROM both_long WHERE is_ref = 1 GROUP BY feature),
edges AS (SELECT feature, k, b[k] AS lo, b[k + 1] AS hi, k = len(b) - 1 AS closed
          FROM (SELECT feature, b, unnest(range(1, len(b))) AS k FROM bp)),
hist AS (SELECT e.feature, e.k, coalesce(sum(r), 0) AS r, coalesce(sum(p), 0) AS p
         FROM edges e LEFT JOIN vc ON vc.feature = e.feature AND vc.x >= e.lo AND (vc.x < e.hi OR (e.closed AND vc.x = e.hi))
         GROUP BY ALL),
sh AS (SELECT feature, r / sum(r) OVER w + 1e-8 AS sr, p / sum(p) OVER w + 1e-8 AS sp,
              (r + 1e-8) / sum(r + 1e-8) OVER w AS jr, (p + 1e-8) / sum(p + 1e-8) OVER w AS jp
       FROM hist WINDOW w AS (PARTITION BY feature)),
div AS (SELECT feature, sum((sp - sr) * ln(sp / sr)) AS psi,
               sum(0.5 * jr * ln(jr / ((jr + jp) / 2)) + 0.5 * jp * ln(jp / ((jr + jp) / 2))) AS jsd
        FROM sh GROUP BY feature)
"""
COLS = ", ".join(FEATURES)
BASE = f"WITH {sides_sql(COLS)}, {LONG.format(cols=COLS)}, {SHAPE}"


@query("ks_statistic", BASE + f"SELECT feature, n, m, round(ks, 6) AS ks, round({KS_P}, 6) AS p_value FROM shape JOIN mom USING (feature)".replace("SELECT feature, n, m", "SELECT feature, n::BIGINT AS n_ref, m::BIGINT AS n_prod"))
def ks_statistic(t: Tables):
    ref, prod = sides(t, COLS)
    out = drift.ks_two_sample(ref, prod, FEATURES)
    return rounded(out.select("feature", "n_ref", "n_prod", "ks", F.col("ks_p").alias("p_value")))


@query("psi_numeric", BASE + f", {HIST} SELECT feature, round(psi, 6) AS psi FROM div")
def psi_numeric(t: Tables):
    return rounded(drift.histogram_divergences(*sides(t, COLS), FEATURES).select("feature", "psi"))


@query("jensen_shannon", BASE + f", {HIST} SELECT feature, round(jsd, 6) AS jsd FROM div")
def jensen_shannon(t: Tables):
    return rounded(drift.histogram_divergences(*sides(t, COLS), FEATURES).select("feature", "jsd"))


@query(
    "wasserstein",
    BASE + "SELECT feature, round(CASE WHEN ref_std > 0 THEN w1 / ref_std ELSE w1 END, 6) AS wasserstein FROM shape JOIN mom USING (feature)",
)
def wasserstein(t: Tables):
    return rounded(drift.two_sample_statistics(*sides(t, COLS), FEATURES).select("feature", "wasserstein"))


CATS = "o_orderstatus, o_orderpriority"
CAT_SQL = f"""WITH {order_sides_sql(CATS)},
long AS (SELECT feature, v, is_ref FROM (SELECT *, 1 AS is_ref FROM ref UNION ALL SELECT *, 0 AS is_ref FROM prod)
         UNPIVOT (v FOR feature IN ({CATS}))),
vc AS (SELECT feature, v, sum(is_ref) AS r, sum(1 - is_ref) AS p FROM long GROUP BY ALL),
tot AS (SELECT *, sum(r) OVER (PARTITION BY feature) AS nr, sum(p) OVER (PARTITION BY feature) AS np FROM vc)
"""


@query(
    "psi_categorical",
    CAT_SQL
    + """SELECT feature, count(*) AS categories, round(sum((p / np - r / nr) * ln((p / np + 1e-8) / (r / nr + 1e-8))), 6) AS psi
    FROM tot GROUP BY feature""",
)
def psi_categorical(t: Tables):
    return rounded(drift.categorical_psi(*order_sides(t, CATS), CATS.split(", ")))


# The upper tail has a finite series for an even number of degrees of freedom, as both columns have here.
@query(
    "chi_square",
    CAT_SQL
    + """, s AS (SELECT feature, count(*) - 1 AS dof, sum((p - r * np / nr) ** 2 / (r * np / nr)) AS chi2 FROM tot WHERE r > 0 GROUP BY feature)
    SELECT feature, dof, round(chi2, 6) AS chi2,
           round(exp(-chi2 / 2) * CASE dof WHEN 2 THEN 1 ELSE 1 + chi2 / 2 END, 6) AS p_value FROM s""",
)
def chi_square(t: Tables):
    return rounded(drift.chi_square(*order_sides(t, CATS), CATS.split(", ")))


BIN = "CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.0 END AS is_f, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS is_r"
FULL = f"{COLS}, {BIN}"
FULL_BASE = f"WITH {sides_sql(FULL)}, {LONG.format(cols=COLS)}, {SHAPE}, {HIST}"
BINARY_SQL = """bin_long AS (SELECT feature, x, is_ref FROM (SELECT *, 1 AS is_ref FROM ref UNION ALL SELECT *, 0 AS is_ref FROM prod)
   UNPIVOT (x FOR feature IN (is_f, is_r))),
bm AS (SELECT feature, avg(x::DOUBLE) FILTER (is_ref = 1) AS r, avg(x::DOUBLE) FILTER (is_ref = 0) AS p FROM bin_long GROUP BY feature),
bd AS (SELECT *, abs(p - r) AS diff, abs(p - r) * abs(ln((p + 1e-8) / (r + 1e-8))) AS psi FROM bm)"""
FEATURE_SQL = f"""cont AS (SELECT feature, 'ks+psi' AS test, ks AS statistic, {KS_P} AS p_value, psi, ref_mean, cur_mean, ref_std, cur_std,
     w1 / ref_std AS wasserstein, 0.4 * least(ks * 2, 1) + 0.6 * least(psi / 0.5, 1) AS drift_score
   FROM shape JOIN mom USING (feature) JOIN div USING (feature)),
verdicts AS (SELECT feature, test, statistic, p_value, drift_score, p_value < 0.05 OR psi > 0.2 AS is_drifted, ref_mean, cur_mean, ref_std, cur_std,
     psi, wasserstein FROM cont
   UNION ALL SELECT feature, 'proportion+psi', diff, NULL, least(diff * 2, 1), psi > 0.2 OR diff > 0.1, r, p, 0.0, 0.0, psi, NULL FROM bd)"""
FLAGS = f"{FULL_BASE}, {BINARY_SQL}, {FEATURE_SQL}"


@query(
    "binary_drift",
    f"""WITH {sides_sql(BIN)}, {BINARY_SQL}
    SELECT feature, round(diff, 6) AS statistic, round(least(diff * 2, 1), 6) AS drift_score, psi > 0.2 OR diff > 0.1 AS is_drifted,
           round(r, 6) AS ref_mean, round(p, 6) AS cur_mean FROM bd""",
)
def binary_drift(t: Tables):
    out = drift.feature_drift(*sides(t, BIN))
    return rounded(out.select("feature", "statistic", "drift_score", "is_drifted", "ref_mean", "cur_mean"))


@query(
    "feature_drift",
    FLAGS
    + """ SELECT feature, test, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, round(drift_score, 6) AS drift_score, is_drifted,
    round(ref_mean, 4) AS ref_mean, round(cur_mean, 4) AS cur_mean, round(ref_std, 4) AS ref_std, round(cur_std, 4) AS cur_std,
    round(psi, 6) AS psi, round(wasserstein, 6) AS wasserstein FROM verdicts""",
)
def feature_drift(t: Tables):
    out = drift.feature_drift(*sides(t, FULL))
    return rounded(out, 6, ref_mean=4, cur_mean=4, ref_std=4, cur_std=4)


@query(
    "usable_features",
    f"""WITH {order_sides_sql("o_totalprice, o_custkey, CASE WHEN o_orderpriority = '0-NONE' THEN 1.0 END AS mostly_missing")}
    SELECT feature, n_ref, n_prod, n_ref >= 10 AND n_prod >= 10 AS usable FROM (
      SELECT unnest(['o_totalprice', 'o_custkey', 'mostly_missing']) AS feature,
             unnest([(SELECT count(o_totalprice) FROM ref), (SELECT count(o_custkey) FROM ref), (SELECT count(mostly_missing) FROM ref)]) AS n_ref,
             unnest([(SELECT count(o_totalprice) FROM prod), (SELECT count(o_custkey) FROM prod), (SELECT count(mostly_missing) FROM prod)]) AS n_prod)""",
)
def usable_features(t: Tables):
    ref, prod = order_sides(t, "o_totalprice, o_custkey, CASE WHEN o_orderpriority = '0-NONE' THEN 1.0 END AS mostly_missing")
    cols = drift.shared_features(ref, prod)
    moments = drift.sample_moments(drift._tagged(ref, prod, cols), cols)
    keep = drift.usable_features(moments, cols)
    frame = drift._moments_frame(t.spark, moments, cols)
    return frame.select("feature", "n_ref", "n_prod", F.col("feature").isin(keep).alias("usable"))


TARGET = "o_totalprice, o_orderstatus"


@query(
    "target_drift_numeric",
    f"""WITH {order_sides_sql("o_totalprice")}, {LONG.format(cols="o_totalprice")}, {SHAPE}
    SELECT feature AS target, 'ks_2samp' AS test, round(ks, 6) AS statistic, round({KS_P}, 6) AS p_value, {KS_P} < 0.01 AS concept_drift
    FROM shape JOIN mom USING (feature)""",
)
def target_drift_numeric(t: Tables):
    return rounded(drift.target_drift(*order_sides(t, TARGET), "o_totalprice"))


@query(
    "target_drift_categorical",
    CAT_SQL
    + """, q AS (SELECT sum((p / np - r / nr) * ln((p / np + 1e-8) / (r / nr + 1e-8))) AS psi FROM tot WHERE feature = 'o_orderstatus')
    SELECT 'o_orderstatus' AS target, 'psi' AS test, round(psi, 6) AS statistic, psi > 0.15 AS concept_drift FROM q""",
)
def target_drift_categorical(t: Tables):
    return rounded(drift.target_drift(*order_sides(t, TARGET), "o_orderstatus").drop("p_value"))


@query(
    "target_top_categories",
    f"""WITH {order_sides_sql("o_custkey")}, s AS (
      SELECT 'reference' AS side, o_custkey::VARCHAR AS value, count(*) AS n, count(*) / (SELECT count(*) FROM ref) AS share FROM ref GROUP BY ALL
      UNION ALL SELECT 'production', o_custkey::VARCHAR, count(*), count(*) / (SELECT count(*) FROM prod) FROM prod GROUP BY ALL)
    SELECT side, value, n, round(share, 6) AS share, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY side ORDER BY n DESC, value) AS rank FROM s) WHERE rank <= 10""",
)
def target_top_categories(t: Tables):
    out = drift.top_categories(*order_sides(t, "o_custkey"), "o_custkey")
    return rounded(out.withColumn("rank", F.col("rank").cast("long")))


SUMMARY_SQL = """, agg AS (SELECT count(*) FILTER (is_drifted) AS features_drifted, count(*) AS features_total, avg(drift_score) AS drift_score,
   (count(*) FILTER (is_drifted)) / count(*) AS drift_proportion,
   coalesce((SELECT string_agg(feature, ',' ORDER BY drift_score DESC, feature) FROM (
      SELECT feature, drift_score FROM verdicts WHERE is_drifted ORDER BY drift_score DESC, feature LIMIT 5)), '') AS top_features FROM verdicts)"""
SEVERITY_SQL = """CASE WHEN drift_proportion > 0.6 THEN 'high' WHEN drift_proportion > 0.3 OR drift_score > 0.5 THEN 'moderate'
   WHEN drift_proportion > 0.1 THEN 'low' ELSE 'none' END"""


@query(
    "drift_summary",
    FLAGS
    + SUMMARY_SQL
    + f""" SELECT features_drifted, features_total, round(drift_score, 6) AS drift_score, round(drift_proportion, 6) AS drift_proportion,
    top_features, {SEVERITY_SQL} AS severity FROM agg""",
)
def drift_summary(t: Tables):
    out = drift.drift_summary(drift.feature_drift(*sides(t, FULL)))
    out = out.withColumn("top_features", F.concat_ws(",", "top_features"))
    return rounded(out.select("features_drifted", "features_total", "drift_score", "drift_proportion", "top_features", "severity"))


@query(
    "drift_severity_by_ship_year",
    f"""WITH y AS (SELECT year(l_shipdate) AS yr, avg(l_discount) AS d, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS p FROM lineitem GROUP BY 1)
    SELECT yr, CASE WHEN p > 0.3335 AND p > 0.5 THEN 'critical' WHEN p > 0.3335 OR p > 0.6 THEN 'high'
      WHEN p > 0.3 OR d > 0.5 THEN 'moderate' WHEN p > 0.1 THEN 'low' ELSE 'none' END AS severity FROM y""",
)
def drift_severity_by_ship_year(t: Tables):
    y = t.lineitem.groupBy(F.year("l_shipdate").cast("long").alias("yr")).agg(
        F.avg("l_discount").alias("d"), F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("p")
    )
    return y.select("yr", drift.severity(F.col("p"), F.col("d"), F.col("p") > 0.3335).alias("severity"))


@query(
    "drift_recommendations",
    FLAGS
    + SUMMARY_SQL
    + f""", s AS (SELECT *, {SEVERITY_SQL} AS severity FROM agg)
    SELECT severity, concat_ws('|', CASE WHEN severity IN ('high', 'critical') THEN 'retrain_on_production' END,
      CASE WHEN severity = 'moderate' THEN 'watch_and_schedule_retraining' END,
      CASE WHEN top_features <> '' THEN 'top_drifted:' || top_features END) AS recommendations FROM s""",
)
def drift_recommendations(t: Tables):
    out = drift.drift_summary(drift.feature_drift(*sides(t, FULL)))
    return out.select("severity", F.concat_ws("|", "recommendations").alias("recommendations"))


ALIGN = "o_orderkey, o_custkey, o_totalprice"


@query(
    "distribution_alignment",
    f"""WITH {order_sides_sql(ALIGN.replace('o_orderkey', 'o_orderkey::DOUBLE AS o_orderkey').replace('o_custkey', 'o_custkey::DOUBLE AS o_custkey'))},
    {LONG.format(cols=ALIGN)}, {SHAPE}, v AS (SELECT feature, ks, {KS_P} AS p, ref_mean, cur_mean FROM shape JOIN mom USING (feature))
    SELECT feature AS column, round(ks, 6) AS ks_stat, round(p, 6) AS p_value, NOT (p < 0.01 AND ks > 0.1) AS aligned,
      CASE WHEN NOT (p < 0.01 AND ks > 0.1) THEN 'info' WHEN ks < 0.2 THEN 'warning' ELSE 'error' END AS drift_severity,
      round(ref_mean, 4) AS ref_mean, round(cur_mean, 4) AS new_mean, round(abs(ref_mean - cur_mean) / abs(ref_mean) * 100, 4) AS mean_diff_pct FROM v""",
)
def distribution_alignment(t: Tables):
    out = drift.alignment(*order_sides(t, ALIGN))
    return rounded(out, 6, ref_mean=4, new_mean=4, mean_diff_pct=4)


@query(
    "drift_monitor",
    FLAGS
    + """ SELECT count(*) FILTER (is_drifted) AS n_features_drifted, count(*) AS n_features_total,
    round((count(*) FILTER (is_drifted)) / count(*), 6) AS drift_share, (count(*) FILTER (is_drifted)) / count(*) > 0.5 AS dataset_drift,
    CASE WHEN (count(*) FILTER (is_drifted)) / count(*) > 0.5 THEN 'high' WHEN (count(*) FILTER (is_drifted)) / count(*) > 0.3 THEN 'moderate'
      WHEN (count(*) FILTER (is_drifted)) / count(*) > 0.1 THEN 'low' ELSE 'none' END AS severity FROM verdicts""",
)
def drift_monitor(t: Tables):
    return rounded(drift.monitor_drift(*sides(t, FULL))[1])
