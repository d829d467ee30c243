"""Cleaning and fitted transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean, transform
from ..operators.knn import knn_impute
from ..operators.profile import ColumnConfig
from .base import Tables, query, rounded
from .inputs import SPLIT

# line items with missing, infinite, text and odd values put in by fixed rules
DIRTY = (
    "l_orderkey, l_linenumber, CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS qty, "
    "CASE WHEN l_orderkey % 29 = 0 THEN CAST('Infinity' AS DOUBLE) WHEN l_orderkey % 31 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS price, "
    "CASE WHEN l_orderkey % 10 < 8 THEN NULL ELSE l_tax END AS sparse, CASE WHEN l_orderkey > 0 THEN 7.5 END AS flat, "
    "CASE WHEN l_orderkey % 11 = 0 THEN ' N/A ' WHEN l_orderkey % 11 = 1 THEN 'Unknown' ELSE l_returnflag END AS flag, "
    "CASE l_linenumber WHEN 1 THEN 'Yes' WHEN 2 THEN 'off' WHEN 3 THEN 'T' WHEN 4 THEN '0' WHEN 5 THEN 'maybe' ELSE 'no' END AS word, "
    "CASE WHEN l_orderkey % 7 = 0 THEN 'n.a. 12' WHEN l_orderkey % 7 = 1 THEN 'abc' ELSE concat('$', CAST(l_linenumber AS VARCHAR(9)), '.50') END AS amount, "
    "CASE WHEN l_orderkey % 19 = 0 THEN 'not a date' ELSE substr(CAST(l_shipdate AS VARCHAR(30)), 1, 10) END AS day, l_shipdate, l_linestatus"
)
DIRTY_SQL = f"d AS (SELECT {DIRTY} FROM lineitem)"


def dirty(t: Tables):
    t.lineitem.createOrReplaceTempView("lg_lineitem")
    return t.spark.sql(f"SELECT {DIRTY} FROM lg_lineitem")


@query("split_target", "SELECT l_linestatus AS y, count(*) AS n, round(sum(l_quantity + l_tax), 4) AS feature_sum FROM lineitem GROUP BY 1")
def split_target(t: Tables):
    df = t.lineitem.select("l_quantity", "l_tax", "l_linestatus")
    features, target = clean.split_target(df, "l_linestatus")
    total = sum((F.col(c) for c in features), F.lit(0.0))
    return rounded(df.groupBy(F.col(target).alias("y")).agg(F.count("*").alias("n"), F.sum(total).alias("feature_sum")), 4)


@query(
    "deduplicate_keep_first",
    """SELECT l_quantity, l_discount, l_tax, l_orderkey FROM (SELECT l_quantity, l_discount, l_tax, l_orderkey,
    row_number() OVER (PARTITION BY l_quantity, l_discount, l_tax ORDER BY l_shipdate, l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
)
def deduplicate_keep_first(t: Tables):
    features = ["l_quantity", "l_discount", "l_tax"]
    out = clean.keep_first(t.lineitem.select(*features, "l_orderkey", "l_linenumber", "l_shipdate"), features, ["l_shipdate", "l_orderkey", "l_linenumber"])
    return out.select(*features, "l_orderkey")


@query(
    "structural_drops",
    f"""WITH {DIRTY_SQL} SELECT 'sparse' AS column, 'null_rate' AS reason FROM d HAVING (count(*) - count(sparse)) / count(*) > 0.7
    UNION ALL SELECT 'flat', 'low_variance' FROM d HAVING var_pop(flat) < 1e-8 UNION ALL SELECT 'qty', 'low_variance' FROM d HAVING var_pop(qty) < 1e-8""",
)
def structural_drops(t: Tables):
    return clean.columns_to_drop(dirty(t).select("qty", "sparse", "flat", "flag", "l_linestatus"))


@query(
    "null_rates_and_variance",
    f"""WITH {DIRTY_SQL} SELECT 'qty' AS column, round((count(*) - count(qty)) / count(*), 6) AS null_rate, round(var_pop(qty), 4) AS variance FROM d
    UNION ALL SELECT 'sparse', round((count(*) - count(sparse)) / count(*), 6), round(var_pop(sparse), 4) FROM d
    UNION ALL SELECT 'flag', round((count(*) - count(flag)) / count(*), 6), NULL FROM d""",
)
def null_rates_and_variance(t: Tables):
    return rounded(clean.null_rates(dirty(t).select("qty", "sparse", "flag")), 6, variance=4)


@query("align_columns", "SELECT l_quantity, l_tax, NULL::DOUBLE AS lost, count(*) AS n FROM lineitem GROUP BY ALL")
def align_columns(t: Tables):
    out = clean.align(t.lineitem, {"l_quantity": "double", "lost": "double", "l_tax": "double"})
    return out.groupBy("l_quantity", "l_tax", "lost").agg(F.count("*").alias("n"))


@query("null_tokens", f"WITH {DIRTY_SQL} SELECT CASE WHEN lower(trim(flag)) NOT IN ('n/a', 'unknown') THEN flag END AS flag, count(*) AS n FROM d GROUP BY 1")
def null_tokens(t: Tables):
    return dirty(t).select(clean.null_tokens(F.col("flag")).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query(
    "boolean_words",
    f"WITH {DIRTY_SQL} SELECT word, CASE WHEN lower(word) IN ('yes', 't') THEN 1.0 WHEN lower(word) IN ('off', '0', 'no') THEN 0.0 END::DOUBLE AS value, count(*) AS n FROM d GROUP BY ALL",
)
def boolean_words(t: Tables):
    return dirty(t).select("word", clean.bool_words(F.col("word")).alias("value")).groupBy("word", "value").agg(F.count("*").alias("n"))


@query("date_to_epoch", f"WITH {DIRTY_SQL} SELECT day, epoch(try_strptime(day, '%Y-%m-%d')) AS seconds, count(*) AS n FROM d GROUP BY ALL")
def date_to_epoch(t: Tables):
    return dirty(t).select("day", clean.date_epoch(F.col("day"), "yyyy-MM-dd").alias("seconds")).groupBy("day", "seconds").agg(F.count("*").alias("n"))


@query(
    "numeric_coercion",
    f"WITH {DIRTY_SQL} SELECT amount, try_cast(regexp_replace(amount, '[^0-9.\\-+eE]', '', 'g') AS DOUBLE) AS value, count(*) AS n FROM d GROUP BY ALL",
)
def numeric_coercion(t: Tables):
    return dirty(t).select("amount", clean.numeric_text(F.col("amount")).alias("value")).groupBy("amount", "value").agg(F.count("*").alias("n"))


@query("infinite_to_null", f"WITH {DIRTY_SQL} SELECT count(*) AS rows, count(*) FILTER (NOT isinf(price)) AS finite, round(max(price) FILTER (NOT isinf(price)), 4) AS top FROM d")
def infinite_to_null(t: Tables):
    v = dirty(t).select(clean.drop_infinite(F.col("price")).alias("v"))
    return rounded(v.agg(F.count("*").alias("rows"), F.count("v").alias("finite"), F.max("v").alias("top")), 4)


@query("hard_range", f"WITH {DIRTY_SQL} SELECT count(*) FILTER (price BETWEEN 0 AND 90000) AS kept, round(sum(CASE WHEN price BETWEEN 0 AND 90000 THEN price END), 2) AS total FROM d")
def hard_range(t: Tables):
    v = dirty(t).select(clean.hard_range(F.col("price"), 0, 90000).alias("v"))
    return rounded(v.agg(F.count("v").alias("kept"), F.sum("v").alias("total")), 2)


@query("allowed_values", f"WITH {DIRTY_SQL} SELECT CASE WHEN flag IN ('A', 'N') THEN flag END AS flag, count(*) AS n FROM d GROUP BY 1")
def allowed_values(t: Tables):
    return dirty(t).select(clean.allowed_only(F.col("flag"), ["A", "N"]).alias("flag")).groupBy("flag").agg(F.count("*").alias("n"))


@query("final_cleanup", f"WITH {DIRTY_SQL} SELECT flag, coalesce(qty::FLOAT, 0)::DOUBLE AS qty, round(coalesce(sparse::FLOAT, 0)::DOUBLE, 6) AS sparse, count(*) AS n FROM d GROUP BY ALL")
def final_cleanup(t: Tables):
    out = clean.finish(dirty(t).select("qty", "sparse", "flag"), keep=["flag"])
    out = out.select("flag", F.col("qty").cast("double").alias("qty"), F.round(F.col("sparse").cast("double"), 6).alias("sparse"))
    return out.groupBy("flag", "qty", "sparse").agg(F.count("*").alias("n"))


# ---- fitted on the reference side, applied to the production side -----------------------------------------

REF, PROD = f"l_shipdate < {SPLIT}", f"l_shipdate >= {SPLIT}"
SIDES = f"WITH {DIRTY_SQL}, ref AS (SELECT * FROM d WHERE {REF}), prod AS (SELECT * FROM d WHERE {PROD})"


def sides(t: Tables):
    d = dirty(t)
    return d.where(REF), d.where(PROD)


def totals(col: str) -> str:
    return f"count({col}) AS n, round(avg({col}), 4) AS mean, round(min({col}), 4) AS low, round(max({col}), 4) AS high"


def totals_df(df, col: str):
    return rounded(df.agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("low"), F.max(col).alias("high")), 4)


def outlier_query(strategy: str, col: str = "qty"):
    def run(t: Tables):
        ref, prod = sides(t)
        return totals_df(transform.apply_outliers(prod, transform.fit_outliers(ref, {col: strategy})), col)

    return run


query("clip_percentiles", f"{SIDES}, b AS (SELECT quantile_cont(qty, 0.01) AS lo, quantile_cont(qty, 0.99) AS hi FROM ref), x AS (SELECT CASE WHEN qty IS NOT NULL THEN greatest(least(qty, hi), lo) END AS v FROM prod, b) SELECT {totals('v')} FROM x")(outlier_query("clip"))
query("clip_zscore", f"{SIDES}, b AS (SELECT avg(qty) - 3.5 * stddev_pop(qty) AS lo, avg(qty) + 3.5 * stddev_pop(qty) AS hi FROM ref), x AS (SELECT CASE WHEN qty IS NOT NULL THEN greatest(least(qty, hi), lo) END AS v FROM prod, b) SELECT {totals('v')} FROM x")(outlier_query("zscore_clip"))
query("clip_iqr", f"{SIDES}, q AS (SELECT quantile_cont(sparse, 0.25) AS q1, quantile_cont(sparse, 0.75) AS q3 FROM ref), x AS (SELECT CASE WHEN sparse IS NOT NULL THEN greatest(least(sparse, q3 + 1.5 * (q3 - q1)), q1 - 1.5 * (q3 - q1)) END AS v FROM prod, q) SELECT {totals('v')} FROM x")(outlier_query("iqr_clip", "sparse"))
query("log_transform", f"{SIDES}, b AS (SELECT CASE WHEN min(qty) <= 0 THEN abs(min(qty)) + 1 ELSE 0 END AS s FROM ref), x AS (SELECT ln(1 + qty + s) AS v FROM prod, b) SELECT {totals('v')} FROM x")(outlier_query("log"))


@query(
    "outlier_overrides",
    f"{SIDES}, b AS (SELECT quantile_cont(qty, 0.01) AS lo, quantile_cont(qty, 0.99) AS hi, CASE WHEN min(sparse) <= 0 THEN abs(min(sparse)) + 1 ELSE 0 END AS s FROM ref), "
    "x AS (SELECT CASE WHEN qty IS NOT NULL THEN greatest(least(qty, hi), lo) END AS a, ln(1 + sparse + s) AS c FROM prod, b) SELECT count(a) AS na, round(avg(a), 4) AS ma, count(c) AS nc, round(avg(c), 6) AS mc FROM x",
)
def outlier_overrides(t: Tables):
    ref, prod = sides(t)
    out = transform.apply_outliers(prod, transform.fit_outliers(ref, {"qty": "clip", "sparse": "log", "price": "none"}))
    return rounded(out.agg(F.count("qty").alias("na"), F.avg("qty").alias("ma"), F.count("sparse").alias("nc"), F.avg("sparse").alias("mc")), 6, ma=4)


@query(
    "impute_fills",
    f"{SIDES}, m AS (SELECT avg(qty) AS mean, quantile_cont(qty, 0.5) AS median FROM ref), k AS (SELECT qty FROM ref WHERE qty IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, qty LIMIT 1) "
    "SELECT strategy, round(value, 4) AS value, round((SELECT avg(coalesce(qty, value)) FROM prod), 4) AS filled_mean FROM "
    "(SELECT unnest(['mean', 'median', 'mode', 'constant']) AS strategy, unnest([mean, median, k.qty, -1.0]) AS value FROM m, k)",
)
def impute_fills(t: Tables):
    from ..functions.frames import local_frame

    ref, prod = sides(t)
    kinds = ("mean", "median", "mode", "constant")
    fills = {k: transform.fit_fills(ref.select("qty"), {"qty": (k, -1.0)})["qty"] for k in kinds}
    wide = prod.agg(*[F.avg(F.coalesce("qty", F.lit(v))).alias(k) for k, v in fills.items()])
    cells = [F.struct(F.lit(k).alias("strategy"), F.lit(fills[k]).alias("value"), F.col(k).alias("filled_mean")) for k in kinds]
    return rounded(wide.select(F.inline(F.array(*cells))), 4)


def scaler_query(strategy: str):
    def run(t: Tables):
        ref, prod = sides(t)
        params = transform.fit_scalers(ref, {"qty": strategy})["qty"]
        return totals_df(prod.select(transform.scale_expr(F.col("qty"), params).alias("v")), "v")

    return run


query("scale_standard", f"{SIDES}, b AS (SELECT avg(qty) AS c, stddev_pop(qty) AS s FROM ref), x AS (SELECT (qty - c) / s AS v FROM prod, b) SELECT {totals('v')} FROM x")(scaler_query("standard"))
query("scale_minmax", f"{SIDES}, b AS (SELECT min(qty) AS c, max(qty) - min(qty) AS s FROM ref), x AS (SELECT (qty - c) / s AS v FROM prod, b) SELECT {totals('v')} FROM x")(scaler_query("minmax"))
query("scale_robust", f"{SIDES}, b AS (SELECT quantile_cont(qty, 0.5) AS c, quantile_cont(qty, 0.75) - quantile_cont(qty, 0.25) AS s FROM ref), x AS (SELECT (qty - c) / s AS v FROM prod, b) SELECT {totals('v')} FROM x")(scaler_query("robust"))
query("scale_log", f"{SIDES}, x AS (SELECT ln(1 + qty) AS v FROM prod) SELECT {totals('v')} FROM x")(scaler_query("log"))


PART_REF, PART_PROD = "p_size <= 40", "p_size > 35"


def parts(t: Tables):
    p = t.part.select("p_partkey", "p_brand", "p_type", "p_name", "p_size", "p_retailprice")
    return p.where(PART_REF), p.where(PART_PROD)


PARTS = f"WITH ref AS (SELECT * FROM part WHERE {PART_REF}), prod AS (SELECT * FROM part WHERE {PART_PROD})"


@query(
    "encode_ordinal",
    f"{PARTS}, c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS code FROM (SELECT DISTINCT p_type FROM ref WHERE p_type <> 'PROMO')) "
    "SELECT p.p_type, coalesce(code, -1)::DOUBLE AS code, count(*) AS n FROM prod p LEFT JOIN c USING (p_type) GROUP BY ALL",
)
def encode_ordinal(t: Tables):
    ref, prod = parts(t)
    lookup = transform.fit_ordinal(ref.where("p_type <> 'PROMO'"), "p_type")
    return transform.apply_lookup(prod, "p_type", lookup, "code").groupBy("p_type", "code").agg(F.count("*").alias("n"))


@query(
    "encode_onehot",
    f"{PARTS} SELECT p_type, " + "{cells}, count(*) AS n FROM prod GROUP BY ALL".format(
        cells=", ".join(f"CASE WHEN p_type = '{v}' AND EXISTS (SELECT 1 FROM ref r WHERE r.p_type = '{v}') THEN 1.0 ELSE 0.0 END::DOUBLE AS \"p_type_{v}\"" for v in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"))
    ),
)
def encode_onehot(t: Tables):
    ref, prod = parts(t)
    cells = [c.cast("double").alias(f"p_type_{v}") for v, c in ((v, transform.onehot_columns("p_type", [v])[0]) for v in transform.fit_onehot(ref, "p_type", 20))]
    out = prod.select("p_type", *cells)
    return out.groupBy(*out.columns).agg(F.count("*").alias("n"))


@query(
    "encode_frequency",
    f"{PARTS}, f AS (SELECT p_name, count(*) / (SELECT count(p_name) FROM ref) AS share FROM ref WHERE p_brand <> 'Brand#1' OR p_size < 5 GROUP BY 1) "
    "SELECT p.p_name, round(coalesce(share, 0), 6)::DOUBLE AS code, count(*) AS n FROM prod p LEFT JOIN (SELECT p_name, count(*) / (SELECT count(p_name) FROM ref) AS share FROM ref GROUP BY 1) USING (p_name) GROUP BY ALL",
)
def encode_frequency(t: Tables):
    ref, prod = parts(t)
    out = transform.apply_lookup(prod, "p_name", transform.fit_frequency(ref, "p_name"), "code")
    return rounded(out.groupBy("p_name", "code").agg(F.count("*").alias("n")))


@query(
    "encode_frequency_unknown_mean",
    f"{PARTS}, r AS (SELECT * FROM ref WHERE p_brand < 'Brand#2'), f AS (SELECT p_brand, count(*) / (SELECT count(*) FROM r) AS share FROM r GROUP BY 1) "
    "SELECT p.p_brand, round(coalesce(share, (SELECT avg(share) FROM f)), 6) AS code, count(*) AS n FROM prod p LEFT JOIN f USING (p_brand) GROUP BY ALL",
)
def encode_frequency_unknown_mean(t: Tables):
    ref, prod = parts(t)
    out = transform.apply_lookup(prod, "p_brand", transform.fit_frequency(ref.where("p_brand < 'Brand#2'"), "p_brand", "mean"), "code")
    return rounded(out.groupBy("p_brand", "code").agg(F.count("*").alias("n")))


SHRINK = "CASE WHEN n * v + var = 0 THEN m ELSE n * v / (n * v + var) * mean + (1 - n * v / (n * v + var)) * m END"


@query(
    "encode_target",
    f"{PARTS}, w AS (SELECT avg(p_retailprice) AS m, var_pop(p_retailprice) AS v FROM ref), c AS (SELECT p_brand, count(*) AS n, avg(p_retailprice) AS mean, var_pop(p_retailprice) AS var FROM ref GROUP BY 1) "
    f"SELECT p.p_brand, round({SHRINK}, 4) AS code, count(*) AS rows FROM prod p JOIN c USING (p_brand), w GROUP BY ALL",
)
def encode_target(t: Tables):
    ref, prod = parts(t)
    out = transform.apply_lookup(prod, "p_brand", transform.fit_target(ref, "p_brand", "p_retailprice"), "code")
    return rounded(out.groupBy("p_brand", "code").agg(F.count("*").alias("rows")), 4)


@query(
    "encode_target_cross_fit",
    "WITH t AS (SELECT p_brand, p_partkey % 5 AS fold, p_retailprice AS y FROM part), f AS (SELECT DISTINCT fold FROM t), "
    "w AS (SELECT f.fold, avg(y) AS m, var_pop(y) AS v FROM f JOIN t ON t.fold <> f.fold GROUP BY 1), "
    "c AS (SELECT f.fold, p_brand, count(*) AS n, avg(y) AS mean, var_pop(y) AS var FROM f JOIN t ON t.fold <> f.fold GROUP BY ALL) "
    f"SELECT p_brand, fold, round({SHRINK}, 3) AS code, k.rows FROM c JOIN w USING (fold) JOIN (SELECT p_brand, fold, count(*) AS rows FROM t GROUP BY ALL) k USING (p_brand, fold)",
)
def encode_target_cross_fit(t: Tables):
    p = t.part.withColumn("fold", F.col("p_partkey") % 5)
    out = transform.cross_fit_target(p, "p_brand", "p_retailprice", F.col("p_partkey") % 5, "code")
    return rounded(out.groupBy("p_brand", "fold", "code").agg(F.count("*").alias("rows")), 3)


@query("constant_features", f"WITH {DIRTY_SQL} SELECT 'three' AS column FROM d HAVING min(l_linenumber * 0 + 3) = max(l_linenumber * 0 + 3) UNION ALL SELECT 'qty' FROM d HAVING min(qty) = max(qty) AND count(qty) = count(*)")
def constant_features(t: Tables):
    from ..functions.frames import local_frame

    df = dirty(t).select("qty", "sparse", "flat", "flag", (F.col("l_linenumber") * 0 + 3).alias("three"))
    return local_frame(t.spark, [(c,) for c in transform.constant_columns(df)], "column string")


@query(
    "leakage_check",
    "WITH d AS (SELECT l_quantity, l_extendedprice, l_tax, l_quantity * 3 + l_tax AS copy, l_quantity AS y FROM lineitem) SELECT feature, round(c, 6) AS correlation, c > 0.99 AS leaks FROM "
    "(SELECT unnest(['l_extendedprice', 'l_tax', 'copy']) AS feature, unnest([abs(corr(l_extendedprice, y)), abs(corr(l_tax, y)), abs(corr(copy, y))]) AS c FROM d)",
)
def leakage_check(t: Tables):
    d = t.lineitem.select("l_extendedprice", "l_tax", (F.col("l_quantity") * 3 + F.col("l_tax")).alias("copy"), F.col("l_quantity").alias("y"))
    return rounded(transform.leakage(d, "y"))


@query("drop_non_numeric", "SELECT round(avg(l_quantity), 6) AS l_quantity, round(avg(l_tax), 6) AS l_tax FROM lineitem")
def drop_non_numeric(t: Tables):
    out = clean.drop_non_numeric(t.lineitem.select("l_quantity", "l_returnflag", "l_tax", "l_shipdate"))
    return rounded(out.agg(*[F.avg(c).alias(c) for c in out.columns]))


@query("passthrough_columns", "SELECT l_linenumber::DOUBLE AS l_linenumber, count(*) AS n FROM lineitem GROUP BY 1")
def passthrough_columns(t: Tables):
    df = t.lineitem.select("l_linenumber", "l_quantity")
    configs = {c: ColumnConfig(c, imputation="none", outlier="none", scaling="none") for c in df.columns}
    out = transform.fit_preparation(df, configs).transform(df)
    return out.groupBy(F.col("l_linenumber").cast("double").alias("l_linenumber")).agg(F.count("*").alias("n"))


@query(
    "knn_imputation",
    f"""WITH {DIRTY_SQL}, d2 AS (SELECT qty, price, l_linenumber FROM d WHERE price BETWEEN 0 AND 1000000), gaps AS (SELECT DISTINCT price FROM d2 WHERE qty IS NULL),
    near AS (SELECT g.price, (g.price - p.price) ** 2 AS d, p.qty AS v, row_number() OVER (PARTITION BY g.price ORDER BY (g.price - p.price) ** 2, p.qty) AS k FROM gaps g JOIN (
        SELECT qty, price FROM d2 WHERE qty IS NOT NULL) p ON abs(g.price - p.price) <= 400),
    fill AS (SELECT price, CASE WHEN min(d) = 0 THEN avg(v) FILTER (d = 0) ELSE sum(v / sqrt(d)) / sum(1 / sqrt(d)) END AS v FROM near WHERE k <= 5 GROUP BY 1 HAVING count(*) = 5)
    SELECT l_linenumber, count(coalesce(qty, v)) AS n, round(avg(coalesce(qty, v)), 5) AS mean_qty FROM d2 LEFT JOIN fill USING (price) GROUP BY 1""",
)
def knn_imputation(t: Tables):
    d = dirty(t).where("price BETWEEN 0 AND 1000000").select("qty", "price", "l_linenumber")
    filled = knn_impute(d, d, ["qty", "price"])
    return rounded(filled.groupBy("l_linenumber").agg(F.count("qty").alias("n"), F.avg("qty").alias("mean_qty")), 5)


# deduplicate, fit on the reference, apply to production: clip + median + robust, one-hot, ordinal, frequency
PREP_CONFIG = {
    "qty": ColumnConfig("qty"),
    "price": ColumnConfig("price", scaling="standard", outlier="zscore_clip", imputation="mean", min_value=0.0),
    "sparse": ColumnConfig("sparse"),
    "flat": ColumnConfig("flat"),
    "flag": ColumnConfig("flag", expected_dtype="object", imputation="mode", outlier="none", scaling="none", encoding="onehot"),
    "l_linestatus": ColumnConfig("l_linestatus", expected_dtype="object", imputation="mode", outlier="none", scaling="none", encoding="ordinal"),
    "word": ColumnConfig("word", expected_dtype="object", imputation="mode", outlier="none", scaling="none", encoding="frequency"),
}
PREP_COLS = list(PREP_CONFIG)
PREP_SQL = f"""{SIDES}, r0 AS (SELECT DISTINCT qty, price, sparse, flat, flag, l_linestatus, word FROM ref),
typed_r AS (SELECT qty, CASE WHEN price >= 0 AND NOT isinf(price) THEN price END AS price, CASE WHEN lower(trim(flag)) NOT IN ('n/a', 'unknown') THEN flag END AS flag, l_linestatus, word FROM r0),
typed_p AS (SELECT qty, CASE WHEN price >= 0 AND NOT isinf(price) THEN price END AS price, CASE WHEN lower(trim(flag)) NOT IN ('n/a', 'unknown') THEN flag END AS flag, l_linestatus, word FROM prod),
b AS (SELECT quantile_cont(qty, 0.01) AS ql, quantile_cont(qty, 0.99) AS qh, avg(price) - 3.5 * stddev_pop(price) AS pl, avg(price) + 3.5 * stddev_pop(price) AS ph FROM typed_r),
fix_r AS (SELECT CASE WHEN qty IS NOT NULL THEN greatest(least(qty, qh), ql) END AS qty, CASE WHEN price IS NOT NULL THEN greatest(least(price, ph), pl) END AS price, flag, l_linestatus, word FROM typed_r, b),
fix_p AS (SELECT CASE WHEN qty IS NOT NULL THEN greatest(least(qty, qh), ql) END AS qty, CASE WHEN price IS NOT NULL THEN greatest(least(price, ph), pl) END AS price, flag, l_linestatus, word FROM typed_p, b),
fills AS (SELECT quantile_cont(qty, 0.5) AS fq, avg(price) AS fp, (SELECT flag FROM fix_r WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, flag LIMIT 1) AS ff FROM fix_r),
sc AS (SELECT quantile_cont(coalesce(qty, fq), 0.5) AS c1, quantile_cont(coalesce(qty, fq), 0.75) - quantile_cont(coalesce(qty, fq), 0.25) AS s1, avg(coalesce(price, fp)) AS c2, stddev_pop(coalesce(price, fp)) AS s2 FROM fix_r, fills),
fr AS (SELECT word, count(*) / (SELECT count(*) FROM fix_r) AS share FROM fix_r GROUP BY 1),
o AS (SELECT (coalesce(qty, fq) - c1) / s1 AS qty, (coalesce(price, fp) - c2) / s2 AS price, CASE WHEN l_linestatus = 'F' THEN 0.0 ELSE 1.0 END::DOUBLE AS l_linestatus,
  (coalesce(flag, ff) = 'A')::INT::DOUBLE AS "flag_A", (coalesce(flag, ff) = 'N')::INT::DOUBLE AS "flag_N", (coalesce(flag, ff) = 'R')::INT::DOUBLE AS "flag_R", coalesce(share, 0) AS word
  FROM fix_p LEFT JOIN fr USING (word), fills, sc)
SELECT count(*) AS rows, {', '.join(f'round(avg("{c}"), 4) AS "{c}"' for c in ('qty', 'price', 'l_linestatus', 'flag_A', 'flag_N', 'flag_R', 'word'))} FROM o"""


def fitted(t: Tables):
    ref, prod = sides(t)
    return transform.prepare(ref.select(*PREP_COLS), prod.select(*PREP_COLS), PREP_CONFIG)


def column_means(df):
    return rounded(df.agg(F.count("*").alias("rows"), *[F.avg(F.col(c).cast("double")).alias(c) for c in df.columns]), 4)


@query("fit_and_transform", PREP_SQL)
def fit_and_transform(t: Tables):
    _, _, prod = fitted(t)
    return column_means(prod)


@query("saved_preparation", PREP_SQL)
def saved_preparation(t: Tables):
    from ..session import scratch_path

    prep, _, _ = fitted(t)
    path = scratch_path(t.spark, "preparation")
    prep.save(t.spark, path)
    _, prod = sides(t)
    return column_means(transform.Preparation.load(t.spark, path).transform(prod.select(*PREP_COLS)))


# training rows read the totals of the other folds, production rows all of them
TARGET_CONFIG = {
    "p_partkey": ColumnConfig("p_partkey", outlier="none", scaling="none", imputation="none"),
    "p_brand": ColumnConfig("p_brand", expected_dtype="object", imputation="mode", outlier="none", scaling="none", encoding="target"),
}


@query(
    "prepare_with_target_encoding",
    f"""{PARTS}, t AS (SELECT *, floor(('0x' || substr(md5(p_partkey::VARCHAR || ':42'), 1, 8))::BIGINT / 4294967296.0 * 5)::INT AS fold, p_retailprice AS y FROM ref), f AS (SELECT DISTINCT fold FROM t),
    w AS (SELECT f.fold, avg(y) AS m, var_pop(y) AS v FROM f JOIN t ON t.fold <> f.fold GROUP BY 1), c AS (SELECT f.fold, p_brand, count(*) AS n, avg(y) AS mean, var_pop(y) AS var FROM f JOIN t ON t.fold <> f.fold GROUP BY ALL),
    own AS (SELECT t.p_brand, t.fold, coalesce({SHRINK}, m) AS code FROM t JOIN w USING (fold) LEFT JOIN c USING (p_brand, fold)),
    w2 AS (SELECT avg(y) AS m, var_pop(y) AS v FROM t), c2 AS (SELECT p_brand, count(*) AS n, avg(y) AS mean, var_pop(y) AS var FROM t GROUP BY 1),
    other AS (SELECT p.p_brand, coalesce({SHRINK}, m) AS code FROM prod p LEFT JOIN c2 USING (p_brand), w2)
    SELECT 'reference' AS side, round(code, 1) AS code, count(*) AS rows FROM own GROUP BY ALL UNION ALL SELECT 'production', round(code, 1), count(*) FROM other GROUP BY ALL""",
)
def prepare_with_target_encoding(t: Tables):
    ref, prod = parts(t)
    cols = ["p_partkey", "p_brand", "p_retailprice"]
    _, training, ready = transform.prepare(ref.select(*cols), prod.select(*cols), TARGET_CONFIG, "p_retailprice", order_by=["p_partkey"])
    side = lambda df, name: df.select(F.lit(name).alias("side"), F.round(F.col("p_brand").cast("double"), 1).alias("code"))
    return side(training, "reference").unionAll(side(ready, "production")).groupBy("side", "code").agg(F.count("*").alias("rows"))


@query("stream_saved_preparation", PREP_SQL)
def stream_saved_preparation(t: Tables):
    from ..session import scratch_path
    from ..streaming import streams

    prep, _, _ = fitted(t)
    path = scratch_path(t.spark, "preparation")
    prep.save(t.spark, path)
    _, prod = sides(t)
    prod.select(*PREP_COLS).write.parquet(f"{path}/incoming")
    incoming = streams.read_stream(t.spark, f"{path}/incoming", t.spark.read.parquet(f"{path}/incoming").schema)
    return column_means(streams.drain(transform.Preparation.load(t.spark, path).transform(incoming), "prepared"))
