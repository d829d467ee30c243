"""Fitted transforms: learn numbers on a reference table, apply them as a projection and lookups."""

from __future__ import annotations

import json
import time
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import NumericType

from ..functions.frames import local_frame
from ..functions.quantiles import clean_double, exact_quantiles
from ..session import materialize, scratch_path
from . import clean
from .evaluate import split_point
from .knn import knn_impute
from .profile import ColumnConfig, check_config, processing_audit, route_columns

# A lookup up to this many categories is collected and becomes a local relation that is broadcast;
# a larger one is written below the shared folder and joined without a hint.
LOOKUP_LIMIT = 50_000
# Categories of one range when they are put in order by many tasks.
RANGE_KEYS = 1_000_000
# Column that carries the fold of a training row through the preparation.
FOLD = "__part"


# ---- outliers ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Limits:
    """What an outlier treatment learned: bounds to clip to, or the shift of a logarithm."""

    lower: float | None = None
    upper: float | None = None
    shift: float | None = None

    @classmethod
    def around(cls, low: float, high: float, reach: float) -> "Limits":
        return cls(low - reach, high + reach)


def _quartile_limits(q: Sequence[float], _: Mapping[str, float], z: float) -> Limits:
    return Limits.around(q[0], q[1], 1.5 * (q[1] - q[0]))


def _deviation_limits(_: Sequence[float], m: Mapping[str, float], z: float) -> Limits:
    return Limits.around(m["mean"], m["mean"], z * (m["std"] if m["std"] > 1e-10 else 1.0))


#: Strategy -> (quantiles it needs; "tails" stands for the caller's, limits from those quantiles and the column's moments).
OUTLIER_RULES = {
    "clip": ("tails", lambda q, m, z: Limits(*q)),
    "iqr_clip": ((0.25, 0.75), _quartile_limits),
    "iqr_remove": ((0.25, 0.75), _quartile_limits),
    "zscore_clip": ((), _deviation_limits),
    "log": ((), lambda q, m, z: Limits(shift=1.0 - m["min"] if m["min"] <= 0 else 0.0)),
}


def fit_outliers(df: DataFrame, strategies: Mapping[str, str], lower: float = 0.01, upper: float = 0.99, z: float = 3.5, min_values: int = 10) -> dict[str, Limits]:
    """Limits per column: one aggregate and one quantile pass. Columns with fewer than ``min_values`` values stay as they are."""
    wanted = {c: OUTLIER_RULES.get(s) for c, s in strategies.items() if s != "none"}
    if unknown := [c for c, rule in wanted.items() if rule is None]:
        raise ValueError(f"{unknown[0]}: unknown outlier strategy {strategies[unknown[0]]!r}")
    if not wanted:
        return {}
    df = df.select(*[clean_double(F.col(c)).alias(c) for c in wanted])
    moments = {"n": F.count, "mean": F.avg, "std": F.stddev_pop, "min": F.min}
    row = df.agg(*[F.struct(*[f(c).alias(k) for k, f in moments.items()]).alias(c) for c in wanted]).first()
    learned = {c: row[c].asDict() for c in wanted if row[c]["n"] >= min_values}
    probs = {c: [lower, upper] if wanted[c][0] == "tails" else list(wanted[c][0]) for c in learned}
    quantiles = exact_quantiles(df, {c: p for c, p in probs.items() if p}, n={c: learned[c]["n"] for c, p in probs.items() if p})
    return {c: wanted[c][1](quantiles.get(c, ()), m, z) for c, m in learned.items()}


def outlier_expr(col: Column, limits: Limits | None) -> Column:
    if limits is None:
        return col
    if limits.shift is not None:
        # A value below the fitted minimum has no logarithm; it counts as missing.
        return F.when(col + limits.shift > -1.0, F.log1p(col + limits.shift))
    return F.when(col.isNotNull(), F.greatest(F.least(col, F.lit(limits.upper)), F.lit(limits.lower)))


def apply_outliers(df: DataFrame, params: Mapping[str, Limits]) -> DataFrame:
    return df.withColumns({c: outlier_expr(F.col(c).cast("double"), p) for c, p in params.items() if c in df.columns})


# ---- imputation and scaling -------------------------------------------------------------------------------


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, object]:
    """Most frequent value per column, the smallest on ties, over counts that are summed map-side."""
    out = {}
    for c in cols:
        row = df.where(F.col(c).isNotNull()).groupBy(c).count().agg(F.min_by(c, F.struct(-F.col("count"), F.col(c))).alias("mode")).first()
        out[c] = row["mode"]
    return out


def fit_fills(df: DataFrame, configs: Mapping[str, tuple[str, object]]) -> dict[str, float]:
    """Fill value per numeric column from (strategy, constant); a column without values gets 0."""
    by = lambda kind: [c for c, (s, _) in configs.items() if s == kind]
    out: dict[str, float] = {}
    means, medians, modes = by("mean"), by("median"), by("mode")
    if means or medians:
        row = df.agg(*[F.avg(c).alias(c) for c in means], *[F.count(c).alias(f"n|{c}") for c in medians]).first()
        out.update({c: row[c] for c in means})
        found = exact_quantiles(df, {c: [0.5] for c in medians}, n={c: row[f"n|{c}"] for c in medians})
        out.update({c: v[0] if v else None for c, v in found.items()})
    if modes:
        out.update(fit_modes(df, modes))
    out.update({c: float(configs[c][1] or 0) for c in by("constant")})
    return {c: 0.0 if v is None else float(v) for c, v in out.items()}


def fit_scalers(df: DataFrame, strategies: Mapping[str, str]) -> dict[str, dict]:
    """Centre and divisor per column; a zero spread becomes 1."""
    aggs = []
    for c, s in strategies.items():
        if s == "standard":
            aggs += [F.avg(c).alias(f"a|{c}"), F.stddev_pop(c).alias(f"b|{c}")]
        elif s == "minmax":
            aggs += [F.min(c).alias(f"a|{c}"), F.max(c).alias(f"b|{c}")]
        elif s == "robust":
            aggs.append(F.count(c).alias(f"n|{c}"))
    row = df.agg(*aggs).first().asDict() if aggs else {}
    robust = [c for c, s in strategies.items() if s == "robust"]
    quantiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in robust}, n={c: row[f"n|{c}"] for c in robust})
    out = {}
    for c, s in strategies.items():
        if s == "standard":
            centre, spread = row[f"a|{c}"], row[f"b|{c}"]
        elif s == "minmax":
            centre = row[f"a|{c}"]
            spread = None if centre is None else row[f"b|{c}"] - centre
        elif s == "robust":
            q = quantiles[c]
            centre, spread = (q[1], q[2] - q[0]) if q else (None, None)
        else:
            out[c] = {"strategy": s}
            continue
        out[c] = {"strategy": s, "centre": centre or 0.0, "spread": spread or 1.0}
    return out


def scale_expr(col: Column, params: dict) -> Column:
    if params["strategy"] == "none":
        return col
    if params["strategy"] == "log":
        return F.when(col > -1.0, F.log1p(col))
    return (col - params["centre"]) / params["spread"]


# ---- encoders ---------------------------------------------------------------------------------------------


@dataclass
class Lookup:
    """Category -> number; ``rows`` for a collected one, ``path`` for a written one."""

    default: float
    rows: list | None = None
    path: str | None = None

    def frame(self, spark: SparkSession) -> DataFrame:
        if self.rows is not None:
            return F.broadcast(local_frame(spark, [tuple(r) for r in self.rows], "lk string, lv double"))
        return spark.read.parquet(self.path)


def make_lookup(df: DataFrame, default: float, limit: int = LOOKUP_LIMIT) -> Lookup:
    """Collect a (lk, lv) table if it is small, else write it below the shared folder."""
    head = df.limit(limit + 1).collect()
    if len(head) <= limit:
        return Lookup(default, rows=sorted([r["lk"], r["lv"]] for r in head))
    path = scratch_path(df.sparkSession, "lookup")
    df.write.parquet(path)
    return Lookup(default, path=path)


def apply_lookup(df: DataFrame, key: str, lookup: Lookup, out: str) -> DataFrame:
    """Left join on the category. A hot category on the big side is split by the skew-join rule."""
    pairs = lookup.frame(df.sparkSession)
    joined = df.join(pairs, df[key].cast("string") == pairs["lk"], "left")
    return joined.withColumn(out, F.coalesce("lv", F.lit(lookup.default))).drop("lk", "lv")


def category_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("lk")).agg(F.count("*").alias("n"))


def small_counts(df: DataFrame, cols: Sequence[str], limit: int = LOOKUP_LIMIT) -> dict[str, dict[str, int]] | None:
    """Counts per category of several columns in one pass, or ``None`` if there are more than ``limit`` in all."""
    if not cols:
        return {}
    cells = ", ".join(f"`{c}`" for c in cols)
    texts = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = df.sparkSession.sql(f"SELECT column, value FROM {{t}} UNPIVOT (value FOR column IN ({cells}))", t=texts)
    rows = long.groupBy("column", "value").count().limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    out: dict[str, dict[str, int]] = {c: {} for c in cols}
    for r in rows:
        out[r["column"]][r["value"]] = r["count"]
    return out


def fit_frequency(df: DataFrame, col: str, unknown: str = "zero", limit: int = LOOKUP_LIMIT) -> Lookup:
    """Share of each category among the non-null values."""
    total = df.agg(F.count(col).alias("n")).first()["n"]
    shares = category_counts(df, col).select("lk", (F.col("n") / F.lit(total or 1)).alias("lv"))
    default = 0.0
    if unknown == "mean":
        default = shares.agg(F.avg("lv").alias("m")).first()["m"] or 0.0
    return make_lookup(shares, default, limit)


def positions(keys: DataFrame, range_keys: int = RANGE_KEYS) -> DataFrame:
    """``(lk, lv)``: the position of each distinct ``lk`` in sorted order.

    Ranges of keys are sorted side by side and written; the number of keys in the ranges before, one row per range,
    is added to the place inside a range.
    """
    parts = keys.count() // range_keys + 1
    placed = keys.repartitionByRange(parts, "lk").sortWithinPartitions("lk").withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "positions").select("lk", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("inside"))
    before, offsets = 0, []
    for r in sorted(placed.groupBy("part").count().collect()):
        offsets.append((r["part"], before))
        before += r["count"]
    ranges = F.broadcast(local_frame(keys.sparkSession, offsets, "part long, before long"))
    return placed.join(ranges, "part").select("lk", (F.col("before") + F.col("inside")).cast("double").alias("lv"))


def fit_ordinal(df: DataFrame, col: str, categories: Sequence | None = None, limit: int = LOOKUP_LIMIT, range_keys: int = RANGE_KEYS) -> Lookup:
    """Position of each category in the given or sorted order, whatever their number."""
    if categories is not None:
        return Lookup(-1.0, rows=[[str(c), float(i)] for i, c in enumerate(categories)])
    return make_lookup(positions(category_counts(df, col).select("lk"), range_keys), -1.0, limit)


def fit_onehot(df: DataFrame, col: str, limit: int) -> list[str]:
    found = category_counts(df, col).select("lk").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"{col}: more than {limit} categories for one-hot encoding")
    return sorted(r["lk"] for r in found)


def onehot_columns(col: str, categories: Sequence[str]) -> list[Column]:
    return [F.when(F.col(col).cast("string") == c, 1.0).otherwise(0.0).cast("float").alias(f"{col}_{c}") for c in categories]


def shrunk_mean(n: Column, mean: Column, var: Column, all_mean: Column, all_var: Column) -> Column:
    """Empirical-Bayes mean: weight of the category is ``n * all_var / (n * all_var + var)``."""
    weight = F.try_divide(n * all_var, n * all_var + var)
    return F.when(weight.isNull(), all_mean).otherwise(weight * mean + (1 - weight) * all_mean)


def target_stats(df: DataFrame, col: str, target: str) -> DataFrame:
    y = F.col(target).cast("double")
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("lk")).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean"), F.var_pop(y).alias("var")
    )


def fit_target(df: DataFrame, col: str, target: str) -> Lookup:
    y = F.col(target).cast("double")
    whole = df.where(F.col(col).isNotNull()).agg(F.avg(y).alias("m"), F.var_pop(y).alias("v")).first()
    encoded = target_stats(df, col, target).select(
        "lk", shrunk_mean(F.col("n"), F.col("mean"), F.col("var"), F.lit(whole["m"]), F.lit(whole["v"])).alias("lv")
    )
    return make_lookup(encoded, whole["m"] or 0.0)


def cross_fit_target(df: DataFrame, col: str, target: str, fold: Column, out: str, folds: int = 5) -> DataFrame:
    """Encode each training row with the other folds only: category totals minus those of its own fold.

    Moments per (category, fold) are summed map-side; the table of categories x folds is joined back.
    """
    y = F.col(target).cast("double")
    # Centring on the overall mean keeps the sums of squares well conditioned.
    centre = df.agg(F.avg(y).alias("m")).first()["m"] or 0.0
    tagged = df.withColumn("__fold", fold)
    cells = (
        tagged.groupBy(F.col(col).cast("string").alias("lk"), F.col("__fold").alias("lf"))
        .agg(F.count(y).alias("n"), F.sum(y - centre).alias("s"), F.sum((y - centre) * (y - centre)).alias("q"))
        .where("lk IS NOT NULL")
    )
    per_cat = cells.groupBy("lk").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"), F.sum("q").alias("cq"))
    per_fold = cells.groupBy("lf").agg(F.sum("n").alias("fn"), F.sum("s").alias("fs"), F.sum("q").alias("fq"))
    whole = cells.agg(F.sum("n").alias("an"), F.sum("s").alias("as_"), F.sum("q").alias("aq")).first()
    rest = per_fold.select(
        "lf", (F.lit(whole["an"]) - F.col("fn")).alias("rn"), (F.lit(whole["as_"]) - F.col("fs")).alias("rs"), (F.lit(whole["aq"]) - F.col("fq")).alias("rq")
    )
    mean_rest = F.try_divide(F.col("rs"), F.col("rn"))
    var_rest = F.try_divide(F.col("rq"), F.col("rn")) - mean_rest * mean_rest
    n, s, q = F.col("cn") - F.col("n"), F.col("cs") - F.col("s"), F.col("cq") - F.col("q")
    mean = F.try_divide(s, n)
    var = F.greatest(F.try_divide(q, n) - mean * mean, F.lit(0.0))
    encoded = (
        cells.join(per_cat, "lk")
        .join(F.broadcast(rest), "lf")
        .select("lk", "lf", (F.when(n > 0, shrunk_mean(n, mean, var, mean_rest, var_rest)).otherwise(mean_rest) + centre).alias("lv"))
    )
    joined = tagged.join(encoded, (tagged[col].cast("string") == encoded["lk"]) & (tagged["__fold"] == encoded["lf"]), "left")
    return joined.withColumn(out, F.coalesce("lv", F.lit(centre))).drop("lk", "lf", "lv", "__fold")


# ---- safety checks after the transforms -------------------------------------------------------------------


def constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> list[str]:
    """Numeric columns with at most one distinct value, NULL counted as a value."""
    cols = [f.name for f in df.schema.fields if f.name not in keep and isinstance(f.dataType, NumericType)]
    if not cols:
        return []
    aggs = [F.count("*").alias("rows")]
    for c in cols:
        aggs += [F.count(c).alias(f"n|{c}"), F.min(c).alias(f"lo|{c}"), F.max(c).alias(f"hi|{c}")]
    row = df.agg(*aggs).first().asDict()
    return [c for c in cols if row[f"n|{c}"] == 0 or (row[f"n|{c}"] == row["rows"] and row[f"lo|{c}"] == row[f"hi|{c}"])]


def leakage(df: DataFrame, target: str, threshold: float = 0.99) -> DataFrame:
    """``(feature, correlation, leaks)`` of every numeric feature with the target, in one aggregate."""
    cols = [f.name for f in df.schema.fields if f.name != target and isinstance(f.dataType, NumericType)]
    y = F.col(target).cast("double")
    wide = df.agg(*[F.corr(F.col(c).cast("double"), y).alias(c) for c in cols])
    cells = [F.struct(F.lit(c).alias("feature"), F.abs(F.col(c)).alias("correlation")) for c in cols]
    out = wide.select(F.inline(F.array(*cells)))
    return out.withColumn("correlation", F.when(~F.isnan("correlation"), F.col("correlation"))).withColumn(
        "leaks", F.coalesce(F.col("correlation") > threshold, F.lit(False))
    )


# ---- the whole preparation --------------------------------------------------------------------------------


@dataclass
class Preparation:
    """Numbers learned on the reference; ``transform`` uses nothing else."""

    columns: dict[str, str]
    configs: dict[str, ColumnConfig]
    routes: dict[str, list[str]]
    outliers: dict[str, Limits]
    fills: dict[str, object]
    scalers: dict[str, dict]
    lookups: dict[str, Lookup] = field(default_factory=dict)
    onehot: dict[str, list[str]] = field(default_factory=dict)
    dropped: list[str] = field(default_factory=list)
    constants: list[str] = field(default_factory=list)
    target: str | None = None
    donors: str | None = None
    #: Features that all but give the target away, found on the training rows.
    leaks: list[str] = field(default_factory=list)

    def fixed(self, df: DataFrame) -> DataFrame:
        """Alignment, value fixes and outlier treatment; the target and the fold of a training row ride along."""
        keep = [self.target] if self.target in df.columns else []
        own = [c for c in (FOLD,) if c in df.columns]
        carried = df.select(*[F.col(c).alias(f"__{c}") for c in keep], *own, *[c for c in df.columns if c in self.columns])
        have = set(carried.columns)
        aligned = carried.select(
            *[f"__{c}" for c in keep],
            *own,
            *[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in self.columns.items()],
        )
        return apply_outliers(clean.fix_types(aligned, self.configs), self.outliers)

    def transform(self, df: DataFrame) -> DataFrame:
        """Works on batch and streaming tables; only a KNN column needs a batch table."""
        out = self.fixed(df)
        if self.routes["knn"]:
            out = knn_impute(out, df.sparkSession.read.parquet(self.donors), self.routes["knn"])
        cats = self.routes["ordinal"] + self.routes["onehot"] + self.routes["frequency"] + self.routes["target"]
        filled = {c: F.coalesce(F.col(c).cast("string"), F.lit(self.fills[c])) for c in cats if self.fills.get(c) is not None}
        out = out.withColumns(filled) if filled else out
        for c in self.routes["ordinal"] + self.routes["frequency"] + self.routes["target"]:
            if c in self.routes["target"] and FOLD in out.columns:
                out = cross_fit_target(out, c, f"__{self.target}", F.col(FOLD), f"{c}__code")
            else:
                out = apply_lookup(out, c, self.lookups[c], f"{c}__code")
        keep = [c for c in out.columns if c == f"__{self.target}"]
        cells = []
        for c in self.routes["numeric"] + self.routes["knn"]:
            value = F.coalesce(F.col(c), F.lit(self.fills[c])) if c in self.fills else F.col(c)
            cells.append(scale_expr(value, self.scalers[c]).alias(c))
        cells += [F.col(f"{c}__code").alias(c) for c in self.routes["ordinal"]]
        for c in self.routes["onehot"]:
            cells += onehot_columns(c, self.onehot[c])
        cells += [F.col(f"{c}__code").cast("float").alias(c) for c in self.routes["frequency"]]
        cells += [F.col(f"{c}__code").alias(c) for c in self.routes["target"]]
        cells += [F.col(c) for c in self.routes["passthrough"]]
        wide = out.select(*cells, *[F.col(c).alias(self.target) for c in keep])
        own = [self.target] if keep else []
        wide = wide.select(*[c for c in wide.columns if c not in self.constants])
        return clean.finish(clean.drop_non_numeric(wide, own), own)

    def training_rows(self, df: DataFrame, key: Sequence[str], folds: int = 5, seed: int = 42) -> DataFrame:
        """``transform`` for the rows the preparation was fitted on: target encodings come from the other folds only.

        A row's fold is a hash of its ``key``, so its own target never reaches its features.
        """
        if not self.routes["target"]:
            return self.transform(df)
        return self.transform(df.withColumn(FOLD, F.floor(split_point(key, seed) * folds)))

    # -- persistence --

    def params(self, spark: SparkSession) -> DataFrame:
        """Everything learned as ``(column, key, value)`` rows."""
        rows = [("", "columns", json.dumps(self.columns)), ("", "routes", json.dumps(self.routes)), ("", "target", json.dumps(self.target))]
        rows += [("", "constants", json.dumps(self.constants)), ("", "dropped", json.dumps(self.dropped)), ("", "donors", json.dumps(self.donors)), ("", "leaks", json.dumps(self.leaks))]
        for key, values in (("outlier", {c: asdict(v) for c, v in self.outliers.items()}), ("fill", self.fills), ("scaler", self.scalers), ("onehot", self.onehot)):
            rows += [(c, key, json.dumps(v)) for c, v in values.items()]
        rows += [(c, "config", json.dumps(asdict(v))) for c, v in self.configs.items()]
        rows += [(c, "lookup", json.dumps(asdict(v))) for c, v in self.lookups.items()]
        return local_frame(spark, rows, "column string, key string, value string")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the numbers, the large lookups and the donor rows below ``path``; nothing saved points elsewhere."""
        lookups = dict(self.lookups)
        for i, (c, lookup) in enumerate(sorted(lookups.items())):
            if lookup.path is not None:
                spark.read.parquet(lookup.path).write.parquet(f"{path}/lookup-{i}")
                lookups[c] = replace(lookup, path=f"lookup-{i}")
        if self.donors is not None:
            spark.read.parquet(self.donors).write.parquet(f"{path}/donors")
        own = replace(self, lookups=lookups, donors=None if self.donors is None else "donors")
        own.params(spark).write.parquet(f"{path}/params")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Preparation":
        by: dict[str, dict] = {}
        for r in spark.read.parquet(f"{path}/params").collect():
            by.setdefault(r["key"], {})[r["column"]] = json.loads(r["value"])
        configs = {}
        for c, v in by.get("config", {}).items():
            v = {k: tuple(x) if isinstance(x, list) else x for k, x in v.items()}
            configs[c] = ColumnConfig(**v)
        one = lambda key: by[key][""]
        below = lambda name: None if name is None else f"{path}/{name}"
        return cls(
            one("columns"), configs, one("routes"), {c: Limits(**v) for c, v in by.get("outlier", {}).items()}, by.get("fill", {}), by.get("scaler", {}),
            {c: Lookup(**v | {"path": below(v["path"])}) for c, v in by.get("lookup", {}).items()},
            by.get("onehot", {}), one("dropped"), one("constants"), one("target"), below(one("donors")), one("leaks"),
        )


def fit_preparation(
    ref: DataFrame,
    configs: Mapping[str, ColumnConfig],
    target: str | None = None,
    max_null_rate: float = 0.70,
    min_variance: float = 1e-8,
) -> Preparation:
    """Learn every parameter on the reference, one stage after the other."""
    for cfg in configs.values():
        check_config(cfg)
    features, target = clean.split_target(ref, target)
    X = ref.select(*features)
    dropped = [r["column"] for r in clean.columns_to_drop(X, max_null_rate, min_variance).collect()]
    kinds = {f.name: f.dataType.simpleString() for f in X.schema.fields if f.name not in dropped}
    prep = Preparation(kinds, {c: v for c, v in configs.items() if c in kinds}, {}, {}, {}, {}, dropped=dropped, target=target)
    typed = clean.fix_types(ref.select(*kinds), prep.configs)
    prep.routes = route_columns(typed, prep.configs, target)
    numbers = prep.routes["numeric"] + prep.routes["knn"]
    prep.outliers = fit_outliers(typed, {c: prep.configs[c].outlier for c in numbers})
    fixed = prep.fixed(ref)
    plain = prep.routes["numeric"]
    prep.fills = dict(fit_fills(fixed, {c: (prep.configs[c].imputation, prep.configs[c].constant) for c in plain if prep.configs[c].imputation != "none"}))
    filled = fixed
    if prep.routes["knn"]:
        prep.donors = scratch_path(ref.sparkSession, "donors")
        fixed.select(*prep.routes["knn"]).write.parquet(prep.donors)
        filled = knn_impute(fixed, ref.sparkSession.read.parquet(prep.donors), prep.routes["knn"])
    filled = filled.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in prep.fills.items()}) if prep.fills else filled
    scaling = {c: prep.configs[c].scaling for c in plain} | {c: "robust" for c in prep.routes["knn"]}
    prep.scalers = fit_scalers(filled, scaling)
    cats = prep.routes["ordinal"] + prep.routes["onehot"] + prep.routes["frequency"] + prep.routes["target"]
    counts = small_counts(fixed, cats)
    if counts is not None:
        _encode_from_counts(prep, counts, fixed)
        modes = {c: prep.fills[c] for c in cats}
    else:
        modes = fit_modes(fixed, cats)
        prep.fills.update(modes)
    seen = fixed.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in modes.items() if m is not None}) if modes else fixed
    if counts is None:
        for c in prep.routes["ordinal"]:
            prep.lookups[c] = fit_ordinal(seen, c, prep.configs[c].ordinal_categories)
        for c in prep.routes["onehot"]:
            prep.onehot[c] = fit_onehot(seen, c, prep.configs[c].onehot_max)
        for c in prep.routes["frequency"]:
            prep.lookups[c] = fit_frequency(seen, c)
    for c in prep.routes["target"]:
        prep.lookups[c] = fit_target(seen, c, f"__{target}")
    prep.constants = constant_columns(prep.transform(ref), [target] if target else [])
    return prep


def _encode_from_counts(prep: Preparation, counts: dict[str, dict[str, int]], fixed: DataFrame) -> None:
    """Modes and encoders of all categorical columns from their counts; missing values count for the mode."""
    rows = fixed.count() if counts else 0
    for c, n in counts.items():
        mode = min(n, key=lambda v: (-n[v], v)) if n else None
        prep.fills[c] = mode
        if c in prep.routes["ordinal"]:
            given = prep.configs[c].ordinal_categories
            prep.lookups[c] = Lookup(-1.0, rows=[[str(v), float(i)] for i, v in enumerate(given if given is not None else sorted(n))])
        elif c in prep.routes["onehot"]:
            prep.onehot[c] = sorted(n)
        elif c in prep.routes["frequency"]:
            missing = rows - sum(n.values()) if mode is not None else 0
            filled = {v: k + (missing if v == mode else 0) for v, k in n.items()}
            prep.lookups[c] = Lookup(0.0, rows=sorted([v, k / max(1, sum(filled.values()))] for v, k in filled.items()))


def prepare(
    ref: DataFrame, prod: DataFrame, configs: Mapping[str, ColumnConfig], target: str | None = None, order_by: Sequence[str] | None = None, audit: list[DataFrame] | None = None
) -> tuple[Preparation, DataFrame, DataFrame]:
    """Deduplicate the reference, fit on it, apply to both tables; the reference gets out-of-fold target encodings.

    Features that leak the target are named in ``leaks``. ``audit`` takes a report row for each step, with its duration.
    """
    features, _ = clean.split_target(ref, target)
    key = list(order_by or ref.columns)
    started = time.monotonic()
    # every fitting stage reads the distinct rows again, so the shuffle behind them runs once
    distinct = materialize(clean.keep_first(ref, features, key), "reference")
    deduplicated = time.monotonic()
    prep = fit_preparation(distinct, configs, target)
    training, ready = prep.training_rows(distinct, key), prep.transform(prod)
    if target:
        prep.leaks = sorted(r.feature for r in leakage(training, target).where("leaks").collect())
    fitted = time.monotonic()
    if audit is not None:
        audit += [
            processing_audit(ref, distinct, "deduplicate", deduplicated - started),
            processing_audit(distinct, training, "prepare_reference", fitted - deduplicated, [f"leaks_target:{c}" for c in prep.leaks]),
            processing_audit(prod, ready, "prepare_production"),
        ]
    return prep, training, ready
