"""Column snapshots, top values, content hash and automatic column configuration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType, TimestampNTZType, TimestampType

from ..functions.frames import local_frame
from ..functions.quantiles import clean_double, exact_quantiles


def is_numeric(kind) -> bool:
    return isinstance(kind, NumericType)


def snapshot(df: DataFrame, sensitive: Sequence[str] = ()) -> DataFrame:
    """One row per column: type, nulls, exact distinct count and, unless sensitive, numeric summaries.

    Distinct counts are those of ``exact_distinct``, so no task holds a column's values.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    numeric = [c for c, k in kinds.items() if is_numeric(k) and c not in sensitive]
    aggs = [F.count("*").alias("rows")] + [F.count(F.col(c)).alias(f"n|{c}") for c in kinds]
    for c in numeric:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"mean|{c}"), F.stddev_samp(x).alias(f"std|{c}"), F.min(x).alias(f"min|{c}"), F.max(x).alias(f"max|{c}")]
    row = df.agg(*aggs).first().asDict()
    thirds = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in numeric}, n={c: row[f"n|{c}"] for c in numeric})
    unique = exact_distinct(df)
    rows = []
    for c, k in kinds.items():
        nulls = row["rows"] - row[f"n|{c}"]
        base = (c, k.simpleString(), nulls, nulls / row["rows"] * 100 if row["rows"] else 0.0, unique[c], c in numeric)
        if c in numeric and thirds[c] is not None:
            p25, median, p75 = thirds[c]
            rows.append((*base, row[f"mean|{c}"], row[f"std|{c}"], row[f"min|{c}"], p25, median, p75, row[f"max|{c}"]))
        else:
            rows.append((*base, *[None] * 7))
    return local_frame(
        df.sparkSession,
        rows,
        "column string, dtype string, null_count long, null_pct double, unique long, is_numeric boolean, mean double, std double, min double, "
        "p25 double, median double, p75 double, max double",
    )


#: Distinct values of a column that a task holds as a set; columns with more are counted through a shuffle.
SET_LIMIT = 10_000
#: A sketch's estimate settles a question only when it is this many times beyond the limit in question.
CLEAR = 4


def comparable(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """The columns with a type that can be grouped: maps, arrays and structs as texts."""
    nested = ("map", "array", "struct", "variant")
    return [(F.col(c).cast("string") if df.schema[c].dataType.simpleString().startswith(nested) else F.col(c)).alias(c) for c in cols]


def distinct_estimates(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Estimated distinct non-null values of all columns in one pass: a mergeable sketch of a few kB for each."""
    if not cols:
        return {}
    hashed = df.select(*comparable(df, cols))
    aggs = [F.hll_sketch_estimate(F.hll_sketch_agg(F.when(F.col(c).isNotNull(), F.xxhash64(c)))).alias(f"e{i}") for i, c in enumerate(cols)]
    row = hashed.agg(*aggs).first()
    return {c: float(row[f"e{i}"] or 0) for i, c in enumerate(cols)}


def set_sizes(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    """Exact distinct counts of columns whose sets are known to be small, in one pass without a shuffle of values."""
    if not cols:
        return {}
    row = df.select(*comparable(df, cols)).agg(*[F.size(F.collect_set(c)).alias(f"k{i}") for i, c in enumerate(cols)]).first()
    return {c: row[f"k{i}"] for i, c in enumerate(cols)}


def exact_distinct(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, int]:
    """Exact distinct counts over non-null values: small sets all at once, each larger column on its own in its own type."""
    cols = list(cols) if cols is not None else df.columns
    estimates = distinct_estimates(df, cols)
    out = set_sizes(df, [c for c in cols if estimates[c] <= SET_LIMIT])
    for c in cols:
        if c not in out:
            out[c] = df.select(*comparable(df, [c])).agg(F.count_distinct(c)).first()[0]
    return out


def distinct_up_to(df: DataFrame, cols: Sequence[str], limit: int) -> dict[str, int]:
    """Exact distinct counts up to ``limit``; ``limit + 1`` stands for more.

    Columns that a sketch puts far beyond the limit are settled by it; the others hold few values, which are counted as sets.
    """
    estimates = distinct_estimates(df, cols)
    near = [c for c in cols if estimates[c] <= CLEAR * limit + 100]
    sizes = set_sizes(df, near)
    return {c: min(sizes.get(c, limit + 1), limit + 1) for c in cols}


def all_distinct(df: DataFrame, col: str) -> bool:
    """Whether no non-null value repeats; meant for columns that a sketch puts near the number of rows."""
    return df.where(F.col(col).isNotNull()).groupBy(col).count().where("count > 1").isEmpty()


def top5(df: DataFrame, sensitive: Sequence[str] = (), k: int = 5) -> DataFrame:
    """Most frequent values of the non-numeric columns."""
    from .validate import top_values

    cols = [f.name for f in df.schema.fields if not is_numeric(f.dataType) and f.name not in sensitive]
    return top_values(df, cols, k)


def content_hash(df: DataFrame) -> DataFrame:
    """16 hex digits that depend on the rows, repeated ones included, but not on their order or partitioning.

    They come from sums over the quarters of each row's MD5, which have room for any number of rows.
    """
    # each value goes in with its length, NULL without one, so that no two rows share a text
    text = F.concat(*[F.coalesce(F.concat(F.length(v), F.lit(":"), v), F.lit("~")) for v in (F.col(c).cast("string") for c in df.columns)])
    quarters = [F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)") for i in range(4)]
    parts = df.select(F.md5(text).alias("h")).agg(F.count("*").alias("n"), *[F.coalesce(F.sum(q), F.lit(0)).alias(f"q{i}") for i, q in enumerate(quarters)])
    return parts.select("n", F.substring(F.sha2(F.concat_ws("|", "n", *[f"q{i}" for i in range(4)]), 256), 1, 16).alias("data_hash"))


# ---- automatic column configuration -----------------------------------------------------------------------


@dataclass(frozen=True)
class ColumnConfig:
    name: str
    expected_dtype: str = "float64"
    imputation: str = "median"  # mean, median, mode, constant, knn, none
    constant: float | str | None = None
    outlier: str = "clip"  # clip, zscore_clip, iqr_clip, iqr_remove, log, none
    scaling: str = "robust"  # standard, minmax, robust, log, none
    encoding: str = "none"  # onehot, ordinal, frequency, target, none
    onehot_max: int = 20
    ordinal_categories: tuple | None = None
    is_id: bool = False
    is_date: bool = False
    date_format: str | None = None
    allowed_values: tuple | None = None
    min_value: float | None = None
    max_value: float | None = None


IMPUTATIONS = {"mean", "median", "mode", "constant", "knn", "none"}
OUTLIERS = {"clip", "zscore_clip", "iqr_clip", "iqr_remove", "log", "none"}
SCALINGS = {"standard", "minmax", "robust", "log", "none"}
ENCODINGS = {"onehot", "ordinal", "frequency", "target", "none"}


def check_config(cfg: ColumnConfig) -> ColumnConfig:
    """Reject strategies that do not exist instead of replacing them silently."""
    for value, known in ((cfg.imputation, IMPUTATIONS), (cfg.outlier, OUTLIERS), (cfg.scaling, SCALINGS), (cfg.encoding, ENCODINGS)):
        if value not in known:
            raise ValueError(f"{cfg.name}: unknown strategy {value!r}")
    return cfg


def auto_config(df: DataFrame, target: str | None = None, ids: Sequence[str] = (), onehot_max: int = 10, skew_limit: float = 2.0) -> dict[str, ColumnConfig]:
    """Strategies per column from its null rate, cardinality, skew and minimum."""
    fields = [f for f in df.schema.fields if f.name != target and f.name not in ids]
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    texts = [f.name for f in fields if isinstance(f.dataType, StringType)]
    aggs = [F.count("*").alias("rows")]
    for c in numeric:
        x = clean_double(F.col(c))
        aggs += [F.count(x).alias(f"n|{c}"), F.skewness(x).alias(f"skew|{c}"), F.min(x).alias(f"min|{c}")]
    row = df.agg(*aggs).first().asDict()
    unique = distinct_up_to(df, texts, max(2, onehot_max, 100))
    whole = df.agg(*[F.count(c).alias(c) for c in texts]).first().asDict() if texts else {}
    sizes = distinct_estimates(df, [c for c in texts if whole[c] == row["rows"] > 100])
    keys = {c for c, k in sizes.items() if k * CLEAR > row["rows"] and all_distinct(df, c)}
    out: dict[str, ColumnConfig] = {}
    for f in fields:
        cfg = ColumnConfig(f.name)
        if isinstance(f.dataType, BooleanType):
            cfg = replace(cfg, expected_dtype="int64", imputation="constant", constant=0, outlier="none", scaling="none")
        elif f.name in numeric:
            n = row[f"n|{f.name}"]
            low = row[f"min|{f.name}"] if n else 0.0
            skew = row[f"skew|{f.name}"]
            long_tail = n >= 8 and skew is not None and abs(skew) > skew_limit and low >= 0
            cfg = replace(
                cfg,
                imputation="knn" if row["rows"] and 1 - n / row["rows"] > 0.20 else "median",
                outlier="log" if long_tail else "clip",
                scaling="standard" if long_tail else "robust",
                min_value=0.0 if low >= 0 else None,
            )
        elif f.name in texts:
            k = unique.get(f.name, 0)
            if f.name in keys:
                cfg = replace(cfg, is_id=True)
            else:
                encoding = "ordinal" if k <= 2 else "onehot" if k <= onehot_max else "frequency"
                cfg = replace(
                    cfg, expected_dtype="object", imputation="mode", outlier="none", scaling="none", encoding=encoding, onehot_max=onehot_max if encoding == "onehot" else 20
                )
        else:
            cfg = replace(cfg, imputation="none", outlier="none", scaling="none", is_date=isinstance(f.dataType, (TimestampType, TimestampNTZType)))
        out[f.name] = cfg
    return out


def config_frame(spark, configs: dict[str, ColumnConfig]) -> DataFrame:
    rows = [
        (c.name, c.is_id, c.imputation, c.outlier, c.scaling, c.encoding, c.min_value)
        for c in configs.values()
    ]
    return local_frame(
        spark, rows, "column string, is_id boolean, imputation string, outlier string, scaling string, encoding string, min_value double"
    )


def route_columns(df: DataFrame, configs: dict[str, ColumnConfig], target: str | None = None) -> dict[str, list[str]]:
    """Seven groups of columns; ids, dates and columns without a configuration are dropped."""
    routes: dict[str, list[str]] = {k: [] for k in ("numeric", "knn", "ordinal", "onehot", "frequency", "target", "passthrough", "dropped")}
    onehot = [c for c, cfg in configs.items() if cfg.encoding == "onehot" and not cfg.is_id and c in df.columns]
    unique = distinct_up_to(df, onehot, max((configs[c].onehot_max for c in onehot), default=1))
    for f in df.schema.fields:
        if f.name == target:
            continue
        cfg = configs.get(f.name)
        if cfg is None or cfg.is_id:
            routes["dropped"].append(f.name)
        elif is_numeric(f.dataType) or isinstance(f.dataType, BooleanType):
            routes["knn" if cfg.imputation == "knn" else "numeric"].append(f.name)
        elif isinstance(f.dataType, StringType):
            group = {"ordinal": "ordinal", "onehot": "onehot", "target": "target", "none": "passthrough"}.get(cfg.encoding, "frequency")
            if group == "onehot" and unique.get(f.name, 0) > cfg.onehot_max:
                group = "frequency"
            routes[group].append(f.name)
        else:
            routes["dropped"].append(f.name)
    return routes


def slice_columns(df: DataFrame, candidates: Sequence[str] | None = None, most: int = 3) -> list[str]:
    """The first columns with two to ten distinct values."""
    cols = list(candidates) if candidates is not None else df.columns
    unique = distinct_up_to(df, cols, 10)
    return [c for c in cols if 2 <= unique.get(c, 0) <= 10][:most]


def processing_audit(before: DataFrame, after: DataFrame, step: str = "process", seconds: float | None = None, warnings: Sequence[str] = ()) -> DataFrame:
    """Rows and columns in and out, dropped and added columns, how long the step took and what it warns of."""
    lost = sorted(set(before.columns) - set(after.columns))
    new = sorted(set(after.columns) - set(before.columns))

    def names(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    rows = before.select(F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(after.select(F.lit(0), F.lit(1)))
    return rows.agg(F.sum("i").alias("rows_in"), F.sum("o").alias("rows_out")).select(
        F.lit(step).alias("step"),
        "rows_in",
        "rows_out",
        F.lit(len(before.columns)).cast("long").alias("columns_in"),
        F.lit(len(after.columns)).cast("long").alias("columns_out"),
        names(lost).alias("dropped_columns"),
        names(new).alias("added_columns"),
        F.concat(F.when(F.col("rows_out") < F.col("rows_in"), F.array(F.lit("rows_removed"))).otherwise(F.array().cast("array<string>")), names(list(warnings))).alias("warnings"),
        F.lit(seconds).cast("double").alias("seconds"),
    )
