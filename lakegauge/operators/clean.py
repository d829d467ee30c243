"""Row operations and value fixes that need no fitted numbers, plus the structural fit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, NumericType, StringType, TimestampNTZType, TimestampType

from .profile import ColumnConfig

# Strings that stand for a missing value, and words for true and false.
NULL_TOKENS = ["", "na", "n/a", "nan", "null", "none", "nil", "?", "-", "--", ".", "unknown", "missing", "#n/a", "#null!", "#ref!", "#value!"]
TRUE_WORDS = ["true", "yes", "1", "t", "y", "on"]
FALSE_WORDS = ["false", "no", "0", "f", "n", "off"]
NOT_NUMERIC = r"[^\d.\-+eE]"


def null_tokens(col: Column) -> Column:
    return F.when(~F.lower(F.trim(col)).isin(NULL_TOKENS), col)


def bool_words(col: Column) -> Column:
    word = F.lower(F.trim(col))
    return F.when(word.isin(TRUE_WORDS), 1.0).when(word.isin(FALSE_WORDS), 0.0)


def date_epoch(col: Column, fmt: str | None = None) -> Column:
    parsed = F.try_to_timestamp(col, F.lit(fmt)) if fmt else F.try_to_timestamp(col)
    return F.unix_seconds(parsed).cast("double")


def numeric_text(col: Column) -> Column:
    return F.regexp_replace(col, NOT_NUMERIC, "").try_cast("double")


def drop_infinite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def hard_range(col: Column, low: float | None, high: float | None) -> Column:
    keep = F.lit(True)
    if low is not None:
        keep = keep & (col >= low)
    if high is not None:
        keep = keep & (col <= high)
    return F.when(keep, col)


def allowed_only(col: Column, values: Sequence) -> Column:
    return F.when(col.cast("string").isin([str(v) for v in values]), col)


def fix_types(df: DataFrame, configs: Mapping[str, ColumnConfig]) -> DataFrame:
    """All value fixes as one projection."""
    out = []
    for f in df.schema.fields:
        cfg, col, kind = configs.get(f.name), F.col(f.name), f.dataType
        text = isinstance(kind, StringType)
        number = isinstance(kind, NumericType)
        if text:
            col = null_tokens(col)
        if cfg is not None and cfg.is_date:
            col = date_epoch(col, cfg.date_format) if text else F.unix_seconds(col.cast("timestamp")).cast("double")
            text, number = False, True
        elif cfg is not None and text and cfg.expected_dtype in ("bool", "boolean"):
            col, text, number = bool_words(col), False, True
        elif cfg is not None and text and cfg.expected_dtype in ("float64", "float32", "int64"):
            col, text, number = numeric_text(col), False, True
        elif isinstance(kind, BooleanType):
            col, number = col.cast("double"), True
        if number:
            col = drop_infinite(col.cast("double"))
            if cfg is not None:
                col = hard_range(col, cfg.min_value, cfg.max_value)
        if text and cfg is not None and cfg.allowed_values:
            col = allowed_only(col, cfg.allowed_values)
        out.append(col.alias(f.name))
    return df.select(*out)


def split_target(df: DataFrame, target: str | None) -> tuple[list[str], str | None]:
    """Feature names and the target, if the table has it."""
    features = [c for c in df.columns if c != target]
    return features, target if target in df.columns else None


def keep_first(df: DataFrame, features: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per distinct features: the first by ``order_by``; the other columns follow it.

    An aggregate, not a window: copies are reduced before the shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in features]
    if not rest:
        return df.select(*features).distinct()
    if len(rest) == 1 and rest[0] in order_by and set(order_by) <= set(df.columns):
        # rows of equal features differ in this column alone, null comes first: a number that needs no sorted groups
        kept = F.when(F.count(F.col(rest[0])) == F.count("*"), F.min(rest[0])).alias(rest[0])
        return df.groupBy(*features).agg(kept).select(*df.columns)
    first = F.min_by(F.struct(*rest), F.struct(*order_by)).alias("kept")
    grouped = df.groupBy(*features).agg(first)
    return grouped.select(*[F.col(c) if c in features else F.col(f"kept.{c}").alias(c) for c in df.columns])


def null_rates(df: DataFrame) -> DataFrame:
    """``(column, null_rate, variance)``; the variance of numeric columns is the population one."""
    aggs = []
    for f in df.schema.fields:
        aggs.append(F.avg(F.col(f.name).isNull().cast("double")).alias(f"rate|{f.name}"))
        numeric = isinstance(f.dataType, NumericType)
        aggs.append((F.var_pop(f.name) if numeric else F.lit(None).cast("double")).alias(f"var|{f.name}"))
    wide = df.agg(*aggs)
    cells = [
        F.struct(F.lit(c).alias("column"), F.col(f"`rate|{c}`").alias("null_rate"), F.col(f"`var|{c}`").alias("variance")) for c in df.columns
    ]
    return wide.select(F.inline(F.array(*cells)))


def columns_to_drop(df: DataFrame, max_null_rate: float = 0.70, min_variance: float = 1e-8) -> DataFrame:
    return null_rates(df).select(
        "column",
        F.when(F.col("null_rate") > max_null_rate, "null_rate").when(F.col("variance") < min_variance, "low_variance").alias("reason"),
    ).where("reason IS NOT NULL")


def align(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Exactly the given columns (name -> type): unknown ones go, missing ones come as NULL."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in columns.items()])


def finish(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Numeric NULL to 0 and 32-bit floats; ``keep`` stays as it is; repeated names are kept once."""
    out, seen = [], set()
    for f in df.schema.fields:
        if f.name in seen:
            continue
        seen.add(f.name)
        if f.name not in keep and isinstance(f.dataType, (NumericType, BooleanType)):
            out.append(F.coalesce(F.col(f.name).cast("float"), F.lit(0.0).cast("float")).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def drop_non_numeric(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    kinds = (NumericType, BooleanType)
    return df.select(*[f.name for f in df.schema.fields if f.name in keep or isinstance(f.dataType, kinds)])


def is_timestamp(kind) -> bool:
    return isinstance(kind, (TimestampType, TimestampNTZType))


def is_floating(kind) -> bool:
    return isinstance(kind, (DoubleType, FloatType))
