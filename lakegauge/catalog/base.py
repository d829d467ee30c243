"""Registry of runnable queries, each with its comparison SQL where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of one scale-factor folder as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, TimestampNTZType)]
        return df.withColumns({c: F.col(c).cast("timestamp") for c in stamps}) if stamps else df


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under ``name``; ``sql`` gives the same rows from the same tables."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return wrap


def rounded(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Round floating columns for a comparison between engines; ``special`` overrides single columns."""
    cols = []
    for f in df.schema.fields:
        if f.dataType.simpleString() in ("double", "float"):
            cols.append(F.round(F.col(f.name).cast("double"), special.get(f.name, digits)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)
