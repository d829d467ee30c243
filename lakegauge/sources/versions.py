"""Versioned snapshots and the reference that moves on after every cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.frames import local_frame


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def save_version(df: DataFrame, root: str, version: str) -> bool:
    """Write ``root/version=...`` once; an existing version stays and False comes back."""
    path = f"{root}/version={version}"
    if _exists(df.sparkSession, path + "/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    return spark.read.option("basePath", root).parquet(f"{root}/version={version}")


def shift_reference(production: DataFrame, root: str, version: str, shifted_at: str) -> None:
    """Production becomes the next reference: write its version, then append the pointer row.

    The pointer comes last, so a lost job leaves the old reference in force.
    """
    save_version(production, f"{root}/data", version)
    row = local_frame(production.sparkSession, [(version, shifted_at)], "version string, shifted_at string")
    row.coalesce(1).write.mode("append").parquet(f"{root}/pointer")


def current_version(spark: SparkSession, root: str) -> str | None:
    if not _exists(spark, f"{root}/pointer"):
        return None
    return spark.read.parquet(f"{root}/pointer").agg(F.max_by("version", F.struct("shifted_at", "version")).alias("v")).first()["v"]


def load_reference(spark: SparkSession, root: str, configured: DataFrame | None = None, fallback=None) -> tuple[DataFrame, str]:
    """The configured table, else the last cycle's reference, else the fallback, with its origin."""
    if configured is not None:
        return configured, "configured"
    version = current_version(spark, root)
    if version is not None:
        return read_version(spark, f"{root}/data", version).drop("version"), "previous_cycle"
    if fallback is None:
        raise ValueError("no reference: none configured, none from an earlier cycle")
    return fallback(), "initial"
