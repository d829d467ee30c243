"""Model versions as an append-only stage log: ``model_id, version, stage, at, metrics..., parent_version``.

Every operation returns the rows to append; the state is always derived from the log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

STAGES = ["development", "staging", "champion", "archived", "rejected", "challenger"]
KEY = ["model_id", "version"]
#: Of a version's events at one time the one furthest along this list counts.
LIFECYCLE = ["development", "staging", "challenger", "champion", "archived", "rejected"]


def current(log: DataFrame) -> DataFrame:
    """Stage of every version: its latest event, with creation and update time; ties go along the life cycle."""
    step = F.array_position(F.array(*[F.lit(s) for s in LIFECYCLE]), F.col("stage"))
    return log.groupBy(*KEY).agg(
        F.max_by("stage", F.struct(F.col("at"), step)).alias("stage"),
        F.min("at").alias("created_at"),
        F.max("at").alias("updated_at"),
        F.max("parent_version").alias("parent_version"),
    )


def champions(log: DataFrame) -> DataFrame:
    """Current champion per model; the latest one, should a log hold several."""
    champion = current(log).where("stage = 'champion'")
    return champion.groupBy("model_id").agg(F.max_by("version", F.struct("updated_at", "version")).alias("version"), F.max("updated_at").alias("updated_at"))


def _rows(df: DataFrame, stage: str, at: Column, parent: Column | None = None) -> DataFrame:
    parent = F.lit(None).cast("string") if parent is None else parent
    return df.select("model_id", "version", F.lit(stage).alias("stage"), at.alias("at"), parent.alias("parent_version"))


def register(log: DataFrame, new: DataFrame, at: Column, stage: str = "development") -> DataFrame:
    """Rows for new versions, each with the current champion as parent and its own version number."""
    parents = champions(log).select("model_id", F.col("version").alias("champion"))
    return _rows(new.join(parents, "model_id", "left"), stage, at, F.col("champion"))


def promote(log: DataFrame, picks: DataFrame, at: Column) -> DataFrame:
    """Rows that make the picked versions champion and archive the old ones; unknown versions give none."""
    known = picks.join(current(log).select(*KEY), KEY, "left_semi").select(*KEY)
    target = known.withColumnRenamed("version", "target")
    old = champions(log).join(target, "model_id").where("version <> target")
    return _rows(old, "archived", at).unionByName(_rows(known, "champion", at))


def unknown_versions(log: DataFrame, picks: DataFrame) -> DataFrame:
    return picks.join(current(log).select(*KEY), KEY, "left_anti")


def rollback(log: DataFrame, models: DataFrame, at: Column) -> DataFrame:
    """Rows that restore the most recently archived version and reject the current champion."""
    state = current(log).join(models.select("model_id"), "model_id", "left_semi")
    restored = state.where("stage = 'archived'").groupBy("model_id").agg(F.max_by("version", F.struct("updated_at", "version")).alias("version"))
    beaten = champions(log).join(restored.select("model_id"), "model_id", "left_semi")
    return _rows(beaten, "rejected", at).unionByName(_rows(restored, "champion", at))


def list_versions(log: DataFrame, stages: Sequence[str] | None = None, model_id: str | None = None) -> DataFrame:
    out = current(log)
    if model_id is not None:
        out = out.where(F.col("model_id") == model_id)
    if stages is not None:
        out = out.where(F.col("stage").isin(list(stages)))
    return out.orderBy("model_id", F.desc("created_at"), "version")


def get_version(log: DataFrame, model_id: str, version: str) -> DataFrame:
    return current(log).where((F.col("model_id") == model_id) & (F.col("version") == version))
