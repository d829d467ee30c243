"""The daily cycle on two tables: validate, prepare, drift, decide, train, compare, register, shift the reference."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions.frames import local_frame
from ..operators import compare, decide, drift, evaluate, profile, registry, train, transform, validate
from ..session import materialize
from ..sources import versions


@dataclass
class Cycle:
    """What one run produced; a part that was not reached stays ``None``."""

    validation: DataFrame | None = None
    drift_features: DataFrame | None = None
    drift: DataFrame | None = None
    assessment: DataFrame | None = None
    trials: DataFrame | None = None
    comparison: DataFrame | None = None
    stage_rows: DataFrame | None = None
    steps: list[tuple[str, str]] = field(default_factory=list)

    def report(self, spark) -> DataFrame:
        return local_frame(spark, [(i, s, r) for i, (s, r) in enumerate(self.steps)], "position int, step string, outcome string")


def run_cycle(
    reference: DataFrame,
    production: DataFrame,
    target: str,
    key: Sequence[str],
    model_id: str,
    version: str,
    stage_log: DataFrame,
    trained_at: str,
    as_of: str,
    champion=None,
    reference_root: str | None = None,
    trials: int = 30,
    families: Sequence[str] | None = None,
    overrides: Mapping[str, Mapping] | None = None,
    min_rows: int = 1000,
) -> Cycle:
    """One cycle. ``champion`` is the fitted model in production or ``None``; ``key`` names rows.

    Both tables are written to the shared folder first. The evaluation rows are held out before training. Reports are DataFrames; only one-row verdicts are read
    to choose the next step.
    """
    spark = production.sparkSession
    out = Cycle()
    at = F.lit(as_of).cast("timestamp")
    # some fifty passes read these two: what makes them runs once
    reference, production = materialize(reference, "cycle-reference"), materialize(production, "cycle-production")

    summary = validate.validate(production, ref=reference).summary
    out.validation = summary
    verdict = summary.first()
    out.steps.append(("validate", "valid" if verdict["is_valid"] else "invalid"))
    if not verdict["is_valid"]:
        return out

    features = [c for c in reference.columns if c not in key]
    configs = profile.auto_config(reference.select(*features), target)
    prep, training, ready = transform.prepare(reference.select(*features), production.select(*features), configs, target)
    ref_ready, prod_ready = materialize(training, "reference-ready"), materialize(ready, "production-ready")
    names = [c for c in prod_ready.columns if c != target]
    out.steps.append(("prepare", f"{len(names)} features"))

    concept = drift.target_drift(ref_ready, prod_ready, target).first()["concept_drift"]
    out.drift_features = drift.feature_drift(ref_ready, prod_ready, names, target)
    out.drift = drift.drift_summary(out.drift_features, bool(concept))
    found = out.drift.first()
    out.steps.append(("drift", found["severity"]))

    signals = local_frame(spark, [(model_id, found["severity"], bool(concept))], "model_id string, severity string, concept_drift boolean").select(
        "model_id",
        F.lit(None).cast("double").alias("performance"),
        decide.drift_signal(F.col("severity"), F.col("concept_drift")).alias("drift"),
        decide.staleness_signal(F.lit(trained_at).cast("timestamp"), at).alias("staleness"),
        F.lit(production.count() >= min_rows).alias("ready"),
        "concept_drift",
    )
    out.assessment = decide.route(decide.assess(signals))
    step = out.assessment.first()["next_step"]
    out.steps.append(("decide", step))
    if step == "retrain":
        _retrain(out, prep, production, target, key, model_id, version, stage_log, at, champion, trials, families, overrides, names)
    if reference_root is not None:
        versions.shift_reference(production, reference_root, version, as_of)
        out.steps.append(("shift_reference", version))
    return out


def _retrain(out, prep, production, target, key, model_id, version, stage_log, at, champion, trials, families, overrides, names) -> None:
    spark = production.sparkSession
    keyed = _with_key(prep, production, key, target).withColumn("__held", evaluate.held_out(key))
    training, held_out = evaluate.holdout(materialize(keyed, "keyed"), key, noted="__held")
    held_out = materialize(held_out, "held-out")
    model, out.trials, _, _ = train.auto_train(training, names, target, key, trials, families, overrides)
    out.steps.append(("train", type(model.stages[-1]).__name__))
    scored = train.score_rows(model, held_out)
    new = compare.snapshot_of(scored, model_id, target, "pred", "prob")
    if champion is None:
        paired = compare.pair(new.where("false"), new)
        p_values = local_frame(spark, [(model_id, 0.0)], "model_id string, p_value double")
    else:
        old_scored = train.score_rows(champion, held_out).select(*key, F.col("pred").alias("a"))
        both = scored.join(old_scored, list(key))
        p = compare.significance(compare.bootstrap_f1(both, target, "a", "pred")).first()["p_value"]
        paired = compare.pair(compare.snapshot_of(train.score_rows(champion, held_out), model_id, target, "pred", "prob"), new)
        p_values = local_frame(spark, [(model_id, p)], "model_id string, p_value double")
    out.comparison = compare.decide(paired, p_values)
    wins = out.comparison.first()["challenger_wins"]
    out.steps.append(("compare", "challenger" if wins else "champion"))
    pick = local_frame(spark, [(model_id, version)], "model_id string, version string")
    rows = registry.register(stage_log, pick, at)
    if wins:
        rows = rows.unionByName(registry.promote(stage_log.select(*rows.columns).unionByName(rows), pick, at))
    out.stage_rows = rows
    out.steps.append(("register", version))


def _with_key(prep: transform.Preparation, df: DataFrame, key: Sequence[str], target: str) -> DataFrame:
    """Prepared rows with their key, which is no feature."""
    wide = df.withColumn("__row", F.struct(*key))
    carried = transform.Preparation(**{**prep.__dict__, "target": "__row"})
    ready = carried.transform(wide.withColumn("__row", F.struct(*key, F.col(target).alias("__y"))))
    cells = [F.col("__row")[k].alias(k) for k in key]
    return ready.select(*[c for c in ready.columns if c != "__row"], *cells, F.col("__row")["__y"].alias(target))
