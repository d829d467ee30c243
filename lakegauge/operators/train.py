"""Splits, folds, weighted training with Spark ML, random search, threshold and calibration steps."""

from __future__ import annotations

import math
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor, TimeoutError as FutureTimeout
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import NumericType

from ..functions.frames import local_frame
from ..session import materialize
from . import dataset, evaluate, logistic, registry

MAX_STRATA = 50
#: Rows of a class that one task sorts, on average; and rows of a table that is sent to every task.
BUCKET_ROWS, SMALL_SIDE = 1 << 15, 10_000
#: Bins of a feature that trees may tell apart.
BINS = 32
#: Rows of a training table that one task reads at most, on average.
TASK_ROWS = 1 << 20
#: A forest takes cells instead of more rows than the first, where it finds fewer than the second; trees fitted side by side.
FOREST_ROWS, FOREST_CELLS, FOREST_THREADS = 1 << 20, 1 << 20, 8
#: Combinations of bins up to which a model's answers are looked up in a table of them all.
ANSWERS = 1 << 17


# ---- splits and folds -------------------------------------------------------------------------------------


def hash_order(key: Sequence[str], seed: int) -> Column:
    """A random-looking order that depends on the key and the seed only."""
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in key], F.lit(str(seed)))
    return F.md5(text)


def ranked(df: DataFrame, strata: str | None, key: Sequence[str], seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``__rank`` (1-based) inside each stratum in hash order, and the stratum size ``__size``.

    A window over a whole stratum would sort it in one task. The leading hash digits cut a stratum into buckets of at
    most ``bucket_rows`` rows on average: as many digits as its size asks for, none for a small one. The counts of the
    buckets are a table; each gets its first rank digit by digit, from the at most 15 siblings in front of it.
    """
    # a null class is one of its own, whatever the other classes are called
    stratum = F.concat(F.lit("="), F.col(strata).cast("string")) if strata else F.lit("all")
    rows = df.withColumns({"__stratum": F.coalesce(stratum, F.lit("")), "__order": hash_order(key, seed)})
    sizes = materialize(rows.groupBy("__stratum").agg(F.count("*").alias("__size")), "strata")
    classes, largest = sizes.agg(F.count("*"), F.coalesce(F.max("__size"), F.lit(0))).first()
    depth = digits_for(largest, bucket_rows)
    digits = sum((F.col("__size") > bucket_rows * 16**d).cast("int") for d in range(depth)) if depth else F.lit(0)
    rows = rows.join(F.broadcast(sizes) if classes <= SMALL_SIDE else sizes, "__stratum").withColumn("__bucket", F.substring("__order", F.lit(1), digits))
    leaves = materialize(rows.groupBy("__stratum", "__bucket").agg(F.count("*").alias("n")), "strata-buckets")
    offsets = leaves.select("__stratum", "__bucket", F.lit(0).cast("long").alias("__before"))
    for d in range(1, depth + 1):
        nodes = leaves.where(F.length("__bucket") >= d).groupBy("__stratum", F.substring("__bucket", 1, d).alias("__node")).agg(F.sum("n").alias("n"))
        siblings = Window.partitionBy("__stratum", F.substring("__node", 1, d - 1)).orderBy("__node").rowsBetween(Window.unboundedPreceding, -1)
        ahead = nodes.select("__stratum", "__node", F.coalesce(F.sum("n").over(siblings), F.lit(0)).alias("__ahead"))
        own = offsets.withColumn("__node", F.when(F.length("__bucket") >= d, F.substring("__bucket", 1, d)))
        offsets = own.join(ahead, ["__stratum", "__node"], "left").select("__stratum", "__bucket", (F.col("__before") + F.coalesce("__ahead", F.lit(0))).alias("__before"))
    offsets = materialize(offsets, "strata-offsets")
    few = offsets.limit(SMALL_SIDE + 1).count() <= SMALL_SIDE
    inside = Window.partitionBy("__stratum", "__bucket").orderBy("__order", *key)
    joined = rows.join(F.broadcast(offsets) if few else offsets, ["__stratum", "__bucket"])
    return joined.withColumn("__rank", F.col("__before") + F.row_number().over(inside)).drop("__stratum", "__order", "__bucket", "__before")


def digits_for(size: int, bucket_rows: int) -> int:
    """Hash digits that cut ``size`` rows into buckets of at most ``bucket_rows`` on average."""
    digits = 0
    while size > bucket_rows * 16**digits:
        digits += 1
    return digits


def few_classes(df: DataFrame, target: str, limit: int = MAX_STRATA) -> bool:
    return df.select(target).distinct().limit(limit).count() < limit


def train_validation_split(df: DataFrame, key: Sequence[str], target: str | None = None, share: float = 0.20, seed: int = 42) -> DataFrame:
    """Add ``is_validation``; with fewer than 50 classes every class gives the same share of its rows."""
    strata = target if target and few_classes(df, target) else None
    out = ranked(df, strata, key, seed)
    return out.withColumn("is_validation", F.col("__rank") <= F.round(F.col("__size") * share)).drop("__rank", "__size")


def fold_count(minority: int, wanted: int) -> int:
    """As many folds as leave two minority rows in each, at least two."""
    return max(2, min(wanted, minority // 2))


def with_folds(df: DataFrame, key: Sequence[str], folds: int, target: str | None = None, seed: int = 42) -> DataFrame:
    """Add ``fold``; stratified by the target if given."""
    out = ranked(df, target, key, seed)
    return out.withColumn("fold", F.pmod(F.col("__rank") - 1, F.lit(folds)).cast("int")).drop("__rank", "__size")


def minority_count(df: DataFrame, target: str) -> int:
    return dataset.class_counts(df, target).agg(F.min("n").alias("n")).first()["n"]


# ---- model families and search spaces ---------------------------------------------------------------------

# What may be tried per family. A list is a choice, ("int", a, b) a whole number in [a, b),
# ("uniform", a, b) and ("log", a, b) a number.
SPACES: dict[str, dict] = {
    "random_forest": {
        "n_estimators": [100, 200, 300, 500],
        "max_depth": [5, 10, 15, 20, 30],
        "min_samples_leaf": ("int", 1, 10),
        "max_features": ["sqrt", "log2", "0.3", "0.5", "0.7"],
        "class_weight": [None, "balanced"],
    },
    "gradient_boosting": {
        "n_estimators": [100, 200, 300, 500],
        "max_depth": [3, 4, 5, 6, 8],
        "learning_rate": ("log", 0.01, 0.3),
        "subsample": ("uniform", 0.6, 1.0),
        "min_samples_leaf": ("int", 1, 10),
        "max_features": ["sqrt", "log2", "0.5", "0.7", "all"],
    },
    "logistic_regression": {
        "C": ("log", 1e-4, 100.0),
        "penalty": ["l1", "l2", "elasticnet"],
        "max_iter": [500, 1000, 2000],
        "class_weight": [None, "balanced"],
        "l1_ratio": ("uniform", 0.0, 1.0),
    },
    "ridge_regression": {"alpha": ("log", 1e-4, 1000.0), "fit_intercept": [True, False]},
    "elasticnet_regression": {
        "alpha": ("log", 1e-4, 100.0),
        "l1_ratio": ("uniform", 0.0, 1.0),
        "fit_intercept": [True, False],
        "max_iter": [1000, 2000],
    },
}
CLASSIFIERS = {"random_forest", "gradient_boosting", "logistic_regression"}
REGRESSORS = {"random_forest", "gradient_boosting", "ridge_regression", "elasticnet_regression"}


def draw(space: Mapping, rng: np.random.Generator) -> dict:
    out = {}
    for name, rule in space.items():
        if isinstance(rule, tuple):
            kind, low, high = rule
            if kind == "int":
                out[name] = int(rng.integers(low, high))
            elif kind == "log":
                out[name] = float(math.exp(rng.uniform(math.log(low), math.log(high))))
            else:
                out[name] = float(rng.uniform(low, high))
        else:
            out[name] = rule[int(rng.integers(len(rule)))]
    return out


def estimator(family: str, params: Mapping, classification: bool, rows: int, label: str, weight: str | None = None, seed: int = 42):
    """A Spark ML estimator for a family.

    The penalties of the linear families are per table in the search space and per row in Spark, hence the
    division by the number of rows.
    """
    p = dict(params)
    common = {"labelCol": label, "featuresCol": "features"}
    if weight:
        common["weightCol"] = weight
    if family == "random_forest":
        cls = RandomForestClassifier if classification else RandomForestRegressor
        return cls(
            numTrees=p.get("n_estimators", 100), maxDepth=min(p.get("max_depth") or 30, 30), minInstancesPerNode=p.get("min_samples_leaf", 1),
            featureSubsetStrategy=str(p.get("max_features", "auto")), seed=seed, **common,
        )
    if family == "gradient_boosting":
        cls = GBTClassifier if classification else GBTRegressor
        return cls(
            maxIter=p.get("n_estimators", 100), maxDepth=p.get("max_depth", 3), stepSize=p.get("learning_rate", 0.1), subsamplingRate=p.get("subsample", 1.0),
            minInstancesPerNode=p.get("min_samples_leaf", 1), featureSubsetStrategy=str(p.get("max_features", "all")), seed=seed, **common,
        )
    if family == "logistic_regression" and classification:
        mix = {"l1": 1.0, "l2": 0.0}.get(p.get("penalty", "l2"), p.get("l1_ratio", 0.5))
        return LogisticRegression(regParam=1.0 / (p.get("C", 1.0) * rows), elasticNetParam=mix, maxIter=p.get("max_iter", 100), **common)
    if family == "ridge_regression" and not classification:
        return LinearRegression(regParam=p.get("alpha", 1.0) / rows, elasticNetParam=0.0, fitIntercept=p.get("fit_intercept", True), standardization=False, **common)
    if family == "elasticnet_regression" and not classification:
        return LinearRegression(
            regParam=p.get("alpha", 1.0), elasticNetParam=p.get("l1_ratio", 0.5), fitIntercept=p.get("fit_intercept", True), maxIter=p.get("max_iter", 1000),
            standardization=False, **common,
        )
    raise ValueError(f"no {family} for {'classes' if classification else 'numbers'}")


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep").transform(df)


def fold_score(scored: DataFrame, label: str, scoring: str) -> float:
    """Score of a scored validation fold, oriented so that larger is better; NaN where it is undefined."""
    if scoring in ("pr_auc", "roc_auc"):
        value = evaluate.ranking_metrics(scored, label, {"prob": 1}).first()[scoring]
    elif scoring in ("accuracy", "f1"):
        value = evaluate.classification_metrics(scored, label, "pred").first()[scoring]
    elif scoring in ("f1_weighted", "f1_macro"):
        kind = scoring.removeprefix("f1_")
        value = evaluate.classification_from(evaluate.confusion(scored, label, "pred"), multi=kind, binary=False).first()["f1"]
    else:
        rmse = evaluate.regression_metrics(scored, label, "pred").first()["rmse"]
        value = None if rmse is None else -rmse
    return float("nan") if value is None else float(value)


# ---- random search ----------------------------------------------------------------------------------------


@dataclass
class Trial:
    family: str
    number: int
    params: dict
    mean: float
    std: float


def search(
    df: DataFrame,
    features: Sequence[str],
    label: str,
    family: str,
    classification: bool,
    scoring: str,
    trials: int = 30,
    overrides: Mapping | None = None,
    patience: int = 10,
    seed: int = 42,
    parallel: int = 4,
    budget: float | None = None,
    weighted: bool = False,
    early_stopping: bool = False,
) -> list[Trial]:
    """Seeded random draws, each cross-validated over the ``fold`` column; stops after ``patience`` draws without gain.

    ``parallel`` draws are fitted side by side, so that the cluster stays busy in the small jobs of a fit. Draws count in
    their order, whichever ends first: the same draws are found whatever ``parallel`` is. ``budget`` seconds after the start
    the jobs still running are cancelled by their tag and their draws dropped; the result may then be empty.
    Logistic regressions of the labels 0 and 1 are fitted some draws at a time in the same passes over the table: there the
    budget ends later draws, the first ones are always fitted.
    ``weighted`` draws weigh the classes by their ratio whether they ask for it or not. With ``early_stopping`` boosted trees
    stop growing when the next fold, left out of the fit, gains no more. The assembled table is cached meanwhile.
    """
    rng = np.random.default_rng(seed)
    space = {**SPACES[family], **(overrides or {})}
    if not classification:
        space.pop("class_weight", None)
    drawn = [draw(space, rng) for _ in range(trials)]
    df = materialize(df.select(*dict.fromkeys([*features, label, "fold"])), "trials")  # ranks and folds are found once
    if classification and family == "logistic_regression":
        found = search_logistic(df, features, label, drawn, scoring, patience, budget, weighted)
        if found is not None:
            return found
    data = assemble(df, features).select("features", label, "fold")
    data = spread(dataset.with_class_weights(data, label, "balanced_weight") if classification else data)
    sizes = {r["fold"]: r["count"] for r in data.groupBy("fold").count().collect()}
    rows, folds = sum(sizes.values()), sorted(sizes)
    stops = early_stopping and family == "gradient_boosting" and len(folds) > 2

    def scored(params: Mapping) -> Iterator[float]:
        weight = "weight" if classification and (weighted or params.get("class_weight") in ("balanced", "balanced_subsample")) else None
        for i, f in enumerate(folds):
            own = data.where(F.col("fold") != f)
            learner = estimator(family, params, classification, rows - sizes[f], label, weight, seed)
            if stops:
                own, learner = own.withColumn("stop", F.col("fold") == folds[(i + 1) % len(folds)]), learner.setValidationIndicatorCol("stop")
            yield fold_score(score_rows(learner.fit(own), data.where(F.col("fold") == f), classification), label, scoring)

    found: list[Trial] = []
    best, stale = -math.inf, 0
    with Trials(df.sparkSession, parallel, budget) as running:
        for number, scores in running.results([partial(scored, p) for p in drawn]):
            known = [s for s in scores if s == s]
            mean = float(np.mean(known)) if known else float("nan")
            found.append(Trial(family, number, drawn[number], mean, float(np.std(known)) if known else float("nan")))
            best, stale = (mean, 0) if mean > best else (best, stale + 1)
            if stale >= patience:
                break
    data.unpersist()
    return found


def search_logistic(df: DataFrame, features: Sequence[str], label: str, drawn: Sequence[Mapping], scoring: str, patience: int, budget: float | None, weighted: bool) -> list[Trial] | None:
    """The search over logistic regressions of 0 and 1, draws and folds side by side; ``None`` for other labels."""
    ends = math.inf if budget is None else time.monotonic() + budget
    if not isinstance(df.schema[label].dataType, NumericType):
        return None
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().limit(3).collect()}
    if set(counts) != {0, 1}:
        return None
    folds = sorted(r["fold"] for r in df.select("fold").distinct().collect())
    data = logistic.packed(df, features, label, "fold")
    ratio = tuple(sum(counts.values()) / (2 * counts[c]) for c in (0, 1))
    found: list[Trial] = []
    best, stale = -math.inf, 0
    while len(found) < len(drawn) and stale < patience:
        # as many draws as it takes at least until the search may stop: none is fitted in vain
        start = len(found)
        wave = drawn[start : start + max(1, patience - stale + (start == 0))]
        problems, owner = [], []
        for params in wave:
            heavy = weighted or params.get("class_weight") in ("balanced", "balanced_subsample")
            mix = {"l1": 1.0, "l2": 0.0}.get(params.get("penalty", "l2"), params.get("l1_ratio", 0.5))
            own = logistic.Problem(params.get("C", 1.0), mix, params.get("max_iter", 100), ratio if heavy else (1.0, 1.0))
            problems += [own] * len(folds)
            owner += folds
        left_out = np.array(owner)
        alive = lambda first=start == 0: first or time.monotonic() < ends
        try:
            models = logistic.fit_many(data, len(features), lambda g, o=left_out: g[None, :] != o[:, None], problems, alive)
        except logistic.Ended:
            break
        scores = wave_scores(df, data, features, label, scoring, owner, models)
        for i, params in enumerate(wave):
            known = [s for s in scores[i * len(folds) : (i + 1) * len(folds)] if s == s]
            mean = float(np.mean(known)) if known else float("nan")
            found.append(Trial("logistic_regression", start + i, params, mean, float(np.std(known)) if known else float("nan")))
            best, stale = (mean, 0) if mean > best else (best, stale + 1)
            if stale >= patience:
                break
    data.unpersist()
    return found


def wave_scores(df: DataFrame, data: DataFrame, features: Sequence[str], label: str, scoring: str, owner: Sequence[int], models: Sequence[tuple]) -> list[float]:
    """The score of each model on the fold that it left out."""
    if any(not np.isfinite([*b, c]).all() for b, c in models):
        return [float("nan")] * len(models)
    if scoring in ("pr_auc", "roc_auc"):
        each = ((df.where(F.col("fold") == f), m) for f, m in zip(owner, models))
        return [fold_score(own.withColumn("prob", logistic.probability(features, m)), label, scoring) for own, m in each]
    cells = logistic.fold_confusions(data, len(features), owner, models)
    rows = [(i, y, p, int(cells[i, y, p])) for i in range(len(models)) for y in (0, 1) for p in (0, 1) if cells[i, y, p]]
    conf = local_frame(df.sparkSession, rows, "model int, y int, pred int, n long")
    if scoring in ("accuracy", "f1"):
        scores = evaluate.classification_from(conf, ["model"]).select("model", F.col(scoring).alias("score"))
    else:
        scores = evaluate.classification_from(conf, ["model"], multi=scoring.removeprefix("f1_"), binary=False).select("model", F.col("f1").alias("score"))
    by_model = {r["model"]: r["score"] for r in scores.collect()}
    return [float("nan") if by_model.get(i) is None else float(by_model[i]) for i in range(len(models))]


class Trials:
    """Runs steps that submit Spark jobs on a few threads, under one job tag; leaving it ends whatever still runs."""

    def __init__(self, spark, parallel: int, budget: float | None):
        self.spark, self.tag = spark, f"trials-{uuid.uuid4().hex}"
        self.ends = math.inf if budget is None else time.monotonic() + budget
        self.over = threading.Event()
        self.pool = ThreadPoolExecutor(max(1, parallel))

    def __enter__(self) -> Trials:
        return self

    def results(self, steps: Sequence[Callable[[], Iterator[float]]]) -> Iterator[tuple[int, list[float]]]:
        """(number, values) of the steps in their order, up to the end of the budget."""
        waiting = [self.pool.submit(inheritable_thread_target(self.spark)(partial(self._run, s))) for s in steps]
        for number, future in enumerate(waiting):
            try:
                yield number, future.result(None if self.ends == math.inf else max(0.0, self.ends - time.monotonic()))
            except (FutureTimeout, Ended):
                # a later draw may have ended in time
                self.stop()

    def _run(self, step: Callable[[], Iterator[float]]) -> list[float]:
        out: list[float] = []
        try:
            if self.over.is_set():
                raise Ended
            self.spark.sparkContext.addJobTag(self.tag)
            for value in step():
                out.append(value)
                if self.over.is_set():
                    raise Ended
            return out
        except Exception as stopped:
            # a cancelled job fails in a way of its own
            raise (Ended() if self.over.is_set() else stopped)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)

    def stop(self) -> None:
        self.over.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def __exit__(self, *_) -> None:
        self.over.set()
        self.pool.shutdown(wait=False, cancel_futures=True)
        while any(t.is_alive() for t in self.pool._threads):
            # a fit submits its next job right after a cancelled one
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            time.sleep(0.05)


class Ended(Exception):
    """A step was given up."""


def trial_table(spark, trials: Sequence[Trial]) -> DataFrame:
    import json

    rows = [(t.family, t.number, json.dumps(t.params, sort_keys=True), float(t.mean), float(t.std)) for t in trials]
    return local_frame(spark, rows, "family string, trial int, params string, cv_mean double, cv_std double")


def best_family(trials: DataFrame) -> DataFrame:
    """Highest mean, then lowest spread, then name: one row."""
    usable = trials.where("cv_mean IS NOT NULL AND NOT isnan(cv_mean)")
    return usable.orderBy(F.desc("cv_mean"), F.asc("cv_std"), "family", "trial").limit(1)


def cv_summary(scores: DataFrame, by: Sequence[str], score: str = "score") -> DataFrame:
    """Mean and population spread over the folds, NaN left out."""
    value = F.when(~F.isnan(score), F.col(score))
    return scores.groupBy(*by).agg(F.count(value).alias("folds"), F.avg(value).alias("cv_mean"), F.stddev_pop(value).alias("cv_std"))


# ---- fitting, scoring, importance -------------------------------------------------------------------------


def fit(df: DataFrame, features: Sequence[str], label: str, family: str, params: Mapping, classification: bool, weight: str | None = None, seed: int = 42, stop: str | None = None) -> PipelineModel:
    """A fitted pipeline; boosted trees stop growing when the rows marked in ``stop``, left out of the fit, gain no more."""
    if family == "gradient_boosting" and by_weight(df, features, params):
        return fit_bins(df, features, label, params, classification, weight, seed, stop)
    assembler = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")
    rows = df.count()
    if family == "random_forest" and classification and rows > FOREST_ROWS and by_weight(df, features, params):
        if (model := fit_forest(df, features, label, params, weight, seed)) is not None:
            return model
    data = spread(assembler.transform(df).select("features", label, *[c for c in (weight, stop) if c]), rows)
    learner = estimator(family, params, classification, rows, label, weight, seed)
    model = (learner.setValidationIndicatorCol(stop) if stop else learner).fit(data)
    data.unpersist()
    return PipelineModel([assembler, model])


def by_weight(df: DataFrame, features: Sequence[str], params: Mapping) -> bool:
    """Whether n equal rows are the same to boosted trees as one of n times the weight: no row is drawn or counted alone."""
    plain = params.get("subsample", 1.0) == 1.0 and params.get("min_samples_leaf", 1) == 1
    return plain and all(isinstance(df.schema[c].dataType, NumericType) for c in features)


def fit_bins(df: DataFrame, features: Sequence[str], label: str, params: Mapping, classification: bool, weight: str | None, seed: int, stop: str | None) -> PipelineModel:
    """Boosted trees over the bins that their splits tell apart: rows of the same bins and label are one of their summed weight.

    A tree has hundreds of passes over its table; here the rows are read a few times to find and fill the bins. The model
    bins the rows it scores by itself.
    """
    bins, names = binned(df, features)
    # without the note of the bins' names, which would make them categories without an order
    keys = [*[F.col(n).alias(n, metadata={}) for n in names], label, *([stop] if stop else [])]
    cells = bins.transform(df).groupBy(*keys).agg(F.sum(F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__weight"))
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    data = spread(assembler.transform(materialize(cells, "bins")).select("features", label, "__weight", *([stop] if stop else [])))
    learner = estimator("gradient_boosting", params, classification, 0, label, "__weight", seed).setMaxBins(BINS + 1)  # one for NaN
    model = (learner.setValidationIndicatorCol(stop) if stop else learner).fit(data)
    data.unpersist()
    return PipelineModel([bins, assembler, model])


def binned(df: DataFrame, features: Sequence[str]) -> tuple[Bucketizer, list[str]]:
    """The bins of features, and the names of their columns."""
    names = [f"__bin_{c}" for c in features]
    splits = [[-math.inf, *cuts, math.inf] for cuts in bin_cuts(df, features)]
    return Bucketizer(splitsArray=splits, inputCols=list(features), outputCols=names, handleInvalid="keep"), names


def fit_forest(df: DataFrame, features: Sequence[str], label: str, params: Mapping, weight: str | None, seed: int) -> PipelineModel | None:
    """A forest over the cells of the bins that its splits tell apart; ``None`` where there are too many of them.

    A row is in a tree's bag as often as a Poisson draw of mean 1 says. The draws of n rows of the same bins, label and weight
    add up to one of mean n: the forest of a cell's draws is, in law, that of its rows, and no tree reads the rows.
    """
    spark = df.sparkSession
    bins, names = binned(df, features)
    keys = [*[F.col(n).alias(n, metadata={}) for n in names], F.col(label).cast("double").alias("__label"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("__each")]
    cells = materialize(bins.transform(df).groupBy(*keys).agg(F.count("*").alias("__n")), "cells")
    count, top, bad = cells.agg(F.count("*"), F.max("__label"), F.count_if(F.expr("__label is null or __label < 0 or __label <> floor(__label)"))).first()
    if count > FOREST_CELLS or bad:
        return None
    trees, classes = params.get("n_estimators", 100), int(top) + 1
    # the number of features a split may choose from depends on the forest, not on the one tree
    subset = str(params.get("max_features", "auto"))
    subset = subset if subset != "auto" else "sqrt" if trees > 1 else "all"
    # a label that names its classes is the same to a bag that misses one
    named = F.col("__label").alias("__label", metadata={"ml_attr": {"type": "nominal", "num_vals": classes}})
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")
    # a hash of the cell, whatever task it is in, starts its draws
    drawn = cells.withColumn("__hash", F.xxhash64(*names, "__label", "__each")).mapInArrow(bags(trees, seed), ", ".join([*[f"{n} double" for n in names], "__label double", "__draws array<double>"]))
    drawn = materialize(drawn, "bags")
    data = assembler.transform(drawn).select("features", named, "__draws").repartition(max(1, math.ceil(count / BUCKET_ROWS))).cache()

    def grown(number: int):
        one = {**params, "n_estimators": 1, "max_features": subset}
        learner = estimator("random_forest", one, True, 0, "__label", "__weight", seed + number).setBootstrap(False).setMaxBins(BINS + 1)  # one for NaN
        return learner.fit(data.select("features", "__label", F.get("__draws", F.lit(number)).alias("__weight")).where("__weight > 0"))

    with ThreadPoolExecutor(min(trees, FOREST_THREADS)) as pool:
        found = list(pool.map(inheritable_thread_target(spark)(grown), range(trees)))
    data.unpersist()
    return PipelineModel([bins, assembler, joined_forest(spark, found, len(features), classes, label)])


def bags(trees: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(bins, label, weight of a row, rows, hash) of cells -> (bins, label, the weight that each tree draws)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, n, hashes = (c.to_numpy(zero_copy_only=False) for c in batch.columns[-3:])
            draws = np.empty((len(batch), trees))
            for i, (start, rows) in enumerate(zip(hashes.view(np.uint64).tolist(), n.tolist())):
                draws[i] = np.random.default_rng([seed & 0xFFFFFFFF, start]).poisson(rows, trees)
            draws *= each[:, None]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * trees, pa.int32()), pa.array(draws.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], lists], names=[*batch.schema.names[:-3], "__draws"])

    return run


def joined_forest(spark, found: Sequence[RandomForestClassificationModel], n_features: int, classes: int, label: str) -> RandomForestClassificationModel:
    """Forests of one tree each as one forest."""
    jvm = spark.sparkContext._jvm
    trees = [m._java_obj.trees()[0] for m in found]
    array = spark.sparkContext._gateway.new_array(jvm.org.apache.spark.ml.classification.DecisionTreeClassificationModel, len(trees))
    for i, t in enumerate(trees):
        array[i] = t
    out = RandomForestClassificationModel(jvm.org.apache.spark.ml.classification.RandomForestClassificationModel(f"forest_{uuid.uuid4().hex[:12]}", array, n_features, classes))
    out._set(labelCol=label, numTrees=len(trees))
    out._transfer_params_to_java()
    return out


def bin_cuts(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """The borders of at most ``BINS`` bins a feature: every value of its own where there are so few, else of about equal size."""
    probs = [i / BINS for i in range(1, BINS)]
    value = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in features}
    aggs = [F.struct(F.approx_count_distinct(v), F.percentile_approx(v, probs, 10_000)).alias(f"f{i}") for i, v in enumerate(value.values())]
    found = df.agg(*aggs).first()
    few = [i for i in range(len(features)) if found[i][0] <= 2 * BINS]
    sets = df.agg(*[F.sort_array(F.collect_set(value[features[i]])).alias(f"f{i}") for i in few]).first() if few else []
    cuts = []
    for i in range(len(features)):
        values = sets[few.index(i)] if i in few else None
        at = values[1:] if values is not None and len(values) <= BINS else found[i][1] or []
        cuts.append(sorted({float(v) for v in at if math.isfinite(v)}))
    return cuts


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The training table over all cores, cached: an iterative fit reads it many times. Tasks keep their size as it grows."""
    rows = df.count() if rows is None else rows
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / TASK_ROWS))).cache()


def score_rows(model: Model, df: DataFrame, classification: bool = True, probabilities: bool = False) -> DataFrame:
    """Predictions for a batch or streaming table, with one column per class on request.

    Trees over bins give rows of the same bins the same answer: up to ANSWERS combinations each is worked out once, and the
    rows look theirs up.
    """
    keep = df.columns
    bins = model.stages[0] if isinstance(model, PipelineModel) else None
    sizes = [len(s) for s in bins.getSplitsArray()] if isinstance(bins, Bucketizer) else []  # one for NaN, as borders are one more
    if not sizes or math.prod(sizes) > ANSWERS:
        out, extra = answered(model, df, classification, probabilities)
        return out.select(*keep, *extra)
    names, strides = bins.getOutputCols(), [math.prod(sizes[:i]) for i in range(len(sizes))]
    grid = df.sparkSession.range(math.prod(sizes)).select("id", *[F.expr(f"cast(id div {s} % {n} as double)").alias(c) for c, s, n in zip(names, strides, sizes)])
    out, extra = answered(PipelineModel(model.stages[1:]), grid, classification, probabilities)
    table = F.broadcast(out.select(F.col("id").alias("__cell"), *extra))
    cell = sum(F.coalesce(F.col(c).cast("long"), F.lit(n - 1)) * F.lit(s) for c, s, n in zip(names, strides, sizes))
    return bins.transform(df).withColumn("__cell", cell).drop(*extra).join(table, "__cell").select(*keep, *extra)


def answered(model: Model, df: DataFrame, classification: bool, probabilities: bool) -> tuple[DataFrame, list[str]]:
    """The rows with a model's predictions, and the names of these columns."""
    out = model.transform(df).withColumn("pred", F.col("prediction"))
    extra = ["pred"]
    if classification and "probability" in out.columns:
        out = out.withColumn("__p", vector_to_array("probability"))
        out = out.withColumn("prob", F.get("__p", F.lit(1)))
        extra.append("prob")
        if probabilities:
            k = (model.stages[-1] if isinstance(model, PipelineModel) else model).numClasses
            out = out.withColumns({f"prob_{i}": F.get("__p", F.lit(i)) for i in range(k)})
            extra += [f"prob_{i}" for i in range(k)]
    return out, extra


def importance(model: Model, features: Sequence[str], spark) -> DataFrame:
    """Importances or absolute coefficients, largest first."""
    last = model.stages[-1] if isinstance(model, PipelineModel) else model
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    elif hasattr(last, "coefficientMatrix") and last.numClasses > 2:
        values = np.abs(last.coefficientMatrix.toArray()).mean(axis=0)
    else:
        values = np.abs(last.coefficients.toArray())
    rows = sorted(((f, float(v)) for f, v in zip(features, values)), key=lambda r: (-r[1], r[0]))
    return local_frame(spark, rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")


# ---- techniques for strong imbalance ----------------------------------------------------------------------


def product_features(df: DataFrame, features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Pairwise products as extra columns."""
    names = [f"{a}_x_{b}" for i, a in enumerate(features) for b in features[i + 1 :]]
    cells = {f"{a}_x_{b}": F.col(a) * F.col(b) for i, a in enumerate(features) for b in features[i + 1 :]}
    return df.withColumns(cells), names


def in_balanced_bag(df: DataFrame, target: str, key: Sequence[str], seed: int = 42) -> Callable[[int], Column]:
    """Whether a row is in a bag: all minority rows are, and a hashed sample of the others of about the same size."""
    counts = {r["label"]: r["n"] for r in dataset.class_counts(df, target).collect()}
    smallest = min(counts.values())
    share = None
    for label, n in counts.items():
        hit = F.col(target).cast("string") == label
        share = F.when(hit, smallest / n) if share is None else share.when(hit, smallest / n)
    return lambda bag: evaluate.split_point(key, seed + 1000 * (bag + 1)) < share


def balanced_bag(df: DataFrame, target: str, key: Sequence[str], bag: int, seed: int = 42) -> DataFrame:
    """All minority rows and a hashed sample of the others of about the same size."""
    return df.where(in_balanced_bag(df, target, key, seed)(bag))


def bagged_probability(df: DataFrame, scored: DataFrame, features: Sequence[str], label: str, key: Sequence[str], bags: int, params: Mapping) -> DataFrame:
    """Mean probability of models fitted on balanced bags, all in the same passes over the table; labels are 0 and 1."""
    inside = in_balanced_bag(df, label, key)
    total = None
    for start in range(0, bags, 50):  # a number's bits say in which bags a row is
        own = range(start, min(bags, start + 50))
        places = sum(F.coalesce(inside(b), F.lit(False)).cast("long") * F.lit(1 << (b - start)) for b in own)
        data = logistic.packed(df.select(*features, label, places.alias("__bags")), features, label, "__bags")
        mix = {"l1": 1.0, "l2": 0.0}.get(params.get("penalty", "l2"), params.get("l1_ratio", 0.5))
        problem = logistic.Problem(params.get("C", 1.0), mix, params.get("max_iter", 100))
        shifts = np.arange(len(own))
        for model in logistic.fit_many(data, len(features), lambda g, s=shifts: g[None, :] >> s[:, None] & 1, [problem] * len(own)):
            prob = logistic.probability(features, model)
            total = prob if total is None else total + prob
        data.unpersist()
    return scored.withColumn("prob", total / bags)


def calibrator(validation: DataFrame, prob: str, label: str):
    """Isotonic regression of the label on the score."""
    return IsotonicRegression(featuresCol=prob, labelCol=label).fit(validation.select(F.col(prob).cast("double").alias(prob), F.col(label).cast("double").alias(label)))


def calibrated(model, scored: DataFrame, prob: str, out: str = "prob_calibrated") -> DataFrame:
    return model.setFeaturesCol(prob).setPredictionCol(out).transform(scored)


# ---- end to end -------------------------------------------------------------------------------------------


def auto_train(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    key: Sequence[str],
    trials: int = 30,
    families: Sequence[str] | None = None,
    overrides: Mapping[str, Mapping] | None = None,
    seed: int = 42,
    budget: float | None = None,
    parallel: int = 4,
) -> tuple[PipelineModel, DataFrame, DataFrame, float | None]:
    """Profile, strategy, search per family, best one, final fit: (model, trials, validation metrics, threshold).

    ``budget`` seconds are the most that one family may search; a family that ends no draw in them is left out. The
    strategy's class ratio weighs class 1 of two in boosted trees, its early stopping ends their growth.
    """
    spark = df.sparkSession
    about = dataset.with_strategy(dataset.profile(df, features, target)).first()
    classification, category = about["is_classification"], about["category"]
    split = materialize(train_validation_split(df, key, target if classification else None, seed=seed), "split")
    training, validation = split.where("NOT is_validation"), split.where("is_validation")
    folds = fold_count(minority_count(training, target), about["cv_folds"]) if classification else about["cv_folds"]
    folded = materialize(with_folds(training, key, folds, target if classification else None, seed), "folds")
    names = [f for f in (families or about["strategy_families"]) if f in (CLASSIFIERS if classification else REGRESSORS)]
    if classification and about["n_classes"] > 2:
        names = [f for f in names if f != "gradient_boosting"]  # boosted trees take two classes only
    stops = about["early_stopping_rounds"] is not None
    found: list[Trial] = []
    for family in names:
        changed = {**dataset.OVERRIDES[category].get(family, {}), **(overrides or {}).get(family, {})}
        ratio = classification and about["n_classes"] == 2 and family == "gradient_boosting" and about["strategy_spw"] != 1.0
        found += search(
            folded, features, target, family, classification, about["strategy_scoring"], trials, changed,
            seed=seed, parallel=parallel, budget=budget, weighted=ratio, early_stopping=stops,
        )
    if not any(t.mean == t.mean for t in found):
        raise TimeoutError(f"no draw of {', '.join(names)} gave a score within its budget")
    table = trial_table(spark, found)
    row = best_family(table).first()
    pick = next(t for t in found if t.family == row["family"] and t.number == row["trial"])
    weight = None
    if classification and about["n_classes"] == 2 and (pick.params.get("class_weight") or about["use_sample_weight"]):
        folded, weight = dataset.with_class_weights(folded, target, "balanced_weight"), "weight"
    stop = "stop" if stops and pick.family == "gradient_boosting" else None
    model = fit(folded.withColumn("stop", F.col("fold") == 0), features, target, pick.family, pick.params, classification, weight, seed, stop)
    scored = score_rows(model, validation, classification)
    threshold = None
    if classification:
        metrics = evaluate.classification_metrics(scored, target, "pred", multi="macro", macro=True)
        if about["n_classes"] == 2 and "prob" in scored.columns:
            threshold = evaluate.threshold_scan(scored, target, "prob").where("is_best").first()["threshold"]
    else:
        metrics = evaluate.regression_metrics(scored, target, "pred")
    return model, table, metrics, threshold


def first_champion(log: DataFrame, model_id: str, version: str, at: Column, train: Callable[[], object]) -> tuple[DataFrame | None, object]:
    """Train, register and promote, unless the model already has a champion: rows to append and the model."""
    spark = log.sparkSession
    wanted = local_frame(spark, [(model_id, version)], "model_id string, version string")
    if not wanted.join(registry.champions(log).select("model_id"), "model_id", "left_anti").take(1):
        return None, None
    model = train()
    new = registry.register(log, wanted, at)
    return new.unionByName(registry.promote(log.select(*new.columns).unionByName(new), wanted, at)), model
