"""Many penalised logistic regressions of one table, fitted in the same passes over it.

The models of a random search, of its folds and of balanced bags differ in penalties and row weights only. A pass gives
loss, gradient and curvature of all of them at once, summed over the cluster; the Newton step of a model is a problem as
small as its number of coefficients and is solved on the driver, with the absolute penalty by coordinate descent. The
objective is that of Spark's ``LogisticRegression`` with standardised penalties: mean weighted loss plus
``reg * (mix * |b| + (1 - mix) / 2 * b^2)`` over the coefficients times the spread of their feature.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Rows worked on at a time, and bytes of a table that one task reads in a pass.
CHUNK, TASK_BYTES = 1024, 64 << 20
#: A model is done when a step promises less than this share of the loss of no model.
TOLERANCE = 1e-7


@dataclass
class Problem:
    """``strength`` is the inverse penalty of the whole table; ``weights`` are those of the classes 0 and 1."""

    strength: float = 1.0
    mix: float = 0.0
    max_iter: int = 100
    weights: tuple[float, float] = (1.0, 1.0)


class Ended(Exception):
    """The caller wants no further pass."""


def packed(df: DataFrame, features: Sequence[str], label: str, group: str) -> DataFrame:
    """The columns of ``df`` as cached blocks of numbers, which every pass reads as they are: features, label and group by rows."""
    names = [*features, label, group]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = b"".join(np.asarray(c.to_numpy(zero_copy_only=False), dtype=float).tobytes() for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array([cells], pa.binary())], names=["cells"])

    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() * len(names) * 8 / TASK_BYTES))
    columns = [F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)]
    return df.select(*columns).repartition(parts).mapInArrow(blocks, "cells binary").cache()


def totals(data: DataFrame, p: int, kernel: Callable, size: int) -> np.ndarray:
    """The sums over all rows of ``kernel(x, y, group)``, which gives ``size`` numbers a chunk; ``x`` has a row a feature."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size)
        for batch in batches:
            for cells in batch.column(0):
                block = np.frombuffer(cells.as_buffer(), dtype=float).reshape(p + 2, -1)
                for a in range(0, block.shape[1], CHUNK):
                    part = block[:, a : a + CHUNK]
                    out += kernel(part[:p], part[p], part[p + 1].astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(out)], names=["k", "v"])

    found = np.zeros(size)
    for r in data.mapInArrow(add, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect():
        found[r["k"]] = r["v"]
    return found


def fit_many(data: DataFrame, p: int, member: Callable[[np.ndarray], np.ndarray], problems: Sequence[Problem], alive: Callable[[], bool] = lambda: True) -> list[tuple[np.ndarray, float]]:
    """(coefficients, intercept) of every problem; ``member(groups)`` says as 0/1, problems by rows, who is fitted on what.

    ``data`` is a ``packed`` table of ``p`` features. Labels are 0 and 1. Raises ``Ended`` when ``alive`` says no between two
    passes. Values that are missing or not finite give missing coefficients.
    """
    m = len(problems)
    low = np.array([q.weights[0] for q in problems])[:, None]
    high = np.array([q.weights[1] for q in problems])[:, None]
    whole = totals(data, p, lambda x, y, g: np.concatenate([[x.shape[1]], x.sum(axis=1)]), 1 + p)
    rows = max(whole[0], 1.0)
    centre = (whole[1:] / rows)[:, None]
    spread = np.sqrt(totals(data, p, lambda x, y, g: ((x - centre) ** 2).sum(axis=1), p) / rows)
    if not np.isfinite(spread).all():
        return [(np.full(p, np.nan), math.nan)] * m
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)[:, None]

    def first(x, y, g):
        x, inside = (x - centre) * scale, member(g).astype(float)
        w = inside * np.where(y > 0, high, low)
        return np.concatenate([inside.sum(axis=1), w.sum(axis=1), (w * w).sum(axis=1), (x @ w.T).ravel(), ((x * x) @ w.T).ravel()])

    sums = totals(data, p, first, m * (3 + 2 * p))
    counts, weight, squares = sums[: 3 * m].reshape(3, m)
    mean, second = sums[3 * m :].reshape(2, p, m) / np.maximum(weight, 1e-300)
    unbiased = weight / np.maximum(weight - squares / np.maximum(weight, 1e-300), 1e-300)
    sigma = np.sqrt(np.maximum(second - mean**2, 0.0) * unbiased)  # of a problem's own rows
    up, down = np.triu_indices(p + 1)
    even = bool((low == 1).all() and (high == 1).all())

    def at(points: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Mean loss, gradient and curvature of the problems ``own`` at ``points``, a row each."""

        def kernel(x, y, g):
            full = np.ones((p + 1, x.shape[1]))
            np.subtract(x, centre, out=full[:p])
            full[:p] *= scale
            w = member(g)[own].astype(float)
            if not even:
                w *= np.where(y > 0, high[own], low[own])
            side = np.where(y > 0, -1.0, 1.0)
            z = points @ full
            z *= side  # the loss is log(1 + exp(z)), s the probability of the other class
            e = np.exp(-np.abs(z))
            above = np.maximum(z, 0.0)
            s = np.exp(z - above) / (1.0 + e)
            loss = (w * (above + np.log1p(e))).sum(axis=1)
            w *= s
            slope = full @ (w * side).T
            w *= 1.0 - s
            return np.concatenate([loss, slope.ravel(), ((full[up] * full[down]) @ w.T).ravel()])

        k = len(own)
        found = totals(data, p, kernel, k * (2 + p + len(up)))
        loss, slope, bend = found[:k], found[k : k * (2 + p)].reshape(p + 1, k), found[k * (2 + p) :].reshape(len(up), k)
        full = np.zeros((k, p + 1, p + 1))
        full[:, up, down] = full[:, down, up] = bend.T
        mass = np.maximum(weight[own], 1e-300)
        return loss / mass, slope.T / mass[:, None], full / mass[:, None, None]

    reg = [1.0 / (q.strength * max(n, 1.0)) for q, n in zip(problems, counts)]
    lasso = np.array([r * q.mix for r, q in zip(reg, problems)])[:, None] * sigma.T
    ridge = np.array([r * (1 - q.mix) for r, q in zip(reg, problems)])[:, None] * sigma.T**2
    penalty = lambda i, b: float(lasso[i] @ np.abs(b[:p]) + ridge[i] @ b[:p] ** 2 / 2)
    solved = np.zeros((m, p + 1))
    tried, base = np.zeros((m, p + 1)), [None] * m
    share = np.ones(m)
    left, steps = np.flatnonzero(counts > 0), np.zeros(m, dtype=int)
    while len(left):
        if not alive():
            raise Ended
        loss, slope, bend = at(tried[left], left)
        going = []
        for i, f, g, h in zip(left.tolist(), loss, slope, bend):
            value = f + penalty(i, tried[i])
            if base[i] is not None and not value <= base[i][0]:
                # beyond the valley: half the way
                share[i] /= 2
                if share[i] > 1e-6:
                    tried[i] = solved[i] + share[i] * base[i][1]
                    going.append(i)
                continue
            solved[i] = tried[i]
            step = newton_step(solved[i], g, h, lasso[i], ridge[i])
            after = solved[i] + step
            gain = -(g @ step + step @ h @ step / 2 + penalty(i, after) - penalty(i, solved[i]))
            steps[i] += 1
            if gain <= TOLERANCE * math.log(2) or steps[i] > problems[i].max_iter:
                continue
            base[i], share[i], tried[i] = (value, step), 1.0, after
            going.append(i)
        left = np.array(going, dtype=int)
    out = []
    for b in solved:
        slopes = b[:p] * scale[:, 0]
        out.append((slopes, float(b[p] - slopes @ centre[:, 0])))
    return out


def newton_step(b: np.ndarray, g: np.ndarray, h: np.ndarray, lasso: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """The step to the lowest point of the quadratic model with its penalties; the last coefficient has none."""
    q = len(b)
    l1, l2 = np.append(lasso, 0.0), np.append(ridge, 0.0)
    # a hair of ridge around the present point keeps features without spread where they are
    h = h + np.eye(q) * (1e-12 * max(float(np.trace(h)), 1e-12) / q)
    if not l1.any():
        return np.linalg.solve(h + np.diag(l2), -(g + l2 * b))
    d = np.zeros(q)
    for _ in range(10_000):
        moved = 0.0
        for j in range(q):
            a = h[j, j] + l2[j]
            c = a * (b[j] + d[j]) - (g[j] + h[j] @ d + l2[j] * (b[j] + d[j]))
            new = math.copysign(max(abs(c) - l1[j], 0.0), c) / a - b[j]
            moved = max(moved, abs(new - d[j]) * math.sqrt(a))
            d[j] = new
        if moved < 1e-10:
            break
    return d


def probability(features: Sequence[str], model: tuple[np.ndarray, float]) -> Column:
    """The probability of class 1."""
    z = F.lit(float(model[1]))
    for c, b in zip(features, model[0]):
        z = z + F.col(c).cast("double") * F.lit(float(b))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fold_confusions(data: DataFrame, p: int, owner: Sequence[int], models: Sequence[tuple[np.ndarray, float]]) -> np.ndarray:
    """Rows by problem, label and prediction (problems, 2, 2), each on the group that it leaves out: its ``owner``."""
    owner = np.array(owner)[:, None]
    slopes, shift = np.array([b for b, _ in models]), np.array([c for _, c in models])[:, None]

    def kernel(x, y, g):
        mine, hit, one = g == owner, slopes @ x + shift > 0, y > 0
        return np.concatenate([(mine & (one == bool(a)) & (hit == bool(b))).sum(axis=1) for a in (0, 1) for b in (0, 1)]).astype(float)

    return totals(data, p, kernel, 4 * len(models)).reshape(2, 2, len(models)).transpose(2, 0, 1)
