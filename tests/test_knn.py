"""Nearest-neighbour imputation against a plain NumPy version."""

import numpy as np
import pandas as pd
import pytest

from lakegauge.operators import knn
from lakegauge.operators.knn import knn_impute


def brute_force(q, d, k):
    out = q.copy()
    for i in range(len(q)):
        for j in np.flatnonzero(np.isnan(q[i])):
            found = []
            for row in d:
                if np.isnan(row[j]):
                    continue
                both = ~np.isnan(q[i]) & ~np.isnan(row)
                if both.any():
                    found.append((np.sqrt(((q[i][both] - row[both]) ** 2).sum() * len(row) / both.sum()), row[j]))
            found = sorted(found)[:k]
            if not found:
                out[i, j] = np.nanmean(d[:, j])
            elif found[0][0] == 0:
                out[i, j] = np.mean([v for x, v in found if x == 0])
            else:
                w = np.array([1 / x for x, _ in found])
                out[i, j] = (w * np.array([v for _, v in found])).sum() / w.sum()
    return out


@pytest.mark.parametrize(("block_rows", "task_rows"), [(10_000, 10_000), (7, 10_000), (30, 4)])
def test_matches_brute_force(spark, monkeypatch, block_rows, task_rows):
    monkeypatch.setattr(knn, "TASK_ROWS", task_rows)
    rng = np.random.default_rng(3)
    d = rng.normal(size=(120, 3))
    d[40:50] = d[0]
    d[rng.random(d.shape) < 0.2] = np.nan
    q = rng.normal(size=(30, 3))
    q[rng.random(q.shape) < 0.4] = np.nan
    q[0] = np.nan
    want = brute_force(q, d, 5)
    cols = ["a", "b", "c"]
    frame = lambda x: spark.createDataFrame(pd.DataFrame(x, columns=cols).assign(id=range(len(x)))).replace(float("nan"), None)
    got = knn_impute(frame(q), frame(d), cols, block_rows=block_rows).orderBy("id").toPandas()[cols].to_numpy()
    assert np.allclose(got, want)


def test_single_column_takes_the_mean(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (None,)], "a double")
    assert sorted(r.a for r in knn_impute(df, df, ["a"]).collect()) == [1.0, 2.0, 3.0]


def test_one_known_value_is_searched_in_order(spark, monkeypatch):
    """Ties and copies on a line of blocks; no row meets the donors of a block one by one."""
    rng = np.random.default_rng(8)
    d = np.column_stack([rng.integers(0, 9, 400), rng.integers(0, 60, 400)]).astype(float)
    q = np.column_stack([np.full(90, np.nan), rng.integers(-5, 70, 90) + rng.choice([0.0, 0.5], 90)])
    want = brute_force(q, d, 5)
    frame = lambda x: spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]).assign(id=range(len(x)))).replace(float("nan"), None)
    for block_rows in (10_000, 20, 3):
        got = knn_impute(frame(q), frame(d), ["a", "b"], block_rows=block_rows).orderBy("id").toPandas()[["a", "b"]].to_numpy()
        assert np.allclose(got, want)
    seen = []
    donors = np.arange(100_000.0)
    monkeypatch.setattr(np, "clip", lambda v, *a, _clip=np.clip: seen.append(np.size(v)) or _clip(v, *a))
    knn.along_line(np.arange(50.0) * 1000 + 0.4, donors, donors, np.ones(100_000, dtype=int), 5, 2)
    assert seen and sum(seen) < 50 * 100
