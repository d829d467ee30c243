"""P-values of the two-sample tests."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType


def ks_pvalue(d: Column, n: Column, m: Column) -> Column:
    """Kolmogorov limit form ``2 * sum((-1)^(j-1) * exp(-2 j^2 lambda^2))`` with ``lambda = d*sqrt(nm/(n+m))``.

    Below lambda = 0.2 the series does not settle in 100 terms; the value there is 1 to 12 digits.
    """
    lam = d * F.sqrt(n * m / (n + m))
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(100)),
        lambda j: F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * lam * lam),
    )
    series = 2.0 * F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)
    return F.when(lam.isNull(), None).when(lam < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series)))


def _gamma_q(a: float, x: float) -> float:
    """Upper regularised incomplete gamma: power series below a+1, continued fraction above."""
    if x <= 0.0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= x / k
            total += term
        return max(0.0, 1.0 - front * total)
    tiny = 1e-300
    b = x + 1.0 - a
    c, d = 1.0 / tiny, 1.0 / b
    h = d
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2.0
        d = 1.0 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return front * h


@F.pandas_udf(DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution; called on one row per feature."""
    return pd.Series(
        [None if s is None or s != s or k is None or k != k or k <= 0 else _gamma_q(k / 2.0, s / 2.0) for s, k in zip(stat, dof)],
        dtype="float64",
    )
