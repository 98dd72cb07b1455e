"""Tail probabilities for finished statistics (one row per result, not per cell).

Spark has no ``erf`` or t distribution.  These vectorised functions run only on
summary rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) with ``df`` degrees of freedom."""
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x)
                     + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_critical(level: float, df: float) -> float:
    """t with P(|T| <= t) = level, by bisection."""
    lo, hi = 0.0, 1.0
    while t_two_sided(hi, df) > 1.0 - level:
        hi *= 2.0
    for _ in range(200):
        mid = 0.5 * (lo + hi)
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1.0 - level else (lo, mid)
    return 0.5 * (lo + hi)


def _each(fn, *series: pd.Series) -> pd.Series:
    values = [fn(*row) if not any(v is None or np.isnan(v) for v in row) else None
              for row in zip(*series)]
    return pd.Series(values, dtype="float64")


@F.pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    return _each(normal_upper, z)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(t_two_sided, t, df)


@F.pandas_udf(DoubleType())
def t_quantile_975(df: pd.Series) -> pd.Series:
    return _each(lambda d: t_critical(0.95, d) if d > 0 else None, df)
