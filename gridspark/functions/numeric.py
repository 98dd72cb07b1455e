"""Null-safe double arithmetic.

Missing cells are SQL NULL, never NaN, because Spark orders NaN above every
number.  ANSI mode raises on division by zero and returns NULL for ``ln(0)``;
these helpers give the IEEE results that array code would give.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")


def dbl(c: str | Column) -> Column:
    """Column as DOUBLE with NaN turned into NULL."""
    c = F.col(c) if isinstance(c, str) else c
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def nn(c: Column) -> Column:
    """NaN -> NULL; ``c`` is computed once, where a CASE would compute it for its test and again for its value."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def safe_ln(x: Column) -> Column:
    """ln(x) with ln(0) = -Infinity and NULL for negative input."""
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(NEG_INF))


def clip(x: Column, lo=None, hi=None) -> Column:
    """Clamp, keeping NULL (``greatest``/``least`` alone would skip it)."""
    y = x
    if lo is not None:
        lo = lo if isinstance(lo, Column) else F.lit(float(lo))
        y = F.when(y < lo, lo).otherwise(y)
    if hi is not None:
        hi = hi if isinstance(hi, Column) else F.lit(float(hi))
        y = F.when(y > hi, hi).otherwise(y)
    return y


def linear(terms: Mapping[str, Column], coefficients: Mapping[str, float]) -> Column:
    """Sum of ``coefficient * term``; the key ``"1"`` is the intercept.

    Regressions are kept as coefficient tables over named terms, so one plain
    expression per target reaches whole-stage codegen and shared terms are
    computed once per row.
    """
    parts = [
        F.lit(value) if name == "1" else F.lit(value) * terms[name]
        for name, value in coefficients.items()
    ]
    return reduce(lambda a, b: a + b, parts)

