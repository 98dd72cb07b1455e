"""Per-day, per-cell climate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.numeric import clip


def saturation_vapour_pressure(temp_c: Column) -> Column:
    """Tetens formula in kPa (fixed values 0.6108, 17.27, 237.3)."""
    return F.lit(0.6108) * F.exp(F.try_divide(17.27 * temp_c, temp_c + 237.3))


def vpd(tas: Column, td: Column) -> Column:
    """Vapour pressure deficit of one day, not below zero."""
    return clip(saturation_vapour_pressure(tas) - saturation_vapour_pressure(td), lo=0.0)


def anomaly(actual: Column, base: Column, method: str) -> Column:
    """Percent of normal (NULL for |base| <= 0.001) or difference."""
    if method == "percent":
        return actual / F.when(F.abs(base) > 0.001, base) * 100.0
    if method == "absolute":
        return actual - base
    raise ValueError(f"unknown anomaly method {method!r}")
