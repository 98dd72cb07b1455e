"""Class, scaling and skill expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridspark.functions.numeric import clip, nn


def binarize(value: Column, threshold: float = 4000.0, strict: bool = False) -> Column:
    """1 above the threshold, else 0; NULL and NaN give NULL.

    ``strict`` compares with ``>`` (hexagon shares), otherwise ``>=`` (classes).
    """
    value = nn(value)
    hit = value > threshold if strict else value >= threshold
    return hit.cast("int")


def standardize(x: Column, lo: Column, hi: Column, center: Column, scale: Column) -> Column:
    return (clip(nn(x), lo, hi) - center) / scale


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def probability(features: Sequence[Column], coefficients: Sequence, intercept) -> Column:
    """Logistic probability of standardised features; NULL if any is NULL."""
    z = intercept if isinstance(intercept, Column) else F.lit(float(intercept))
    for x, w in zip(features, coefficients, strict=True):
        z = z + (w if isinstance(w, Column) else F.lit(float(w))) * x
    return sigmoid(z)


def _usable(prevalence: Column) -> Column:
    return F.when((prevalence > 0) & (prevalence < 1), prevalence)


def brier_skill_score(brier: Column, prevalence: Column) -> Column:
    p = _usable(prevalence)
    return 1.0 - brier / (p * (1.0 - p))


def pr_auc_skill_ratio(average_precision: Column, prevalence: Column) -> Column:
    return average_precision / _usable(prevalence)
