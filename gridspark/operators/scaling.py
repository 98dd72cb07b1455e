"""Feature scaling and predictor diagnostics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.numeric import dbl
from gridspark.functions.scores import standardize
from gridspark.operators.order_statistics import quantile_agg, running_counts, value_counts

BOUNDS = ("clip_lower", "clip_upper", "v_min", "v_max")
SCALER_PARTS = ("clip_lower", "clip_upper", "center", "scale")


def long_features(cells: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """One row per cell and feature: (keep..., feature, value)."""
    doubles = cells.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])
    return doubles.unpivot(list(keep), list(columns), "feature", "value")


def fit_scaler(cells: DataFrame, columns: Sequence[str],
               q: tuple[float, float] | None = (0.001, 0.999)) -> DataFrame:
    """Per feature: clip_lower, clip_upper, center, scale.

    Clip limits are exact linear quantiles; centre and scale are the mean and
    population deviation of the clipped values, a zero scale becoming 1.  Both
    steps work on distinct values; the limits reach the second one as a scalar
    subquery, so no row is shuffled on the feature name.
    """
    features = long_features(cells, columns)
    if q is None:
        infinity = float("inf")
        bounds = features.groupBy("feature").agg(
            F.min("value").alias("v_min"), F.max("value").alias("v_max"))
        bounds = bounds.withColumns({"clip_lower": F.lit(-infinity), "clip_upper": F.lit(infinity)})
    else:
        rows = running_counts(features, ["feature"], "value")
        bounds = rows.groupBy("feature").agg(
            quantile_agg(q[0]).alias("clip_lower"), quantile_agg(q[1]).alias("clip_upper"),
            F.max("v_min").alias("v_min"), F.max("v_max").alias("v_max"))
    row = bounds.agg(*[F.first(F.when(F.col("feature") == c, F.struct(*BOUNDS)), ignorenulls=True).alias(c)
                       for c in columns])
    counts = value_counts(features, ["feature"], "value").withColumn("__b", row.select(F.struct(*columns)).scalar())
    own = None
    for c in columns:
        hit = F.col("feature") == c
        own = F.when(hit, F.col(f"__b.{c}")) if own is None else own.when(hit, F.col(f"__b.{c}"))
    counts = counts.select("feature", "value", "n", own.alias("__own")).select("feature", "value", "n", "__own.*")
    clipped = F.greatest(F.col("clip_lower"), F.least(F.col("clip_upper"), F.col("value")))
    shift = (F.greatest("clip_lower", "v_min") + F.least("clip_upper", "v_max")) / 2.0
    d, n = clipped - shift, F.col("n")
    sums = counts.groupBy("feature", "clip_lower", "clip_upper").agg(
        F.sum("n").alias("n"), F.sum(n * d).alias("s"), F.sum(n * d * d).alias("q"),
        F.max(shift).alias("shift"))
    variance = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    spread = F.sqrt(F.greatest(F.lit(0.0), variance))
    return sums.select("feature", "clip_lower", "clip_upper",
                       (F.col("shift") + F.col("s") / F.col("n")).alias("center"),
                       F.when(spread > 0, spread).otherwise(1.0).alias("scale"))


def scaler_row(scaler: DataFrame, columns: Sequence[str]) -> DataFrame:
    """All scaler parameters as one row of structs, one per feature."""
    struct = F.struct(*SCALER_PARTS)
    return scaler.agg(*[F.first(F.when(F.col("feature") == c, struct), ignorenulls=True).alias(c)
                        for c in columns])


def apply_scaler(cells: DataFrame, scaler: DataFrame, columns: Sequence[str],
                 suffix: str = "_z") -> DataFrame:
    """Standardise ``columns`` with stored parameters.

    The parameters come in as one scalar subquery, evaluated once, and the
    cells stay in a narrow projection.
    """
    out = cells.withColumn("__scaler", scaler_struct(scaler, columns))
    return out.withColumns({f"{c}{suffix}": z for c, z in scaled_columns(columns).items()}).drop("__scaler")


def scaler_struct(scaler: DataFrame, columns: Sequence[str]) -> Column:
    """All scaler parameters as one scalar subquery."""
    return scaler_row(scaler, columns).select(F.struct(*columns)).scalar()


def scaled_columns(columns: Sequence[str], params: str = "__scaler") -> dict[str, Column]:
    """Standardised features, with the parameters in the struct column ``params``."""
    return {c: standardize(F.col(c).cast("double"), *[F.col(f"{params}.{c}.{part}") for part in SCALER_PARTS])
            for c in columns}


def _correlations(columns: Sequence[str]) -> list[Column]:
    """Pearson r of every pair over rows that have both; NULL, not an error, where one of them is constant."""
    out = []
    for a, b in combinations(columns, 2):
        x, y = F.when(dbl(b).isNotNull(), dbl(a)), F.when(dbl(a).isNotNull(), dbl(b))
        out.append(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias(f"{a}|{b}"))
    return out


def pairwise_corr(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson r and r squared of every feature pair from one aggregation."""
    one = cells.agg(*_correlations(columns))
    rows = F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"{a}|{b}").alias("pearson_r"))
        for a, b in combinations(columns, 2)]))
    return one.select(rows).withColumn("pearson_r2", F.col("pearson_r") * F.col("pearson_r"))


def vif(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Variance inflation per feature: 1 / (1 - R2) against the other features.

    One aggregation gives a single row of correlations; only that row is solved,
    by pseudo-inverse, so a feature that others determine gets infinity and the
    rest keep their own values.  A constant feature gets NULL and is left out of
    the others' regressions.  Fewer than two features give no rows.
    """
    columns = list(columns)
    schema = "feature string, r2_vs_others double, vif double"
    if len(columns) < 2:
        return cells.sparkSession.createDataFrame([], schema)
    pairs = list(combinations(range(len(columns)), 2))

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for values in batch.to_numpy(dtype=float):
                m = np.eye(len(columns))
                for (i, j), r in zip(pairs, values):
                    m[i, j] = m[j, i] = r
                r2 = np.full(len(columns), np.nan)
                varies = np.flatnonzero(np.isnan(m).sum(axis=1) < max(1, len(columns) - 1))
                for i in varies:
                    rest = varies[varies != i]
                    r = m[i, rest]
                    if not np.isnan(m[np.ix_(rest, rest)]).any() and not np.isnan(r).any():
                        r2[i] = r @ np.linalg.pinv(m[np.ix_(rest, rest)], rcond=1e-10, hermitian=True) @ r
                unexplained = np.where(1.0 - r2 < 1e-12, 0.0, 1.0 - r2)
                with np.errstate(divide="ignore"):
                    yield pd.DataFrame({"feature": columns, "r2_vs_others": 1.0 - unexplained, "vif": 1.0 / unexplained})

    return cells.agg(*_correlations(columns)).mapInPandas(invert, schema)
