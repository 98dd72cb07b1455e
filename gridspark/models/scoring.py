"""Stored models as tables, and their application to other cells and years."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.scores import binarize, probability
from gridspark.models.logistic import Model, Scale
from gridspark.operators.class_stats import separability
from gridspark.operators.run_keys import stack
from gridspark.operators.scaling import scaled_columns, scaler_struct


def scaler_table(spark: SparkSession, features: Sequence[str], scales: Sequence[Scale]) -> DataFrame:
    rows = [(f, s.lower, s.upper, s.center, s.scale) for f, s in zip(features, scales)]
    return spark.createDataFrame(
        rows, "feature string, clip_lower double, clip_upper double, center double, scale double")


def coefficient_table(spark: SparkSession, features: Sequence[str], model: Model) -> DataFrame:
    """term, coefficient, odds_ratio; the intercept has no odds ratio."""
    rows = [("intercept", float(model.weights[0]), None)]
    rows += [(f, float(w), float(np.exp(w))) for f, w in zip(features, model.weights[1:])]
    return spark.createDataFrame(rows, "term string, coefficient double, odds_ratio double")


def predict_proba(cells: DataFrame, scaler: DataFrame, coefficients: DataFrame, features: Sequence[str],
                  name: str = "p") -> DataFrame:
    """Probability per cell from stored tables; NULL when a feature is missing.

    Each table enters as one scalar subquery, so scoring stays a narrow
    projection whatever the number of cells.
    """
    terms = ("intercept", *features)
    picked = coefficients.agg(*[
        F.first(F.when(F.col("term") == t, F.col("coefficient")), ignorenulls=True).alias(t) for t in terms])
    held = cells.withColumns({"__scaler": scaler_struct(scaler, features),
                              "__model": picked.select(F.struct(*terms)).scalar()})
    p = probability(list(scaled_columns(features).values()), [F.col(f"__model.{f}") for f in features],
                    F.col("__model.intercept"))
    return held.withColumn(name, p).drop("__scaler", "__model")


def score_scenarios(scenarios: Mapping[str, DataFrame] | DataFrame, scaler: DataFrame, coefficients: DataFrame,
                    features: Sequence[str], threshold: float = 4000.0, disco: str = "disco") -> DataFrame:
    """(label, row, col, p, cls) of all scenarios in one plan.

    ``scenarios`` maps a label to its aligned layers (row, col, features,
    disco), or is one table with a ``label`` column.  Cells with a gap in any
    layer are dropped; a scenario without cells simply yields no rows.
    """
    cells = scenarios if isinstance(scenarios, DataFrame) else stack(
        {k: v.select("row", "col", *features, disco) for k, v in scenarios.items()}, "label")
    cells = cells.dropna(subset=[*features, disco])
    scored = predict_proba(cells, scaler, coefficients, features)
    return scored.select("label", "row", "col", "p", binarize(F.col(disco), threshold).alias("cls"))


def apply_to_years(scenarios, scaler: DataFrame, coefficients: DataFrame, features: Sequence[str],
                   threshold: float = 4000.0, disco: str = "disco") -> DataFrame:
    """Separability of predicted probabilities per scenario."""
    return separability(score_scenarios(scenarios, scaler, coefficients, features, threshold, disco))


def apply_to_year(cells: DataFrame, label: str, scaler: DataFrame, coefficients: DataFrame,
                  features: Sequence[str], threshold: float = 4000.0, disco: str = "disco") -> DataFrame:
    """Probabilities of one scenario, without the comparison."""
    return score_scenarios({label: cells}, scaler, coefficients, features, threshold, disco)
