"""Point functions as random forests: water contents at field capacity and wilting point from soil properties.

Both forests are Spark ML models, fitted, stored, loaded and scored inside the JVM; no row leaves it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import soil

FEATURES = ("sand", "clay", "soc", "trd")
TARGETS = ("fc", "wp")


def _assembled(df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    doubles = df.withColumns({f"__{f}": F.col(f).cast("double") for f in features})
    ready = VectorAssembler(inputCols=[f"__{f}" for f in features], outputCol=name, handleInvalid="keep").transform(doubles)
    return ready.drop(*(f"__{f}" for f in features))


def fit_point_forests(samples: DataFrame, features: Sequence[str] = FEATURES, targets: Sequence[str] = TARGETS,
                      n_trees: int = 20, max_depth: int = 5, seed: int = 42, **settings) -> dict[str, RandomForestRegressionModel]:
    """One forest per target from samples with measured ``targets``; samples with a gap are left out.

    ``settings`` are further parameters of the regressor, such as ``bootstrap`` or ``featureSubsetStrategy``.
    """
    known = samples.dropna(subset=[*features, *targets]).select(*features, *(F.col(t).cast("double").alias(t) for t in targets))
    ready = _assembled(known, features, "__x").select("__x", *targets)
    return {t: RandomForestRegressor(featuresCol="__x", labelCol=t, numTrees=n_trees, maxDepth=max_depth, seed=seed, **settings).fit(ready)
            for t in targets}


def store_forests(forests: Mapping[str, RandomForestRegressionModel], folder: str) -> None:
    """Write each forest to ``<folder>/<target>``; an existing one is an error, as stored models are never changed."""
    for target, forest in forests.items():
        forest.write().save(f"{folder}/{target}")


def load_forests(folder: str, targets: Sequence[str] = TARGETS) -> dict[str, RandomForestRegressionModel]:
    return {t: RandomForestRegressionModel.load(f"{folder}/{t}") for t in targets}


def predict_points(profile: DataFrame, forests: Mapping[str, RandomForestRegressionModel],
                   features: Sequence[str] = FEATURES) -> DataFrame:
    """``profile`` with one column per forest; NULL where a feature is missing."""
    gap = F.lit(False)
    for f in features:
        gap = gap | F.col(f).isNull()
    out = _assembled(profile.withColumn("__gap", gap), features, "__x")
    for target, forest in forests.items():
        scored = forest.copy().setFeaturesCol("__x").setPredictionCol("__prediction").transform(out.drop(target))
        out = scored.withColumn(target, F.when(~F.col("__gap"), F.col("__prediction"))).drop("__prediction")
    return out.drop("__x", "__gap")


def awc_from_forests(profile: DataFrame, forests: Mapping[str, RandomForestRegressionModel],
                     features: Sequence[str] = FEATURES) -> DataFrame:
    """fc, wp, awc_vol and layer_awc_mm of a profile with layer limits, as :func:`soil.awc_from_point_ptf` has them."""
    return soil.awc_from_point_ptf(predict_points(profile, forests, features))
