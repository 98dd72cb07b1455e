"""NaN counts as missing; singular and constant predictors give values, not errors."""

import math

import pytest
from pyspark.sql import functions as F

from gridspark.functions.scores import binarize, standardize
from gridspark.operators.order_statistics import value_counts
from gridspark.operators.scaling import pairwise_corr, vif
from gridspark.operators.soil import awc_from_point_ptf

NAN = float("nan")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(NAN,), (None,), (5000.0,)], "x double")
    assert [r[0] for r in df.select(binarize(F.col("x"))).collect()] == [None, None, 1]
    lit = [F.lit(v) for v in (0.0, 10.0, 0.0, 1.0)]
    assert [r[0] for r in df.select(standardize(F.col("x"), *lit)).collect()] == [None, None, 10.0]
    assert [tuple(r) for r in value_counts(df, [], "x").collect()] == [(5000.0, 1)]


def test_nan_prediction(spark):
    rows = [(1.0, 1.0, 1.0, 0.0, 0.1, fc, 0.1) for fc in (NAN, None, 0.4)]
    df = spark.createDataFrame(rows, "sand double, clay double, trd double, gravel double, thick_mm double, fc double, wp double")
    got = [r.awc_vol for r in awc_from_point_ptf(df).collect()]
    assert got[:2] == [None, None] and got[2] == pytest.approx(0.3)


def test_singular_and_constant(spark):
    rows = [(float(i), 2.0 * i, float((i * 7) % 11), 3.0) for i in range(50)]
    df = spark.createDataFrame(rows, "a double, b double, c double, k double")
    got = {r.feature: r.vif for r in vif(df, ["a", "b", "c", "k"]).collect()}
    assert got["a"] == got["b"] == math.inf and 1.0 <= got["c"] < 1.1 and got["k"] is None
    r = {(x.feature_1, x.feature_2): x.pearson_r for x in pairwise_corr(df, ["a", "b", "k"]).collect()}
    assert r["a", "b"] == pytest.approx(1.0) and r["a", "k"] is None and r["b", "k"] is None
