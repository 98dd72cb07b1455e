"""Integer encodings, partitioned writes and summary tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.operators.lookup import per_key
from gridspark.operators.order_statistics import by_magnitude
from gridspark.operators.run_keys import pending

NODATA = -9999
INT_RANGE = {"int8": (-128, 127), "int16": (-32768, 32767), "int32": (-2147483648, 2147483647)}
SQL_TYPE = {"int8": "tinyint", "int16": "smallint", "int32": "int"}
FIELD_KEYS = ("var", "stat", "year", "season")


def encode_int16(value: Column, nodata: int = NODATA, rounding: str = "trunc") -> Column:
    """SMALLINT with NULL (or overflow) as ``nodata``; truncating unless rounded half-even."""
    if rounding not in ("trunc", "half_even"):
        raise ValueError(f"unknown rounding {rounding!r}")
    v = F.bround(value, 0) if rounding == "half_even" else value
    return F.coalesce(v.try_cast("smallint"), F.lit(nodata).cast("smallint"))


def write_cells_int16(awc: DataFrame, path: str, nodata: int = NODATA, rounding: str = "trunc",
                      value: str = "awc_mm", mode: str = "overwrite") -> None:
    """Maps as SMALLINT Parquet, one partition per function and depth."""
    (awc.withColumn(value, encode_int16(F.col(value), nodata, rounding))
     .write.mode(mode).partitionBy("ptf", "depth").parquet(path))


def scale_factors(layers: DataFrame, keys: Sequence[str], value: str = "value",
                  dtype: str = "int16") -> DataFrame:
    """Largest power of ten up to 10,000 that keeps every value of a layer in range.

    A layer without any value is an error.
    """
    top = INT_RANGE[dtype][1]
    largest = F.max(F.abs(F.col(value)))
    factor = F.lit(1)
    for candidate in (10, 100, 1000, 10000):
        factor = F.when(largest * candidate <= top, candidate).otherwise(factor)
    empty = F.raise_error(F.concat_ws(" ", F.lit("no valid data in layer"), *[F.col(k).cast("string") for k in keys]))
    checked = F.when(F.count(value) > 0, factor).otherwise(empty.cast("int"))
    return layers.groupBy(*keys).agg(checked.alias("factor"))


def scale_to_int(layers: DataFrame, keys: Sequence[str], value: str = "value",
                 dtype: str = "int16") -> DataFrame:
    """Every layer as scaled integers: ``stored`` and ``scale`` (true = stored * scale).

    The factors of all layers are one aggregate, read as a map while the layers
    are encoded, so the cells are not shuffled.
    """
    low = INT_RANGE[dtype][0]
    joined = layers.withColumn("factor", per_key(scale_factors(layers, keys, value, dtype), keys, "factor"))
    stored = F.coalesce(F.bround(F.col(value) * F.col("factor"), 0), F.lit(float(low)))
    return joined.select(*[c for c in layers.columns if c != value],
                         stored.cast(SQL_TYPE[dtype]).alias("stored"), (1.0 / F.col("factor")).alias("scale"))


def existing_keys(spark: SparkSession, path: str, keys: Sequence[str] = FIELD_KEYS) -> DataFrame | None:
    """Stored partition keys, or None before the first write."""
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored.select(*keys).distinct()


def write_missing_fields(fields: DataFrame, path: str, keys: Sequence[str] = FIELD_KEYS) -> None:
    """Append the fields whose partition does not exist yet."""
    done = existing_keys(fields.sparkSession, path, keys)
    todo = fields if done is None else pending(fields, done, keys)
    todo.write.mode("append").partitionBy(*keys).parquet(path)


def write_summary_csv(summary: DataFrame, path: str, columns: Sequence[str] | None = None,
                      largest_first: str | None = None) -> None:
    """One CSV file of a finished summary (a row per run), fixed column order."""
    table = summary.select(*columns) if columns else summary
    table = by_magnitude(table, largest_first) if largest_first else table
    table.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
