"""Reading cell tables.  Variables, layers and years are partition columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.functions.numeric import dbl
from gridspark.functions.ka5 import CODE_OF
from gridspark.operators.depth import LAYER_RANGES, with_layers
from gridspark.operators.grid import Grid, resample_nearest

SOIL_VARIABLES = ("sand", "clay", "gravel", "trd", "soc")
LOOKUP_SCHEMA = "texture string, thr double, ths double, alpha double, n double, tort double, ksat double"


def read_cells(spark: SparkSession, path: str, nodata: float | None = None, value: str = "value",
               drop_missing: bool = False) -> DataFrame:
    """One layer of cells with nodata and NaN as NULL."""
    return clean_cells(spark.read.parquet(path), nodata, value, drop_missing)


def clean_cells(cells: DataFrame, nodata: float | None = None, value: str = "value",
                drop_missing: bool = False) -> DataFrame:
    v = dbl(value)
    if nodata is not None:
        v = F.when(v != nodata, v)
    cleaned = cells.withColumn(value, v)
    return cleaned.dropna(subset=[value]) if drop_missing else cleaned


def pivot_soil(long: DataFrame, variables: Sequence[str] = SOIL_VARIABLES,
               ranges: Sequence[str] = LAYER_RANGES,
               names: Mapping[str, str] | None = None) -> DataFrame:
    """(var, layer, row, col, value) -> one row per cell and layer with its limits.

    ``names`` maps a standard variable to its name in the source.  Filters on
    ``var`` and ``layer`` come first so that they prune partitions; the pivot
    names its values, so no extra pass looks for them.  A variable missing for
    a layer stays NULL.
    """
    names = {v: (names or {}).get(v, v) for v in variables}
    wanted = long.where(F.col("var").isin(list(names.values()))
                        & F.col("layer").isin(list(range(1, len(ranges) + 1))))
    wide = (wanted.groupBy("row", "col", "layer").pivot("var", list(names.values()))
            .agg(F.first(dbl("value"), ignorenulls=True)))
    renamed = wide.select("row", "col", "layer", *[F.col(src).alias(std) for std, src in names.items()])
    return with_layers(renamed, ranges)


def load_soil_cube(spark: SparkSession, path: str, variables: Sequence[str] = SOIL_VARIABLES,
                   ranges: Sequence[str] = LAYER_RANGES,
                   names: Mapping[str, str] | None = None) -> DataFrame:
    """Soil table from Parquet partitioned by ``var`` and ``layer``."""
    return pivot_soil(spark.read.parquet(path), variables, ranges, names)


def load_mrd(mrd: DataFrame, src: Grid, targets: DataFrame, dst: Grid, value: str = "mrd_cm") -> DataFrame:
    """Rooting depth snapped to the soil grid; values up to 0 are missing."""
    snapped = resample_nearest(mrd, src, targets, dst, value)
    return snapped.withColumn(value, F.when(F.col(value) > 0, F.col(value)))


def daily_of(climate: DataFrame, var: str, years: Sequence[int]) -> DataFrame:
    """Daily rows of one variable and some years: (date, row, col, value)."""
    if "var" in climate.columns:  # long layout, partitioned by var and year
        rows = climate.where(F.col("var") == var)
    else:
        rows = climate.withColumn("value", F.col(var))
    in_years = (F.col("year") if "year" in climate.columns else F.year("date")).isin([int(y) for y in years])
    return rows.where(in_years).select("date", "row", "col", dbl("value").alias("value"))


def load_daily(spark: SparkSession, path: str, var: str, years: Sequence[int]) -> DataFrame:
    """:func:`daily_of` from Parquet partitioned by ``var`` and ``year``.

    Raises if the years hold no data (a one-row probe of the pruned partitions).
    """
    rows = daily_of(spark.read.parquet(path), var, years)
    if rows.isEmpty():
        raise ValueError(f"no {var!r} data for years {list(years)} in {path}")
    return rows


def load_lookup(spark: SparkSession, path: str) -> DataFrame:
    """Class parameters from CSV, keyed by class code; unknown names are dropped."""
    table = spark.read.csv(path, header=True, schema=LOOKUP_SCHEMA)
    codes = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])
    return table.withColumn("ka5", codes[F.col("texture")].cast("smallint")).dropna(subset=["ka5"])


def read_summary_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A written summary with the types of ``schema``; columns in another order than its own are an error."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
