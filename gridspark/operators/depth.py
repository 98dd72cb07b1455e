"""Available water over depth: one shuffle on the cell, partial sums before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Depth layers in cm.
LAYER_RANGES = ("0_5", "5_15", "15_30", "30_60", "60_100", "100_200")
CELL = ("row", "col")


def layer_table(spark: SparkSession, ranges: Sequence[str] = LAYER_RANGES) -> DataFrame:
    """layer (1-based), upper_cm, lower_cm, thick_mm; one row per named range."""
    rows = []
    for number, text in enumerate(ranges, start=1):
        upper, lower = (int(part) for part in text.split("_"))
        rows.append((number, upper, lower, (lower - upper) * 10))
    return spark.createDataFrame(rows, "layer int, upper_cm int, lower_cm int, thick_mm int")


def with_layers(soil: DataFrame, ranges: Sequence[str] = LAYER_RANGES) -> DataFrame:
    """Attach layer limits; the layer table has ``len(ranges)`` rows."""
    return soil.join(F.broadcast(layer_table(soil.sparkSession, ranges)), "layer")


def gravel_share(null_is_zero: bool = False) -> Column:
    share = F.col("gravel") / 100.0
    return F.coalesce(share, F.lit(0.0)) if null_is_zero else share


def layer_awc_mm(df: DataFrame, null_gravel_is_zero: bool = False) -> DataFrame:
    """awc_vol * (1 - gravel share) * thickness."""
    return df.withColumn(
        "layer_awc_mm",
        F.col("awc_vol") * (1.0 - gravel_share(null_gravel_is_zero)) * F.col("thick_mm"),
    )


def awc_totals(df: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """awc_1m and awc_2m per cell; NULL only when every layer is NULL."""
    mm = F.col("layer_awc_mm")
    return df.groupBy(*keys).agg(
        F.sum(F.when(F.col("upper_cm") < 100, mm)).alias("awc_1m"),
        F.sum(mm).alias("awc_2m"),
    )


def _share_above(depth_cm: Column, strict_nulls: bool) -> Column:
    """Part of the layer's water that lies above ``depth_cm``.

    Without ``strict_nulls`` a layer below the depth counts as zero water even
    if its own value is missing.
    """
    mm, upper, lower = F.col("layer_awc_mm"), F.col("upper_cm"), F.col("lower_cm")
    partial = mm / F.when(F.col("thick_mm") > 0, F.col("thick_mm")) * (depth_cm - upper) * 10
    part = F.when(depth_cm >= lower, mm).when((depth_cm > upper) & (depth_cm < lower), partial)
    return part if strict_nulls else part.when(depth_cm <= upper, 0.0)


def _zero_if_layers_below(total: Column, depth_cm: Column, ranges: Sequence[str],
                          strict_nulls: bool) -> Column:
    """Missing profile rows stand for missing layers, so they count as zero too."""
    if strict_nulls:
        return total
    deepest_upper = max(int(text.split("_")[0]) for text in ranges)
    return F.coalesce(total, F.when(depth_cm <= deepest_upper, 0.0))


def awc_to_depth(df: DataFrame, cm: float, strict_nulls: bool = False,
                 ranges: Sequence[str] = LAYER_RANGES, keys: Sequence[str] = CELL) -> DataFrame:
    """Water above a constant depth, pro-rating the layer it cuts."""
    depth = F.lit(float(cm))
    total = df.groupBy(*keys).agg(F.sum(_share_above(depth, strict_nulls)).alias("t"))
    return total.select(*keys, _zero_if_layers_below(F.col("t"), depth, ranges, strict_nulls)
                        .alias("awc_mm"))


def awc_to_rooting_depth(df: DataFrame, mrd: DataFrame, strict_nulls: bool = False,
                         ranges: Sequence[str] = LAYER_RANGES,
                         keys: Sequence[str] = CELL) -> DataFrame:
    """Water above the cell's own rooting depth ``mrd_cm``; NULL without one.

    ``mrd`` has one row per cell.  The join and the aggregation share the cell
    key, so the profile is shuffled once.
    """
    depth = F.col("mrd_cm")
    joined = df.join(mrd.select(*keys, "mrd_cm"), list(keys), "left")
    total = joined.groupBy(*keys).agg(
        F.sum(_share_above(depth, strict_nulls)).alias("t"), F.first("mrd_cm").alias("mrd_cm")
    )
    value = _zero_if_layers_below(F.col("t"), depth, ranges, strict_nulls)
    return total.select(*keys, "mrd_cm", F.when(depth.isNotNull(), value).alias("awc_mrd"))


def stack_depths(wide: DataFrame, ptf: str, columns: Sequence[str] = ("awc_1m", "awc_2m"),
                 keys: Sequence[str] = CELL) -> DataFrame:
    """awc_1m, awc_2m, ... -> (ptf, depth, row, col, awc_mm)."""
    rows = F.inline(F.array(*[
        F.struct(F.lit(c.removeprefix("awc_")).alias("depth"), F.col(c).alias("awc_mm")) for c in columns]))
    return wide.select(F.lit(ptf).alias("ptf"), *keys, rows).select("ptf", "depth", *keys, "awc_mm")


def awc_wide(profile: DataFrame, names: Sequence[str], null_gravel_is_zero: bool | Sequence[str] = False,
             keys: Sequence[str] = CELL) -> DataFrame:
    """One row per cell with ``<name>@1m`` and ``<name>@2m`` of every function.

    ``profile`` carries a ``<name>_awc_vol`` column per function and the layer
    limits.  All functions are summed side by side in a single aggregation.
    ``null_gravel_is_zero`` may name the functions for which missing gravel counts as none.
    """
    lenient = names if null_gravel_is_zero is True else null_gravel_is_zero or ()
    factor = lambda n: (1.0 - gravel_share(n in lenient)) * F.col("thick_mm")
    layers = profile.select(*keys, "upper_cm", *[(F.col(f"{n}_awc_vol") * factor(n)).alias(n) for n in names])
    sums = []
    for name in names:
        sums.append(F.sum(F.when(F.col("upper_cm") < 100, F.col(name))).alias(f"{name}@1m"))
        sums.append(F.sum(name).alias(f"{name}@2m"))
    return layers.groupBy(*keys).agg(*sums)


def unfold_maps(wide: DataFrame, names: Sequence[str], kept: Sequence[str] = CELL) -> DataFrame:
    """Rows (ptf, depth, awc_mm) of the columns of :func:`awc_wide`, after the columns ``kept``."""
    rows = F.inline(F.array(*[
        F.struct(F.lit(n).alias("ptf"), F.lit(d).alias("depth"), F.col(f"{n}@{d}").alias("awc_mm"))
        for n in names for d in ("1m", "2m")]))
    return wide.select(*kept, rows)


def awc_maps(profile: DataFrame, names: Sequence[str], null_gravel_is_zero: bool | Sequence[str] = False,
             keys: Sequence[str] = CELL) -> DataFrame:
    """(ptf, depth, row, col, awc_mm) of many functions from one scan and one shuffle.

    Only the per-cell result of :func:`awc_wide` is turned into long form.
    """
    wide = awc_wide(profile, names, null_gravel_is_zero, keys)
    return unfold_maps(wide, names, keys).select("ptf", "depth", *keys, "awc_mm")
