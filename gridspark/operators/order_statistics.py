"""Ranks, quantiles and cumulative counts of very large groups.

A window over all rows of a group would put a group that holds a third of the
data into one task.  Here every order statistic comes from the same three
steps, each of which stays small per task:

1. collapse equal values (partial aggregation, so ties never travel);
2. cut the value axis of each group into narrow bins and take running sums of
   the bin totals - 65,536 rows per octave of values at most, however many rows
   the group has;
3. take running sums inside each (group, bin) and add the bin's offset.

The bins only split the work; results are exact for any bins.  They have equal
relative width (15 millionths or less), so small scores and scores that lie
close together spread over as many bins as others do.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.numeric import dbl

BINS_PER_OCTAVE = 65536.0
_BIN, _ALL = "__bin", "__all"


def value_counts(df: DataFrame, keys: Sequence[str], value: str | Column,
                 measures: Mapping[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value) with summed measures; missing values dropped."""
    value = F.col(value) if isinstance(value, str) else value
    measures = measures or {"n": F.lit(1).cast("bigint")}
    slim = df.select(*keys, dbl(value).alias("value"),
                     *[m.alias(name) for name, m in measures.items()])
    return (slim.where(F.col("value").isNotNull()).groupBy(*keys, "value")
            .agg(*[F.sum(name).alias(name) for name in measures]))


def _bin_of(value: Column) -> Column:
    """Bin number, growing with the value; never NULL.

    The binary exponent and the leading bits of the mantissa, as one number.  Being visibly never NULL keeps the
    join on the bin from adding a filter to one side only, so both sides read the same shuffle.
    """
    size = F.abs(value)
    exponent = F.least(F.greatest(F.floor(F.log2(F.when(size > 0, size))), F.lit(-1000)), F.lit(1023))
    mantissa = F.least(size / F.pow(F.lit(2.0), exponent.cast("double")), F.lit(2.0))
    steps = (exponent + 1001) * F.lit(int(BINS_PER_OCTAVE)) + F.floor((mantissa - 1.0) * BINS_PER_OCTAVE)
    magnitude = F.greatest(F.coalesce(steps, F.lit(0)), F.lit(0))
    return F.coalesce(F.when(value < 0, -magnitude).otherwise(magnitude), F.lit(0))


def running_counts(df: DataFrame, keys: Sequence[str], value: str | Column,
                   measures: Mapping[str, Column] | None = None) -> DataFrame:
    """Distinct values with, per measure ``m``: m, m_before, m_total.

    ``m_before`` sums over strictly smaller values of the group and ``m_total``
    over the whole group; ``v_min`` and ``v_max`` are the group's extremes.
    Keys must not be NULL.
    """
    measures = dict(measures or {"n": F.lit(1).cast("bigint")})
    keys = list(keys)
    constant = not keys
    if constant:
        df, keys = df.withColumn(_ALL, F.lit(1)), [_ALL]
    counts = value_counts(df, keys, value, measures)
    binned = counts.withColumn(_BIN, _bin_of(F.col("value")))

    totals = binned.groupBy(*keys, _BIN).agg(
        *[F.sum(m).alias(m) for m in measures],
        F.min("value").alias("__lo"), F.max("value").alias("__hi"))
    group = Window.partitionBy(*keys)
    earlier_bins = group.orderBy(_BIN).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, _BIN,
        *[F.coalesce(F.sum(m).over(earlier_bins), F.lit(0)).alias(f"__{m}_offset") for m in measures],
        *[F.sum(m).over(group).alias(f"{m}_total") for m in measures],
        F.min("__lo").over(group).alias("v_min"), F.max("__hi").over(group).alias("v_max"))

    in_bin = Window.partitionBy(*keys, _BIN).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    local = binned.select(
        *keys, _BIN, "value", *measures,
        *[F.coalesce(F.sum(m).over(in_bin), F.lit(0)).alias(f"__{m}_local") for m in measures])
    rows = local.join(offsets, [*keys, _BIN])
    out_keys = [] if constant else keys
    return rows.select(
        *out_keys, "value", "v_min", "v_max",
        *[c for m in measures for c in (
            F.col(m), (F.col(f"__{m}_local") + F.col(f"__{m}_offset")).alias(f"{m}_before"),
            F.col(f"{m}_total"))])


def quantile_agg(p: float, measure: str = "n") -> Column:
    """Linear-interpolated quantile over the rows of :func:`running_counts`.

    An ordinary aggregate (two filtered minima), so groups combine partially.
    """
    total, before = F.col(f"{measure}_total"), F.col(f"{measure}_before")
    through = before + F.col(measure)
    position = (total - 1) * F.lit(float(p))
    low = F.min(F.when(through > F.floor(position), F.col("value")))
    high = F.min(F.when(through > F.ceil(position), F.col("value")))
    fraction = F.max(position - F.floor(position))
    return F.when(F.max(total) > 0, low + (high - low) * fraction)


def quantiles(df: DataFrame, keys: Sequence[str], value: str | Column,
              probabilities: Mapping[str, float]) -> DataFrame:
    """Exact quantiles per group, one named column per probability."""
    rows = running_counts(df, keys, value)
    return rows.groupBy(*keys).agg(*[quantile_agg(p).alias(name) for name, p in probabilities.items()])


def mid_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Average rank of every distinct value within its group."""
    rows = running_counts(df, keys, value)
    rank = F.col("n_before") + (F.col("n") + 1) / 2.0
    return rows.select(*keys, "value", "n", rank.alias("mid_rank"))


def class_measures(label: str | Column, weight: str | None = None) -> dict[str, Column]:
    """Counts of class 0 and class 1 as measures n0 and n1.

    ``weight`` names a count column of rows that stand for several cells.
    """
    label = F.col(label) if isinstance(label, str) else label
    one = F.lit(1) if weight is None else F.col(weight)
    return {f"n{c}": F.when(label == c, one).otherwise(0).cast("bigint") for c in (0, 1)}


def sample_cap(df: DataFrame, group: Sequence[str], n: int, cell: Sequence[str],
               seed: int = 42) -> DataFrame:
    """At most ``n`` rows per group, without replacement, fixed by ``seed``.

    Rows are ordered by a hash of their identity.  The hash range is cut into
    65,536 slices; slices that cannot hold one of the first ``n`` rows are
    dropped by a join with their counts on (group, slice), and a slice, not a
    group, is what one task ranks.
    """
    group = list(group)
    draws = df.withColumn("__draw", F.xxhash64(F.lit(seed), *cell))
    draws = draws.withColumn("__slice", F.shiftrightunsigned(F.col("__draw"), 48).cast("int"))
    ordering = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (draws.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
              .withColumn("__before", F.coalesce(F.sum("__n").over(ordering), F.lit(0)))
              .where(F.col("__before") < n).select(*group, "__slice", "__before"))
    kept = draws.join(slices, [*group, "__slice"])
    rank = F.row_number().over(Window.partitionBy(*group, "__slice").orderBy("__draw", *cell))
    return (kept.withColumn("__rank", rank + F.col("__before")).where(F.col("__rank") <= n)
            .select(*df.columns))


def first_match(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """The row with the smallest ``order`` per key, as a partial aggregate."""
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*columns, order), F.col(order)).alias("__row"))
    return picked.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in (*columns, order)])


def by_magnitude(df: DataFrame, column: str) -> DataFrame:
    """Order by absolute value, largest first."""
    return df.orderBy(F.abs(F.col(column)).desc_nulls_last())
