"""Daily climate to seasonal fields, climatology and anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.climate import anomaly, vpd

# Season months; December belongs to the following year's season.
SEASONS = {"DJFMAM": (12, 1, 2, 3, 4, 5), "JJA": (6, 7, 8)}
# Output name, variable, season, reduction.
SEASONAL_OUTPUTS = (
    ("pr", "pr", "DJFMAM", "sum"),
    ("pr", "pr", "JJA", "sum"),
    ("tas", "tas", "JJA", "mean"),
    ("tasmax", "tasmax", "JJA", "max"),
    ("vpd", "vpd", "JJA", "mean"),
    ("vpdmax", "vpd", "JJA", "max"),
)
# Climatology variable, season, reduction, anomaly method.
CLIMATOLOGY = (
    ("pr", "DJFMAM", "sum", "percent"),
    ("pr", "JJA", "sum", "percent"),
    ("tas", "JJA", "mean", "absolute"),
)
MIN_BASELINE_YEARS = 10
CELL = ("row", "col")


def season_of(date: Column) -> Column:
    month = F.month(date)
    season = None
    for name, months in SEASONS.items():
        season = F.when(month.isin(*months), name) if season is None else season.when(month.isin(*months), name)
    return season


def season_year_of(date: Column) -> Column:
    return F.year(date) + F.when(F.month(date) == 12, 1).otherwise(0)


def select_season(daily: DataFrame) -> DataFrame:
    """Add season and season_year; days outside every season are dropped."""
    date = F.col("date")
    return daily.withColumns({"season": season_of(date), "season_year": season_year_of(date)}).where(
        F.col("season").isNotNull())


def season_days(daily: DataFrame, years: Sequence[int] | None) -> DataFrame:
    """:func:`select_season` for some years; the date range reaches the scan."""
    if years is None:
        return select_season(daily)
    first, last = min(years) - 1, max(years)
    daily = daily.where(F.col("date").between(F.make_date(F.lit(first), F.lit(12), F.lit(1)),
                                              F.make_date(F.lit(last), F.lit(8), F.lit(31))))
    return select_season(daily).where(F.col("season_year").isin([int(y) for y in years]))


def reduce_days(value: Column, how: str, wanted: Column | None = None) -> Column:
    """sum/mean/max over the days selected by ``wanted``; one missing day gives NULL."""
    picked = value if wanted is None else F.when(wanted, value)
    days = F.count(F.lit(1)) if wanted is None else F.count_if(wanted)
    reduction = {"sum": F.sum, "mean": F.avg, "max": F.max}
    if how not in reduction:
        raise ValueError(f"unknown reduction {how!r}")
    return F.when(F.count(picked) == days, reduction[how](picked))


def seasonal_aggregate(daily: DataFrame, value: str, how: str,
                       years: Sequence[int] | None = None,
                       keys: Sequence[str] = CELL) -> DataFrame:
    """One variable per cell and season: value, n_days."""
    return (season_days(daily, years).groupBy(*keys, "season_year", "season")
            .agg(reduce_days(F.col(value), how).alias("value"), F.count(F.lit(1)).alias("n_days")))


def with_vpd(daily: DataFrame) -> DataFrame:
    """Daily vapour pressure deficit, before any reduction over time."""
    return daily.withColumn("vpd", vpd(F.col("tas"), F.col("td")))


def pair_variables(tas: DataFrame, td: DataFrame) -> DataFrame:
    """Temperature and dew point of the same day and cell (inner join)."""
    return tas.join(td, ["date", "row", "col"])


def _fields(daily: DataFrame, outputs, years) -> DataFrame:
    """All wanted (name, season, reduction) fields in one pass over the days."""
    days = season_days(daily, years)
    aggregates = []
    for name, variable, season, how in outputs:
        wanted = F.col("season") == season
        aggregates.append(reduce_days(F.col(variable), how, wanted).alias(f"{name}@{season}@{how}"))
    present = [F.count_if(F.col("season") == s).alias(f"n@{s}") for s in SEASONS]
    wide = days.groupBy(*CELL, "season_year").agg(*aggregates, *present)
    rows = F.inline(F.array(*[
        F.struct(F.lit(name).alias("var"), F.lit(how).alias("stat"), F.lit(season).alias("season"),
                 F.col(f"{name}@{season}@{how}").alias("value"), F.col(f"n@{season}").alias("n_days"))
        for name, _, season, how in outputs]))
    return (wide.select(F.col("season_year").alias("year"), *CELL, rows).where(F.col("n_days") > 0)
            .select("var", "stat", "year", "season", *CELL, "value", "n_days"))


def seasonal_meteo(daily: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """The six seasonal fields from one scan and one aggregation.

    Input: (date, row, col, pr, tas, tasmax, td).  Output: (var, stat, year,
    season, row, col, value, n_days).
    """
    return _fields(with_vpd(daily), SEASONAL_OUTPUTS, years)


def _climatology_fields(daily: DataFrame, years: Sequence[int] | None) -> DataFrame:
    return _fields(daily, [(v, v, s, h) for v, s, h, _ in CLIMATOLOGY], years)


def _all_years(value: Column, aggregate: Column) -> Column:
    return F.when(F.count(value) == F.count(F.lit(1)), aggregate)


def baseline_climatology(daily: DataFrame, start: int = 1991, end: int = 2020) -> DataFrame:
    """Mean and sample deviation over years of the seasonal fields, per cell."""
    fields = _climatology_fields(daily, range(start, end + 1))
    value = F.col("value")
    return fields.groupBy("var", "season", *CELL).agg(
        _all_years(value, F.avg(value)).alias("base_mean"),
        _all_years(value, F.stddev_samp(value)).alias("base_sd"),
        F.count(F.lit(1)).alias("n_years"),
        (F.count(F.lit(1)) >= MIN_BASELINE_YEARS).alias("reliable"),
    )


def seasonal_anomaly(daily: DataFrame, years: Sequence[int], start: int = 1991,
                     end: int = 2020) -> DataFrame:
    """Anomaly of each year against the baseline mean of the same cell and season.

    Days are reduced once for target and baseline years together; the baseline
    is a window over the few years of a cell instead of a second scan and join.
    """
    wanted = sorted(set(range(start, end + 1)) | {int(y) for y in years})
    fields = _climatology_fields(daily, wanted)
    in_base = F.col("year").between(start, end)
    cell = Window.partitionBy("var", "season", *CELL)
    fields = fields.withColumn("base_value", F.when(in_base, F.col("value"))).withColumn("in_base", in_base)
    fields = fields.withColumns({
        "base_avg": F.avg("base_value").over(cell), "n_known": F.count("base_value").over(cell),
        "n_base": F.sum(F.col("in_base").cast("int")).over(cell)})
    fields = fields.where(F.col("year").isin([int(y) for y in years])).withColumn(
        "base_mean", F.when(F.col("n_known") == F.col("n_base"), F.col("base_avg")))
    methods = {v: m for v, _, _, m in CLIMATOLOGY}
    result = F.coalesce(*[anomaly(F.when(F.col("var") == v, F.col("value")), F.col("base_mean"), m)
                          for v, m in methods.items()])
    return fields.select("var", "season", "year", *CELL, "value", "base_mean", result.alias("anomaly"))


def anomaly_against(seasonal: DataFrame, baseline: DataFrame, method: str) -> DataFrame:
    """Anomaly of stored seasonal fields against a stored baseline (equi-join)."""
    joined = seasonal.join(baseline.select("var", "season", *CELL, "base_mean"),
                           ["var", "season", *CELL])
    return joined.withColumn("anomaly", anomaly(F.col("value"), F.col("base_mean"), method))
