"""Queries over daily climate."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import Tables, sql
from gridspark.catalog.registry import query, rounded
from gridspark.catalog.soil_sql import r
from gridspark.functions.climate import saturation_vapour_pressure
from gridspark.operators import climate, run_keys
from gridspark.sources import readers

ES = "0.6108E0*exp(17.27E0*{t}/({t} + 237.3E0))"
VPD = f"greatest({ES.format(t='tas')} - {ES.format(t='td')}, 0E0)"
YEARS = (1993, 1995, 1996)

SEASONED = """
SELECT *, CASE WHEN month(date) IN (12, 1, 2, 3, 4, 5) THEN 'DJFMAM' WHEN month(date) IN (6, 7, 8) THEN 'JJA' END AS season,
       (year(date) + CASE WHEN month(date) = 12 THEN 1 ELSE 0 END)::INT AS season_year
FROM climate_daily"""
DAYS = {"seasoned": SEASONED, "days": f"SELECT *, {VPD} AS vpd FROM seasoned WHERE season IS NOT NULL"}


def _sql(select: str, **more: str) -> str:
    return sql("climate_daily", select, **DAYS, **more)


def _reduced(how: str, v: str) -> str:
    return f"CASE WHEN count({v}) = count(*) THEN {how}({v}) END"


def _field(name: str, v: str, season: str, stat: str) -> str:
    how = {"mean": "avg"}.get(stat, stat)
    return (f"SELECT '{name}' AS var, '{stat}' AS stat, season_year AS year, season, row, col, "
            f"{_reduced(how, v)} AS value, count(*) AS n_days FROM days WHERE season = '{season}' "
            f"GROUP BY season_year, season, row, col")


SIX = "\nUNION ALL\n".join([
    _field("pr", "pr", "DJFMAM", "sum"), _field("pr", "pr", "JJA", "sum"), _field("tas", "tas", "JJA", "mean"),
    _field("tasmax", "tasmax", "JJA", "max"), _field("vpd", "vpd", "JJA", "mean"), _field("vpdmax", "vpd", "JJA", "max")])
THREE = "\nUNION ALL\n".join([
    _field("pr", "pr", "DJFMAM", "sum"), _field("pr", "pr", "JJA", "sum"), _field("tas", "tas", "JJA", "mean")])
BASE = """
SELECT var, season, row, col, CASE WHEN count(value) = count(*) THEN avg(value) END AS base_mean,
       CASE WHEN count(value) = count(*) THEN stddev_samp(value) END AS base_sd, count(*) AS n_years,
       count(*) >= 10 AS reliable
FROM fields WHERE year BETWEEN 1991 AND 2020 GROUP BY var, season, row, col"""
ANOMALY = """CASE WHEN var = 'pr' THEN value / CASE WHEN abs(base_mean) > 0.001 THEN base_mean END * 100
       ELSE value - base_mean END"""


@query("S3_load_daily", sql("climate_daily", """
SELECT date, row, col, pr AS value FROM climate_daily WHERE year(date) IN (1994, 1995)"""))
def _(t: Tables):
    return readers.daily_of(t.climate, "pr", [1994, 1995])


@query("P16_saturation_vapour_pressure", _sql(
    f"SELECT date, row, col, {r(ES.format(t='tas'))} AS es_tas, {r(ES.format(t='td'))} AS es_td FROM climate_daily"))
def _(t: Tables):
    return rounded(t.climate.select("date", "row", "col",
                                    saturation_vapour_pressure(F.col("tas")).alias("es_tas"),
                                    saturation_vapour_pressure(F.col("td")).alias("es_td")), 6, "es_tas", "es_td")


@query("P17_vpd", _sql(f"SELECT date, row, col, {r(VPD)} AS vpd FROM climate_daily"))
def _(t: Tables):
    return rounded(climate.with_vpd(t.climate).select("date", "row", "col", "vpd"), 6, "vpd")


@query("J3_pair_variables", _sql(
    f"""SELECT a.date, a.row, a.col, {r(VPD)} AS vpd
        FROM (SELECT date, row, col, tas FROM climate_daily WHERE pr IS NOT NULL) a
        JOIN (SELECT date, row, col, td FROM climate_daily) b ON a.date = b.date AND a.row = b.row AND a.col = b.col"""))
def _(t: Tables):
    tas = t.climate.where(F.col("pr").isNotNull()).select("date", "row", "col", "tas")
    td = t.climate.select("date", "row", "col", "td")
    return rounded(climate.with_vpd(climate.pair_variables(tas, td)).select("date", "row", "col", "vpd"), 6, "vpd")


@query("A7_select_season", _sql("SELECT date, row, col, season, season_year, pr FROM days"))
def _(t: Tables):
    return climate.select_season(t.climate).select("date", "row", "col", "season", "season_year", "pr")


@query("A8_seasonal_aggregate", _sql(
    f"SELECT row, col, season_year, season, {r(_reduced('sum', 'pr'))} AS value, count(*) AS n_days "
    "FROM days GROUP BY row, col, season_year, season"))
def _(t: Tables):
    return rounded(climate.seasonal_aggregate(t.climate, "pr", "sum"), 6, "value")


@query("A9_seasonal_meteo", _sql(
    f"SELECT var, stat, year, season, row, col, {r('value')} AS value, n_days FROM fields "
    f"WHERE year IN {YEARS}", fields=SIX))
def _(t: Tables):
    return rounded(climate.seasonal_meteo(t.climate, YEARS), 6, "value")


@query("A10_baseline_climatology", _sql(
    f"SELECT var, season, row, col, {r('base_mean')} AS base_mean, {r('base_sd')} AS base_sd, n_years, reliable FROM base",
    fields=THREE, base=BASE))
def _(t: Tables):
    return rounded(climate.baseline_climatology(t.climate), 6, "base_mean", "base_sd")


@query("A11_seasonal_anomaly", _sql(
    f"""SELECT var, season, year, row, col, {r('value')} AS value, {r('base_mean')} AS base_mean, {r(ANOMALY)} AS anomaly
        FROM fields JOIN base USING (var, season, row, col) WHERE year IN {YEARS}""", fields=THREE, base=BASE))
def _(t: Tables):
    return rounded(climate.seasonal_anomaly(t.climate, YEARS), 6, "value", "base_mean", "anomaly")


@query("J8_season_baseline_join", _sql(
    f"""SELECT var, season, year, row, col, {r('value - base_mean')} AS anomaly
        FROM fields JOIN base USING (var, season, row, col) WHERE var = 'tas'""", fields=THREE, base=BASE))
def _(t: Tables):
    fields = climate.seasonal_meteo(t.climate).where(F.col("var") == "tas")
    joined = climate.anomaly_against(fields, climate.baseline_climatology(t.climate), "absolute")
    return rounded(joined.select("var", "season", "year", "row", "col", "anomaly"), 6, "anomaly")


@query("P19_anomaly", _sql(
    f"""SELECT season, year, row, col, {r('value / CASE WHEN abs(base_mean) > 0.001 THEN base_mean END * 100')} AS anomaly
        FROM fields JOIN base USING (var, season, row, col) WHERE var = 'pr'""", fields=THREE, base=BASE))
def _(t: Tables):
    fields = climate.seasonal_meteo(t.climate).where(F.col("var") == "pr")
    joined = climate.anomaly_against(fields, climate.baseline_climatology(t.climate), "percent")
    return rounded(joined.select("season", "year", "row", "col", "anomaly"), 6, "anomaly")


@query("S8_pending_fields", _sql(
    f"""SELECT var, stat, year, season, count(*) AS n_cells, {r('sum(value)')} AS total FROM fields
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT season_year, season FROM days WHERE season = 'JJA') d
                          WHERE d.season_year = fields.year AND d.season = fields.season)
        GROUP BY var, stat, year, season""", fields=SIX))
def _(t: Tables):
    # Stored already: every summer.
    days = climate.select_season(t.climate)
    stored = days.where(F.col("season") == "JJA").select(F.col("season_year").alias("year"), "season")
    todo = run_keys.pending(climate.seasonal_meteo(t.climate), stored, ["year", "season"])
    out = todo.groupBy("var", "stat", "year", "season").agg(F.count(F.lit(1)).alias("n_cells"),
                                                            F.sum("value").alias("total"))
    return rounded(out, 6, "total")
