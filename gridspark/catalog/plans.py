"""End-to-end plans."""

from __future__ import annotations

from gridspark.catalog import soil_sql as q
from gridspark.catalog.fixtures import Tables, sql
from gridspark.catalog.registry import query, rounded
from gridspark.operators import soil
from gridspark.plans import soil_to_awc

_MM = "awc_vol * (1 - gravel/100) * thick_mm"


@query("E1_soil_to_awc", sql(
    "soil layers",
    f"""SELECT row, col, {q.r(f'sum(CASE WHEN upper_cm < 100 THEN {_MM} END)')} AS awc_1m,
        {q.r(f'sum({_MM})')} AS awc_2m
        FROM (SELECT *, {q.theta(330)} - {q.theta(16000)} AS awc_vol FROM fitted) GROUP BY row, col""",
    profile=q.PROFILE, fitted=q.WOSTEN))
def _(t: Tables):
    return rounded(soil_to_awc.water_map(t.profile, soil.ptf_wosten), 6, "awc_1m", "awc_2m")


@query("E1_class_map", sql(
    "soil layers",
    f"""SELECT 'wessolek' AS ptf, depth, row, col, {q.r('awc_mm')} AS awc_mm FROM (
          SELECT '1m' AS depth, row, col, sum(CASE WHEN upper_cm < 100 THEN {_MM} END) AS awc_mm FROM water GROUP BY row, col
          UNION ALL SELECT '2m', row, col, sum({_MM}) FROM water GROUP BY row, col)""",
    profile=q.PROFILE, classed=q.KA5, lut=q.LUT,
    water=f"SELECT *, {q.theta(330)} - {q.theta(16000)} AS awc_vol FROM classed LEFT JOIN lut USING (ka5)"))
def _(t: Tables):
    return rounded(soil_to_awc.all_maps(t.profile, ["wessolek"]), 6, "awc_mm")
