"""Seasons, resampling, hexagons, polygons and blocks."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions.climate import anomaly
from gridspark.operators import climate, grid as g

DAILY = "date date, row int, col int, pr double, tas double, tasmax double, td double"


def daily(spark, days):
    return spark.createDataFrame([(dt.date.fromisoformat(d), 0, 0, pr, 10.0, 15.0, td) for d, pr, td in days], DAILY)


@pytest.mark.parametrize("day,season,year", [
    ("2000-11-30", None, None), ("2000-12-01", "DJFMAM", 2001), ("2001-05-31", "DJFMAM", 2001),
    ("2001-06-01", "JJA", 2001), ("2001-08-31", "JJA", 2001), ("2001-09-01", None, None)])
def test_season_edges(spark, day, season, year):
    row = climate.select_season(daily(spark, [(day, 1.0, 5.0)])).first()
    assert (row is None) if season is None else (row.season, row.season_year) == (season, year)


def test_one_missing_day_voids_the_season(spark):
    out = {r["var"]: r for r in climate.seasonal_meteo(daily(spark, [("2001-06-01", 1.0, 5.0), ("2001-06-02", None, 20.0)]), [2001]).collect()}
    assert out["pr"].value is None and out["pr"].n_days == 2
    assert out["tas"].value == 10.0
    assert out["vpdmax"].stat == "max"
    assert "DJFMAM" not in {r.season for r in out.values()}


def test_vpd_is_not_negative_and_precedes_the_mean(spark, close):
    out = {r["var"]: r.value for r in climate.seasonal_meteo(daily(spark, [("2001-06-01", 1.0, 20.0), ("2001-06-02", 1.0, 5.0)]), [2001]).collect()}
    es = lambda t: 0.6108 * math.exp(17.27 * t / (t + 237.3))
    close(out["vpd"], (es(10.0) - es(5.0)) / 2)


def test_baseline_and_anomaly(spark, close):
    d = daily(spark, [(f"{y}-07-01", float(y - 1990), 5.0) for y in range(1991, 1995)])
    base = {r["var"]: r for r in climate.baseline_climatology(d, 1991, 1993).where("season = 'JJA'").collect()}["pr"]
    close(base.base_mean, 2.0)
    close(base.base_sd, 1.0)
    assert base.n_years == 3 and base.reliable is False
    an = climate.seasonal_anomaly(d, [1994], 1991, 1993).where("var = 'pr'").collect()
    assert len(an) == 1
    close(an[0].anomaly, 200.0)
    fields = climate.seasonal_meteo(d).where("var = 'pr' AND season = 'JJA'")
    joined = climate.anomaly_against(fields, climate.baseline_climatology(d, 1991, 1993), "percent").where("year = 1994").first()
    close(joined.anomaly, 200.0)
    with pytest.raises(ValueError):
        anomaly(F.lit(1.0), F.lit(1.0), "ratio")


def test_zero_baseline_gives_null_percentage(spark):
    df = spark.range(1).select(anomaly(F.lit(1.0), F.lit(0.0005), "percent").alias("a"))
    assert df.first().a is None


def raster(spark, array):
    rows = [(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(array)]
    return spark.createDataFrame(rows, "row int, col int, value double")


def test_average_over_cells_that_do_not_nest(spark, close):
    a = np.arange(25, dtype=float).reshape(5, 5)
    a[0, 0] = np.nan
    out = {(r.row, r.col): r.value for r in g.resample_average(
        raster(spark, a), g.Grid(0, 0, 1, 1, 5, 5), g.Grid(0, 0, 2.5, 2.5, 2, 2)).collect()}
    w = np.array([1.0, 1.0, 0.5])
    area = np.outer(w, w)
    block = a[:3, :3]
    keep = ~np.isnan(block)
    close(out[0, 0], float((area * np.nan_to_num(block)).sum() / area[keep].sum()))
    assert set(out) == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_average_flips_with_descending_rows(spark, close):
    a = np.arange(16, dtype=float).reshape(4, 4)
    out = {(r.row, r.col): r.value for r in g.resample_average(
        raster(spark, a), g.Grid(0, 4, 1, -1, 4, 4), g.Grid(0, 0, 2, 2, 2, 2)).collect()}
    close(out[1, 0], a[:2, :2].mean())


def test_bilinear_against_formula_and_edges(spark, close):
    a = np.array([[1.0, 2.0], [3.0, np.nan]])
    targets = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3)], "row int, col int")
    src, dst = g.Grid(0, 0, 2, 2, 2, 2), g.Grid(0, 0, 1, 1, 4, 4)
    out = {(r.row, r.col): r.value for r in g.resample_bilinear(raster(spark, a), src, targets, dst).collect()}
    close(out[0, 0], 1.0)
    close(out[1, 1], (0.5625 * 1 + 0.1875 * 2 + 0.1875 * 3) / (0.5625 + 0.375))
    close(out[2, 2], (0.0625 * 1 + 0.1875 * 2 + 0.1875 * 3) / 0.4375)
    assert out[3, 3] is None


def test_align_grids_passes_equal_grids_through(spark):
    a = raster(spark, np.ones((2, 2)))
    grid = g.Grid(0, 0, 1, 1, 2, 2)
    assert g.align_grids([(a, grid), (a, grid)])[1] is a


def test_hexagons_are_nearest_centres_and_keep_all_cells(spark):
    grid = g.Grid(1000.0, 2000.0, 25.0, 25.0, 40, 40)
    lattice = g.HexLattice.over(grid.bounds, 0.02)
    cells = g.with_centers(raster(spark, np.arange(1600, dtype=float).reshape(40, 40)), grid)
    placed = g.hex_bin(cells, lattice).collect()
    centres = [(lattice.min_x + q * 1.5 * lattice.radius,
                lattice.min_y + r * lattice.row_step + (lattice.row_step / 2 if q % 2 else 0), q * lattice.n_rows + r + 1)
               for q in range(lattice.n_cols) for r in range(lattice.n_rows)]
    for c in placed[::37]:
        nearest = min(centres, key=lambda h: (h[0] - c.x) ** 2 + (h[1] - c.y) ** 2)
        assert nearest[2] == c.hex_id
    hexes = g.hex_proportion(cells, lattice, threshold=800.0).collect()
    assert sum(h.cell_count for h in hexes) == 1600
    assert sum(round(h.cell_count * h.prop_disco) for h in hexes) == 799


def test_polygon_even_odd(spark):
    square = [(1, 1, 4, 1), (4, 1, 4, 4), (4, 4, 1, 4), (1, 4, 1, 1)]
    hole = [(2, 2, 3, 2), (3, 2, 3, 3), (3, 3, 2, 3), (2, 3, 2, 2)]
    edges = spark.createDataFrame([tuple(map(float, e)) for e in square + hole], "x1 double, y1 double, x2 double, y2 double")
    cells = raster(spark, np.ones((6, 6)))
    inside = {(r.row, r.col) for r in g.clip_to_polygon(cells, edges, g.Grid(0, 0, 1, 1, 6, 6)).collect()}
    assert inside == {(i, j) for i in (1, 2, 3) for j in (1, 2, 3)} - {(2, 2)}


def test_blocks_use_the_grid_width(spark):
    grid = g.Grid(0, 0, 25.0, 25.0, 50, 50)
    assert g.block_columns(grid, 500.0) == (20, 20, 3)
    only_left = spark.createDataFrame([(45, 3)], "row int, col int")
    assert g.block_id(only_left, grid, 500.0).first().block_id == 2 * 3
    assert g.block_columns(grid, 1.0)[:2] == (1, 1)
