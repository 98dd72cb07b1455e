"""Queries over grid geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridspark.catalog.fixtures import CELL_UNITS, CLIMATE_GRID, SOIL_GRID, Tables, sql
from gridspark.catalog.registry import query, rounded
from gridspark.catalog.soil_sql import r
from gridspark.functions.scores import binarize
from gridspark.operators import grid as g

# Target cells of 2.5 x 2.5 source cells, which do not nest.
COARSE = g.Grid(0.0, 0.0, 62.5, 62.5, 40)
HEX_KM2 = 0.05
# Origin and size of the hexagons, which do not depend on how far the rows go; their number of rows does.
HEX = g.HexLattice.over((0.0, 0.0, 2500.0, 25.0), HEX_KM2)


def _lattice(t: Tables) -> g.HexLattice:
    return g.HexLattice.over(g.framed(SOIL_GRID, t.disco).bounds, HEX_KM2)


def _climate_cells(t: Tables):
    """One value per climate cell: its mean daily maximum."""
    return t.climate.groupBy("row", "col").agg(F.avg("tasmax").alias("value"))


_CLIM = "SELECT row, col, avg(tasmax) AS value FROM climate_daily GROUP BY row, col"
_TARGETS = "SELECT DISTINCT row, col FROM soil"


@query("P18_binarize", sql("disco", """
SELECT row, col, CASE WHEN value IS NULL THEN NULL WHEN value >= 4000 THEN 1 ELSE 0 END AS at_least,
       CASE WHEN value IS NULL THEN NULL WHEN value > 4000 THEN 1 ELSE 0 END AS above FROM disco"""))
def _(t: Tables):
    return t.disco.select("row", "col", binarize(F.col("value")).alias("at_least"),
                          binarize(F.col("value"), strict=True).alias("above"))


@query("G1_resample_average", sql("disco", f"""
SELECT ty AS row, tx AS col, {r('sum(w*value)/sum(w)')} AS value FROM (
  SELECT value, tx, ty, (least((col+1)/2.5E0, tx+1) - greatest(col/2.5E0, tx)) * (least((row+1)/2.5E0, ty+1) - greatest(row/2.5E0, ty)) AS w
  FROM (SELECT *, unnest(range(floor(col/2.5E0)::INT, ceil((col+1)/2.5E0)::INT))::INT AS tx FROM
         (SELECT *, unnest(range(floor(row/2.5E0)::INT, ceil((row+1)/2.5E0)::INT))::INT AS ty FROM disco WHERE value IS NOT NULL)))
GROUP BY ty, tx"""))
def _(t: Tables):
    return rounded(g.resample_average(t.disco, SOIL_GRID, COARSE), 6, "value")


@query("G2_resample_bilinear", sql("soil climate_daily", f"""
SELECT row, col, {r('sum(w*value)/sum(w)')} AS value FROM (
  SELECT t.row, t.col, s.value, CASE WHEN s.row = t.qr THEN 1 - t.fy ELSE t.fy END * CASE WHEN s.col = t.qc THEN 1 - t.fx ELSE t.fx END AS w
  FROM (SELECT row, col, floor(x)::INT AS qc, floor(y)::INT AS qr, x - floor(x) AS fx, y - floor(y) AS fy
        FROM (SELECT row, col, (col + .5E0)*25/250 - .5E0 AS x, (row + .5E0)*25/250 - .5E0 AS y FROM targets)) t
  LEFT JOIN clim s ON s.row BETWEEN t.qr AND t.qr + 1 AND s.col BETWEEN t.qc AND t.qc + 1)
GROUP BY row, col""", targets=_TARGETS, clim=_CLIM))
def _(t: Tables):
    targets = t.soil.select("row", "col").distinct()
    return rounded(g.resample_bilinear(_climate_cells(t), CLIMATE_GRID, targets, SOIL_GRID), 6, "value")


@query("G3_resample_nearest", sql("soil climate_daily", f"""
SELECT t.row, t.col, {r('s.value')} AS value FROM targets t
LEFT JOIN clim s ON s.row = floor((t.row + .5E0)*25/250)::INT AND s.col = floor((t.col + .5E0)*25/250)::INT""",
    targets=_TARGETS, clim=_CLIM))
def _(t: Tables):
    targets = t.soil.select("row", "col").distinct()
    return rounded(g.resample_nearest(_climate_cells(t), CLIMATE_GRID, targets, SOIL_GRID), 6, "value")


@query("G4_align_grids", sql("soil climate_daily disco", f"""
SELECT d.row, d.col, d.value AS disco, {r('s.value')} AS tasmax FROM disco d
LEFT JOIN clim s ON s.row = floor((d.row + .5E0)*25/250)::INT AND s.col = floor((d.col + .5E0)*25/250)::INT""", clim=_CLIM))
def _(t: Tables):
    first, second = g.align_grids([(t.disco.select("row", "col", "value"), SOIL_GRID),
                                   (_climate_cells(t), CLIMATE_GRID)], method="nearest")
    joined = first.withColumnRenamed("value", "disco").join(second.withColumnRenamed("value", "tasmax"), ["row", "col"])
    return rounded(joined, 6, "tasmax")


_STEP, _ROW = 1.5 * HEX.radius, HEX.row_step
_HEX_ROWS = f"(SELECT ceil(((max(row) + 1) * 25E0 + {_ROW!r}::DOUBLE - ({HEX.min_y!r}::DOUBLE)) / {_ROW!r}::DOUBLE)::BIGINT + 1 FROM disco)"
_HEX_SQL = f"""
SELECT row, col, value, arg_min(q, (d, q, rr)) AS q, arg_min(rr, (d, q, rr)) AS r FROM (
  SELECT row, col, value, q, rr, pow(x - ({HEX.min_x!r}::DOUBLE + q*{_STEP!r}::DOUBLE), 2) + pow(y - ({HEX.min_y!r}::DOUBLE + rr*{_ROW!r}::DOUBLE + odd), 2) AS d
  FROM (SELECT *, unnest([floor((y - {HEX.min_y!r}::DOUBLE - odd)/{_ROW!r}::DOUBLE)::BIGINT, floor((y - {HEX.min_y!r}::DOUBLE - odd)/{_ROW!r}::DOUBLE)::BIGINT + 1]) AS rr
    FROM (SELECT *, CASE WHEN q % 2 = 1 THEN {_ROW!r}::DOUBLE/2 ELSE 0 END AS odd
      FROM (SELECT *, unnest(range(floor((x - {HEX.min_x!r}::DOUBLE)/{_STEP!r}::DOUBLE)::BIGINT - 1, floor((x - {HEX.min_x!r}::DOUBLE)/{_STEP!r}::DOUBLE)::BIGINT + 3)) AS q
        FROM (SELECT row, col, value, (col + .5E0)*25 AS x, (row + .5E0)*25 AS y FROM disco)))))
GROUP BY row, col, value"""


@query("G5_hex_bin", sql("disco", f"SELECT row, col, q::INT AS q, r::INT AS r, q*{_HEX_ROWS} + r + 1 AS hex_id FROM hexed", hexed=_HEX_SQL))
def _(t: Tables):
    cells = g.with_centers(t.disco.select("row", "col"), SOIL_GRID)
    return g.hex_bin(cells, _lattice(t)).select("row", "col", "q", "r", "hex_id")


@query("G6_hex_proportion", sql("disco", f"""
SELECT q*{_HEX_ROWS} + r + 1 AS hex_id, count(*) AS cell_count, {r('avg(CASE WHEN value > 4000 THEN 1E0 ELSE 0E0 END)')} AS prop_disco
FROM hexed WHERE value IS NOT NULL GROUP BY q, r""", hexed=_HEX_SQL))
def _(t: Tables):
    hexes = g.hex_proportion(g.with_centers(t.disco, SOIL_GRID), _lattice(t))
    return rounded(hexes.select("hex_id", "cell_count", "prop_disco"), 6, "prop_disco")


@query("G7_clip_to_polygon", sql("disco polygon_edges", """
SELECT d.row, d.col, d.value FROM disco d JOIN polygon_edges e
  ON (e.y1 > d.row + .5E0) <> (e.y2 > d.row + .5E0)
 AND e.x1 + (d.row + .5E0 - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1) > d.col + .5E0
GROUP BY d.row, d.col, d.value HAVING count(*) % 2 = 1"""))
def _(t: Tables):
    return g.clip_to_polygon(t.disco.select("row", "col", "value"), t.polygon_edges, CELL_UNITS)


@query("G8_block_id", sql("disco", "SELECT row, col, (row // 20) * 5 + col // 20 AS block_id FROM disco"))
def _(t: Tables):
    return g.block_id(t.disco.select("row", "col"), SOIL_GRID, 500.0)


_LAYERS = """
SELECT s.row, s.col, s.sand, d.value AS disco, m.mrd_cm
FROM (SELECT row, col, avg(sand) AS sand FROM soil GROUP BY row, col) s
JOIN disco d ON s.row = d.row AND s.col = d.col
JOIN mrd m ON s.row = m.row AND s.col = m.col"""


def _layers(t: Tables):
    sand = t.soil.groupBy("row", "col").agg(F.avg("sand").alias("sand"))
    disco = t.disco.select("row", "col", F.col("value").alias("disco"))
    return g.align_layers([sand, disco, t.mrd])


@query("G9_valid_cells", sql("soil disco mrd", f"SELECT row, col, {r('sand')} AS sand, disco, mrd_cm FROM layered WHERE disco IS NOT NULL",
                             layered=_LAYERS))
def _(t: Tables):
    return rounded(g.valid_cells(_layers(t), ["sand", "disco", "mrd_cm"]), 6, "sand")


@query("J1_align_layers", sql("soil disco mrd", f"SELECT row, col, {r('sand')} AS sand, disco, mrd_cm FROM layered", layered=_LAYERS))
def _(t: Tables):
    return rounded(_layers(t), 6, "sand")
