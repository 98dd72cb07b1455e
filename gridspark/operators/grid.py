"""Grid geometry: resampling, hexagons, polygons, blocks.

A grid is stated metadata, never derived from the surviving cells.  Cells carry
(row, col); the centre of a cell is ``x0 + (col + 0.5) * dx`` and
``y0 + (row + 0.5) * dy`` (``dy`` may be negative).  All grids share one
coordinate system.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


CELL = ("row", "col")


@dataclass(frozen=True)
class Grid:
    x0: float
    y0: float
    dx: float
    dy: float
    n_cols: int
    n_rows: int | None = None  # None: as many rows as the cells have

    def x(self, col: Column) -> Column:
        return F.lit(float(self.x0)) + (col + 0.5) * F.lit(float(self.dx))

    def y(self, row: Column) -> Column:
        return F.lit(float(self.y0)) + (row + 0.5) * F.lit(float(self.dy))

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        if self.n_rows is None:
            raise ValueError("a grid without a number of rows has no bounds; take them from its cells (framed)")
        xs = (self.x0, self.x0 + self.n_cols * self.dx)
        ys = (self.y0, self.y0 + self.n_rows * self.dy)
        return min(xs), min(ys), max(xs), max(ys)


def framed(grid: Grid, cells: DataFrame) -> Grid:
    """``grid`` with the rows that ``cells`` reach: a one-row aggregate, run at once."""
    last = cells.agg(F.max("row")).first()[0]
    return replace(grid, n_rows=1 if last is None else int(last) + 1)


def with_centers(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.withColumns({"x": grid.x(F.col("col")), "y": grid.y(F.col("row"))})


def _in_grid(row: Column, col: Column, grid: Grid) -> Column:
    below = row >= 0 if grid.n_rows is None else row.between(0, grid.n_rows - 1)
    return below & col.between(0, grid.n_cols - 1)


def _touched(index: Column, src_origin: float, src_step: float, dst_origin: float, dst_step: float):
    """First and last target index a source cell reaches, and its two ends there."""
    scale = F.lit(float(dst_step))
    a = (F.lit(float(src_origin)) + index * F.lit(float(src_step)) - F.lit(float(dst_origin))) / scale
    b = (F.lit(float(src_origin)) + (index + 1) * F.lit(float(src_step)) - F.lit(float(dst_origin))) / scale
    lo, hi = F.least(a, b), F.greatest(a, b)
    return F.floor(lo), F.ceil(hi) - 1, lo, hi


def resample_average(cells: DataFrame, src: Grid, dst: Grid, value: str = "value",
                     keys: Sequence[str] = ()) -> DataFrame:
    """Area-weighted mean of the non-null source cells under each target cell.

    Each source cell is spread over the target cells it touches (one when the
    grids nest), then a partial aggregation on the target cell follows.
    """
    c0, c1, cl, ch = _touched(F.col("col"), src.x0, src.dx, dst.x0, dst.dx)
    r0, r1, rl, rh = _touched(F.col("row"), src.y0, src.dy, dst.y0, dst.dy)
    known = cells.where(F.col(value).isNotNull())
    spread = known.select(*keys, F.col(value).alias("__v"), cl.alias("cl"), ch.alias("ch"), rl.alias("rl"),
                          rh.alias("rh"), F.explode(F.sequence(c0, c1)).alias("c"), r0.alias("r0"), r1.alias("r1"))
    spread = spread.select("*", F.explode(F.sequence("r0", "r1")).alias("r"))
    width = F.least(F.col("ch"), F.col("c") + 1) - F.greatest(F.col("cl"), F.col("c"))
    height = F.least(F.col("rh"), F.col("r") + 1) - F.greatest(F.col("rl"), F.col("r"))
    area = width * height
    return (spread.where(_in_grid(F.col("r"), F.col("c"), dst))
            .groupBy(*keys, F.col("r").cast("int").alias("row"), F.col("c").cast("int").alias("col"))
            .agg((F.sum(area * F.col("__v")) / F.sum(area)).alias(value)))


def _source_position(targets: DataFrame, src: Grid, dst: Grid) -> tuple[Column, Column]:
    """Fractional source (col, row) of a target centre; whole numbers are centres."""
    fx = (dst.x(F.col("col")) - F.lit(float(src.x0))) / F.lit(float(src.dx)) - 0.5
    fy = (dst.y(F.col("row")) - F.lit(float(src.y0))) / F.lit(float(src.dy)) - 0.5
    return fx, fy


def resample_bilinear(cells: DataFrame, src: Grid, targets: DataFrame, dst: Grid,
                      value: str = "value", keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of the four source cells around each target centre.

    Plain four-point interpolation; missing corners drop out and the rest is
    reweighted.  The four corners are first gathered into one row per source
    quad, so the (usually far larger) target side takes part in exactly one
    equi-join and no aggregation.  ``targets`` has columns row, col plus
    anything to keep; ``keys`` name extra source keys (variable, year) that
    multiply the output.
    """
    corner = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)]))
    spread = cells.where(F.col(value).isNotNull()).select(*keys, "row", "col", F.col(value).alias("__v"),
                                                          corner.alias("at"))
    quads = spread.groupBy(
        *keys, (F.col("row") - F.col("at.i")).alias("__qr"), (F.col("col") - F.col("at.j")).alias("__qc")
    ).agg(*[F.max(F.when((F.col("at.i") == i) & (F.col("at.j") == j), F.col("__v"))).alias(f"__v{i}{j}")
            for i in (0, 1) for j in (0, 1)])
    fx, fy = _source_position(targets, src, dst)
    placed = targets.withColumns({"__fx": fx, "__fy": fy})
    placed = placed.withColumns({"__qc": F.floor("__fx").cast("int"), "__qr": F.floor("__fy").cast("int")})
    tx, ty = F.col("__fx") - F.col("__qc"), F.col("__fy") - F.col("__qr")
    weight = {(i, j): (ty if i else 1.0 - ty) * (tx if j else 1.0 - tx) for i in (0, 1) for j in (0, 1)}
    top = bottom = F.lit(0.0)
    for (i, j), w in weight.items():
        v = F.col(f"__v{i}{j}")
        top = top + F.coalesce(w * v, F.lit(0.0))
        bottom = bottom + F.when(v.isNotNull(), w).otherwise(0.0)
    joined = placed.join(quads, ["__qr", "__qc"], "left")
    return joined.select(*targets.columns, *keys,
                         F.when(bottom > 0, top / F.when(bottom > 0, bottom)).alias(value))


def resample_nearest(cells: DataFrame, src: Grid, targets: DataFrame, dst: Grid,
                     value: str = "value") -> DataFrame:
    """Value of the source cell holding each target centre; one equi-join."""
    fx, fy = _source_position(targets, src, dst)
    placed = targets.withColumns({"__c": F.floor(fx + 0.5).cast("int"), "__r": F.floor(fy + 0.5).cast("int")})
    source = cells.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value))
    return placed.join(source, ["__r", "__c"], "left").select(*targets.columns, value)


def align_grids(layers: Sequence[tuple[DataFrame, Grid]], method: str = "bilinear",
                value: str = "value") -> list[DataFrame]:
    """Bring layers to the first layer's grid; equal grids pass through untouched."""
    (first, grid), *rest = layers
    resample = {"bilinear": resample_bilinear, "nearest": resample_nearest}[method]
    out = [first]
    for df, own in rest:
        out.append(df if own == grid else resample(df, own, first.select(*CELL), grid, value))
    return out


@dataclass(frozen=True)
class HexLattice:
    """Flat-top hexagons of equal area over padded bounds; odd columns sit half a row higher."""

    min_x: float
    min_y: float
    radius: float
    n_cols: int
    n_rows: int

    @classmethod
    def over(cls, bounds: tuple[float, float, float, float], area_km2: float) -> HexLattice:
        radius = math.sqrt(area_km2 * 1_000_000 / (1.5 * math.sqrt(3.0)))
        width, height = 2.0 * radius, math.sqrt(3.0) * radius
        lo_x, lo_y = bounds[0] - width, bounds[1] - height
        hi_x, hi_y = bounds[2] + width, bounds[3] + height
        return cls(lo_x, lo_y, radius, math.ceil((hi_x - lo_x) / (1.5 * radius)) + 1,
                   math.ceil((hi_y - lo_y) / height) + 1)

    @property
    def row_step(self) -> float:
        return math.sqrt(3.0) * self.radius

    def center(self, q: Column, r: Column) -> tuple[Column, Column]:
        odd = F.when(q % 2 == 1, self.row_step / 2.0).otherwise(0.0)
        return (F.lit(self.min_x) + q * F.lit(1.5 * self.radius),
                F.lit(self.min_y) + r * F.lit(self.row_step) + odd)


def hex_bin(cells: DataFrame, lattice: HexLattice) -> DataFrame:
    """Hexagon of each cell centre (columns x, y): hex_id, q, r, cx, cy.

    The hexagon holding a point is the one with the nearest centre, which lies
    in one of the two lattice columns around the point: pure arithmetic, no
    polygons and no join.  A centre outside the lattice is an error, as its id
    would be another hexagon's.
    """
    x, y = F.col("x"), F.col("y")
    left = F.floor((x - lattice.min_x) / F.lit(1.5 * lattice.radius)).cast("int")
    best = None
    for q in (left, left + 1):
        odd = F.when(q % 2 == 1, lattice.row_step / 2.0).otherwise(0.0)
        r = F.floor((y - lattice.min_y - odd) / F.lit(lattice.row_step) + 0.5).cast("int")
        cx, cy = lattice.center(q, r)
        gap = (x - cx) * (x - cx) + (y - cy) * (y - cy)
        candidate = F.struct(gap.alias("d"), q.alias("q"), r.alias("r"))
        best = candidate if best is None else F.least(best, candidate)
    placed = cells.withColumn("__hex", best)
    q, r = F.col("__hex.q"), F.col("__hex.r")
    cx, cy = lattice.center(q, r)
    inside = q.between(0, lattice.n_cols - 1) & r.between(0, lattice.n_rows - 1)
    outside = F.raise_error(F.lit("cell centre outside the hexagon lattice")).cast("bigint")
    hex_id = F.when(inside | x.isNull() | y.isNull(), q.cast("bigint") * lattice.n_rows + r + 1).otherwise(outside)
    return placed.withColumns({"q": q, "r": r, "hex_id": hex_id, "cx": cx, "cy": cy}).drop("__hex")


def hex_proportion(cells: DataFrame, lattice: HexLattice, threshold: float = 4000.0,
                   value: str = "value") -> DataFrame:
    """Valid cells and share strictly above ``threshold`` per hexagon.

    Missing values are never valid and hexagons without cells are absent.  The
    aggregation combines partially, so a crowded hexagon costs nothing extra.
    """
    placed = hex_bin(cells.where(F.col(value).isNotNull()), lattice)
    hit = (F.col(value) > threshold).cast("double")
    return placed.groupBy("hex_id", "q", "r", "cx", "cy").agg(
        F.count(F.lit(1)).alias("cell_count"), F.avg(hit).alias("prop_disco"))


def scan_rows(edges: DataFrame, grid: Grid) -> DataFrame:
    """Where a polygon boundary crosses each grid row's centre line.

    ``edges``: (x1, y1, x2, y2).  One row per grid row that the polygon spans,
    holding the crossing positions; its size follows the boundary, not the
    cells.
    """
    y1, y2 = F.col("y1"), F.col("y2")
    a = (y1 - grid.y0) / grid.dy - 0.5
    b = (y2 - grid.y0) / grid.dy - 0.5
    first = F.greatest(F.lit(0), F.floor(F.least(a, b)))
    last = F.ceil(F.greatest(a, b))
    if grid.n_rows is not None:
        last = F.least(F.lit(grid.n_rows - 1), last)
    rows = edges.where(first <= last).select(
        "x1", "y1", "x2", "y2", F.explode(F.sequence(first.cast("int"), last.cast("int"))).alias("row"))
    cy = grid.y(F.col("row"))
    crosses = (y1 > cy) != (y2 > cy)
    at = F.col("x1") + (cy - y1) * (F.col("x2") - F.col("x1")) / F.when(y2 != y1, y2 - y1)
    return (rows.where(crosses).select("row", at.alias("at"))
            .groupBy("row").agg(F.array_sort(F.collect_list("at")).alias("crossings")))


def clip_to_polygon(cells: DataFrame, edges: DataFrame, grid: Grid) -> DataFrame:
    """Cells whose centre lies inside the polygon (even-odd rule).

    Scan-line form: boundary crossings are worked out once per grid row, cells
    join them on the row and count crossings to their right.
    """
    lines = scan_rows(edges, grid)
    cx = grid.x(F.col("col"))
    right = F.size(F.filter("crossings", lambda x: x > cx))
    return cells.join(lines, "row").where(right % 2 == 1).select(*cells.columns)


def block_columns(grid: Grid, block_size_m: float) -> tuple[int, int, int]:
    """Cells per block along x and y, and blocks per row of blocks."""
    per_x = max(1, round(block_size_m / abs(grid.dx)))
    per_y = max(1, round(block_size_m / abs(grid.dy)))
    return per_x, per_y, (grid.n_cols - 1) // per_x + 1


def block_id(cells: DataFrame, grid: Grid, block_size_m: float = 30_000.0) -> DataFrame:
    """Square spatial block of each cell."""
    per_x, per_y, across = block_columns(grid, block_size_m)
    row_tile = F.floor(F.col("row") / F.lit(per_y))
    col_tile = F.floor(F.col("col") / F.lit(per_x))
    return cells.withColumn("block_id", row_tile * F.lit(across) + col_tile)


def valid_cells(cells: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells with a value in every layer."""
    return cells.dropna(subset=list(columns))


def align_layers(layers: Sequence[DataFrame], keys: Sequence[str] = CELL) -> DataFrame:
    """Inner equi-join of layers on the cell."""
    joined, *rest = layers
    for layer in rest:
        joined = joined.join(layer, list(keys))
    return joined
