"""Water retention per cell and layer.

Input: one row per (row, col, layer) with sand, clay, soc (percent), trd
(g/cm3), gravel (percent) and, where a rule needs depth, the layer limits.
All operators are narrow projections.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions import ka5
from gridspark.functions import pedotransfer as ptf
from gridspark.functions.numeric import clip, dbl

FIELD_CAPACITY_CM = 330.0
WILTING_POINT_CM = 16000.0
RETENTION = ptf.RETENTION


def ptf_schoch(df: DataFrame) -> DataFrame:
    """ths, thr, alpha, n, tau, ksat; all NULL where the residual content is negative."""
    return ptf.run_steps(df, ptf.schoch())


def ptf_wosten(df: DataFrame, van_bemmelen: float = ptf.VAN_BEMMELEN) -> DataFrame:
    """ths, thr, alpha, n, silt; needs ``upper_cm`` (topsoil is above 30 cm)."""
    return ptf.run_steps(df, ptf.wosten(van_bemmelen=van_bemmelen))


def ptf_weynants(df: DataFrame) -> DataFrame:
    return ptf.run_steps(df, ptf.weynants())


def ptf_puhlmann(df: DataFrame) -> DataFrame:
    return ptf.run_steps(df, ptf.puhlmann())


def ptf_teepe(df: DataFrame, awc_direct: bool = False) -> DataFrame:
    """Retention parameters, or ``awc_vol`` by the direct regression."""
    return ptf.run_steps(df, ptf.teepe(awc_direct=awc_direct))


def ptf_toth(df: DataFrame) -> DataFrame:
    return ptf.run_steps(df, ptf.toth())


def ptf_saxton_rawls(df: DataFrame, density_factor: float | None = None,
                     van_bemmelen: float = ptf.VAN_BEMMELEN) -> DataFrame:
    return ptf.run_steps(df, ptf.saxton_rawls(density_factor=density_factor, van_bemmelen=van_bemmelen))


def derive_silt(df: DataFrame, clip: bool = True) -> DataFrame:
    return df.withColumn("silt", ptf.silt_from(dbl("sand"), dbl("clay"), clip))


def classify_ka5(df: DataFrame) -> DataFrame:
    """Texture class code from ``clay`` and ``silt`` (SMALLINT, 0 = unknown)."""
    return df.withColumn("ka5", ka5.ka5_code(dbl("clay"), dbl("silt")))


def classify_ka5_by_join(df: DataFrame, step: int = 5) -> DataFrame:
    """Same result as :func:`classify_ka5`, as a range join on texture tiles.

    Both shares are bucketed to ``step`` percent, so the containment join is an
    equi-join with a residual test against a table of a few hundred rows.
    """
    clay, silt = dbl("clay"), dbl("silt")
    tile = lambda c: clip(F.floor(c / step), 0, 100 // step).cast("int")
    tiles = ka5.box_cells(df.sparkSession, step)
    left = df.drop("ka5").withColumns({"clay_tile": tile(clay), "silt_tile": tile(silt)}).alias("cell")
    on = (
        (F.col("cell.clay_tile") == F.col("box.clay_tile"))
        & (F.col("cell.silt_tile") == F.col("box.silt_tile"))
        & (F.col("cell.clay") >= F.col("box.clay_lo")) & (F.col("cell.clay") < F.col("box.clay_hi"))
        & (F.col("cell.silt") >= F.col("box.silt_lo")) & (F.col("cell.silt") < F.col("box.silt_hi"))
    )
    joined = left.join(F.broadcast(tiles.alias("box")), on, "left")
    keep = [F.col(f"cell.{c}") for c in df.columns if c != "ka5"]
    return joined.select(*keep, F.coalesce(F.col("box.ka5"), F.lit(0)).cast("smallint").alias("ka5"))


def ptf_wessolek(df: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Retention parameters by texture class; unknown classes give NULL.

    ``lookup`` holds one row per class code (at most 38), hence the broadcast.
    """
    lookup = ka5.builtin_lookup(df.sparkSession) if lookup is None else lookup
    return df.join(F.broadcast(lookup.select("ka5", *RETENTION)), "ka5", "left")


def normalize_texture(df: DataFrame) -> DataFrame:
    """Rescale sand, silt and clay to 100 percent; the sum is floored at 1."""
    sand, silt, clay = dbl("sand"), dbl("silt"), dbl("clay")
    total = clip(sand + silt + clay, lo=1.0)
    return df.withColumns({name: share / total * 100.0
                           for name, share in (("sand", sand), ("silt", silt), ("clay", clay))})


def mvg_theta(df: DataFrame, h_cm: float, name: str = "theta") -> DataFrame:
    return df.withColumn(name, ptf.mvg_theta(h_cm, *map(F.col, RETENTION)))


def awc_vol_mvg(df: DataFrame, fc: float = FIELD_CAPACITY_CM,
                pwp: float = WILTING_POINT_CM) -> DataFrame:
    """fc_vol, pwp_vol and their difference awc_vol from retention parameters."""
    return ptf.run_steps(df, ptf.water_between(fc, pwp))


def awc_from_point_ptf(df: DataFrame, fc: str = "fc", wp: str = "wp") -> DataFrame:
    """awc_vol and layer_awc_mm from externally predicted fc and wp columns.

    NULL where sand, clay, density or a prediction is missing; the difference is held to
    [0, 0.8] and missing gravel counts as none.  Needs ``thick_mm``.
    """
    known = dbl("sand").isNotNull() & dbl("clay").isNotNull() & dbl("trd").isNotNull()
    awc = F.when(known, clip(dbl(fc) - dbl(wp), 0.0, 0.8))
    gravel = F.coalesce(dbl("gravel") / 100.0, F.lit(0.0))
    return df.withColumns({"awc_vol": awc, "layer_awc_mm": awc * (1.0 - gravel) * F.col("thick_mm")})


def awc_volumes(df: DataFrame, names: Sequence[str] = tuple(ptf.CLOSED_FORM),
                fc: float = FIELD_CAPACITY_CM, pwp: float = WILTING_POINT_CM) -> DataFrame:
    """One ``<name>_awc_vol`` column per closed-form function, in one narrow pass.

    Needs ``upper_cm``.  The texture-class function needs a lookup join and the
    ensemble a member table; add their volumes as further columns.
    """
    return ptf.run_steps(df, ptf.awc_volume_steps(names, fc, pwp), keep=[f"{n}_awc_vol" for n in names])
