"""Soil profiles to available-water maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators import depth, ensemble, soil

NETWORK_INPUTS = ("sand", "silt", "clay", "trd")
POINT_KEYS = ("row", "col", "layer")
GRAVEL_OPTIONAL = ("szabo",)


def water_map(profile: DataFrame, function: Callable[[DataFrame], DataFrame],
              retention: bool = True) -> DataFrame:
    """awc_1m and awc_2m per cell for one function.

    Scan, projections and one shuffle on the cell with partial sums before it.
    """
    fitted = function(profile)
    volumes = soil.awc_vol_mvg(fitted) if retention else fitted
    return depth.awc_totals(depth.layer_awc_mm(volumes))


def class_volume(profile: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """``wessolek_awc_vol`` beside the profile, from texture class parameters."""
    classed = soil.classify_ka5(soil.derive_silt(profile, clip=False))
    volumes = soil.awc_vol_mvg(soil.ptf_wessolek(classed, lookup))
    return volumes.withColumnRenamed("awc_vol", "wessolek_awc_vol").select(*profile.columns, "wessolek_awc_vol")


def network_volume(profile: DataFrame, members: DataFrame) -> DataFrame:
    """``zhang_awc_vol`` beside the profile: mean retention parameters of linear ensemble members.

    ``members`` has one row per member and output (thr, ths and the logarithms of alpha and n) with the weights of
    sand, silt, clay (rescaled to 100 percent) and density.
    """
    packed = profile.select(F.struct(*profile.columns).alias("__in"), *profile.columns)
    ready = soil.normalize_texture(soil.derive_silt(packed))
    fitted = ensemble.score_linear_ensemble(ready, members, NETWORK_INPUTS, soil.RETENTION, log10_outputs=("alpha", "n"))
    return soil.awc_vol_mvg(fitted).select("__in.*", F.col("awc_vol").alias("zhang_awc_vol"))


def point_volume(profile: DataFrame, points: DataFrame) -> DataFrame:
    """``szabo_awc_vol`` beside the profile, from ``points``: fc and wp predicted elsewhere, one row per cell and layer.

    Both tables are dealt by the cell alone, so a cell leaves the join as one row of partial sums: the layer is compared by
    two inequalities, since an equality would become part of the key and spread the layers over tasks.
    """
    (row, col, layer), at = POINT_KEYS, [f"__{k}" for k in POINT_KEYS]
    named = points.select(*[F.col(k).alias(a) for k, a in zip(POINT_KEYS, at)], F.col("fc").alias("__fc"), F.col("wp").alias("__wp"))
    same = ((F.col(row) == F.col(at[0])) & (F.col(col) == F.col(at[1]))
            & (F.col(layer) <= F.col(at[2])) & (F.col(layer) >= F.col(at[2])))
    # A hash table of a part of the points spares the sort of both sides.
    volumes = soil.awc_from_point_ptf(profile.join(named.hint("shuffle_hash"), same, "left"), "__fc", "__wp")
    return volumes.select(*profile.columns, F.col("awc_vol").alias("szabo_awc_vol"))


def _volumes(profile: DataFrame, names: Sequence[str], lookup: DataFrame | None, members: DataFrame | None,
             points: DataFrame | None) -> DataFrame:
    for name, table in (("zhang", members), ("szabo", points)):
        if name in names and table is None:
            raise ValueError(f"{name} needs a table of its own: members for zhang, points for szabo")
    # Points first: their join moves the few columns of the profile, not the volumes of all functions.
    volumes = point_volume(profile, points) if "szabo" in names else profile
    volumes = soil.awc_volumes(volumes, [n for n in names if n not in ("wessolek", "zhang", "szabo")])
    if "wessolek" in names:
        volumes = class_volume(volumes, lookup)
    return network_volume(volumes, members) if "zhang" in names else volumes


def all_maps(profile: DataFrame, names: Sequence[str], lookup: DataFrame | None = None, members: DataFrame | None = None,
             points: DataFrame | None = None) -> DataFrame:
    """(ptf, depth, row, col, awc_mm) of the named functions: closed forms, ``wessolek`` by texture class, ``zhang`` from
    ensemble members, ``szabo`` from predicted points, for which missing gravel counts as none."""
    return depth.awc_maps(_volumes(profile, names, lookup, members, points), names, null_gravel_is_zero=GRAVEL_OPTIONAL)


def wide_maps(profile: DataFrame, names: Sequence[str], lookup: DataFrame | None = None, members: DataFrame | None = None,
              points: DataFrame | None = None) -> DataFrame:
    """The maps of :func:`all_maps` side by side: one row per cell, ``<name>@1m`` and ``<name>@2m``."""
    return depth.awc_wide(_volumes(profile, names, lookup, members, points), names, null_gravel_is_zero=GRAVEL_OPTIONAL)


def ensemble_maps(profile: DataFrame, names: Sequence[str], lookup: DataFrame | None = None, members: DataFrame | None = None,
                  points: DataFrame | None = None) -> DataFrame:
    """Cell-wise mean and deviation over functions, straight from the profiles.

    The layers of a cell are summed in one shuffle; predicted points add that of their join.
    """
    return ensemble.ensemble_of_columns(wide_maps(profile, names, lookup, members, points), names)
