"""Keys carried in file and layer names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_depth_range(text: Column) -> dict[str, Column]:
    """``"15_30"`` -> upper_cm, lower_cm and thickness in mm."""
    ends = F.split(text, "_")
    upper, lower = ends.getItem(0).cast("int"), ends.getItem(1).cast("int")
    return {"upper_cm": upper, "lower_cm": lower, "thick_mm": (lower - upper) * 10}


def parse_run_key(name: Column, groups: Sequence[str] = ("1m", "2m", "mrd")) -> dict[str, Column]:
    """``proportion_<ptf>_<group>_<yyyy-mm-dd>.png`` -> its parts; NULL if no match.

    ``display`` is the spaced, capitalised function name ("and" stays small),
    ``label`` its first word as written.
    """
    pattern = rf"^proportion_(.*)_({'|'.join(groups)})_(\d{{4}}-\d{{2}}-\d{{2}})\.png"
    hit = name.rlike(pattern)
    part = lambda i: F.when(hit, F.regexp_extract(name, pattern, i))
    ptf = part(1)
    return {
        "ptf": ptf,
        "grp": part(2),
        "date": part(3),
        "display": F.replace(F.initcap(F.replace(ptf, F.lit("_"), F.lit(" "))),
                             F.lit(" And "), F.lit(" and ")),
        "label": F.split(ptf, "_").getItem(0),
    }
