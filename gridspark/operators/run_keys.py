"""Which (dataset, depth, date) results exist, are missing, or are excluded."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RUN_KEYS = ("dataset", "depth", "date")


def requested_keys(existing: DataFrame, new: Mapping[str, Sequence], keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Every combination of existing and newly named key values.

    Key values are labels (functions, depths, dates) and come out of one
    aggregation of distinct labels per key, so the product is an explode of
    short arrays in a single row, not a join.
    """
    axes = []
    for key in keys:
        known = F.collect_set(F.col(key).cast("string"))
        named = F.array(*[F.lit(str(v)) for v in new.get(key, ())]).cast("array<string>")
        axes.append(F.array_union(known, named).alias(key))
    grid = existing.agg(*axes)
    for key in keys:
        grid = grid.withColumn(key, F.explode(key))
    return grid.select(*keys)


def missing_keys(existing: DataFrame, new: Mapping[str, Sequence], keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Requested combinations without a result yet (anti-join)."""
    done = existing.select(*[F.col(k).cast("string").alias(k) for k in keys]).distinct()
    # The combinations alone: the labels of the axes come from the shuffle that already found them.
    return requested_keys(done, new, keys).join(done, list(keys), "left_anti")


def append_incremental(existing: DataFrame, new: Mapping[str, Sequence],
                       compute: Callable[[DataFrame], DataFrame],
                       keys: Sequence[str] = RUN_KEYS) -> DataFrame:
    """Existing results plus those of the missing combinations.

    ``compute`` receives the missing keys and returns result rows for them; it
    should semi-join its input on the keys so that nothing else is read twice.
    """
    added = compute(missing_keys(existing, new, keys))
    casted = existing.withColumns({k: F.col(k).cast("string") for k in keys})
    return casted.unionByName(added, allowMissingColumns=True)


def pending(requested: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested rows whose key has no stored output."""
    return requested.join(existing.select(*keys).distinct(), list(keys), "left_anti")


def exclude(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    return df.where(~F.col(column).isin(list(names)))


def stack(frames: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Concatenate frames along a new key column."""
    out = None
    for name, df in frames.items():
        tagged = df.withColumn(key, F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    return out


def union_columns(frames: Sequence[DataFrame]) -> DataFrame:
    """Union with all columns in first-seen order, absent ones NULL."""
    out, *rest = frames
    for df in rest:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
