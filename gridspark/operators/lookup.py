"""Per-key results beside large tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_key(small: DataFrame, on: Sequence[str], value: str) -> Column:
    """``value`` of the row of ``small`` with the same ``on``, read from a scalar subquery; NULL without one.

    For results that are few by construction (one row per layer, fold or model): an aggregate looks as large as its
    input to the planner, and a join on so few keys would shuffle the large side onto them.  Results with many keys
    belong in an ordinary join.
    """
    key = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(on)])
    table = small.agg(F.map_from_entries(F.collect_list(F.struct(key, F.col(value))))).scalar()
    return F.element_at(table, key)
