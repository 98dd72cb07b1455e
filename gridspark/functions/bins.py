"""Equal-width bins whose limits are ``lo + i * (hi - lo) / n``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bin_edge(index: Column, lo: Column, hi: Column, n: int) -> Column:
    return F.when(index >= n, hi).otherwise(lo + index * ((hi - lo) / float(n)))


def equal_bin(value: Column, lo: Column, hi: Column, n: int, extend: bool = False) -> Column:
    """0-based bin, left-closed, the last bin closed on both sides.

    The arithmetic index is corrected against the actual bin limits so that a
    value equal to a limit always falls right of it.  Outside [lo, hi] the bin
    is NULL, or the nearest one with ``extend``.
    """
    width = (hi - lo) / float(n)
    guess = F.floor(F.try_divide(value - lo, width))
    left, right = bin_edge(guess, lo, hi, n), bin_edge(guess + 1, lo, hi, n)
    index = F.when(value < left, guess - 1).when(value >= right, guess + 1).otherwise(guess)
    index = F.greatest(F.lit(0), F.least(F.lit(n - 1), index))
    index = F.when(hi > lo, index).otherwise(F.lit(n // 2))
    if not extend:
        return F.when((value >= lo) & (value <= hi), index).cast("int")
    return F.when(value.isNotNull(), index).cast("int")


def bin_center(index: Column, lo: Column, hi: Column, n: int) -> Column:
    return (bin_edge(index, lo, hi, n) + bin_edge(index + 1, lo, hi, n)) / 2.0
