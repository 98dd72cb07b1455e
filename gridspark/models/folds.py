"""Spatial folds: whole blocks of cells stay together.

Blocks are taken by falling size, each into the fold with the fewest cells so far; equal sizes by
ascending block, equal folds by ascending number.  Among blocks of one size the order of the folds
soon repeats, so a block's fold follows from its rank inside its size.  The driver sees one row per
size (no more than a block has cells), never the blocks, and executors rank and assign them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.operators.order_statistics import running_counts
from gridspark.session import cut_lineage


@dataclass(frozen=True)
class Dealing:
    """Folds of the blocks of one size by rank: ``head`` once, then ``cycle`` over and over."""

    head: tuple[int, ...]
    cycle: tuple[int, ...]

    def at(self, rank: np.ndarray) -> np.ndarray:
        """Fold of each rank."""
        h = len(self.head)
        return np.array(self.head + self.cycle)[np.where(rank < h, rank, h + (rank - h) % len(self.cycle))]

    def before(self, rank, fold: int) -> np.ndarray:
        """How many of the ranks below each ``rank`` are in ``fold``."""
        h, rank = len(self.head), np.asarray(rank)
        seen = np.concatenate([[0], np.cumsum(np.array(self.head + self.cycle) == fold)])
        rounds, rest = np.divmod(np.maximum(rank - h, 0), len(self.cycle))
        return np.where(rank <= h, seen[np.minimum(rank, h)], seen[h + rest] + rounds * (seen[-1] - seen[h]))


def deal(blocks_of_size: Mapping[int, int], k: int) -> dict[int, Dealing]:
    """Dealing of each size, given the number of blocks of that size."""
    n_blocks = sum(blocks_of_size.values())
    if k < 1 or k > n_blocks:
        raise ValueError(f"{k} folds need at least {max(k, 1)} blocks, got {n_blocks}")
    filled, out = [0] * k, {}
    for size in sorted(blocks_of_size, reverse=True):
        left, head = blocks_of_size[size], []
        # Until all folds lie within one block of each other, the emptiest is not the one that waited longest.
        while left and max(filled) - min(filled) >= size:
            fold = filled.index(min(filled))
            filled[fold] += size
            head.append(fold)
            left -= 1
        cycle = sorted(range(k), key=lambda fold: (filled[fold], fold))
        rounds, rest = divmod(left, k)
        for i, fold in enumerate(cycle):
            filled[fold] += size * (rounds + (i < rest))
        out[size] = Dealing(tuple(head), tuple(cycle))
    return out


def block_sizes(cells: DataFrame, block: str = "block_id") -> DataFrame:
    """(block, cells): cells per block; cells without a block have no fold."""
    return cells.where(F.col(block).isNotNull()).groupBy(F.col(block).cast("bigint").alias(block)).agg(F.count(F.lit(1)).alias("cells"))


def blocks_by_size(blocks: DataFrame) -> dict[int, int]:
    return {r["cells"]: r["n"] for r in blocks.groupBy("cells").agg(F.count(F.lit(1)).alias("n")).collect()}


def fold_table(blocks: DataFrame, outer: Mapping[int, Dealing], inner: Sequence[Mapping[int, Dealing]] = ()) -> DataFrame:
    """(block, fold, inner_0, ...) from (block, cells); block numbers lie below 2 ** 53."""
    block = blocks.columns[0]
    ranked = running_counts(blocks, ["cells"], block).select(F.col("value").cast("bigint").alias(block), "cells", F.col("n_before").alias("rank"))
    names = [f"inner_{o}" for o in range(len(inner))]

    def assign(frames):
        for frame in frames:
            out = frame[[block]].copy()
            folds = np.full((len(frame), 1 + len(names)), -1, "int32")
            for size, at in frame.groupby("cells").indices.items():
                rank = frame["rank"].to_numpy()[at]
                folds[at, 0] = own = outer[size].at(rank)
                for o, dealt in enumerate(inner):
                    trains = own != o
                    if trains.any():
                        folds[at[trains], 1 + o] = dealt[size].at((rank - outer[size].before(rank, o))[trains])
            out[["fold", *names]] = folds
            yield out

    return ranked.mapInPandas(assign, f"`{block}` bigint, fold int" + "".join(f", {n} int" for n in names))


@dataclass(frozen=True)
class FoldPlan:
    """Outer fold per block and, per outer fold, the inner fold of its training blocks."""

    folds: DataFrame  # block, fold, inner_0, ...
    sizes: dict[int, int]  # number of blocks by their number of cells
    outer: dict[int, Dealing]
    inner_folds: list[int]
    n_outer: int

    @classmethod
    def build(cls, blocks: DataFrame, n_outer: int, n_inner: int) -> FoldPlan:
        blocks = cut_lineage(blocks)
        sizes = blocks_by_size(blocks)
        outer, inner, inner_folds = deal(sizes, n_outer), [], []
        for fold in range(n_outer):
            training = {size: n - int(outer[size].before(n, fold)) for size, n in sizes.items()}
            training = {size: n for size, n in training.items() if n}
            inner_folds.append(min(n_inner, sum(training.values())))
            inner.append(deal(training, inner_folds[-1]))
        return cls(cut_lineage(fold_table(blocks, outer, inner)), sizes, outer, inner_folds, n_outer)

    def n_inner(self, fold: int) -> int:
        return self.inner_folds[fold]

    def blocks_in(self, fold: int) -> int:
        return sum(int(self.outer[size].before(n, fold)) for size, n in self.sizes.items())

    def cells_in(self, fold: int) -> int:
        return sum(size * int(self.outer[size].before(n, fold)) for size, n in self.sizes.items())

    def n_cells(self) -> int:
        return sum(size * n for size, n in self.sizes.items())

    def attach(self, cells: DataFrame, block: str = "block_id") -> DataFrame:
        """Add ``fold`` and ``inner_<o>`` (-1 inside outer fold o)."""
        return cells.join(self.folds, block)


def group_kfold(cells: DataFrame, k: int, block: str = "block_id") -> DataFrame:
    """Cells with ``fold``: whole blocks, near-equal fold sizes."""
    blocks = cut_lineage(block_sizes(cells, block))
    return cells.join(fold_table(blocks, deal(blocks_by_size(blocks), k)), block)
