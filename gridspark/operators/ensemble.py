"""Combining models: cell-wise ensembles of maps and bootstrap ensembles of scorers."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ptf_ensemble(awc: DataFrame, ptfs: Sequence[str] | None = None,
                 depths: Sequence[str] | None = None) -> DataFrame:
    """Mean and population deviation over functions, per depth and cell.

    A cell is kept only where every function present for that depth has a
    value.  Input: (ptf, depth, row, col, awc_mm).  The number of functions per
    depth is a map of a few labels, read by a scalar subquery.
    """
    if ptfs is not None:
        awc = awc.where(F.col("ptf").isin(list(ptfs)))
    if depths is not None:
        awc = awc.where(F.col("depth").isin(list(depths)))
    present = awc.groupBy("depth").agg(F.count_distinct("ptf").alias("n_ptf"))
    present = present.agg(F.map_from_entries(F.collect_list(F.struct("depth", "n_ptf")))).scalar()
    cells = awc.groupBy("depth", "row", "col").agg(
        F.avg("awc_mm").alias("awc_mean"),
        F.stddev_pop("awc_mm").alias("awc_sd"),
        F.count("awc_mm").alias("n_valid"),
    )
    return (cells.where(F.col("n_valid") == F.element_at(present, F.col("depth")))
            .select("depth", "row", "col", "awc_mean", "awc_sd"))


def ensemble_of_columns(wide: DataFrame, names: Sequence[str], depths: Sequence[str] = ("1m", "2m")) -> DataFrame:
    """:func:`ptf_ensemble` when all maps already share a row per cell.

    Columns are ``<name>@<depth>``; mean and deviation are row arithmetic, so
    nothing is shuffled again.
    """
    def struct(d: str):
        columns = [F.col(f"{n}@{d}") for n in names]
        mean = sum(columns[1:], columns[0]) / float(len(columns))  # NULL if any is NULL
        squares = [(c - mean) * (c - mean) for c in columns]
        sd = F.sqrt(sum(squares[1:], squares[0]) / float(len(columns)))
        return F.struct(F.lit(d).alias("depth"), mean.alias("awc_mean"), sd.alias("awc_sd"))

    rows = wide.select("row", "col", F.inline(F.array(*[struct(d) for d in depths])))
    return rows.where(F.col("awc_mean").isNotNull()).select("depth", "row", "col", "awc_mean", "awc_sd")


def score_linear_ensemble(df: DataFrame, members: DataFrame, features: Sequence[str], outputs: Sequence[str],
                          log10_outputs: Sequence[str] = ()) -> DataFrame:
    """:func:`score_ensemble` for members without hidden units, as plain columns.

    The mean of linear members is the linear function of their mean weights, so one small aggregation of the member table
    replaces all passes over the rows, whatever the number of members.  An output without a member is NULL throughout.
    """
    def mean(output: str, value):
        return F.avg(F.when(F.col("output") == output, value))

    # One row of plain numbers: a field is found at once, an entry of a map by comparing names in every cell.
    means = members.where(F.col("output").isin(list(outputs))).agg(F.struct(*[
        c for o, name in enumerate(outputs)
        for c in (mean(name, F.col("bias")).alias(f"b{o}"),
                  *[mean(name, F.col("weights")[i]).alias(f"w{o}_{i}") for i in range(len(features))])])).scalar()
    scored = {}
    for o, name in enumerate(outputs):
        total = means[f"b{o}"]
        for i, feature in enumerate(features):
            total = total + means[f"w{o}_{i}"] * F.col(feature)
        scored[name] = F.pow(F.lit(10.0), total) if name in log10_outputs else total
    return df.withColumns(scored)


def score_ensemble(df: DataFrame, members: DataFrame, features: Sequence[str],
                   outputs: Sequence[str], log10_outputs: Sequence[str] = (),
                   block_weights: int = 2_000_000) -> DataFrame:
    """Mean prediction of a bootstrap ensemble, row by row.

    ``members`` is a weight table, one row per (member, output): ``weights``
    (one per input), ``bias`` and, for networks, ``hidden_weights`` (one array
    per hidden unit) with ``hidden_bias``; a hidden unit is a tanh and then
    ``weights`` refers to hidden units.  Members are averaged in the network's
    own output space and the outputs named in ``log10_outputs`` are raised to
    10 afterwards.  Rows with a missing feature get NULL.

    Members travel in blocks of ``block_weights`` numbers, one pass over the rows
    for each, whatever their number; outputs are summed over blocks.
    """
    features, outputs, logs = list(features), list(outputs), set(log10_outputs)
    kept = df.drop(*outputs)
    scored, counts, sums = kept, dict.fromkeys(outputs, 0), {name: [] for name in outputs}
    wanted = members.where(F.col("output").isin(outputs)).orderBy("member")
    for i, heads in enumerate(_member_blocks(wanted, "hidden_weights" in members.columns, block_weights)):
        scored = _add_block(scored, heads, features, f"__sum{i}_")
        for name in heads:
            counts[name] += len(heads[name])
            sums[name].append(F.col(f"__sum{i}_{name}"))
    for name in outputs:
        if not counts[name]:
            raise ValueError(f"no ensemble member for output {name!r}")
    means = {}
    for name in outputs:
        mean = sum(sums[name][1:], sums[name][0]) / F.lit(float(counts[name]))
        means[name] = F.pow(F.lit(10.0), mean) if name in logs else mean
    return scored.select(*kept.columns, *[m.alias(n) for n, m in means.items()])


def _member_blocks(members: DataFrame, has_hidden: bool, limit: int) -> Iterator[dict[str, list]]:
    """Members per output, in blocks of about ``limit`` numbers, fetched one partition at a time."""
    heads: dict[str, list] = {}
    size = 0
    for r in members.toLocalIterator():
        hidden = None
        if has_hidden and r["hidden_weights"] is not None:
            hidden = (np.array(r["hidden_weights"], float), np.array(r["hidden_bias"], float))
        weights = np.array(r["weights"], float)
        n = weights.size + 1 + (hidden[0].size + hidden[1].size if hidden else 0)
        if heads and size + n > limit:
            yield heads
            heads, size = {}, 0
        heads.setdefault(r["output"], []).append((weights, float(r["bias"]), hidden))
        size += n
    if heads:
        yield heads


def _add_block(df: DataFrame, heads: Mapping[str, list], features: Sequence[str], prefix: str) -> DataFrame:
    """``df`` with the summed outputs of one block of members; NULL where a feature is missing."""
    def summed(x: np.ndarray, nets: list) -> np.ndarray:
        total = np.zeros(len(x))
        for weights, bias, hidden in nets:
            inner = x if hidden is None else np.tanh(x @ hidden[0].T + hidden[1])
            total += inner @ weights + bias
        return total

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[features].to_numpy(dtype=float)
            known = ~np.isnan(x).any(axis=1)
            for name, nets in heads.items():
                values = np.full(len(batch), np.nan)
                values[known] = summed(x[known], nets)
                batch[prefix + name] = values
            yield batch

    added = [prefix + name for name in heads]
    schema = T.StructType(df.schema.fields + [T.StructField(n, T.DoubleType()) for n in added])
    scored = df.mapInPandas(score, schema)
    return scored.withColumns({n: F.when(~F.isnan(n), F.col(n)) for n in added})
