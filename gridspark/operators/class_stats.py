"""Comparison of two classes of cells (discolored or not)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.bins import equal_bin
from gridspark.functions.scores import binarize
from gridspark.functions.tails import normal_sf
from gridspark.operators.order_statistics import (
    class_measures, quantile_agg, running_counts, value_counts,
)

RUN_KEYS = ("dataset", "depth", "date")


def class_split(awc: DataFrame, disco: DataFrame, threshold: float = 4000.0, strict: bool = False,
                unfold: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None) -> DataFrame:
    """Cells with both values, labelled by discoloration.

    ``awc``: (dataset, depth, row, col, awc_mm); ``disco``: (date, row, col,
    value) already on the same grid.  Inner equi-join on the cell; nothing is
    stored as an array, each cell stays one row.

    ``awc`` may instead have all maps of a cell in one row.  Then ``unfold`` makes
    (dataset, depth, awc_mm) of them, beside the columns named to it, and the join
    moves and compares one row a cell.
    """
    labelled = disco.where(F.col("value").isNotNull())
    if unfold is None:
        joined = awc.where(F.col("awc_mm").isNotNull()).join(labelled, ["row", "col"])
    else:
        both = awc.join(labelled.select("date", "row", "col", "value"), ["row", "col"])
        joined = unfold(both, ("date", "row", "col", "value")).where(F.col("awc_mm").isNotNull())
    return joined.select(*RUN_KEYS, "row", "col", "awc_mm",
                         binarize(F.col("value"), threshold, strict).alias("cls"))


def _u_of(first: str, second: str) -> Column:
    """Pairs in which a ``first`` value exceeds a ``second`` value, ties half."""
    return F.sum(F.col(first) * (F.col(f"{second}_before") + F.col(second) / 2.0))


def _tie_term() -> Column:
    t = (F.col("n0") + F.col("n1")).cast("double")
    return F.sum(t * t * t - t)


def rank_sum_z(u: Column, n_a: Column, n_b: Column, ties: Column) -> Column:
    """Normal score of a rank-sum statistic, tie-corrected, 0.5 continuity."""
    a, b = n_a.cast("double"), n_b.cast("double")
    n = a + b
    variance = a * b / 12.0 * ((n + 1.0) - F.try_divide(ties, n * (n - 1.0)))
    return F.try_divide(u - a * b / 2.0 - 0.5, F.sqrt(F.when(variance > 0, variance)))


def mann_whitney(df: DataFrame, keys: Sequence[str], x: str, cls: str, first: int = 0,
                 alternative: str = "two-sided") -> DataFrame:
    """U of class ``first``, its normal score and p-value, per key."""
    if alternative not in ("two-sided", "greater"):
        raise ValueError(f"unknown alternative {alternative!r}")
    rows = running_counts(df, keys, x, class_measures(cls))
    a, b = ("n0", "n1") if first == 0 else ("n1", "n0")
    sums = rows.groupBy(*keys).agg(
        F.sum(a).alias("n_first"), F.sum(b).alias("n_second"),
        _u_of(a, b).alias("u"), _tie_term().alias("ties"))
    pairs = F.col("n_first").cast("double") * F.col("n_second")
    tested = F.col("u")
    if alternative == "two-sided":
        tested = F.greatest(tested, pairs - tested)
    scored = sums.withColumn("z", rank_sum_z(tested, F.col("n_first"), F.col("n_second"), F.col("ties")))
    p = normal_sf("z")
    p = F.least(F.lit(1.0), 2.0 * p) if alternative == "two-sided" else p
    return scored.withColumn("p_value", p).drop("ties")


def overlap_coefficient(counts: DataFrame, keys: Sequence[str], n_edges: int = 200) -> DataFrame:
    """Shared area of the two class densities over ``n_edges - 1`` equal bins.

    ``counts`` are rows of ``running_counts`` with measures n0 and n1.
    """
    n_bins = n_edges - 1
    index = equal_bin(F.col("value"), F.col("v_min"), F.col("v_max"), n_bins)
    bins = (counts.where(F.col("v_max") > F.col("v_min")).withColumn("bin", index)
            .groupBy(*keys, "bin")
            .agg(F.sum("n0").alias("h0"), F.sum("n1").alias("h1"),
                 F.max("n0_total").alias("t0"), F.max("n1_total").alias("t1")))
    shared = F.least(F.try_divide(F.col("h0"), F.col("t0")), F.try_divide(F.col("h1"), F.col("t1")))
    return bins.groupBy(*keys).agg(
        F.when((F.max("t0") > 0) & (F.max("t1") > 0), F.sum(shared)).alias("overlap_coeff"))


def two_class_stats(cells: DataFrame, keys: Sequence[str] = RUN_KEYS, x: str = "awc_mm",
                    cls: str = "cls", digits: int = 4,
                    with_p: bool = True) -> DataFrame:
    """Location, spread, rank and overlap statistics of two classes, per key.

    Everything but the overlap is one partial aggregation over distinct values;
    medians and quartiles are exact.  ``cles`` keeps the published value, which
    is the share of pairs with class 0 above class 1.
    """
    rows = running_counts(cells, keys, x, {**class_measures(cls), "n": F.lit(1).cast("bigint")})
    shift = (F.col("v_min") + F.col("v_max")) / 2.0
    d = F.col("value") - shift
    aggs = [F.max("n0_total").alias("n0"), F.max("n1_total").alias("n1"), F.max(shift).alias("shift"),
            quantile_agg(0.5).alias("median_awc"), F.sum(F.col("n") * d).alias("s"),
            _u_of("n0", "n1").alias("u_stat"), _tie_term().alias("ties")]
    for c in ("0", "1"):
        m = f"n{c}"
        aggs += [quantile_agg(0.5, m).alias(f"median{c}"),
                 (quantile_agg(0.75, m) - quantile_agg(0.25, m)).alias(f"iqr{c}"),
                 F.sum(F.col(m) * d).alias(f"s{c}"), F.sum(F.col(m) * d * d).alias(f"q{c}")]
    g = rows.groupBy(*keys).agg(*aggs)

    n0, n1 = F.col("n0"), F.col("n1")
    pairs = n0.cast("double") * n1
    mean = {c: F.col("shift") + F.try_divide(F.col(f"s{c}"), F.col(f"n{c}")) for c in "01"}
    # sum of squares around the class mean
    squares = {c: F.col(f"q{c}") - F.try_divide(F.col(f"s{c}") * F.col(f"s{c}"), F.col(f"n{c}")) for c in "01"}
    pooled = F.sqrt(F.try_divide(squares["0"] + squares["1"], n0 + n1 - 2))
    u = F.col("u_stat")
    rounded = lambda c: F.bround(c, digits)
    out = g.select(
        *keys, "n0", "n1",
        rounded(F.col("median0")).alias("median0"), rounded(F.col("median1")).alias("median1"),
        rounded(mean["0"]).alias("mean0"), rounded(mean["1"]).alias("mean1"),
        rounded(F.col("iqr0")).alias("iqr0"), rounded(F.col("iqr1")).alias("iqr1"),
        rounded(F.col("median1") - F.col("median0")).alias("median_diff"),
        rounded(F.try_divide(F.col("median1"), F.col("median0"))).alias("median_ratio"),
        u.alias("u_stat"),
        rank_sum_z(F.greatest(u, pairs - u), n0, n1, F.col("ties")).alias("z"),
        rounded(1.0 - F.try_divide(2.0 * u, pairs)).alias("r_rb"),
        rounded(F.try_divide(mean["1"] - mean["0"], pooled)).alias("cohens_d"),
        rounded(F.try_divide(u, pairs)).alias("cles"),
        rounded(F.col("shift") + F.col("s") / (n0 + n1)).alias("mean_awc"),
        rounded(F.col("median_awc")).alias("median_awc"),
    ).join(overlap_coefficient(rows, keys), list(keys), "left")
    out = out.withColumn("overlap_coeff", rounded(F.col("overlap_coeff")))
    if with_p:
        out = out.withColumn("p_value", F.least(F.lit(1.0), 2.0 * normal_sf("z")))
    return out


def separability(scored: DataFrame, label: str = "label", p: str = "p", cls: str = "cls") -> DataFrame:
    """Per scenario: class sizes, means, medians, U, AUC and Cohen's d.

    The deviation is the root of the plain mean of both variances.  With fewer
    than two cells in a class: AUC 0, U 0, p 1, d 0.
    """
    rows = running_counts(scored, [label], p, class_measures(cls))
    d = F.col("value") - 0.5
    aggs = [_u_of("n1", "n0").alias("u"), _tie_term().alias("ties")]
    for c in "01":
        m = f"n{c}"
        aggs += [F.max(f"{m}_total").alias(m), quantile_agg(0.5, m).alias(f"median{c}"),
                 F.sum(F.col(m) * d).alias(f"s{c}"), F.sum(F.col(m) * d * d).alias(f"q{c}")]
    g = rows.groupBy(label).agg(*aggs)
    n0, n1 = F.col("n0"), F.col("n1")
    both = (n0 > 1) & (n1 > 1)
    mean = {c: 0.5 + F.try_divide(F.col(f"s{c}"), F.col(f"n{c}")) for c in "01"}
    var = {c: F.try_divide(F.col(f"q{c}") - F.try_divide(F.col(f"s{c}") * F.col(f"s{c}"), F.col(f"n{c}")),
                           F.col(f"n{c}") - 1) for c in "01"}
    pooled = F.sqrt((var["0"] + var["1"]) / 2.0)
    result = g.select(
        label, n1.alias("n_disco"), n0.alias("n_nondisco"),
        mean["1"].alias("mean_disco"), mean["0"].alias("mean_nondisco"),
        F.col("median1").alias("median_disco"), F.col("median0").alias("median_nondisco"),
        F.when(both, F.col("u") / (n0.cast("double") * n1)).otherwise(0.0).alias("auc"),
        F.when(both, F.col("u")).otherwise(0.0).alias("mw_u"),
        F.when(both, rank_sum_z(F.col("u"), n1, n0, F.col("ties"))).alias("mw_z"),
        F.when(both, F.try_divide(mean["1"] - mean["0"], pooled)).otherwise(0.0).alias("cohens_d"))
    return result.withColumn("mw_p", F.when(F.col("mw_z").isNull(), 1.0).otherwise(normal_sf("mw_z")))


def box_stats(df: DataFrame, keys: Sequence[str], value: str, whis: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme values within ``whis`` IQR) and outlier count."""
    rows = running_counts(df, keys, value)
    box = rows.groupBy(*keys).agg(
        quantile_agg(0.25).alias("q1"), quantile_agg(0.5).alias("median"),
        quantile_agg(0.75).alias("q3"), F.max("n_total").alias("n_box"))
    reach = whis * (F.col("q3") - F.col("q1"))
    v = F.col("value")
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    ends = (value_counts(df, keys, value).join(box, list(keys)).groupBy(*keys)
            .agg(F.min(F.when(inside, v)).alias("lo"), F.max(F.when(inside, v)).alias("hi"),
                 F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("n_outliers")))
    return box.withColumnRenamed("n_box", "n").join(ends, list(keys)).select(
        *keys, "n", "q1", "median", "q3", "n_outliers",
        F.least("q1", "lo").alias("whisker_lo"), F.greatest("q3", "hi").alias("whisker_hi"))


def box_outliers(df: DataFrame, keys: Sequence[str], value: str, box: DataFrame) -> DataFrame:
    """Distinct values beyond the whiskers of :func:`box_stats`, with counts."""
    counts = value_counts(df, keys, value)
    joined = counts.join(box.select(*keys, "whisker_lo", "whisker_hi"), list(keys))
    return joined.where((F.col("value") < F.col("whisker_lo")) | (F.col("value") > F.col("whisker_hi"))
                        ).select(*keys, "value", "n")


def pooled_band(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Mean and population deviation of all pooled values, per key."""
    return df.groupBy(*keys).agg(F.avg(value).alias("overall_mean"),
                                 F.stddev_pop(value).alias("overall_sd"))
