"""Binned shares of discolored cells and what is derived from them.

Cells are labelled rows (dataset, depth, date, awc_mm, cls).  They collapse to
distinct values first; everything after the bins has at most ``n_bins`` rows
per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.bins import bin_center, bin_edge, equal_bin
from gridspark.functions.tails import t_p_value, t_quantile_975
from gridspark.operators.order_statistics import class_measures, value_counts

RUN_KEYS = ("dataset", "depth", "date")
# Fixed value: 97.5 percent point of the normal distribution.
Z_975 = 1.959963984540054


def binned_counts(cells: DataFrame, keys: Sequence[str] = RUN_KEYS,
                  range_keys: Sequence[str] = ("depth",), n_bins: int = 25,
                  x: str = "awc_mm", cls: str = "cls") -> DataFrame:
    """Counts per key and bin; bins span the range of all keys sharing ``range_keys``."""
    counts = value_counts(cells, keys, x, class_measures(cls))
    span = counts.groupBy(*range_keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    placed = counts.join(span, list(range_keys)).withColumn("bin", equal_bin(F.col("value"), lo, hi, n_bins))
    return (placed.groupBy(*keys, "bin", "lo", "hi")
            .agg(F.sum("n1").alias("disc"), F.sum(F.col("n0") + F.col("n1")).alias("total"))
            .withColumn("center", bin_center(F.col("bin"), lo, hi, n_bins)))


def binned_proportion(cells: DataFrame, keys: Sequence[str] = RUN_KEYS,
                      range_keys: Sequence[str] = ("depth",), n_bins: int = 25,
                      min_pixels: int = 50, **columns) -> DataFrame:
    """Share of class 1 per bin with at least ``min_pixels`` cells."""
    bins = binned_counts(cells, keys, range_keys, n_bins, **columns)
    return bins.where(F.col("total") >= min_pixels).select(
        *keys, "bin", "center", "disc", "total", (F.col("disc") / F.col("total")).alias("prop"))


def _y_limit(top: Column) -> Column:
    return F.when(top > 0, F.least(F.lit(1.0), top * 1.1)).otherwise(1.0)


def depth_scales(cells: DataFrame, n_bins: int = 25, min_pixels: int = 50,
                 datasets: Sequence[str] | None = None,
                 dates: Sequence | None = None) -> DataFrame:
    """Shared bin limits and y limit per depth over the chosen datasets and dates."""
    if datasets is not None:
        cells = cells.where(F.col("dataset").isin(list(datasets)))
    if dates is not None:
        cells = cells.where(F.col("date").isin(list(dates)))
    bins = binned_counts(cells, n_bins=n_bins)
    prop = F.when(F.col("total") >= min_pixels, F.col("disc") / F.col("total"))
    per_depth = bins.groupBy("depth", "lo", "hi").agg(F.max(prop).alias("top"))
    edges = F.transform(F.sequence(F.lit(0), F.lit(n_bins)),
                        lambda i: bin_edge(i, F.col("lo"), F.col("hi"), n_bins))
    return per_depth.select("depth", "lo", "hi", edges.alias("edges"), _y_limit(F.col("top")).alias("y_limit"))


def mean_proportion_over_ptfs(cells: DataFrame, n_bins: int = 25, min_pixels: int = 50) -> DataFrame:
    """Mean and population deviation of the shares across datasets, per bin.

    Kept where at least two datasets have enough cells; ``pooled_total`` sums
    all datasets, thin bins included.
    """
    bins = binned_counts(cells, n_bins=n_bins)
    prop = F.when(F.col("total") >= min_pixels, F.col("disc") / F.col("total"))
    return (bins.withColumn("prop", prop).groupBy("depth", "date", "bin", "center")
            .agg(F.avg("prop").alias("mean_prop"), F.stddev_pop("prop").alias("sd_prop"),
                 F.count("prop").alias("n_ptf"), F.sum("total").alias("pooled_total"))
            .where(F.col("n_ptf") >= 2))


def quartile_risk(bins: DataFrame, keys: Sequence[str], prop: str = "prop",
                  total: str = "total") -> DataFrame:
    """Risk ratios between low, middle and high quarters of the bin axis.

    ``bins`` has few rows per key (one per bin), so its quartiles are taken
    directly.  Keys with fewer than four bins, an empty quarter or a zero share
    in the middle or high part yield no row.
    """
    q = bins.groupBy(*keys).agg(F.percentile("center", F.lit(0.25)).alias("p25"),
                                F.percentile("center", F.lit(0.75)).alias("p75"),
                                F.count(F.lit(1)).alias("n_bins")).where(F.col("n_bins") >= 4)
    c = F.col("center")
    part = F.when(c <= F.col("p25"), 1).when(c <= F.col("p75"), 2).otherwise(3)
    rows = bins.join(q, list(keys)).withColumns(
        {"part": part, "hits": F.bround(F.col(prop) * F.col(total), 0)})
    aggs = []
    for i in (1, 2, 3):
        own = F.col("part") == i
        aggs += [F.min(F.when(own, c)).alias(f"q{i}_lo"), F.max(F.when(own, c)).alias(f"q{i}_hi"),
                 F.sum(F.when(own, F.col("hits"))).alias(f"k{i}"),
                 F.sum(F.when(own, F.col(total))).alias(f"n{i}")]
    g = rows.groupBy(*keys).agg(*aggs)
    for i in (1, 2, 3):
        g = g.withColumn(f"p{i}", F.coalesce(F.try_divide(F.col(f"k{i}"), F.col(f"n{i}")), F.lit(0.0)))
    g = g.where(F.col("q1_lo").isNotNull() & F.col("q2_lo").isNotNull() & F.col("q3_lo").isNotNull()
                & (F.col("p2") != 0) & (F.col("p3") != 0))
    rr = F.col("p1") / F.col("p3")
    log_se = F.sqrt(F.try_divide(F.lit(1.0), F.col("k1")) - F.try_divide(F.lit(1.0), F.col("n1"))
                    + F.try_divide(F.lit(1.0), F.col("k3")) - F.try_divide(F.lit(1.0), F.col("n3")))
    interval = F.when((F.col("k1") > 0) & (F.col("k3") > 0), Z_975 * log_se)
    return g.select(
        *keys,
        *[F.col(f"q{i}_{end}") for i in (1, 2, 3) for end in ("lo", "hi")],
        *[F.col(f"p{i}").alias(f"q{i}_prop") for i in (1, 2, 3)],
        *[F.col(f"n{i}").alias(f"q{i}_n") for i in (1, 2, 3)],
        rr.alias("rr_q1_vs_q3"), (F.col("p1") / F.col("p2")).alias("rr_q1_vs_q2"),
        F.exp(F.ln(F.when(rr > 0, rr)) - interval).alias("rr_ci_lo"),
        F.exp(F.ln(F.when(rr > 0, rr)) + interval).alias("rr_ci_hi"),
        (F.col("p1") - F.col("p3")).alias("arr_q1_vs_q3"))


def weighted_logit_slope(bins: DataFrame, keys: Sequence[str], prop: str = "prop",
                         total: str = "total", with_tests: bool = True) -> DataFrame:
    """Weighted regression of the logit share on the bin centre, per key.

    Shares are continuity-corrected and weighted by n p (1 - p); the variance
    is scaled by the weighted residuals over (bins - 2).  Fewer than three bins
    yield no row.
    """
    n = F.col(total).cast("double")
    p = (F.col(prop) * n + 0.5) / (n + 1.0)
    pts = bins.select(*keys, F.col("center").alias("x"), F.ln(p / (1.0 - p)).alias("y"),
                      (n * p * (1.0 - p)).alias("w"))
    group = Window.partitionBy(*keys)  # one row per bin
    sw = F.sum("w").over(group)
    pts = pts.withColumns({"xm": F.sum(F.col("w") * F.col("x")).over(group) / sw,
                           "ym": F.sum(F.col("w") * F.col("y")).over(group) / sw})
    dx, dy, w = F.col("x") - F.col("xm"), F.col("y") - F.col("ym"), F.col("w")
    g = pts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bins"), F.max("xm").alias("xm"), F.max("ym").alias("ym"),
        F.sum(w * dx * dx).alias("sxx"), F.sum(w * dx * dy).alias("sxy"), F.sum(w * dy * dy).alias("syy"),
    ).where(F.col("n_bins") >= 3)
    slope = F.try_divide(F.col("sxy"), F.col("sxx"))
    df = (F.col("n_bins") - 2).cast("double")
    residual = F.greatest(F.lit(0.0), F.col("syy") - slope * F.col("sxy"))
    out = g.select(*keys, "n_bins", slope.alias("slope"),
                   (F.col("ym") - slope * F.col("xm")).alias("intercept"),
                   F.sqrt(F.try_divide(F.try_divide(residual, df), F.col("sxx"))).alias("slope_se"),
                   F.exp(slope).alias("or_per_unit"), F.exp(50.0 * slope).alias("or_per_50"))
    if not with_tests:
        return out
    dof = (F.col("n_bins") - 2).cast("double")
    out = out.withColumns({"p_value": t_p_value(F.try_divide(F.col("slope"), F.col("slope_se")), dof),
                           "t_975": t_quantile_975(dof)})
    half = F.col("t_975") * F.col("slope_se")
    return out.withColumns({"slope_ci_lo": F.col("slope") - half,
                            "slope_ci_hi": F.col("slope") + half}).drop("t_975")


def fitted_logit_curve(fit: DataFrame, bins: DataFrame, keys: Sequence[str], n_grid: int = 300) -> DataFrame:
    """Fitted share on ``n_grid`` points between the outermost bin centres."""
    span = bins.groupBy(*keys).agg(F.min("center").alias("lo"), F.max("center").alias("hi"))
    pts = fit.join(span, list(keys)).select(
        *keys, "slope", "intercept", "lo", "hi",
        F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("point"))
    x = bin_edge(F.col("point"), F.col("lo"), F.col("hi"), n_grid - 1)
    return pts.select(*keys, "point", x.alias("x"),
                      (1.0 / (1.0 + F.exp(-(F.col("slope") * x + F.col("intercept"))))).alias("fitted"))


def kde_curves(cells: DataFrame, n_grid: int = 300, pad: float = 0.1, x: str = "awc_mm",
               cls: str = "cls", only_class: int | None = None) -> DataFrame:
    """Gaussian density of each class per (depth, date, dataset) on a shared grid.

    Scott's bandwidth with the sample deviation.  Groups with one value or
    variance up to 1e-6 are skipped.  Values are collapsed to counts, each
    distinct value adds its kernel to the ``n_grid`` points and the sums combine
    before the shuffle.  ``only_class`` limits both curves and grid range.
    """
    keys = ["depth", "date", "dataset", "cls"]
    cells = cells.withColumn("cls", F.col(cls))
    if only_class is not None:
        cells = cells.where(F.col("cls") == only_class)
    counts = value_counts(cells, keys, x)
    v, n = F.col("value"), F.col("n")
    span = counts.groupBy("depth").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    # Deviations are taken from the depth's mid-range to keep the sums well scaled.
    near = counts.join(span, "depth")
    d = v - (F.col("lo") + F.col("hi")) / 2.0
    moments = near.groupBy(*keys).agg(
        F.sum("n").alias("size"), F.sum(n * d).alias("s"), F.sum(n * d * d).alias("q"),
        F.max("lo").alias("lo"), F.max("hi").alias("hi"))
    squares = F.col("q") - F.col("s") * F.col("s") / F.col("size")
    sample_sd = F.sqrt(F.try_divide(squares, F.col("size") - 1))
    shape = (moments.where((F.col("size") > 1) & (squares / F.col("size") > 1e-6))
             .select(*keys, "size", "lo", "hi",
                     (sample_sd * F.pow(F.col("size").cast("double"), F.lit(-0.2))).alias("bw")))
    rows = counts.join(shape, keys).select(
        *keys, "value", "n", "size", "bw",
        (F.col("lo") - pad * (F.col("hi") - F.col("lo"))).alias("from"),
        (F.col("hi") + pad * (F.col("hi") - F.col("lo"))).alias("to"),
        F.explode(F.sequence(F.lit(0), F.lit(n_grid - 1))).alias("point"))
    at = bin_edge(F.col("point"), F.col("from"), F.col("to"), n_grid - 1)
    u = (at - v) / F.col("bw")
    weight = n / (F.col("size") * F.col("bw") * F.lit(2.5066282746310002))
    return (rows.select(*keys, "point", at.alias("x"), (weight * F.exp(-0.5 * u * u)).alias("k"))
            .groupBy(*keys, "point").agg(F.max("x").alias("x"), F.sum("k").alias("density")))


def mean_kde(curves: DataFrame) -> DataFrame:
    """Mean density across datasets with a band of one population deviation."""
    g = curves.groupBy("depth", "date", "cls", "point").agg(
        F.max("x").alias("x"), F.avg("density").alias("mean_density"),
        F.stddev_pop("density").alias("sd_density"), F.count(F.lit(1)).alias("n_ptf"))
    return g.withColumns({
        "lower": F.greatest(F.lit(0.0), F.col("mean_density") - F.col("sd_density")),
        "upper": F.col("mean_density") + F.col("sd_density")})


def pixel_totals_by_date(cells: DataFrame, depth: str | None = None) -> DataFrame:
    """Class sizes and percent discolored per date.

    Without ``depth`` a cell counts once per dataset and depth it appears in.
    """
    if depth is not None:
        cells = cells.where(F.col("depth") == depth)
    return cells.groupBy("date").agg(
        F.count_if(F.col("cls") == 0).alias("not_discolored"),
        F.count_if(F.col("cls") == 1).alias("discolored"),
        F.count(F.lit(1)).alias("total"),
        (100.0 * F.count_if(F.col("cls") == 1) / F.count(F.lit(1))).alias("pct_discolored"))


def pixel_totals_rollup(cells: DataFrame) -> DataFrame:
    """:func:`pixel_totals_by_date` for every depth and date, every depth, and all cells, in one pass.

    ``level`` tells them apart: 0 for a depth and date, 1 for a depth (date is NULL), 3 for all (both are NULL).
    """
    ones = F.count_if(F.col("cls") == 1)
    return cells.rollup("depth", "date").agg(
        F.grouping_id().cast("int").alias("level"), F.count_if(F.col("cls") == 0).alias("not_discolored"),
        ones.alias("discolored"), F.count(F.lit(1)).alias("total"), (100.0 * ones / F.count(F.lit(1))).alias("pct_discolored"))


def density_histogram(scored: DataFrame, keys: Sequence[str], p: str = "p", cls: str = "cls",
                      n_bins: int = 50) -> DataFrame:
    """Density per class on ``n_bins`` equal bins of [0, 1]; empty bins absent."""
    counts = value_counts(scored, [*keys, cls], p)
    index = equal_bin(F.col("value"), F.lit(0.0), F.lit(1.0), n_bins)
    bins = (counts.withColumn("bin", index).where(F.col("bin").isNotNull())
            .groupBy(*keys, cls, "bin").agg(F.sum("n").alias("n")))
    inside = F.sum("n").over(Window.partitionBy(*keys, cls))  # at most n_bins rows
    return bins.select(*keys, cls, "bin", "n", (F.col("n") * float(n_bins) / inside).alias("density"))
