"""Quality of predicted probabilities, per key (fold, run, scenario).

Scores are rows (keys..., p, y), optionally with a count column ``weight`` for
rows that stand for several cells.  Curves and areas come from running counts
of distinct scores; bin tables have at most ``n_bins`` rows per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions.bins import equal_bin
from gridspark.functions.scores import brier_skill_score, pr_auc_skill_ratio
from gridspark.operators.lookup import per_key
from gridspark.operators.order_statistics import class_measures, quantile_agg, running_counts



def score_counts(scored: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y",
                 weight: str | None = None) -> DataFrame:
    return running_counts(scored, keys, p, class_measures(y, weight))


def _at_or_above(m: str) -> Column:
    return F.col(f"{m}_total") - F.col(f"{m}_before")


def roc_curve(scored: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """One point per distinct score: rates of both classes at or above it.

    Keys with a single class give no points.
    """
    rows = score_counts(scored, keys, p, y).where((F.col("n0_total") > 0) & (F.col("n1_total") > 0))
    return rows.select(*keys, F.col("value").alias("threshold"),
                       (_at_or_above("n0") / F.col("n0_total")).alias("fpr"),
                       (_at_or_above("n1") / F.col("n1_total")).alias("tpr"))


def pr_curve(scored: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y",
             weight: str | None = None) -> DataFrame:
    """Precision, recall and F1 at every distinct score taken as threshold."""
    rows = score_counts(scored, keys, p, y, weight)
    tp, fp, positives = _at_or_above("n1"), _at_or_above("n0"), F.col("n1_total")
    f1 = F.coalesce(F.try_divide(2.0 * tp, tp + fp + positives), F.lit(0.0))
    return rows.select(*keys, F.col("value").alias("threshold"),
                       F.try_divide(tp, tp + fp).alias("precision"),
                       F.coalesce(F.try_divide(tp, positives), F.lit(0.0)).alias("recall"), f1.alias("f1"))


def best_f1_threshold(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Threshold with the highest F1, the lowest one among equals."""
    best = F.max(F.struct(F.col("f1"), (-F.col("threshold")).alias("neg"))).alias("b")
    return curve.groupBy(*keys).agg(best).select(*keys, (-F.col("b.neg")).alias("threshold"),
                                                 F.col("b.f1").alias("f1"))


def auc_agg() -> Column:
    """ROC AUC over running counts; NULL for a single class."""
    pairs = F.max("n0_total").cast("double") * F.max("n1_total")
    wins = F.sum(F.col("n1") * (F.col("n0_before") + F.col("n0") / 2.0))
    return F.when(pairs > 0, wins / F.when(pairs > 0, pairs))


def _average_precision() -> Column:
    tp, fp = _at_or_above("n1"), _at_or_above("n0")
    step = F.try_divide(F.col("n1"), F.col("n1_total"))
    both = (F.max("n0_total") > 0) & (F.max("n1_total") > 0)
    return F.when(both, F.sum(step * F.try_divide(tp, tp + fp)))


def roc_auc(scored: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve; NULL when only one class is present."""
    return score_counts(scored, keys, p, y).groupBy(*keys).agg(auc_agg().alias("roc_auc"))


def average_precision(scored: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y") -> DataFrame:
    """Step-wise average precision (not trapezoidal); NULL for a single class."""
    return score_counts(scored, keys, p, y).groupBy(*keys).agg(_average_precision().alias("average_precision"))


def ranking_scores(scored: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y",
                   weight: str | None = None) -> DataFrame:
    """ROC AUC and average precision from one pass."""
    return score_counts(scored, keys, p, y, weight).groupBy(*keys).agg(
        auc_agg().alias("roc_auc"), _average_precision().alias("average_precision"))


def brier(scored: DataFrame, keys: Sequence[str], p: str = "p", y: str = "y",
          weight: str | None = None) -> DataFrame:
    """Mean squared error of the probability, prevalence and skill score."""
    error = F.col(p) - F.col(y)
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    n = F.sum(w)
    g = scored.groupBy(*keys).agg((F.sum(w * error * error) / n).alias("brier"),
                                  (F.sum(w * F.col(y)) / n).alias("prevalence"), n.alias("n"))
    return g.withColumn("brier_skill_score", brier_skill_score(F.col("brier"), F.col("prevalence")))


def f1_precision_recall(scored: DataFrame, keys: Sequence[str], threshold: float | Column = 0.5,
                        p: str = "p", y: str = "y", weight: str | None = None) -> DataFrame:
    """Scores of the hard decision p >= threshold; undefined ratios are 0."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    said, is_one = F.col(p) >= threshold, F.col(y) == 1
    w = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    total = lambda hit: F.sum(F.when(hit, w).otherwise(0))
    g = scored.groupBy(*keys).agg(total(said & is_one).alias("tp"), total(said & ~is_one).alias("fp"),
                                  total(~said & is_one).alias("fn"))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return g.select(*keys, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"),
                    ratio(tp, tp + fn).alias("recall"), ratio(2.0 * tp, 2 * tp + fp + fn).alias("f1"))


def with_skill(metrics: DataFrame) -> DataFrame:
    """Average precision as a multiple of the prevalence."""
    return metrics.withColumn("pr_auc_skill_ratio",
                              pr_auc_skill_ratio(F.col("average_precision"), F.col("prevalence")))


def uniform_edges(n_bins: int) -> list[float]:
    return [i / n_bins for i in range(n_bins)] + [1.0]


def quantile_edges(scored: DataFrame, keys: Sequence[str], n_bins: int, p: str = "p") -> DataFrame:
    """Distinct quantile limits per key with ends 0 and 1.

    Fewer than three distinct limits fall back to uniform ones.
    """
    rows = running_counts(scored, keys, p)
    raw = rows.groupBy(*keys).agg(F.array(*[quantile_agg(i / n_bins) for i in range(n_bins + 1)]).alias("e"))
    distinct = F.array_sort(F.array_distinct("e"))
    size = F.size(distinct)
    forced = F.concat(F.array(F.lit(0.0)), F.slice(distinct, 2, size - 2), F.array(F.lit(1.0)))
    uniform = F.array(*[F.lit(e) for e in uniform_edges(n_bins)])
    return raw.select(*keys, F.when(size >= 3, forced).otherwise(uniform).alias("edges"))


def _bin_rows(binned: DataFrame, keys: Sequence[str], min_pixels: int, p: str, y: str) -> DataFrame:
    g = binned.groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("__p"),
                                         F.avg(F.col(y).cast("double")).alias("__y"))
    enough = F.col("n") >= min_pixels
    return g.select(*keys, "bin", "n", F.when(enough, F.col("__p")).alias("mean_p"),
                    F.when(enough, F.col("__y")).alias("prop"))


def calibration_bins(scored: DataFrame, keys: Sequence[str], n_bins: int = 12, min_pixels: int = 50,
                     strategy: str = "uniform", p: str = "p", y: str = "y",
                     edge_keys: Sequence[str] | None = None) -> DataFrame:
    """Mean probability and observed share per probability bin.

    Bins are left-closed and the outer ones take everything beyond them; bins
    below ``min_pixels`` keep their count but no means.  ``edge_keys`` says
    over which groups quantile limits are taken (default: the same keys).
    """
    if strategy == "uniform":
        index = equal_bin(F.col(p), F.lit(0.0), F.lit(1.0), n_bins, extend=True)
        return _bin_rows(scored.withColumn("bin", index), keys, min_pixels, p, y)
    if strategy != "quantile":
        raise ValueError(f"unknown bin strategy {strategy!r}")
    edge_keys = list(keys if edge_keys is None else edge_keys)
    edges = quantile_edges(scored, edge_keys, n_bins, p)
    inner = lambda e: F.slice(e, 2, F.size(e) - 2)
    if edge_keys:
        placed = scored.withColumn("edges", per_key(edges, edge_keys, "edges")).where(F.col("edges").isNotNull())
        limits = F.col("edges")
    else:
        placed, limits = scored, edges.scalar()
    index = F.size(F.filter(inner(limits), lambda e: e <= F.col(p)))
    return _bin_rows(placed.withColumn("bin", index), keys, min_pixels, p, y)


def calibration_r2(bins: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count-weighted R squared of the observed share against the mean probability."""
    valid = bins.where(F.col("prop").isNotNull())
    group = Window.partitionBy(*keys)  # at most one row per bin
    mean = F.sum(F.col("n") * F.col("prop")).over(group) / F.sum("n").over(group)
    rows = valid.withColumn("__mean", mean)
    res, dev = F.col("prop") - F.col("mean_p"), F.col("prop") - F.col("__mean")
    g = rows.groupBy(*keys).agg(F.sum(F.col("n") * res * res).alias("r"), F.sum(F.col("n") * dev * dev).alias("t"))
    return g.select(*keys, (1.0 - F.try_divide(F.col("r"), F.when(F.col("t") > 0, F.col("t")))).alias("calibration_r2"))


def fold_calibration(scored: DataFrame, fold: str = "fold", n_bins: int = 12, min_pixels: int = 30,
                     strategy: str = "uniform", p: str = "p", y: str = "y") -> DataFrame:
    """Observed share per fold and bin with pooled bin limits.

    Only bins that hold enough cells in at least two folds are kept.
    """
    bins = calibration_bins(scored, [fold], n_bins, min_pixels, strategy, p, y, edge_keys=[])
    bins = bins.where(F.col("prop").isNotNull())
    folds = F.count(F.lit(1)).over(Window.partitionBy("bin"))  # one row per fold
    return bins.withColumn("n_folds", folds).where(F.col("n_folds") >= 2)


def summarize_folds(folds: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Mean, population deviation, min, max and CV percent of each metric over folds."""
    doubles = folds.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    long = doubles.unpivot(list(keys), list(metrics), "metric", "v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    g = long.groupBy(*keys, "metric").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"),
                                          F.min("v").alias("min"), F.max("v").alias("max"))
    return g.withColumn("cv_pct", F.try_divide(100.0 * F.col("std"), F.abs("mean")))


def coefficient_stability(folds: DataFrame, coefficients: Sequence[str], fold: str = "fold") -> DataFrame:
    """Fold values of each coefficient beside their mean and population deviation."""
    long = folds.select(fold, *[F.col(c).cast("double").alias(c) for c in coefficients]).unpivot(
        [fold], list(coefficients), "coefficient", "value")
    group = Window.partitionBy("coefficient")  # one row per fold
    return long.withColumns({"mean": F.avg("value").over(group), "std": F.stddev_pop("value").over(group)})
