"""Order statistics and class statistics against brute force."""

import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.functions import tails
from gridspark.operators import binned, calibration, class_stats, order_statistics, scaling


def labelled(spark, x0, x1, key="a"):
    rows = [(key, float(v), 0) for v in x0] + [(key, float(v), 1) for v in x1]
    return spark.createDataFrame(rows, "key string, x double, cls int")


def u_brute(a, b):
    return sum((x > y) + 0.5 * (x == y) for x, y in product(a, b))


@pytest.fixture(scope="module")
def samples():
    rng = np.random.default_rng(3)
    return rng.integers(0, 40, 300).astype(float), rng.integers(5, 50, 200).astype(float)


@pytest.mark.parametrize("scale", [1.0, 2e-4, 1e300, 1e-300, -3.0])
def test_running_counts_at_any_scale(spark, samples, scale):
    x0 = samples[0] * scale
    df = labelled(spark, x0, [])
    rows = order_statistics.running_counts(df, ["key"], "x").orderBy("value").collect()
    values, counts = np.unique(x0, return_counts=True)
    assert [r.value for r in rows] == list(values)
    assert [r.n_before for r in rows] == list(np.cumsum(counts) - counts)
    assert {r.n_total for r in rows} == {len(x0)}
    assert {(r.v_min, r.v_max) for r in rows} == {(x0.min(), x0.max())}


def test_running_counts_without_keys_and_with_negative_values(spark):
    df = spark.createDataFrame([(-5.5,), (-0.1,), (0.0,), (3.0,), (3.0,)], "x double")
    rows = order_statistics.running_counts(df, [], "x").orderBy("value").collect()
    assert [(r.value, r.n_before) for r in rows] == [(-5.5, 0), (-0.1, 1), (0.0, 2), (3.0, 3)]


@pytest.mark.parametrize("low, high", [(0.0, 2e-4), (0.3, 0.3002), (0.0, 1.0), (-500.0, 1500.0)])
def test_bins_split_concentrated_values(spark, low, high):
    values = np.sort(np.random.default_rng(5).uniform(low, high, 50_000))
    df = spark.createDataFrame([(float(v),) for v in values], "value double")
    bins = [r.b for r in df.orderBy("value").select(order_statistics._bin_of(F.col("value")).alias("b")).collect()]
    assert bins == sorted(bins)
    _, counts = np.unique(bins, return_counts=True)
    assert counts.max() <= max(20, 4 * counts.mean())


def test_bins_of_extreme_values_keep_their_order(spark):
    values = [float("-inf"), -1e308, -1.0, -1e-320, 0.0, 5e-324, 1e-310, 0.5, 1.0, 8.0, 1e308, float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r.b for r in df.orderBy("v").select(order_statistics._bin_of(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins) and len(set(bins)) >= 8


@pytest.mark.parametrize("p", [0.0, 0.001, 0.25, 0.5, 0.75, 0.999, 1.0])
def test_quantiles_match_numpy(spark, samples, p, close):
    df = labelled(spark, samples[0], [])
    close(order_statistics.quantiles(df, ["key"], "x", {"q": p}).first().q, float(np.quantile(samples[0], p)))


def test_result_is_independent_of_partitioning(spark, samples):
    df = labelled(spark, *samples)
    a = class_stats.two_class_stats(df.repartition(1), ["key"], "x").first()
    b = class_stats.two_class_stats(df.repartition(7), ["key"], "x").first()
    assert a == b


def test_two_class_stats_against_numpy(spark, samples, close):
    x0, x1 = samples
    r = class_stats.two_class_stats(labelled(spark, x0, x1), ["key"], "x").first()
    n0, n1 = len(x0), len(x1)
    u = u_brute(x0, x1)
    pooled = math.sqrt(((n0 - 1) * x0.var(ddof=1) + (n1 - 1) * x1.var(ddof=1)) / (n0 + n1 - 2))
    close(r.u_stat, u)
    for got, want in [(r.median0, np.median(x0)), (r.mean1, x1.mean()), (r.iqr1, np.quantile(x1, .75) - np.quantile(x1, .25)),
                      (r.r_rb, 1 - 2 * u / (n0 * n1)), (r.cles, u / (n0 * n1)), (r.cohens_d, (x1.mean() - x0.mean()) / pooled)]:
        close(got, round(float(want), 4))
    both = np.concatenate([x0, x1])
    edges = np.linspace(both.min(), both.max(), 200)
    h0, h1 = (np.histogram(x, bins=edges, density=True)[0] for x in (x0, x1))
    close(r.overlap_coeff, round(float(np.minimum(h0, h1).sum() * (edges[1] - edges[0])), 4))


def test_rank_sum_p_value_and_swap(spark, samples, close):
    x0, x1 = samples
    df = labelled(spark, x0, x1)
    first = class_stats.mann_whitney(df, ["key"], "x", "cls").first()
    second = class_stats.mann_whitney(df, ["key"], "x", "cls", first=1).first()
    close(first.u + second.u, len(x0) * len(x1))
    close(first.p_value, second.p_value)
    n0, n1 = len(x0), len(x1)
    _, t = np.unique(np.concatenate([x0, x1]), return_counts=True)
    n = n0 + n1
    sd = math.sqrt(n0 * n1 / 12 * ((n + 1) - (t.astype(float) ** 3 - t).sum() / (n * (n - 1))))
    z = (max(first.u, second.u) - n0 * n1 / 2 - 0.5) / sd
    close(first.p_value, math.erfc(z / math.sqrt(2)))
    greater = class_stats.mann_whitney(df, ["key"], "x", "cls", first=1, alternative="greater").first()
    close(greater.p_value, 0.5 * math.erfc((second.u - n0 * n1 / 2 - 0.5) / sd / math.sqrt(2)))


def test_t_tail_known_values(close):
    close(tails.t_two_sided(2.0, 10), 0.07338803477074039, 1e-10)
    close(tails.t_critical(0.95, 10), 2.2281388519649385, 1e-9)
    close(tails.t_critical(0.95, 1), 12.706204736432095, 1e-9)


def test_separability_defaults_for_tiny_classes(spark):
    df = spark.createDataFrame([("y", 0.2, 0), ("y", 0.4, 1), ("y", 0.3, 0)], "label string, p double, cls int")
    r = class_stats.separability(df).first()
    assert (r.auc, r.mw_p, r.mw_u, r.cohens_d, r.n_disco, r.n_nondisco) == (0.0, 1.0, 0.0, 0.0, 1, 2)


def test_box_whiskers(spark, close):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 50.0]
    r = class_stats.box_stats(labelled(spark, values, []), ["key"], "x").first()
    q1, q3 = np.quantile(values, [0.25, 0.75])
    close(r.q1, q1)
    close(r.q3, q3)
    assert (r.whisker_lo, r.whisker_hi, r.n_outliers) == (1.0, 7.0, 1)
    box = class_stats.box_stats(labelled(spark, values, []), ["key"], "x")
    assert [x.value for x in class_stats.box_outliers(labelled(spark, values, []), ["key"], "x", box).collect()] == [50.0]


def test_sample_cap_size_and_stability(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.col("id"))
    pick = lambda parts: {tuple(r) for r in order_statistics.sample_cap(df.repartition(parts), ["g"], 100, ["id"]).collect()}
    a = pick(2)
    assert a == pick(5)
    assert all(sum(g == k for g, _ in a) == 100 for k in range(3))
    assert order_statistics.sample_cap(df, ["g"], 10**6, ["id"]).count() == 5000


def scored(spark):
    rng = np.random.default_rng(5)
    p = np.round(rng.uniform(size=400), 2)
    y = (rng.uniform(size=400) < p).astype(int)
    return p, y, spark.createDataFrame([("k", float(a), int(b)) for a, b in zip(p, y)], "key string, p double, y int")


def test_ranking_scores_against_brute_force(spark, close):
    p, y, df = scored(spark)
    r = calibration.ranking_scores(df, ["key"]).first()
    close(r.roc_auc, u_brute(p[y == 1], p[y == 0]) / ((y == 1).sum() * (y == 0).sum()))
    ap, recall = 0.0, 0.0
    for t in sorted(set(p), reverse=True):
        said = p >= t
        now = (said & (y == 1)).sum() / (y == 1).sum()
        ap += (now - recall) * (said & (y == 1)).sum() / said.sum()
        recall = now
    close(r.average_precision, ap)
    best = calibration.best_f1_threshold(calibration.pr_curve(df, ["key"]), ["key"]).first()
    f1 = {t: 2 * ((p >= t) & (y == 1)).sum() / ((p >= t).sum() + (y == 1).sum()) for t in set(p)}
    top = max(f1.values())
    close(best.threshold, min(t for t, v in f1.items() if v == top))


def test_weighted_scores_equal_repeated_rows(spark, close):
    _, _, df = scored(spark)
    merged = df.groupBy("key", "p", "y").agg(F.count(F.lit(1)).alias("w"))
    for function in (calibration.ranking_scores, calibration.brier, calibration.f1_precision_recall):
        for a, b in zip(function(df, ["key"]).first()[1:], function(merged, ["key"], weight="w").first()[1:]):
            close(a, b)


def test_single_class_scores_are_null(spark):
    df = spark.createDataFrame([("k", 0.3, 1), ("k", 0.6, 1)], "key string, p double, y int")
    r = calibration.ranking_scores(df, ["key"]).first()
    assert r.roc_auc is None and r.average_precision is None
    assert calibration.brier(df, ["key"]).first().brier_skill_score is None


def test_calibration_bin_limits(spark):
    df = spark.createDataFrame([("k", 0.0, 0), ("k", 0.25, 0), ("k", 0.5, 1), ("k", 1.0, 1)], "key string, p double, y int")
    bins = {r.bin: r.n for r in calibration.calibration_bins(df, ["key"], 4, 1).collect()}
    assert bins == {0: 1, 1: 1, 2: 1, 3: 1}
    flat = spark.createDataFrame([("k", 0.4, 0)] * 5, "key string, p double, y int")
    edges = calibration.quantile_edges(flat, ["key"], 4).first().edges
    assert edges == calibration.uniform_edges(4)


def test_scaler_constant_feature_and_quantiles(spark, close, samples):
    df = spark.createDataFrame([(float(a), 3.0) for a in samples[0]], "a double, b double")
    rows = {r.feature: r for r in scaling.fit_scaler(df, ["a", "b"]).collect()}
    lo, hi = np.quantile(samples[0], [0.001, 0.999])
    clipped = np.clip(samples[0], lo, hi)
    close(rows["a"].center, clipped.mean())
    close(rows["a"].scale, clipped.std())
    assert rows["b"].scale == 1.0 and rows["b"].center == 3.0
    plain = {r.feature: r for r in scaling.fit_scaler(df, ["a"], q=None).collect()}["a"]
    close(plain.scale, samples[0].std())


def test_vif_matches_regression(spark, close):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=200), rng.normal(size=200)
    c = a + 0.5 * b + rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c)], "a double, b double, c double")
    got = {r.feature: r.vif for r in scaling.vif(df, ["a", "b", "c"]).collect()}
    design = np.column_stack([np.ones(200), a, b])
    residual = c - design @ np.linalg.lstsq(design, c, rcond=None)[0]
    close(got["c"], 1 / (residual.var() / c.var()), 1e-8)
    assert scaling.vif(df, ["a"]).count() == 0


def test_quartile_risk_guards(spark):
    schema = "key string, center double, prop double, total long"
    three = spark.createDataFrame([("k", float(i), 0.5, 100) for i in range(3)], schema)
    assert binned.quartile_risk(three, ["key"]).count() == 0
    zero_high = spark.createDataFrame([("k", float(i), 0.0 if i > 5 else 0.5, 100) for i in range(8)], schema)
    assert binned.quartile_risk(zero_high, ["key"]).count() == 0


def test_logit_slope_against_polyfit(spark, close):
    x, prop, n = np.arange(6) * 10.0, np.array([0.6, 0.5, 0.55, 0.3, 0.2, 0.25]), np.array([100, 80, 120, 90, 60, 200])
    df = spark.createDataFrame([("k", float(a), float(b), int(c)) for a, b, c in zip(x, prop, n)], "key string, center double, prop double, total long")
    r = binned.weighted_logit_slope(df, ["key"]).first()
    p = (prop * n + 0.5) / (n + 1)
    coef, cov = np.polyfit(x, np.log(p / (1 - p)), 1, w=np.sqrt(n * p * (1 - p)), cov=True)
    close(r.slope, coef[0], 1e-8)
    close(r.slope_se, math.sqrt(cov[0, 0]), 1e-8)
    close(r.p_value, tails.t_two_sided(r.slope / r.slope_se, 4))
    assert r.slope_ci_lo < r.slope < r.slope_ci_hi


def test_mean_proportion_needs_two_datasets(spark):
    rows = [("a", "1m", 1, float(v % 10), v % 2) for v in range(200)] + [("b", "1m", 1, 9.0, 1)] * 30
    cells = spark.createDataFrame(rows, "dataset string, depth string, date int, awc_mm double, cls int")
    out = binned.mean_proportion_over_ptfs(cells, n_bins=5, min_pixels=10).collect()
    assert [r.bin for r in out] == [4]
    assert out[0].pooled_total == 40 + 30


def test_density_histogram_integrates_to_one(spark, close):
    _, _, df = scored(spark)
    for r in binned.density_histogram(df, ["key"], cls="y").groupBy("y").agg((F.sum("density") / 50).alias("area")).collect():
        close(r.area, 1.0)
