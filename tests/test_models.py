"""Folds, batched fits, nested validation, scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.models import ranking, scoring, validation
from gridspark.models.folds import FoldPlan, block_sizes, deal, group_kfold
from gridspark.models.logistic import ALL_CELLS, Model, Scale, fit_logistic, fit_logistic_many, score_inner_folds
from gridspark.operators.grid import Grid
from gridspark.plans import dsi

GRID = Grid(0.0, 0.0, 25.0, 25.0, 40, 30)
CONFIG = dsi.DsiConfig(cv_block_size_m=250.0, outer_n_splits=3, inner_n_splits=2, n_iter=3, min_pixels=5)


@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(30):
        for j in range(40):
            awc, rain = float(rng.integers(20, 160)), float(rng.normal(300, 60))
            z = -0.03 * (awc - 90) - 0.008 * (rain - 300)
            rows.append((i, j, awc, rain, int(rng.uniform() < 1 / (1 + np.exp(-z))), (i // 10) * 4 + j // 10))
    return spark.createDataFrame(rows, "row int, col int, awc double, rain double, y int, block_id long").cache()


def prepared(cells, features):
    plan = FoldPlan.build(block_sizes(cells), 3, 2)
    rows = validation.prepare_rows(cells, features, plan).cache()
    return plan, rows, validation.training_scales(rows, features, plan.n_outer)


def numpy_fit(x, y, c, w=None):
    """Newton solution of half |w|^2 + C * summed loss, intercept first and free."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.ones(len(x)) if w is None else w
    b = np.zeros(x.shape[1])
    ridge = np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b - np.linalg.solve(ridge + c * (x * (w * p * (1 - p))[:, None]).T @ x, ridge @ b + c * x.T @ (w * (p - y)))
    return b


def greedy(sizes, k):
    """Blocks one by one, largest first, into the emptiest fold."""
    filled, out = [0] * k, {}
    for block, n in sorted(sizes.items(), key=lambda item: (-item[1], item[0])):
        out[block] = filled.index(min(filled))
        filled[out[block]] += n
    return out


def test_greedy_folds(spark):
    rng = np.random.default_rng(3)
    for sizes, n_outer, n_inner in [([10, 7, 6, 5, 5], 2, 2), (rng.integers(1, 40, 300).tolist(), 10, 5),
                                    ([900] * 50 + rng.integers(1, 900, 40).tolist() + [1] * 400, 7, 3)]:
        sizes = {int(b): n for b, n in zip(rng.permutation(5000), sizes)}
        blocks = spark.createDataFrame(list(sizes.items()), "block_id long, cells long")
        plan = FoldPlan.build(blocks, n_outer, n_inner)
        got = {r.block_id: r for r in plan.folds.collect()}
        outer = greedy(sizes, n_outer)
        assert {b: r.fold for b, r in got.items()} == outer
        for o in range(n_outer):
            inner = greedy({b: n for b, n in sizes.items() if outer[b] != o}, n_inner)
            assert {b: r[f"inner_{o}"] for b, r in got.items()} == {b: inner.get(b, -1) for b in sizes}
            assert plan.cells_in(o) == sum(n for b, n in sizes.items() if outer[b] == o)
            assert plan.blocks_in(o) == sum(f == o for f in outer.values())
    with pytest.raises(ValueError):
        deal({1: 1}, 2)


def test_many_blocks_stay_off_the_driver(spark):
    """More blocks than fit a table on the driver; their sizes are few."""
    blocks = spark.range(3_000_000).select(F.col("id").alias("block_id"), (F.col("id") % 7 + 1).alias("cells"))
    plan = FoldPlan.build(blocks, 10, 5)
    assert len(plan.sizes) == 7 and sum(plan.blocks_in(o) for o in range(10)) == 3_000_000
    filled = [plan.cells_in(o) for o in range(10)]
    assert max(filled) - min(filled) <= 1


def test_no_block_is_split(cells):
    out = group_kfold(cells, 3).groupBy("block_id").agg(F.count_distinct("fold").alias("k"))
    assert out.where("k <> 1").count() == 0
    plan = FoldPlan.build(block_sizes(cells), 3, 2)
    for o in range(3):
        assert plan.folds.where(f"(fold = {o}) <> (inner_{o} = -1)").count() == 0
    assert sum(plan.cells_in(o) for o in range(3)) == 1200


def test_scales_ignore_validation_cells(cells):
    features = ["awc", "rain"]
    plan, rows, scales = prepared(cells, features)
    changed = cells.withColumn("awc", F.when(F.col("block_id").isin([r.block_id for r in plan.folds.where("fold = 0").collect()]),
                                             F.col("awc") * 100).otherwise(F.col("awc")))
    again = validation.training_scales(validation.prepare_rows(changed, features, plan), features, 3)
    assert scales[0] == again[0] and scales[1] != again[1]
    awc = np.array([r.awc for r in rows.where("fold <> 0").collect()])
    lo, hi = np.quantile(awc, [0.001, 0.999])
    assert scales[0][0].center == pytest.approx(np.clip(awc, lo, hi).mean())
    assert scales[0][0].scale == pytest.approx(np.clip(awc, lo, hi).std())


def test_batched_fits_match_the_objective(cells):
    features = ["awc", "rain"]
    plan, rows, scales = prepared(cells, features)
    models = [Model(o, i, c) for o in range(3) for i in (0, 1) for c in (0.001, 1.0, 100.0)] + [Model(1, -1, 0.5)]
    fit_logistic_many(rows, models, features, scales)
    data = rows.toPandas()
    for m in models:
        used = data[data["fold"] != m.outer]
        if m.inner >= 0:
            used = used[used[f"inner_{m.outer}"] != m.inner]
        x = np.column_stack([s(used[f].to_numpy()) for f, s in zip(features, scales[m.outer])])
        assert m.weights == pytest.approx(numpy_fit(x, used["y"].to_numpy(), m.c), abs=1e-6)


def test_single_fit_agrees_with_batched_fit(cells):
    features = ["awc", "rain"]
    _, rows, scales = prepared(cells, features)
    model = validation.fit_final(rows, features, scales[ALL_CELLS], [0.1, 1.0, 10.0])
    assert model.c == 1.0
    scaler = scoring.scaler_table(cells.sparkSession, features, scales[ALL_CELLS])
    from gridspark.operators.scaling import apply_scaler

    scaled = apply_scaler(cells, scaler, features)
    intercept, coefficients = fit_logistic(scaled, ["awc_z", "rain_z"], 1.0)
    assert [intercept, *coefficients] == pytest.approx(list(model.weights), abs=1e-4)


def test_merged_rows_change_nothing(cells):
    plan = FoldPlan.build(block_sizes(cells), 3, 2)
    merged = validation.prepare_rows(cells, ["awc"], plan)
    assert merged.agg(F.sum("w")).first()[0] == 1200 and merged.count() < 1200
    single = merged.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("w").cast("int")))).drop("n").withColumn("w", F.lit(1).cast("bigint"))
    scale = {0: [Scale(0.0, 200.0, 90.0, 40.0)]}
    a, b = ([Model(0, -1, 1.0)] for _ in "ab")
    fit_logistic_many(merged, a, ["awc"], scale)
    fit_logistic_many(single, b, ["awc"], scale)
    assert a[0].weights == pytest.approx(b[0].weights, abs=1e-9)


def test_single_class_training_is_reported(cells):
    plan = FoldPlan.build(block_sizes(cells), 3, 2)
    rows = validation.prepare_rows(cells.withColumn("y", F.lit(1)), ["awc"], plan)
    model = Model(0, -1, 1.0)
    fit_logistic_many(rows, [model], ["awc"], {0: [Scale(0.0, 200.0, 90.0, 40.0)]})
    assert not model.fitted


def test_inner_areas_are_exact(cells):
    features = ["awc", "rain"]
    plan, rows, scales = prepared(cells, features)
    models = [Model(o, i, 1.0) for o in range(3) for i in range(2)]
    fit_logistic_many(rows, models, features, scales)
    areas = validation.inner_auc(rows, models, features, scales)
    data = rows.toPandas()
    for m, area in zip(models, areas):
        held = data[(data["fold"] != m.outer) & (data[f"inner_{m.outer}"] == m.inner)]
        x = np.column_stack([np.ones(len(held))] + [s(held[f].to_numpy()) for f, s in zip(features, scales[m.outer])])
        p, y = x @ m.weights, held["y"].to_numpy()
        wins = (p[y == 1][:, None] > p[y == 0][None, :]).sum() + 0.5 * (p[y == 1][:, None] == p[y == 0][None, :]).sum()
        assert area == pytest.approx(wins / ((y == 1).sum() * (y == 0).sum()), abs=1e-9)
    counts = score_inner_folds(rows, models, features, scales).groupBy("model").agg(F.sum(F.col("n0") + F.col("n1")).alias("n"))
    assert counts.agg(F.sum("n")).first()[0] == 2 * 1200


def test_nested_validation_scores_every_cell_once(cells):
    result = validation.nested_spatial_cv(cells, ["awc", "rain"], 3, 2, n_iter=3)
    rows = sorted(result.rows, key=lambda r: r["fold"])
    assert sum(r["n_val"] for r in rows) == 1200
    assert all(r["n_train"] + r["n_val"] == 1200 for r in rows)
    assert all(0.6 < r["val_roc_auc"] < 1.0 for r in rows)
    oof = result.out_of_fold(cells).toPandas()
    assert len(oof) == 1200 and oof["p"].between(0, 1).all()
    for r in rows:
        part = oof[oof["fold"] == r["fold"]]
        assert r["val_brier"] == pytest.approx(((part["p"] - part["y"]) ** 2).mean())
        said = part["p"] >= r["threshold"]
        assert r["val_recall"] == pytest.approx((said & (part["y"] == 1)).sum() / (part["y"] == 1).sum())
    with pytest.raises(ValueError):
        validation.nested_spatial_cv(cells, ["awc"], 3, 2, threshold_mode="best")


def test_run_summary_and_application(spark, cells):
    awc = cells.select("row", "col", F.col("awc").alias("value"))
    disco = cells.select("row", "col", F.when(F.col("y") == 1, 5000.0).otherwise(1000.0).alias("value"))
    rain = cells.select("row", "col", F.col("rain").alias("value"))
    result = dsi.run_dsi(awc, disco, {"rain": rain}, GRID, CONFIG)
    metrics = dict(dsi.metrics_rows(result))
    assert metrics["model"] == "logistic_regression" and float(metrics["cv_val_roc_auc_mean"]) > 0.6
    assert {"vif_awc", "pearson_r_awc_vs_rain", "final_model_odds_ratio_rain", "cv_coef_awc_min"} <= set(metrics)
    wide = dsi.summarize_run(result, {"ptf": "x", "depth": "1m"})
    plain = dsi.run_dsi(awc, disco, None, GRID, CONFIG)
    both = dsi.aggregate_summary([dsi.summarize_run(plain, {"ptf": "x", "depth": "2m"}), wide])
    assert both.count() == 2 and "final_model_coef_rain" in both.columns
    assert result.stability.count() == 3 * 3

    scenario = lambda shift: cells.select("row", "col", (F.col("awc") + shift).alias("awc"), "rain",
                                          F.when(F.col("y") == 1, 5000.0).otherwise(1000.0).alias("disco"))
    empty = scenario(0).where("row < 0")
    out = {r.label: r for r in scoring.apply_to_years({"a": scenario(0), "b": scenario(20), "gone": empty},
                                                      result.scaler, result.coefficients, ["awc", "rain"]).collect()}
    assert set(out) == {"a", "b"}
    assert out["a"].n_disco + out["a"].n_nondisco == 1200 and out["a"].auc > 0.6
    one = scoring.apply_to_year(scenario(0), "a", result.scaler, result.coefficients, ["awc", "rain"])
    p = one.toPandas().sort_values(["row", "col"])["p"].to_numpy()
    data = cells.toPandas().sort_values(["row", "col"])
    z = result.final["intercept"]
    for f, s in zip(["awc", "rain"], result.nested.scales[ALL_CELLS]):
        z = z + result.final["coef"][f] * s(data[f].to_numpy())
    assert p == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
    gap = spark.createDataFrame([(0, 0, None, 300.0)], "row int, col int, awc double, rain double")
    assert scoring.predict_proba(gap, result.scaler, result.coefficients, ["awc", "rain"]).first().p is None


def exact_choice(rows, plan, features, scales, n_iter):
    """Candidates by areas of all models."""
    candidates = validation.candidate_penalties(n_iter)
    models = [Model(o, i, c) for o in range(plan.n_outer) for c in candidates for i in range(plan.n_inner(o))]
    fit_logistic_many(rows, models, features, scales)
    area = dict(zip(map(id, models), validation.inner_auc(rows, models, features, scales)))
    mean = {(o, c): np.mean([area[id(m)] for m in models if (m.outer, m.c) == (o, c)]) for o in range(plan.n_outer) for c in candidates}
    return {o: candidates[int(np.argmax(np.round([mean[o, c] for c in candidates], 12)))] for o in range(plan.n_outer)}, models, area


@pytest.mark.parametrize("features,coarse,fine", [(["awc", "rain"], 256, 4096), (["awc", "rain"], 4, 16), (["awc"], 8, 32)])
def test_bounded_areas_choose_as_exact_ones(cells, monkeypatch, features, coarse, fine):
    monkeypatch.setattr(ranking, "COARSE", coarse)
    monkeypatch.setattr(ranking, "FINE", fine)
    monkeypatch.setattr(ranking, "HELD", 20 * fine)
    plan, rows, scales = prepared(cells, features)
    want, models, area = exact_choice(rows, plan, features, scales, 6)
    assert validation.random_search_c(rows, plan, features, scales, n_iter=6) == want
    counted = ranking.bounds(rows, models, features, scales, coarse)
    for m, c in zip(models, counted):
        low, high = c.area()
        assert low <= area[id(m)] <= high
    assert ranking.exact_areas(rows, models, features, scales, counted) == [area[id(m)] for m in models]


def test_bounds_move_few_rows(cells):
    """The histogram of a model is one row from each task, whatever the cells."""
    plan, rows, scales = prepared(cells, ["awc", "rain"])
    models = [Model(o, i, 1.0) for o in range(3) for i in range(2)]
    fit_logistic_many(rows, models, ["awc", "rain"], scales)
    counted = {r["model"]: ranking._merge([r["counts"]]) for r in ranking.histograms(rows, models, ["awc", "rain"], scales, 16).collect()}
    assert sum(int(n0.sum() + n1.sum()) for _, n0, n1 in counted.values()) == 2 * 1200
    inside = ranking.scores_within(rows, models, ["awc", "rain"], scales, 16, [np.array([3])] * 6)
    assert inside.agg(F.sum(F.col("n0") + F.col("n1"))).first()[0] == sum(int((n0 + n1)[at == 3].sum()) for at, n0, n1 in counted.values())


def test_bins_that_are_too_many_to_list(cells, monkeypatch):
    plan, rows, scales = prepared(cells, ["awc", "rain"])
    models = [Model(o, 0, 1.0) for o in range(3)]
    fit_logistic_many(rows, models, ["awc", "rain"], scales)
    counted = ranking.bounds(rows, models, ["awc", "rain"], scales, 16)
    every = [ranking.Bounds(c.pairs, c.wins, c.within, c.bins, None) for c in counted]
    assert ranking.exact_areas(rows, models, ["awc", "rain"], scales, every) == ranking.exact_areas(rows, models, ["awc", "rain"], scales, counted)


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_thresholds_equal_those_of_the_whole_curve(cells, bins):
    from gridspark.operators import calibration

    features = ["awc", "rain"]
    plan, rows, scales = prepared(cells, features)
    models = [Model(o, -1, 0.3) for o in range(3)]
    fit_logistic_many(rows, models, features, scales)
    got = ranking.best_f1_thresholds(rows, models, features, scales, bins)
    for m in models:
        scored = rows.where(F.col("fold") != m.outer).select("y", "w", validation._score(m, features, scales[m.outer]).alias("p"))
        want = calibration.best_f1_threshold(calibration.pr_curve(scored, [], weight="w"), []).first()["threshold"]
        assert got[m.outer] == pytest.approx(want, rel=1e-12)


def test_models_without_an_area(cells):
    plan, rows, scales = prepared(cells.withColumn("y", F.lit(1)), ["awc"])
    best = validation.random_search_c(rows, plan, ["awc"], scales, n_iter=2)
    assert best == dict.fromkeys(range(3), validation.candidate_penalties(2)[0])


def test_near_areas_equal_plain_ones(spark):
    """Areas of models that order cells alike, from segments and strips, against all pairs; a model of another order is left out."""
    import numpy as np
    import pandas as pd

    from gridspark.models import ranking
    from gridspark.models.logistic import Model, Scale, _probabilities

    draw = np.random.RandomState(3)
    n = 3000
    frame = pd.DataFrame({"a": np.round(draw.normal(size=n), 2), "b": np.round(draw.normal(size=n), 2), "y": draw.randint(0, 2, n),
                          "w": draw.randint(1, 4, n), "fold": np.where(draw.rand(n) < 0.2, 0, 1), "inner_0": draw.randint(0, 2, n)})
    rows = spark.createDataFrame(frame).repartition(3)
    scales = {0: [Scale(-2.0, 2.0, 0.1, 1.1), Scale(-1.5, 1.5, 0.0, 0.9)]}
    models = [Model(0, 0, c, np.array([0.1, 0.8, 0.5 + s])) for c, s in ((0.1, 0.0), (1.0, 1e-3), (10.0, 2e-3))]
    models += [Model(0, 1, c, np.array([0.1, w, 0.5])) for c, w in ((0.1, 0.8), (1.0, -0.8))]
    kept, ranking.WANTED_ROWS = ranking.WANTED_ROWS, 100
    try:
        got = ranking.near_areas(rows, models, ["a", "b"], scales)
    finally:
        ranking.WANTED_ROWS = kept
    assert sorted(got) == [0, 1, 2]
    held = frame[(frame.fold != 0) & (frame.inner_0 == 0)]
    x = np.column_stack([np.ones(len(held)), *[s(held[f].to_numpy()) for f, s in zip("ab", scales[0])]])
    n1 = held.w.to_numpy() * (held.y.to_numpy() == 1)
    n0 = held.w.to_numpy() - n1
    for i, area in got.items():
        w = models[i].weights
        p = _probabilities(w[0] + x[:, 1] * w[1] + x[:, 2] * w[2])[0]
        above = (p[:, None] > p[None, :]) + 0.5 * (p[:, None] == p[None, :])
        assert area == pytest.approx(float(n1 @ above @ n0) / (n0.sum() * n1.sum()), abs=1e-12)


def test_prepared_rows_are_spread_over_cores(spark):
    from gridspark.models.folds import FoldPlan, block_sizes
    from gridspark.models.validation import prepare_rows

    cells = spark.range(400).selectExpr("double(id % 7) a", "double(id % 5) b", "int(id % 2) y", "id % 40 block_id")
    rows = prepare_rows(cells, ["a", "b"], FoldPlan.build(block_sizes(cells), 4, 3)).persist()
    assert rows.count() == 400 and rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows.unpersist()
