"""Nested spatial cross-validation and the final fit.  These functions run jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scores import probability, standardize
from gridspark.models import ranking
from gridspark.models.folds import FoldPlan, block_sizes
from gridspark.models.logistic import ALL_CELLS, Model, Scale, fit_logistic_many, score_inner_folds
from gridspark.operators import calibration
from gridspark.operators.order_statistics import quantile_agg, running_counts
from gridspark.operators.scaling import long_features
from gridspark.session import cut_lineage


def prepare_rows(cells: DataFrame, features: Sequence[str], plan: FoldPlan, keep: Sequence[str] = ()) -> DataFrame:
    """Cells with folds; with one feature, cells alike in everything become one weighted row.

    A single feature is a map of whole millimetres with few distinct values, so
    merging shrinks the data by orders of magnitude before the fitting passes.
    """
    folds = ["fold", *[f"inner_{o}" for o in range(plan.n_outer)]]
    rows = plan.attach(cells).select(
        *keep, *[F.col(f).cast("double").alias(f) for f in features], F.col("y").cast("int").alias("y"), *folds)
    # Every pass evaluates up to a thousand models a row: few bytes, much work, so their number of tasks follows the cores.
    tasks = 4 * rows.sparkSession.sparkContext.defaultParallelism
    if len(features) == 1 and not keep:
        return rows.groupBy(*features, "y", *folds).agg(F.count(F.lit(1)).alias("w")).repartition(tasks)
    return rows.withColumn("w", F.lit(1).cast("bigint")).repartition(tasks)


def training_scales(rows: DataFrame, features: Sequence[str], n_outer: int,
                    q: tuple[float, float] = (0.001, 0.999)) -> dict[int, list[Scale]]:
    """Standardisation per outer fold from its training cells, and for all cells.

    Two aggregations serve every fold: exact clip limits from running counts
    that carry one count per fold, then clipped moments.
    """
    outers = [*range(n_outer), ALL_CELLS]
    name = {o: "t_all" if o == ALL_CELLS else f"t_{o}" for o in outers}
    measures = {name[o]: F.col("w") if o == ALL_CELLS else F.when(F.col("fold") != o, F.col("w")).otherwise(0)
                for o in outers}
    counts = running_counts(long_features(rows, features, ["fold", "w"]), ["feature"], "value", measures)
    limits = counts.groupBy("feature").agg(*[
        quantile_agg(p, name[o]).alias(f"{name[o]}_{side}") for o in outers for p, side in zip(q, ("lo", "hi"))])
    bounds = {r["feature"]: r for r in limits.collect()}  # one row per feature

    sums = []
    for f in features:
        for o in outers:
            lo, hi = bounds[f][f"{name[o]}_lo"], bounds[f][f"{name[o]}_hi"]
            v = F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(f))) - F.lit((lo + hi) / 2.0)
            w = measures[name[o]]
            sums += [F.sum(w).alias(f"{f}|{o}|n"), F.sum(w * v).alias(f"{f}|{o}|s"), F.sum(w * v * v).alias(f"{f}|{o}|q")]
    moments = rows.agg(*sums).first()
    out: dict[int, list[Scale]] = {o: [] for o in outers}
    for f in features:
        for o in outers:
            lo, hi = bounds[f][f"{name[o]}_lo"], bounds[f][f"{name[o]}_hi"]
            n, s, sq = (moments[f"{f}|{o}|{part}"] for part in "nsq")
            spread = float(np.sqrt(max(0.0, sq / n - (s / n) ** 2)))
            out[o].append(Scale(lo, hi, (lo + hi) / 2.0 + s / n, spread if spread > 0 else 1.0))
    return out


def candidate_penalties(n: int = 20, lo: float = 1e-3, hi: float = 1e2, seed: int = 42) -> list[float]:
    """Log-uniform random values of C."""
    u = np.random.RandomState(seed).uniform(size=n)
    return [float(v) for v in np.exp(np.log(lo) + u * (np.log(hi) - np.log(lo)))]


def inner_auc(rows: DataFrame, models: Sequence[Model], features: Sequence[str], scales,
              bins: int | None = None) -> list[float]:
    """ROC AUC of each model on its inner validation cells; NaN for one class."""
    scored = score_inner_folds(rows, models, features, scales, bins)
    measures = {"n0": F.col("n0"), "n1": F.col("n1")}
    counts = running_counts(scored, ["model"], "p", measures)
    areas = counts.groupBy("model").agg(calibration.auc_agg().alias("auc")).collect()  # one row per model
    out = [float("nan")] * len(models)
    for r in areas:
        if r["auc"] is not None:
            out[r["model"]] = r["auc"]
    return out


def random_search_c(rows: DataFrame, plan: FoldPlan, features: Sequence[str], scales, n_iter: int = 20,
                    seed: int = 42, auc_bins: int | None = None) -> dict[int, float]:
    """Best C per outer fold by mean inner AUC (first one among equals).

    All folds and candidates are fitted in the same passes.  Areas are compared through bounds and exact
    where bounds do not decide; ``auc_bins`` compares areas of scores on a grid instead.
    """
    candidates = candidate_penalties(n_iter, seed=seed)
    models = [Model(o, i, c) for o in range(plan.n_outer) for c in candidates for i in range(plan.n_inner(o))]
    fit_logistic_many(rows, models, features, scales)
    if auc_bins is None:
        return ranking.best_penalties(rows, models, candidates, features, scales)
    usable = [m for m in models if m.fitted]
    area = dict(zip(map(id, usable), inner_auc(rows, usable, features, scales, auc_bins)))
    best = {}
    for o in range(plan.n_outer):
        mean = [np.mean([area.get(id(m), np.nan) for m in models if m.outer == o and m.c == c]) for c in candidates]
        best[o] = candidates[0] if np.isnan(mean).all() else candidates[int(np.nanargmax(np.round(mean, 12)))]
    return best


def _score(model: Model, features: Sequence[str], scales: Sequence[Scale]) -> Column:
    z = [standardize(F.col(f), F.lit(s.lower), F.lit(s.upper), F.lit(s.center), F.lit(s.scale))
         for f, s in zip(features, scales)]
    return probability(z, [float(w) for w in model.weights[1:]], float(model.weights[0]))


def _own_fold(models: Sequence[Model], features: Sequence[str], scales: dict[int, list[Scale]]) -> Column:
    """Score of a cell by the model of its own outer fold."""
    p = None
    for m in models:
        hit, score = F.col("fold") == m.outer, _score(m, features, scales[m.outer])
        p = F.when(hit, score) if p is None else p.when(hit, score)
    return p


def _by_fold(df: DataFrame, key: str = "outer") -> dict[int, dict]:
    return {r[key]: r.asDict() for r in df.collect()}  # one row per fold


@dataclass
class NestedResult:
    """Fold metrics (one row per outer fold), fitted fold models and scales."""

    folds: DataFrame
    rows: list[dict]
    models: list[Model]
    scales: dict[int, list[Scale]]
    plan: FoldPlan
    features: list[str]

    def out_of_fold(self, cells: DataFrame) -> DataFrame:
        """``fold`` and ``p`` of every cell from the model that did not see its block."""
        doubles = {f: F.col(f).cast("double") for f in self.features}
        scored = self.plan.attach(cells).withColumns(doubles).withColumn("p", _own_fold(self.models, self.features, self.scales))
        return scored.select(*cells.columns, "fold", "p")


def nested_spatial_cv(cells: DataFrame, features: Sequence[str], n_outer: int = 10, n_inner: int = 5,
                      n_iter: int = 20, threshold_mode: str = "per_fold_f1", seed: int = 42,
                      auc_bins: int | None = None, plan: FoldPlan | None = None,
                      rows: DataFrame | None = None) -> NestedResult:
    """Outer folds score every cell once; C is tuned by inner folds of the training part.

    ``cells``: features, y, block_id.  About a dozen jobs over the prepared
    rows replace one job per fit.
    """
    if threshold_mode not in ("per_fold_f1", "fixed"):
        raise ValueError(f"unknown threshold mode {threshold_mode!r}")
    features = list(features)
    if plan is None:
        cells = cut_lineage(cells.select(*features, "y", "block_id"))  # read for the folds and for the rows
        plan = FoldPlan.build(block_sizes(cells), n_outer, n_inner)
    own_rows = rows is None
    if own_rows:
        rows = cut_lineage(prepare_rows(cells, features, plan)).persist()
    scales = training_scales(rows, features, plan.n_outer)
    best_c = random_search_c(rows, plan, features, scales, n_iter, seed, auc_bins)
    models = [Model(o, -1, best_c[o]) for o in range(plan.n_outer)]
    fit_logistic_many(rows, models, features, scales)
    if not all(m.fitted for m in models):
        raise ValueError("a training part holds a single class")

    held = rows.select("fold", "y", "w", _own_fold(models, features, scales).alias("p"))
    if threshold_mode == "per_fold_f1":
        cut = ranking.best_f1_thresholds(rows, models, features, scales)
    else:
        cut = {m.outer: 0.5 for m in models}
    threshold = F.create_map(*[x for o, t in cut.items() for x in (F.lit(o), F.lit(float(t)))])[F.col("fold")]
    ranked = _by_fold(calibration.ranking_scores(held, ["fold"], weight="w"), "fold")
    error = _by_fold(calibration.brier(held, ["fold"], weight="w"), "fold")
    hard = _by_fold(calibration.f1_precision_recall(held, ["fold"], threshold, weight="w"), "fold")

    total = plan.n_cells()
    table = []
    for m in models:
        o, e = m.outer, error[m.outer]
        prevalence, ap = e["prevalence"], ranked[o]["average_precision"]
        row = {
            "fold": o, "n_train": total - plan.cells_in(o), "n_val": plan.cells_in(o), "n_val_blocks": plan.blocks_in(o),
            "tuned_C": m.c, "threshold": cut[o], "val_prevalence": prevalence, "intercept": float(m.weights[0]),
            "val_roc_auc": ranked[o]["roc_auc"], "val_pr_auc": ap,
            "val_pr_auc_skill_ratio": ap / prevalence if ap is not None and 0 < prevalence < 1 else None,
            "val_brier": e["brier"], "val_brier_skill_score": e["brier_skill_score"],
            "val_f1": hard[o]["f1"], "val_precision": hard[o]["precision"], "val_recall": hard[o]["recall"],
        }
        for f, w in zip(features, m.weights[1:]):
            row[f"coef_{f}"], row[f"odds_ratio_{f}"] = float(w), float(np.exp(w))
        table.append(row)
    counts = {"fold": "int", "n_train": "bigint", "n_val": "bigint", "n_val_blocks": "int"}
    schema = ", ".join(f"`{k}` {counts.get(k, 'double')}" for k in table[0])
    folds = cells.sparkSession.createDataFrame([tuple(r.values()) for r in table], schema)
    if own_rows:
        rows.unpersist()
    return NestedResult(folds, table, models, scales, plan, features)


def fit_final(rows: DataFrame, features: Sequence[str], scales: Sequence[Scale], tuned_c: Sequence[float]) -> Model:
    """Refit on all cells with the median tuned C (prepared rows)."""
    model = Model(ALL_CELLS, -1, float(np.median(tuned_c)))
    fit_logistic_many(rows, [model], features, {ALL_CELLS: list(scales)})
    return model
