"""L2-penalised logistic regression, one model or a thousand at once.

Objective: half the squared coefficient norm plus C times the summed loss; the
intercept is not penalised.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ALL_CELLS = -1
# Rows of a batch that are evaluated together for all models of an outer fold.
BLOCK = 256


@dataclass(frozen=True)
class Scale:
    """Stored standardisation of one feature."""

    lower: float
    upper: float
    center: float
    scale: float

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (np.clip(x, self.lower, self.upper) - self.center) / self.scale


@dataclass
class Model:
    """One fit: training cells are those outside ``outer`` and, within it, outside ``inner``."""

    outer: int
    inner: int
    c: float
    weights: np.ndarray = field(default=None)  # intercept first
    converged: bool = False  # the gradient fell below the tolerance within the passes allowed

    @property
    def fitted(self) -> bool:
        return self.weights is not None and not np.isnan(self.weights).any()


def fit_logistic(cells: DataFrame, features: Sequence[str], c: float, y: str = "y",
                 max_iter: int = 200) -> tuple[float, list[float]]:
    """Intercept and coefficients of a single model by Spark ML on scaled features.

    Warns when ``max_iter`` steps were not enough.
    """
    assembled = VectorAssembler(inputCols=list(features), outputCol="__x").transform(
        cells.select(*features, F.col(y).cast("double").alias("__y")))
    n = cells.count()
    fit = LogisticRegression(featuresCol="__x", labelCol="__y", regParam=1.0 / (c * n), elasticNetParam=0.0,
                             standardization=False, maxIter=max_iter, tol=1e-12).fit(assembled)
    if fit.summary.totalIterations >= max_iter:
        warnings.warn(f"logistic fit stopped after {max_iter} iterations", RuntimeWarning, stacklevel=2)
    return float(fit.intercept), [float(v) for v in fit.coefficients]


def _groups(models: Sequence[Model]) -> dict[int, list[int]]:
    """Model numbers per outer fold; these share scaling and most of their cells."""
    out: dict[int, list[int]] = {}
    for i, m in enumerate(models):
        out.setdefault(m.outer, []).append(i)
    return out


def _design(batch: pd.DataFrame, rows: np.ndarray, features: Sequence[str], scales: Sequence[Scale]) -> np.ndarray:
    columns = [scale(batch[f].to_numpy(dtype=float)[rows]) for f, scale in zip(features, scales)]
    return np.column_stack([np.ones(int(rows.sum())), *columns])


def _probabilities(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability and softplus(z), both without overflow."""
    e = np.exp(-np.abs(z))
    return np.where(z >= 0, 1.0, e) / (1.0 + e), np.maximum(z, 0.0) + np.log1p(e)


def _one_pass(rows: DataFrame, models: Sequence[Model], trial: np.ndarray, features: Sequence[str],
              scales: Mapping[int, Sequence[Scale]]) -> np.ndarray:
    """Loss, gradient and curvature sums of all models at ``trial`` in one job.

    Every task sums its own cells and emits one short row per model, so what is
    shuffled and collected depends on the number of models, not of cells.
    """
    d = len(features) + 1
    upper = np.triu_indices(d)
    width = 3 + d + len(upper[0])
    groups, features, inner_of = _groups(models), list(features), [m.inner for m in models]
    scales = {o: list(scales[o]) for o in groups}

    def accumulate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(inner_of), width))
        for batch in batches:
            fold = batch["fold"].to_numpy()
            y_all, w_all = batch["y"].to_numpy(dtype=float), batch["w"].to_numpy(dtype=float)
            for outer, numbers in groups.items():
                used = fold != outer
                if not used.any():
                    continue
                x = _design(batch, used, features, scales[outer])
                y, w = y_all[used][:, None], w_all[used][:, None]
                inner = np.array([inner_of[i] for i in numbers])
                weight = np.broadcast_to(w, (len(x), len(numbers)))
                if (inner >= 0).any():
                    own = batch[f"inner_{outer}"].to_numpy()[used][:, None]
                    weight = w * (own != inner[None, :])
                at = trial[numbers].T
                for start in range(0, len(x), BLOCK):  # a block of rows by models stays in the processor's cache
                    some = slice(start, start + BLOCK)
                    xs, ys, ws = x[some], y[some], weight[some]
                    z = xs @ at
                    p, softplus = _probabilities(z)
                    softplus -= ys * z
                    softplus *= ws
                    curvature = (1.0 - p) * p
                    curvature *= ws
                    p -= ys
                    p *= ws
                    total[numbers, 0] += ws.sum(axis=0)
                    total[numbers, 1] += (ws * ys).sum(axis=0)
                    total[numbers, 2] += softplus.sum(axis=0)
                    total[numbers, 3:3 + d] += p.T @ xs
                    total[numbers, 3 + d:] += curvature.T @ (xs[:, upper[0]] * xs[:, upper[1]])
        out = pd.DataFrame(total, columns=[f"s{i}" for i in range(width)])
        out.insert(0, "model", np.arange(len(out), dtype="int32"))
        yield out[out["s0"] > 0]

    schema = "model int, " + ", ".join(f"s{i} double" for i in range(width))
    sums = rows.mapInPandas(accumulate, schema).groupBy("model").agg(
        *[F.sum(f"s{i}").alias(f"s{i}") for i in range(width)])
    out = np.zeros((len(models), width))
    for r in sums.collect():
        out[r["model"]] = r[1:]
    return out


def fit_logistic_many(rows: DataFrame, models: Sequence[Model], features: Sequence[str],
                      scales: Mapping[int, Sequence[Scale]], max_passes: int = 30,
                      tolerance: float = 1e-10) -> Sequence[Model]:
    """Fit all models together by damped Newton steps, one job per step.

    ``rows``: features, y, w (cells a row stands for), fold and the
    ``inner_<o>`` columns of a fold plan; keep it checkpointed or cached.
    ``scales`` holds the standardisation per outer fold and is applied inside
    the task.  Where many models share their training cells, one of each such set is fitted first and
    the others start next to it.  A training set with one class gives NaN weights.  Models that
    ``max_passes`` jobs do not bring below ``tolerance`` keep their best weights,
    stay marked as not converged, and are named in a warning.
    """
    alike: dict[tuple[int, int], list[int]] = {}
    for i, m in enumerate(models):
        alike.setdefault((m.outer, m.inner), []).append(i)
    start = np.zeros((len(models), len(features) + 1))
    if 2 * len(alike) <= len(models):
        leads = [models[sorted(same, key=lambda i: models[i].c)[len(same) // 2]] for same in alike.values()]
        firsts = [Model(m.outer, m.inner, m.c) for m in leads]
        for same, first, (gradient, h) in zip(alike.values(), firsts, _newton(rows, firsts, features, scales, max_passes, tolerance), strict=True):
            if not first.fitted:
                continue
            penalty = np.array([0.0] + [1.0] * len(features))
            for i in same:  # one step from the lead's sums, which all of them share
                ridge = penalty / (models[i].c * gradient[0])
                start[i] = first.weights - np.linalg.lstsq(h + np.diag(ridge), gradient[1:] + ridge * first.weights, rcond=None)[0]
    _newton(rows, models, features, scales, max_passes, tolerance, start)
    open_fits = [m for m in models if not m.converged and m.fitted]
    if open_fits:
        warnings.warn(f"{len(open_fits)} of {len(models)} logistic fits did not converge in {max_passes} passes",
                      RuntimeWarning, stacklevel=2)
    return models


def _newton(rows: DataFrame, models: Sequence[Model], features: Sequence[str], scales: Mapping[int, Sequence[Scale]],
            max_passes: int, tolerance: float, start: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Damped Newton steps of all models from ``start``; per model its cells and mean gradient, and mean curvature, without the penalty."""
    d = len(features) + 1
    upper = np.triu_indices(d)
    at = np.zeros((len(models), d)) if start is None else start.copy()
    trial, step = at.copy(), np.zeros_like(at)
    last = [(np.zeros(1 + d), np.zeros((d, d))) for _ in models]
    best = np.full(len(models), np.inf)
    active = np.ones(len(models), dtype=bool)
    degenerate = np.zeros(len(models), dtype=bool)
    penalty = np.array([0.0] + [1.0] * (d - 1))
    for _ in range(max_passes):
        numbers = np.flatnonzero(active)
        if not len(numbers):
            break
        sums = _one_pass(rows, [models[i] for i in numbers], trial[numbers], features, scales)
        for i, s in zip(numbers, sums):
            n, ones = s[0], s[1]
            if n == 0 or ones == 0 or ones == n:
                degenerate[i], active[i] = True, False
                continue
            ridge = penalty / (models[i].c * n)
            value = s[2] / n + 0.5 * float(ridge @ (trial[i] ** 2))
            if value > best[i] + 1e-12 * max(1.0, abs(best[i])):  # overshoot: halve the step
                step[i] *= 0.5
                trial[i] = at[i] + step[i]
                active[i] = np.abs(step[i]).max() > 1e-14
                continue
            best[i], at[i] = value, trial[i].copy()
            gradient = s[3:3 + d] / n + ridge * at[i]
            h = np.zeros((d, d))
            h[upper] = s[3 + d:] / n
            h = h + np.triu(h, 1).T
            last[i] = np.concatenate([[n], s[3:3 + d] / n]), h
            if np.abs(gradient).max() < tolerance:
                active[i] = False
                continue
            step[i] = -np.linalg.lstsq(h + np.diag(ridge), gradient, rcond=None)[0]
            trial[i] = at[i] + step[i]
    for i, m in enumerate(models):
        m.weights = np.full(d, np.nan) if degenerate[i] else at[i].copy()
        m.converged = not (degenerate[i] or active[i])
    return last


def score_inner_folds(rows: DataFrame, models: Sequence[Model], features: Sequence[str],
                      scales: Mapping[int, Sequence[Scale]], bins: int | None = None) -> DataFrame:
    """(model, p, n0, n1): scores of each model on its inner validation cells.

    Equal scores are merged per batch before they leave the task.  ``bins``
    coarsens scores to a grid, which makes later areas approximate; the default
    keeps them exact.
    """
    groups, features = _groups(models), list(features)
    weights, inner_of = [m.weights for m in models], [m.inner for m in models]
    scales = {o: list(scales[o]) for o in groups}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fold = batch["fold"].to_numpy()
            y_all, w_all = batch["y"].to_numpy(), batch["w"].to_numpy()
            for outer, numbers in groups.items():
                own = batch[f"inner_{outer}"].to_numpy()
                for inner in sorted({inner_of[i] for i in numbers}):
                    held = (fold != outer) & (own == inner)
                    if not held.any():
                        continue
                    x = _design(batch, held, features, scales[outer])
                    n1 = w_all[held] * (y_all[held] == 1)
                    n0 = w_all[held] - n1
                    for i in (i for i in numbers if inner_of[i] == inner):
                        p, _ = _probabilities(x @ weights[i])
                        if bins is not None:
                            p = np.floor(p * bins) / bins
                        values, at = np.unique(p, return_inverse=True)
                        yield pd.DataFrame({
                            "model": np.full(len(values), i, dtype="int32"), "p": values,
                            "n0": np.bincount(at, n0).astype("int64"), "n1": np.bincount(at, n1).astype("int64")})

    return rows.mapInPandas(score, "model int, p double, n0 bigint, n1 bigint")
