"""Drought susceptibility: aligned layers to validated, deployable models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.functions.scores import binarize
from gridspark.models import scoring
from gridspark.models.folds import FoldPlan, block_sizes
from gridspark.models.logistic import ALL_CELLS
from gridspark.models.validation import NestedResult, fit_final, nested_spatial_cv, prepare_rows
from gridspark.operators import calibration, scaling
from gridspark.operators.grid import Grid, align_layers, block_id, resample_average, resample_bilinear, valid_cells
from gridspark.operators.run_keys import union_columns
from gridspark.session import cut_lineage

# Metric names of the fold table, and the defaults of a run below.
PERFORMANCE = ("val_roc_auc", "val_pr_auc", "val_pr_auc_skill_ratio", "val_brier", "val_brier_skill_score",
               "val_f1", "val_precision", "val_recall", "val_prevalence", "tuned_C", "intercept")


@dataclass(frozen=True)
class DsiConfig:
    cv_block_size_m: float = 30_000.0
    outer_n_splits: int = 10
    inner_n_splits: int = 5
    n_iter: int = 20
    n_bins: int = 12
    min_pixels: int = 50
    disco_threshold: float = 4000.0
    bin_strategy: str = "uniform"
    seed: int = 42


@dataclass
class DsiResult:
    """Tables of one run; single numbers are kept in ``final``."""

    config: DsiConfig
    features: list[str]
    nested: NestedResult
    out_of_fold: DataFrame
    scaler: DataFrame
    coefficients: DataFrame
    correlations: DataFrame
    inflation: DataFrame
    cv_summary: DataFrame
    calibration: DataFrame
    calibration_r2: DataFrame
    fold_calibration: DataFrame
    stability: DataFrame
    final: dict


def model_cells(awc: DataFrame, disco: DataFrame, extras: Mapping[str, DataFrame], grid: Grid,
                config: DsiConfig) -> DataFrame:
    """Aligned, complete cells: row, col, awc, extras, y, block_id.

    Inputs are (row, col, value) on the same grid; resample beforehand so that
    a discoloration map shared by many runs is resampled once.
    """
    layers = [awc.select("row", "col", F.col("value").cast("double").alias("awc")),
              disco.select("row", "col", F.col("value").alias("disco"))]
    layers += [df.select("row", "col", F.col("value").cast("double").alias(name)) for name, df in extras.items()]
    cells = valid_cells(align_layers(layers), ["awc", "disco", *extras])
    return block_id(cells, grid, config.cv_block_size_m).select(
        "row", "col", "awc", *extras, binarize(F.col("disco"), config.disco_threshold).alias("y"), "block_id")


def cells_from_grids(awc: DataFrame, grid: Grid, disco: tuple[DataFrame, Grid], extras: Mapping[str, tuple[DataFrame, Grid]],
                     config: DsiConfig) -> DataFrame:
    """:func:`model_cells` for layers on grids of their own, all brought to the grid of ``awc``.

    Discoloration is averaged over what each cell covers and only then compared with its threshold; other layers are
    interpolated between four points.  A layer on the same grid passes untouched.
    """
    seen, own = disco
    seen = seen if own == grid else resample_average(seen, own, grid)
    layers = {}
    for name, (layer, own) in extras.items():
        layers[name] = layer if own == grid else resample_bilinear(layer, own, awc.select("row", "col"), grid)
    return model_cells(awc, seen, layers, grid, config)


def run_dsi(awc: DataFrame, disco: DataFrame, extras: Mapping[str, DataFrame] | None, grid: Grid,
            config: DsiConfig = DsiConfig()) -> DsiResult:
    """Validate and fit one susceptibility model.  Runs jobs."""
    extras = dict(extras or {})
    features = ["awc", *extras]
    cells = cut_lineage(model_cells(awc, disco, extras, grid, config))
    plan = FoldPlan.build(block_sizes(cells), config.outer_n_splits, config.inner_n_splits)
    rows = cut_lineage(prepare_rows(cells, features, plan)).persist()  # read once per fitting pass
    nested = nested_spatial_cv(cells, features, n_iter=config.n_iter, seed=config.seed, plan=plan, rows=rows)
    model = fit_final(rows, features, nested.scales[ALL_CELLS], [r["tuned_C"] for r in nested.rows])
    rows.unpersist()
    spark = cells.sparkSession
    scaler = scoring.scaler_table(spark, features, nested.scales[ALL_CELLS])
    scaled = scaling.apply_scaler(cells, scaler, features).select(*[F.col(f"{f}_z").alias(f) for f in features])

    scores = nested.out_of_fold(cells)
    bins = calibration.calibration_bins(scores, [], config.n_bins, config.min_pixels, config.bin_strategy)
    coefficients = [f"coef_{f}" for f in features]
    return DsiResult(
        config=config, features=features, nested=nested, out_of_fold=scores, scaler=scaler,
        coefficients=scoring.coefficient_table(spark, features, model),
        correlations=scaling.pairwise_corr(scaled, features) if extras else spark.createDataFrame(
            [], "feature_1 string, feature_2 string, pearson_r double, pearson_r2 double"),
        inflation=scaling.vif(scaled, features),
        cv_summary=calibration.summarize_folds(nested.folds, [*PERFORMANCE, *coefficients]),
        calibration=bins, calibration_r2=calibration.calibration_r2(bins, []),
        fold_calibration=calibration.fold_calibration(scores, "fold", config.n_bins, max(10, config.min_pixels // 3),
                                                      config.bin_strategy),
        stability=calibration.coefficient_stability(nested.folds, ["intercept", *coefficients]),
        final={"C": model.c, "intercept": float(model.weights[0]),
               "coef": dict(zip(features, map(float, model.weights[1:])))})


def metrics_rows(result: DsiResult) -> list[tuple[str, str]]:
    """Flat (parameter, value) list of a run: settings, final model, diagnostics, fold summary."""
    out = [("model", "logistic_regression"), ("scaling_method", "standard")]
    cfg = asdict(result.config)
    for key, name in (("cv_block_size_m", "cv_block_size_m"), ("outer_n_splits", "outer_n_splits"),
                      ("inner_n_splits", "inner_n_splits"), ("bin_strategy", "bin_strategy"),
                      ("n_bins", "n_bins_requested"), ("min_pixels", "min_pixels"), ("disco_threshold", "disco_threshold")):
        out.append((name, str(cfg[key])))
    r2 = result.calibration_r2.first()
    out.append(("pooled_oof_calibration_r2", _six(r2["calibration_r2"] if r2 else None)))
    out += [("final_model_C", str(result.final["C"])), ("final_model_intercept", _six(result.final["intercept"]))]
    for f, w in result.final["coef"].items():
        out += [(f"final_model_coef_{f}", _six(w)), (f"final_model_odds_ratio_{f}", _six(float(np.exp(w))))]
    for r in result.correlations.collect():
        pair = f"{r['feature_1']}_vs_{r['feature_2']}"
        out += [(f"pearson_r_{pair}", _six(r["pearson_r"])), (f"pearson_r2_{pair}", _six(r["pearson_r2"]))]
    out += [(f"vif_{r['feature']}", _six(r["vif"])) for r in result.inflation.collect()]
    for r in result.cv_summary.collect():
        out += [(f"cv_{r['metric']}_{part}", _six(r[part])) for part in ("mean", "std", "min", "max", "cv_pct")]
    return out


def _six(v) -> str:
    return "" if v is None else f"{v:.6f}"


def summarize_run(result: DsiResult, keys: Mapping[str, str]) -> DataFrame:
    """One wide row per run: keys, settings, final model, mean/std/CV% per metric.

    The fold summary has one row per metric and is pivoted over named metrics.
    """
    cfg, fin = result.config, result.final
    constants = {**keys, "scaling_method": "standard", "cv_block_size_m": cfg.cv_block_size_m,
                 "outer_n_splits": cfg.outer_n_splits, "inner_n_splits": cfg.inner_n_splits,
                 "bin_strategy": cfg.bin_strategy, "n_bins_requested": cfg.n_bins, "min_pixels": cfg.min_pixels,
                 "disco_threshold": cfg.disco_threshold, "final_model_C": fin["C"],
                 "final_model_intercept": fin["intercept"]}
    for f, w in fin["coef"].items():
        constants[f"final_model_coef_{f}"] = w
        constants[f"final_model_odds_ratio_{f}"] = float(np.exp(w))
    metrics = [*PERFORMANCE, *[f"coef_{f}" for f in result.features]]
    wide = pivot_summary(result.cv_summary, metrics)
    r2 = result.calibration_r2.select("calibration_r2").scalar()
    return wide.select(*[F.lit(v).alias(k) for k, v in constants.items()],
                       r2.alias("pooled_oof_calibration_r2"), *wide.columns)


def pivot_summary(summary: DataFrame, metrics: Sequence[str], keys: Sequence[str] = (),
                  parts: Sequence[str] = ("mean", "std", "cv_pct")) -> DataFrame:
    """(keys, metric, mean, std, cv_pct) -> one row with cv_<metric>_<part> columns."""
    cells = [F.max(F.when(F.col("metric") == m, F.col(part))).alias(f"cv_{m}_{part}") for m in metrics for part in parts]
    return summary.groupBy(*keys).agg(*cells)


def aggregate_summary(rows: Sequence[DataFrame]) -> DataFrame:
    """All run rows under the union of their columns."""
    return union_columns(rows)
