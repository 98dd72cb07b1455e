"""Queries over scaling, calibration and susceptibility models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.catalog import soil_sql as q
from gridspark.catalog.fixtures import CLIMATE_GRID, SOIL_GRID, Tables, sql
from gridspark.catalog.grids import COARSE
from gridspark.catalog.registry import query, rounded
from gridspark.catalog.soil import MAP_SQL, PROFILE, _maps_cte, awc_of
from gridspark.catalog.soil_sql import r
from gridspark.functions.scores import brier_skill_score, pr_auc_skill_ratio
from gridspark.models import scoring, validation
from gridspark.models.folds import FoldPlan, block_sizes, group_kfold
from gridspark.models.logistic import ALL_CELLS, Model, fit_logistic, fit_logistic_many
from gridspark.operators import binned, calibration, class_stats, scaling
from gridspark.plans import dsi
from gridspark.plans.store import ModelStore, apply_years
from gridspark.session import cut_lineage, shared_folder
from gridspark.sources.writers import encode_int16

# Full search: 10 outer and 5 inner folds, 20 candidates.  Blocks of 4 x 4 cells give ten folds on the smallest tables.
CONFIG = dsi.DsiConfig(cv_block_size_m=100.0, outer_n_splits=10, inner_n_splits=5, n_iter=20, min_pixels=20)
FEATURES = ["sand", "clay", "soc"]

_CELLS = "SELECT row, col, avg(sand) AS sand, avg(clay) AS clay, avg(soc) AS soc FROM soil GROUP BY row, col"
_SCALER = """
SELECT feature, lo, hi, avg(least(greatest(v, lo), hi)) AS center, stddev_pop(least(greatest(v, lo), hi)) AS scale
FROM long JOIN (SELECT feature, quantile_cont(v, .001) AS lo, quantile_cont(v, .999) AS hi FROM long GROUP BY feature) USING (feature)
GROUP BY feature, lo, hi"""
_LONG = ("SELECT row, col, 'sand' AS feature, sand AS v FROM fcells UNION ALL SELECT row, col, 'clay', clay FROM fcells "
         "UNION ALL SELECT row, col, 'soc', soc FROM fcells")
SCALED = {"fcells": _CELLS, "long": _LONG, "scaler": _SCALER}
_Z = "(least(greatest(c.{f}, s_{f}.lo), s_{f}.hi) - s_{f}.center)/s_{f}.scale"
_JOIN = " ".join(f"CROSS JOIN (SELECT * FROM scaler WHERE feature = '{f}') s_{f}" for f in FEATURES)
_ZS = {f: _Z.format(f=f) for f in FEATURES}


def _features(t: Tables):
    return t.soil.groupBy("row", "col").agg(*[F.avg(f).alias(f) for f in FEATURES])


@query("A24_fit_scaler", sql("soil", f"""
SELECT feature, {r('lo')} AS clip_lower, {r('hi')} AS clip_upper, {r('center')} AS center, {r('scale')} AS scale FROM scaler""", **SCALED))
def _(t: Tables):
    return rounded(scaling.fit_scaler(_features(t), FEATURES), 6, "clip_lower", "clip_upper", "center", "scale")


@query("P20_standardize", sql("soil", f"""
SELECT c.row, c.col, {', '.join(f'{r(z)} AS {f}_z' for f, z in _ZS.items())} FROM fcells c {_JOIN}""", **SCALED))
def _(t: Tables):
    cells = _features(t)
    out = scaling.apply_scaler(cells, scaling.fit_scaler(cells, FEATURES), FEATURES)
    return rounded(out.select("row", "col", *[f"{f}_z" for f in FEATURES]), 6, *[f"{f}_z" for f in FEATURES])


_PAIRS = """SELECT 'sand' AS feature_1, 'clay' AS feature_2, corr(sand, clay) AS pr FROM fcells
UNION ALL SELECT 'sand', 'soc', corr(sand, soc) FROM fcells UNION ALL SELECT 'clay', 'soc', corr(clay, soc) FROM fcells"""


@query("A25_pairwise_corr", sql("soil", f"SELECT feature_1, feature_2, {r('pr', 9)} AS pearson_r, {r('pr*pr', 9)} AS pearson_r2 FROM pairs",
                                fcells=_CELLS, pairs=_PAIRS))
def _(t: Tables):
    return rounded(scaling.pairwise_corr(_features(t), FEATURES), 9, "pearson_r", "pearson_r2")


@query("A26_vif", sql("soil", f"""
SELECT feature, {r('1 - 1/v', 9)} AS r2_vs_others, {r('v', 9)} AS vif FROM (
  SELECT unnest(['sand', 'clay', 'soc']) AS feature, unnest([(1 - c*c)/d, (1 - b*b)/d, (1 - a*a)/d]) AS v
  FROM (SELECT *, 1 + 2*a*b*c - a*a - b*b - c*c AS d FROM (
    SELECT corr(sand, clay) AS a, corr(sand, soc) AS b, corr(clay, soc) AS c FROM fcells)))""", fcells=_CELLS))
def _(t: Tables):
    return rounded(scaling.vif(_features(t), FEATURES), 9, "r2_vs_others", "vif")


# --- scores ------------------------------------------------------------------------

_RUN = """
SELECT key, p, c0, c1, sum(c0) OVER k AS n0, sum(c1) OVER k AS n1, sum(c0) OVER d AS fp, sum(c1) OVER d AS tp,
       sum(c0) OVER d - c0 AS fp_above
FROM (SELECT key, p, count(*) FILTER (y = 0) AS c0, count(*) FILTER (y = 1) AS c1 FROM scored GROUP BY key, p)
WINDOW k AS (PARTITION BY key), d AS (PARTITION BY key ORDER BY p DESC)"""
RUN = {"run": _RUN}


@query("W1_roc_curve", sql("scored", f"SELECT key, {r('p')} AS threshold, {r('fp/n0')} AS fpr, {r('tp/n1')} AS tpr FROM run WHERE n0 > 0 AND n1 > 0", **RUN))
def _(t: Tables):
    return rounded(calibration.roc_curve(t.scored, ["key"]), 6, "threshold", "fpr", "tpr")


@query("W2_pr_curve", sql("scored", f"""
SELECT key, {r('p')} AS threshold, {r('tp/(tp + fp)')} AS precision, {r('coalesce(tp/nullif(n1, 0), 0)')} AS recall,
       {r('2*tp/(tp + fp + n1)')} AS f1 FROM run""", **RUN))
def _(t: Tables):
    return rounded(calibration.pr_curve(t.scored, ["key"]), 6, "threshold", "precision", "recall", "f1")


@query("W2_best_f1_threshold", sql("scored", f"""
SELECT key, {r('p')} AS threshold, {r('f1')} AS f1 FROM (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY f1 DESC, p) AS k FROM (SELECT *, 2*tp/(tp + fp + n1) AS f1 FROM run)) WHERE k = 1""", **RUN))
def _(t: Tables):
    curve = calibration.pr_curve(t.scored, ["key"])
    return rounded(calibration.best_f1_threshold(curve, ["key"]), 6, "threshold", "f1")


@query("A32_roc_auc", sql("scored", f"SELECT key, {r('sum(c1*(n0 - fp + c0/2))/(max(n0)*max(n1))')} AS roc_auc FROM run GROUP BY key", **RUN))
def _(t: Tables):
    return rounded(calibration.roc_auc(t.scored, ["key"]), 6, "roc_auc")


@query("A33_average_precision", sql("scored", f"SELECT key, {r('sum(c1/n1*tp/(tp + fp))')} AS average_precision FROM run GROUP BY key", **RUN))
def _(t: Tables):
    return rounded(calibration.average_precision(t.scored, ["key"]), 6, "average_precision")


@query("A30_brier", sql("scored", f"""
SELECT key, {r('avg((p - y)*(p - y))')} AS brier, {r('avg(y)')} AS prevalence, count(*) AS n,
       {r('1 - avg((p - y)*(p - y))/(avg(y)*(1 - avg(y)))')} AS brier_skill_score FROM scored GROUP BY key"""))
def _(t: Tables):
    return rounded(calibration.brier(t.scored, ["key"]), 6, "brier", "prevalence", "brier_skill_score")


@query("P21_skill_scores", sql("scored", f"""
SELECT key, {r('CASE WHEN a > 0 AND a < 1 THEN 1 - b/(a*(1 - a)) END')} AS bss, {r('CASE WHEN a > 0 AND a < 1 THEN ap/a END')} AS pr_auc_skill_ratio
FROM (SELECT key, avg(y) AS a, avg((p - y)*(p - y)) AS b FROM scored GROUP BY key)
JOIN (SELECT key, sum(c1/n1*tp/(tp + fp)) AS ap FROM run GROUP BY key) USING (key)""", **RUN))
def _(t: Tables):
    joined = calibration.brier(t.scored, ["key"]).join(calibration.average_precision(t.scored, ["key"]), "key")
    out = joined.select("key", brier_skill_score(F.col("brier"), F.col("prevalence")).alias("bss"),
                        pr_auc_skill_ratio(F.col("average_precision"), F.col("prevalence")).alias("pr_auc_skill_ratio"))
    return rounded(out, 6, "bss", "pr_auc_skill_ratio")


@query("A31_f1_precision_recall", sql("scored", f"""
SELECT key, tp, fp, fn, {r('coalesce(tp/nullif(tp + fp, 0), 0)')} AS precision, {r('coalesce(tp/nullif(tp + fn, 0), 0)')} AS recall,
       {r('coalesce(2*tp/nullif(2*tp + fp + fn, 0), 0)')} AS f1
FROM (SELECT key, count(*) FILTER (p >= .6 AND y = 1) AS tp, count(*) FILTER (p >= .6 AND y = 0) AS fp,
             count(*) FILTER (p < .6 AND y = 1) AS fn FROM scored GROUP BY key)"""))
def _(t: Tables):
    return rounded(calibration.f1_precision_recall(t.scored, ["key"], 0.6), 6, "precision", "recall", "f1")


_CAL = """
SELECT key, least(floor(p*12), 11)::INT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS pr FROM scored GROUP BY ALL"""


@query("A27_calibration_bins", sql("scored", f"""
SELECT key, bin, n, CASE WHEN n >= 50 THEN {r('mp')} END AS mean_p, CASE WHEN n >= 50 THEN {r('pr')} END AS prop FROM cal""", cal=_CAL))
def _(t: Tables):
    return rounded(calibration.calibration_bins(t.scored, ["key"]), 6, "mean_p", "prop")


_QEDGES = f"""
SELECT key, list_concat([0E0], list_sort(list_distinct(list_value({', '.join(f'quantile_cont(p, {i}/12)' for i in range(13))})))[2:-2], [1E0]) AS edges
FROM scored GROUP BY key"""


@query("A27_calibration_bins_quantile", sql("scored", f"""
SELECT key, bin, count(*) AS n, {r('avg(p)')} AS mean_p, {r('avg(y)')} AS prop FROM (
  SELECT key, p, y, len(list_filter(edges[2:-2], lambda e: e <= p))::INT AS bin FROM scored JOIN qedges USING (key)) GROUP BY key, bin""", qedges=_QEDGES))
def _(t: Tables):
    return rounded(calibration.calibration_bins(t.scored, ["key"], min_pixels=1, strategy="quantile"), 6, "mean_p", "prop")


@query("A28_calibration_r2", sql("scored", f"""
SELECT key, {r('1 - sum(n*(pr - mp)*(pr - mp))/sum(n*(pr - m)*(pr - m))')} AS calibration_r2
FROM (SELECT *, sum(n*pr) OVER (PARTITION BY key)/sum(n) OVER (PARTITION BY key) AS m FROM cal WHERE n >= 50) GROUP BY key""", cal=_CAL))
def _(t: Tables):
    return rounded(calibration.calibration_r2(calibration.calibration_bins(t.scored, ["key"]), ["key"]), 6, "calibration_r2")


@query("A29_fold_calibration", sql("scored", f"""
SELECT key, bin, n, {r('mp')} AS mean_p, {r('pr')} AS prop, n_folds FROM (
  SELECT *, count(*) OVER (PARTITION BY bin) AS n_folds FROM cal WHERE n >= 16) WHERE n_folds >= 2""", cal=_CAL))
def _(t: Tables):
    return rounded(calibration.fold_calibration(t.scored, "key", min_pixels=16), 6, "mean_p", "prop")


_KEYED = """SELECT key, avg((p - y)*(p - y)) AS val_brier, avg(y) AS val_prevalence, avg(p) AS coef_p FROM scored GROUP BY key"""
_METRICS = """SELECT 'val_brier' AS metric, val_brier AS v FROM keyed UNION ALL SELECT 'val_prevalence', val_prevalence FROM keyed
UNION ALL SELECT 'coef_p', coef_p FROM keyed"""
_NAMES = ["val_brier", "val_prevalence", "coef_p"]


def _fold_table(t: Tables):
    b = calibration.brier(t.scored, ["key"]).select("key", F.col("brier").alias("val_brier"), F.col("prevalence").alias("val_prevalence"))
    return b.join(t.scored.groupBy("key").agg(F.avg("p").alias("coef_p")), "key")


_SUM = "SELECT metric, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS min, max(v) AS max, 100*stddev_pop(v)/abs(avg(v)) AS cv_pct FROM metrics GROUP BY metric"


@query("A34_summarize_folds", sql("scored", f"""
SELECT metric, {r('mean', 9)} AS mean, {r('std', 9)} AS std, {r('min', 9)} AS min, {r('max', 9)} AS max, {r('cv_pct', 9)} AS cv_pct FROM summed""",
    keyed=_KEYED, metrics=_METRICS, summed=_SUM))
def _(t: Tables):
    return rounded(calibration.summarize_folds(_fold_table(t), _NAMES), 9, "mean", "std", "min", "max", "cv_pct")


@query("A36_coefficient_stability", sql("scored", f"""
SELECT key, 'coef_p' AS coefficient, {r('coef_p', 9)} AS value, {r('avg(coef_p) OVER ()', 9)} AS mean, {r('stddev_pop(coef_p) OVER ()', 9)} AS std FROM keyed""",
    keyed=_KEYED))
def _(t: Tables):
    return rounded(calibration.coefficient_stability(_fold_table(t), ["coef_p"], "key"), 9, "value", "mean", "std")


@query("M9_pivot_summary", sql("scored", "SELECT " + ", ".join(
    f"round(max({part}) FILTER (metric = '{m}'), 9) + 0.0 AS cv_{m}_{part}" for m in _NAMES for part in ("mean", "std", "cv_pct")) + " FROM summed",
    keyed=_KEYED, metrics=_METRICS, summed=_SUM))
def _(t: Tables):
    summary = calibration.summarize_folds(_fold_table(t), _NAMES)
    out = dsi.pivot_summary(summary, _NAMES)
    return rounded(out, 9, *out.columns)


_SEP = """
SELECT key, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0, avg(p) FILTER (y = 1) AS m1, avg(p) FILTER (y = 0) AS m0,
       quantile_cont(p, .5) FILTER (y = 1) AS d1, quantile_cont(p, .5) FILTER (y = 0) AS d0,
       var_samp(p) FILTER (y = 1) AS v1, var_samp(p) FILTER (y = 0) AS v0 FROM scored GROUP BY key"""


@query("A35_separability", sql("scored", f"""
SELECT key, n1 AS n_disco, n0 AS n_nondisco, {r('m1')} AS mean_disco, {r('m0')} AS mean_nondisco, {r('d1')} AS median_disco, {r('d0')} AS median_nondisco,
       {r('u/(n0*n1)')} AS auc, u AS mw_u, {r('(m1 - m0)/sqrt((v1 + v0)/2)')} AS cohens_d
FROM sep JOIN (SELECT key, sum(c1*(n0 - fp + c0/2)) AS u FROM run GROUP BY key) USING (key)""", **RUN, sep=_SEP))
def _(t: Tables):
    out = class_stats.separability(t.scored, "key", cls="y").drop("mw_p", "mw_z")
    return rounded(out, 6, "mean_disco", "mean_nondisco", "median_disco", "median_nondisco", "auc", "cohens_d")


@query("A37_density_histogram", sql("scored", f"""
SELECT key, y, bin, n, {r('n*50E0/sum(n) OVER (PARTITION BY key, y)')} AS density FROM (
  SELECT key, y, i::INT AS bin, count(*) AS n FROM scored JOIN (SELECT unnest(range(0, 50)) AS i)
    ON p >= i*(1E0/50E0) AND (p < (i + 1)*(1E0/50E0) OR (i = 49 AND p <= 1)) GROUP BY key, y, i)"""))
def _(t: Tables):
    return rounded(binned.density_histogram(t.scored, ["key"], cls="y"), 6, "density")


# --- fitted models --------------------------------------------------------------------

# Scoring is checked with stated coefficients, so that both engines can follow it.
_COEF = {"intercept": -0.4, "sand": 0.9, "clay": -0.3, "soc": 0.1}
_P = f"1/(1 + exp(-({_COEF['intercept']}E0 + {_COEF['sand']}E0*{_ZS['sand']} + {_COEF['clay']}E0*{_ZS['clay']} + {_COEF['soc']}E0*{_ZS['soc']})))"
_PROBS = f"SELECT c.row, c.col, {_P} AS p FROM fcells c {_JOIN}"
_YEARS = """SELECT d.year AS key, p, CASE WHEN d.value >= 4000 THEN 1 ELSE 0 END AS y FROM probs JOIN disco d USING (row, col) WHERE d.value IS NOT NULL"""


def _stated(t: Tables):
    cells = _features(t)
    coefficients = t.spark.createDataFrame([(k, v, None) for k, v in _COEF.items()], "term string, coefficient double, odds_ratio double")
    # A stored model: its few parameter rows are materialised before scoring.
    return cells, cut_lineage(scaling.fit_scaler(cells, FEATURES)), coefficients


@query("M7_predict_proba", sql("soil", f"SELECT row, col, {r('p')} AS p FROM probs", **SCALED, probs=_PROBS))
def _(t: Tables):
    cells, scaler, coefficients = _stated(t)
    return rounded(scoring.predict_proba(cells, scaler, coefficients, FEATURES).select("row", "col", "p"), 6, "p")


KEY = {"ptf": "stated", "depth": "2m", "date": "1995-07-01"}


def _store(t: Tables) -> ModelStore:
    return ModelStore(t.spark, f"{shared_folder(t.spark)}/models-{uuid.uuid4().hex}")


@query("M8_store_and_apply", sql("soil", f"SELECT row, col, {r('p')} AS p FROM probs", **SCALED, probs=_PROBS))
def _(t: Tables):
    """Stored as two versions, the newer one resolved by its run key and applied in another plan."""
    cells, scaler, coefficients = _stated(t)
    store = _store(t)
    store.save(KEY, scaler, coefficients.withColumn("coefficient", F.lit(0.0)))
    store.save(KEY, scaler, coefficients)
    return rounded(store.apply(KEY, cells).select("row", "col", "p"), 6, "p")


@query("J9_parameters_on_cells", sql("soil disco", f"""
SELECT key AS label, count(*) AS n, {r('avg(p)')} AS mean_p, sum(y)::BIGINT AS n_disco FROM yearly GROUP BY key""", **SCALED, probs=_PROBS, yearly=_YEARS))
def _(t: Tables):
    cells, scaler, coefficients = _stated(t)
    joined = cells.join(t.disco.select("row", "col", F.col("year").alias("label"), F.col("value").alias("disco")), ["row", "col"])
    scored = scoring.score_scenarios(joined, scaler, coefficients, FEATURES)
    out = scored.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.sum("cls").alias("n_disco"))
    return rounded(out, 6, "mean_p")


# Equal probabilities must be equal in both engines, hence the rounding.
_YEARS9 = _YEARS.replace("AS key, p,", "AS key, round(p, 9) AS p,")
_YRUN = _RUN.replace("FROM scored", "FROM yearly")


@query("M10_separability_of_years", sql("soil disco", f"""
SELECT key AS label, n1 AS n_disco, n0 AS n_nondisco, {r('m1')} AS mean_disco, {r('m0')} AS mean_nondisco, {r('d1')} AS median_disco, {r('d0')} AS median_nondisco,
       {r('u/(n0*n1)')} AS auc, u AS mw_u, {r('(m1 - m0)/sqrt((v1 + v0)/2)')} AS cohens_d
FROM sep JOIN (SELECT key, sum(c1*(n0 - fp + c0/2)) AS u FROM run GROUP BY key) USING (key)""",
    **SCALED, probs=_PROBS, yearly=_YEARS9, run=_YRUN, sep=_SEP.replace("FROM scored", "FROM yearly")))
def _(t: Tables):
    cells, scaler, coefficients = _stated(t)
    joined = cells.join(t.disco.select("row", "col", F.col("year").alias("label"), F.col("value").alias("disco")), ["row", "col"])
    scored = rounded(scoring.score_scenarios(joined, scaler, coefficients, FEATURES), 9, "p")
    out = class_stats.separability(scored).drop("mw_p", "mw_z")
    return rounded(out, 6, "mean_disco", "mean_nondisco", "median_disco", "median_nondisco", "auc", "cohens_d")


@query("M10_isolated_scenarios", sql("soil disco", """
SELECT s.label, CASE WHEN s.reason IS NOT NULL THEN 'failed' WHEN n IS NULL THEN 'empty' ELSE 'done' END AS status,
       CASE WHEN s.reason IS NOT NULL THEN s.reason WHEN n IS NULL THEN 'no complete cell' END AS reason,
       n1 AS n_disco, n0 AS n_nondisco, round(u/(n0*n1), 6) + 0.0 AS auc
FROM (VALUES ('1994', NULL), ('1995', NULL), ('1800', NULL), ('lost', 'no table'), ('bare', 'no column disco')) s(label, reason)
LEFT JOIN (SELECT key::VARCHAR AS label, count(*) AS n, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM yearly GROUP BY key) USING (label)
LEFT JOIN (SELECT key::VARCHAR AS label, sum(c1*(n0 - fp + c0/2)) AS u FROM run GROUP BY key) USING (label)""",
    **SCALED, probs=_PROBS, yearly=_YEARS9, run=_YRUN))
def _(t: Tables):
    """Five scenarios of a stored model, two of them broken and one without cells: results of the others, states of all."""
    cells, scaler, coefficients = _stated(t)
    store = _store(t)
    store.save(KEY, scaler, coefficients)
    of = lambda year: cells.join(t.disco.where(F.col("year") == year).select("row", "col", F.col("value").alias("disco")), ["row", "col"])
    result, status = apply_years(store, KEY, {"1994": of(1994), "1995": of(1995), "1800": of(1800), "lost": None, "bare": cells}, FEATURES)
    out = status.join(result.select("label", "n_disco", "n_nondisco", "auc"), "label", "left")
    return rounded(out, 6, "auc")


_WIDE = """SELECT (floor(row/2.5E0))::INT AS row, (floor(col/2.5E0))::INT AS col, round(max(sand)) AS awc FROM soil GROUP BY 1, 2"""
_AVERAGED = """
SELECT ty AS row, tx AS col, sum(w*value)/sum(w) AS disco FROM (
  SELECT value, tx, ty, (least((col+1)/2.5E0, tx+1) - greatest(col/2.5E0, tx)) * (least((row+1)/2.5E0, ty+1) - greatest(row/2.5E0, ty)) AS w
  FROM (SELECT *, unnest(range(floor(col/2.5E0)::INT, ceil((col+1)/2.5E0)::INT))::INT AS tx FROM
         (SELECT *, unnest(range(floor(row/2.5E0)::INT, ceil((row+1)/2.5E0)::INT))::INT AS ty FROM disco WHERE value IS NOT NULL)))
GROUP BY ty, tx"""
_BETWEEN = """
SELECT row, col, sum(w*value)/sum(w) AS heat FROM (
  SELECT t.row, t.col, s.value, CASE WHEN s.row = t.qr THEN 1 - t.fy ELSE t.fy END * CASE WHEN s.col = t.qc THEN 1 - t.fx ELSE t.fx END AS w
  FROM (SELECT row, col, floor(x)::INT AS qc, floor(y)::INT AS qr, x - floor(x) AS fx, y - floor(y) AS fy
        FROM (SELECT row, col, (col + .5E0)*62.5E0/250 - .5E0 AS x, (row + .5E0)*62.5E0/250 - .5E0 AS y FROM wide)) t
  JOIN (SELECT row, col, avg(tasmax) AS value FROM climate_daily GROUP BY row, col) s
    ON s.row BETWEEN t.qr AND t.qr + 1 AND s.col BETWEEN t.qc AND t.qc + 1)
GROUP BY row, col"""


@query("E3_cells_from_grids", sql("soil disco climate_daily", f"""
SELECT row, col, awc, {r('heat')} AS heat, CASE WHEN round(disco, 6) >= 4000 THEN 1 ELSE 0 END AS y
FROM wide JOIN averaged USING (row, col) JOIN heated USING (row, col) WHERE heat IS NOT NULL""", wide=_WIDE, averaged=_AVERAGED, heated=_BETWEEN))
def _(t: Tables):
    """Water on a 62.5 m grid, discoloration averaged from 25 m and heat interpolated from 250 m."""
    at = lambda c: F.floor(F.col(c) / 2.5).cast("int").alias(c)
    awc = t.soil.groupBy(at("row"), at("col")).agg(F.round(F.max("sand")).alias("value"))
    heat = t.climate.groupBy("row", "col").agg(F.avg("tasmax").alias("value"))
    cells = dsi.cells_from_grids(awc, COARSE, (t.disco.select("row", "col", "value"), SOIL_GRID), {"heat": (heat, CLIMATE_GRID)}, CONFIG)
    return rounded(cells.select("row", "col", "awc", "heat", "y"), 6, "heat")


@query("M10_apply_to_years")
def _(t: Tables):
    cells, scaler, coefficients = _stated(t)
    joined = cells.join(t.disco.select("row", "col", F.col("year").alias("label"), F.col("value").alias("disco")), ["row", "col"])
    return scoring.apply_to_years(joined, scaler, coefficients, FEATURES)


def _inputs(t: Tables):
    """Map of whole millimetres, discoloration, and mean sand as a covariate."""
    water = awc_of(t, "toth").where(F.col("depth") == "2m")
    awc = water.select("row", "col", F.when(encode_int16(F.col("awc_mm")) != -9999, encode_int16(F.col("awc_mm")).cast("double")).alias("value"))
    sand = t.soil.groupBy("row", "col").agg(F.avg("sand").alias("value"))
    return awc, t.disco.select("row", "col", "value"), sand


def _cells(t: Tables, covariate: bool = True):
    awc, disco, sand = _inputs(t)
    return dsi.model_cells(awc, disco, {"sand": sand} if covariate else {}, SOIL_GRID, CONFIG)


@query("M1_group_kfold")
def _(t: Tables):
    return group_kfold(_cells(t), CONFIG.outer_n_splits).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("block_id").alias("n_blocks"))


@query("M2_fit_logistic")
def _(t: Tables):
    cells = _cells(t)
    scaled = scaling.apply_scaler(cells, scaling.fit_scaler(cells, ["awc", "sand"]), ["awc", "sand"]).persist()
    intercept, (awc, sand) = fit_logistic(scaled, ["awc_z", "sand_z"], 1.0)
    scaled.unpersist()
    return t.spark.createDataFrame([("intercept", intercept), ("awc", awc), ("sand", sand)], "term string, coefficient double")


def _prepared(t: Tables, features):
    cells = _cells(t, covariate=len(features) > 1)
    plan = FoldPlan.build(block_sizes(cells), CONFIG.outer_n_splits, CONFIG.inner_n_splits)
    rows = cut_lineage(validation.prepare_rows(cells, features, plan))
    return plan, rows, validation.training_scales(rows, features, plan.n_outer)


@query("M3_fit_logistic_many")
def _(t: Tables):
    features = ["awc", "sand"]
    plan, rows, scales = _prepared(t, features)
    models = [Model(o, i, c) for o in range(plan.n_outer) for i in range(plan.n_inner(o)) for c in validation.candidate_penalties(CONFIG.n_iter)]
    fit_logistic_many(rows, models, features, scales)
    out = [(m.outer, m.inner, m.c, *map(float, m.weights)) for m in models]
    return t.spark.createDataFrame(out, "outer int, inner int, c double, intercept double, awc double, sand double")


@query("M4_random_search_c")
def _(t: Tables):
    features = ["awc"]
    plan, rows, scales = _prepared(t, features)
    best = validation.random_search_c(rows, plan, features, scales, n_iter=CONFIG.n_iter)
    return t.spark.createDataFrame(list(best.items()), "outer int, c double")


@query("M5_nested_spatial_cv")
def _(t: Tables):
    return validation.nested_spatial_cv(_cells(t), ["awc", "sand"], CONFIG.outer_n_splits, CONFIG.inner_n_splits, n_iter=CONFIG.n_iter).folds


@query("M11_fold_metrics_table")
def _(t: Tables):
    return validation.nested_spatial_cv(_cells(t, covariate=False), ["awc"], CONFIG.outer_n_splits, CONFIG.inner_n_splits, n_iter=CONFIG.n_iter).folds


@query("M6_fit_final")
def _(t: Tables):
    features = ["awc", "sand"]
    _, rows, scales = _prepared(t, features)
    model = validation.fit_final(rows, features, scales[ALL_CELLS], [0.1, 1.0, 10.0])
    return scoring.coefficient_table(t.spark, features, model)


@query("M8_run_dsi")
def _(t: Tables):
    awc, disco, _ = _inputs(t)
    result = dsi.run_dsi(awc, disco, None, SOIL_GRID, CONFIG)
    return t.spark.createDataFrame(dsi.metrics_rows(result), "parameter string, value string")


@query("M9_summarize_run")
def _(t: Tables):
    awc, disco, _ = _inputs(t)
    result = dsi.run_dsi(awc, disco, None, SOIL_GRID, CONFIG)
    return dsi.aggregate_summary([dsi.summarize_run(result, {"ptf": "toth", "depth": "2m"})])
