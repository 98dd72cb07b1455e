"""Queries comparing discolored and other cells."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.catalog import soil_sql as q
from gridspark.catalog.fixtures import Tables, sql
from gridspark.catalog.registry import query, rounded
from gridspark.catalog.soil import MAP_SQL, PROFILE, _maps_cte
from gridspark.catalog.soil_sql import r
from gridspark.operators import binned, class_stats, order_statistics, run_keys
from gridspark.operators.depth import unfold_maps
from gridspark.plans import soil_to_awc
from gridspark.session import shared_folder
from gridspark.sources import readers, writers
from gridspark.sources.writers import encode_int16

PTFS = tuple(MAP_SQL)
KEYS = ["dataset", "depth", "date"]

CTES = {
    **PROFILE, **{f"m_{n}": MAP_SQL[n] for n in PTFS}, "maps": _maps_cte({n: f"m_{n}" for n in PTFS}),
    "cells": """
SELECT ptf AS dataset, depth, year AS date, row, col, trunc(awc_mm)::DOUBLE AS awc_mm,
       CASE WHEN value >= 4000 THEN 1 ELSE 0 END AS cls
FROM maps JOIN disco USING (row, col) WHERE awc_mm IS NOT NULL AND value IS NOT NULL""",
}


def _sql(select: str, **more: str) -> str:
    return sql("soil layers disco", select, **CTES, **more)


def _maps_mm(wide, kept):
    """Maps of a cell as rows, in whole millimetres as they are stored."""
    rows = unfold_maps(wide, PTFS, kept).withColumnRenamed("ptf", "dataset")
    stored = encode_int16(F.col("awc_mm"))
    return rows.withColumn("awc_mm", F.when(stored != -9999, stored.cast("double")))


def cells_of(t: Tables):
    """Labelled cells of all ten functions, both depths and all years."""
    wide = soil_to_awc.wide_maps(t.profile, PTFS, members=t.heads, points=t.points)
    return class_stats.class_split(wide, t.disco.withColumnRenamed("year", "date"), unfold=_maps_mm)


@query("A12_class_split", _sql("SELECT dataset, depth, date, row, col, awc_mm, cls FROM cells"))
def _(t: Tables):
    return cells_of(t)


_RANKED = """
SELECT *, (sum(n) OVER (PARTITION BY dataset, depth, date ORDER BY awc_mm) - n) + (n + 1)/2E0 AS mid
FROM (SELECT dataset, depth, date, awc_mm, count(*) AS n, count(*) FILTER (cls = 0) AS c0, count(*) FILTER (cls = 1) AS c1
      FROM cells GROUP BY dataset, depth, date, awc_mm)"""

_RANKSUM = """
SELECT dataset, depth, date, sum(c0) AS n0, sum(c1) AS n1, sum(c0*mid) - sum(c0)*(sum(c0) + 1)/2E0 AS u,
       sum(pow(n::DOUBLE, 3) - n) AS ties FROM ranked GROUP BY dataset, depth, date"""

_Z = ("(greatest(u, n0*n1 - u) - n0*n1/2E0 - .5E0) / sqrt(n0*n1/12E0*((n0 + n1 + 1) - ties/((n0 + n1)*(n0 + n1 - 1E0))))")


@query("W3_mid_ranks", _sql("SELECT dataset, depth, date, awc_mm AS value, n, mid AS mid_rank FROM ranked", ranked=_RANKED))
def _(t: Tables):
    return order_statistics.mid_ranks(cells_of(t), KEYS, "awc_mm")


@query("A14_mann_whitney", _sql(
    f"SELECT dataset, depth, date, n0::BIGINT AS n_first, n1::BIGINT AS n_second, u, {r(_Z)} AS z FROM ranksum",
    ranked=_RANKED, ranksum=_RANKSUM))
def _(t: Tables):
    out = class_stats.mann_whitney(cells_of(t), KEYS, "awc_mm", "cls").drop("p_value")
    return rounded(out, 6, "z")


@query("A14_mann_whitney_p")
def _(t: Tables):
    return class_stats.mann_whitney(cells_of(t), KEYS, "awc_mm", "cls")


_EDGES = """
SELECT dataset, depth, date, v0, v1, i,
       CASE WHEN i = 199 THEN v1 ELSE v0 + i*((v1 - v0)/199E0) END AS lo,
       CASE WHEN i + 1 >= 199 THEN v1 ELSE v0 + (i + 1)*((v1 - v0)/199E0) END AS hi
FROM (SELECT dataset, depth, date, min(awc_mm) AS v0, max(awc_mm) AS v1, unnest(range(0, 199)) AS i FROM cells GROUP BY dataset, depth, date)"""
_HIST = """
SELECT e.dataset, e.depth, e.date, e.i, sum(c0) AS h0, sum(c1) AS h1 FROM ranked c JOIN edges e
  ON c.dataset = e.dataset AND c.depth = e.depth AND c.date = e.date AND c.awc_mm >= e.lo AND (c.awc_mm < e.hi OR (e.i = 198 AND c.awc_mm <= e.hi))
GROUP BY e.dataset, e.depth, e.date, e.i"""


@query("A15_overlap_coefficient", _sql(
    f"""SELECT dataset, depth, date, {r('sum(least(h0/n0, h1/n1))')} AS overlap_coeff
        FROM hist JOIN ranksum USING (dataset, depth, date) GROUP BY dataset, depth, date""",
    ranked=_RANKED, ranksum=_RANKSUM, edges=_EDGES, hist=_HIST))
def _(t: Tables):
    rows = order_statistics.running_counts(cells_of(t), KEYS, "awc_mm", order_statistics.class_measures("cls"))
    return rounded(class_stats.overlap_coefficient(rows, KEYS), 6, "overlap_coeff")


def _even(x: str) -> str:
    return f"round_even({x}, 4) + 0.0"


@query("A13_two_class_stats", _sql(
    f"""SELECT dataset, depth, date, n0::BIGINT AS n0, n1::BIGINT AS n1, {_even('md0')} AS median0, {_even('md1')} AS median1,
        {_even('mean0')} AS mean0, {_even('mean1')} AS mean1, {_even('iqr0')} AS iqr0, {_even('iqr1')} AS iqr1,
        {_even('md1 - md0')} AS median_diff, {_even('md1/nullif(md0, 0)')} AS median_ratio, u AS u_stat, round({_Z}, 6) + 0.0 AS z,
        {_even('1 - 2*u/(n0*n1)')} AS r_rb,
        {_even('(mean1 - mean0)/sqrt(((n0 - 1)*var0 + (n1 - 1)*var1)/(n0 + n1 - 2))')} AS cohens_d,
        {_even('u/(n0*n1)')} AS cles, {_even('overlap')} AS overlap_coeff, {_even('mean_all')} AS mean_awc, {_even('md_all')} AS median_awc
        FROM ranksum JOIN (SELECT dataset, depth, date, sum(least(h0/n0, h1/n1)) AS overlap FROM hist JOIN ranksum USING (dataset, depth, date)
                           GROUP BY dataset, depth, date) USING (dataset, depth, date)
        JOIN (SELECT dataset, depth, date, quantile_cont(awc_mm, .5) FILTER (cls = 0) AS md0, quantile_cont(awc_mm, .5) FILTER (cls = 1) AS md1,
                avg(awc_mm) FILTER (cls = 0) AS mean0, avg(awc_mm) FILTER (cls = 1) AS mean1,
                quantile_cont(awc_mm, .75) FILTER (cls = 0) - quantile_cont(awc_mm, .25) FILTER (cls = 0) AS iqr0,
                quantile_cont(awc_mm, .75) FILTER (cls = 1) - quantile_cont(awc_mm, .25) FILTER (cls = 1) AS iqr1,
                var_samp(awc_mm) FILTER (cls = 0) AS var0, var_samp(awc_mm) FILTER (cls = 1) AS var1,
                avg(awc_mm) AS mean_all, quantile_cont(awc_mm, .5) AS md_all
              FROM cells GROUP BY dataset, depth, date) USING (dataset, depth, date)""",
    ranked=_RANKED, ranksum=_RANKSUM, edges=_EDGES, hist=_HIST))
def _(t: Tables):
    return rounded(class_stats.two_class_stats(cells_of(t), with_p=False), 6, "z")


_BOX = """
SELECT dataset, depth, count(*) AS n, quantile_cont(awc_mm, .25) AS q1, quantile_cont(awc_mm, .5) AS median,
       quantile_cont(awc_mm, .75) AS q3 FROM cells GROUP BY dataset, depth"""


@query("A16_box_stats", _sql(
    f"""SELECT dataset, depth, n, {r('q1')} AS q1, {r('median')} AS median, {r('q3')} AS q3,
        count(*) FILTER (awc_mm < q1 - 1.5*(q3 - q1) OR awc_mm > q3 + 1.5*(q3 - q1)) AS n_outliers,
        min(awc_mm) FILTER (awc_mm >= q1 - 1.5*(q3 - q1)) AS whisker_lo, max(awc_mm) FILTER (awc_mm <= q3 + 1.5*(q3 - q1)) AS whisker_hi
        FROM cells JOIN box USING (dataset, depth) GROUP BY dataset, depth, n, q1, median, q3""", box=_BOX))
def _(t: Tables):
    out = class_stats.box_stats(cells_of(t), ["dataset", "depth"], "awc_mm")
    return rounded(out, 6, "q1", "median", "q3")


@query("A16_pooled_band", _sql(
    f"SELECT depth, {r('avg(awc_mm)')} AS overall_mean, {r('stddev_pop(awc_mm)')} AS overall_sd FROM cells GROUP BY depth"))
def _(t: Tables):
    return rounded(class_stats.pooled_band(cells_of(t), ["depth"], "awc_mm"), 6, "overall_mean", "overall_sd")


_SPAN = "SELECT depth, min(awc_mm) AS v0, max(awc_mm) AS v1 FROM cells GROUP BY depth"
_LIMITS = """
SELECT depth, i, v0 + i*((v1 - v0)/25E0) AS lo, CASE WHEN i = 24 THEN v1 ELSE v0 + (i + 1)*((v1 - v0)/25E0) END AS hi
FROM (SELECT *, unnest(range(0, 25)) AS i FROM span)"""
_BINS = """
SELECT c.dataset, c.depth, c.date, e.i::INT AS bin, (e.lo + e.hi)/2 AS center, count(*) FILTER (cls = 1) AS disc, count(*) AS total
FROM cells c JOIN limits e ON c.depth = e.depth AND c.awc_mm >= e.lo AND (c.awc_mm < e.hi OR (e.i = 24 AND c.awc_mm <= e.hi))
GROUP BY c.dataset, c.depth, c.date, e.i, e.lo, e.hi"""
_BINNED = {"span": _SPAN, "limits": _LIMITS, "bins": _BINS}


@query("A17_binned_proportion", _sql(
    f"SELECT dataset, depth, date, bin, {r('center')} AS center, disc, total, {r('disc/total')} AS prop FROM bins WHERE total >= 10", **_BINNED))
def _(t: Tables):
    return rounded(binned.binned_proportion(cells_of(t), min_pixels=10), 6, "center", "prop")


@query("A18_depth_scales", _sql(
    f"""SELECT depth, v0 AS lo, v1 AS hi, {r('least(1.0, 1.1E0*top)')} AS y_limit FROM span JOIN
        (SELECT depth, max(disc/total) FILTER (total >= 10) AS top FROM bins GROUP BY depth) USING (depth)""", **_BINNED))
def _(t: Tables):
    return rounded(binned.depth_scales(cells_of(t), min_pixels=10).select("depth", "lo", "hi", "y_limit"), 6, "y_limit")


_MEANS = """
SELECT depth, date, bin, center, avg(CASE WHEN total >= 10 THEN disc/total END) AS mean_prop,
       stddev_pop(CASE WHEN total >= 10 THEN disc/total END) AS sd_prop, count(CASE WHEN total >= 10 THEN 1 END) AS n_ptf,
       sum(total)::BIGINT AS pooled_total FROM bins GROUP BY depth, date, bin, center
HAVING count(CASE WHEN total >= 10 THEN 1 END) >= 2"""


@query("A19_mean_proportion_over_ptfs", _sql(
    f"SELECT depth, date, bin, {r('center')} AS center, {r('mean_prop')} AS mean_prop, {r('sd_prop')} AS sd_prop, n_ptf, pooled_total FROM means",
    **_BINNED, means=_MEANS))
def _(t: Tables):
    return rounded(binned.mean_proportion_over_ptfs(cells_of(t), min_pixels=10), 6, "center", "mean_prop", "sd_prop")


_RISK = f"""
SELECT dataset, depth, date, {r('q1_lo')} AS q1_lo, {r('q3_hi')} AS q3_hi, {r('p1')} AS q1_prop, {r('p2')} AS q2_prop, {r('p3')} AS q3_prop,
       n1::BIGINT AS q1_n, n2::BIGINT AS q2_n, n3::BIGINT AS q3_n, {r('p1/p3')} AS rr_q1_vs_q3, {r('p1/p2')} AS rr_q1_vs_q2,
       CASE WHEN k1 > 0 AND k3 > 0 THEN {r('exp(ln(p1/p3) - 1.959963984540054E0*sqrt(1/k1 - 1/n1 + 1/k3 - 1/n3))')} END AS rr_ci_lo,
       CASE WHEN k1 > 0 AND k3 > 0 THEN {r('exp(ln(p1/p3) + 1.959963984540054E0*sqrt(1/k1 - 1/n1 + 1/k3 - 1/n3))')} END AS rr_ci_hi,
       {r('p1 - p3')} AS arr_q1_vs_q3
FROM (SELECT *, k1/n1 AS p1, k2/n2 AS p2, k3/n3 AS p3 FROM (
  SELECT dataset, depth, date, min(center) AS q1_lo, max(center) AS q3_hi,
         sum(disc) FILTER (center <= a) AS k1, sum(total) FILTER (center <= a) AS n1,
         sum(disc) FILTER (center > a AND center <= b) AS k2, sum(total) FILTER (center > a AND center <= b) AS n2,
         sum(disc) FILTER (center > b) AS k3, sum(total) FILTER (center > b) AS n3
  FROM (SELECT * FROM bins WHERE total >= 10) JOIN
       (SELECT dataset, depth, date, quantile_cont(center, .25) AS a, quantile_cont(center, .75) AS b FROM bins WHERE total >= 10
        GROUP BY dataset, depth, date HAVING count(*) >= 4) USING (dataset, depth, date)
  GROUP BY dataset, depth, date))
WHERE p2 > 0 AND p3 > 0 AND n1 > 0"""


@query("A20_quartile_risk", _sql(_RISK, **_BINNED))
def _(t: Tables):
    bins = binned.binned_proportion(cells_of(t), min_pixels=10)
    out = binned.quartile_risk(bins, KEYS)
    floats = ["q1_lo", "q3_hi", "q1_prop", "q2_prop", "q3_prop", "rr_q1_vs_q3", "rr_q1_vs_q2", "rr_ci_lo", "rr_ci_hi", "arr_q1_vs_q3"]
    return rounded(out.select(*KEYS, "q1_n", "q2_n", "q3_n", *floats), 6, *floats)


_SLOPE = f"""
SELECT dataset, depth, date, m AS n_bins, {r('slope')} AS slope, {r('ym - slope*xm')} AS intercept,
       {r('sqrt(greatest(syy - slope*sxy, 0E0)/(m - 2)/sxx)')} AS slope_se, {r('exp(slope)')} AS or_per_unit, {r('exp(50*slope)')} AS or_per_50
FROM (SELECT *, sxy/sxx AS slope FROM (
  SELECT dataset, depth, date, count(*) AS m, max(xm) AS xm, max(ym) AS ym, sum(w*(x - xm)*(x - xm)) AS sxx,
         sum(w*(x - xm)*(y - ym)) AS sxy, sum(w*(y - ym)*(y - ym)) AS syy
  FROM (SELECT *, sum(w*x) OVER g/sum(w) OVER g AS xm, sum(w*y) OVER g/sum(w) OVER g AS ym
        FROM (SELECT dataset, depth, date, center AS x, ln(p/(1 - p)) AS y, total*p*(1 - p) AS w
              FROM (SELECT *, (disc + .5E0)/(total + 1E0) AS p FROM bins WHERE total >= 10))
        WINDOW g AS (PARTITION BY dataset, depth, date))
  GROUP BY dataset, depth, date HAVING count(*) >= 3))"""


@query("A21_weighted_logit_slope", _sql(_SLOPE, **_BINNED))
def _(t: Tables):
    bins = binned.binned_proportion(cells_of(t), min_pixels=10)
    out = binned.weighted_logit_slope(bins, KEYS, with_tests=False)
    return rounded(out, 6, "slope", "intercept", "slope_se", "or_per_unit", "or_per_50")


@query("A21_weighted_logit_slope_tests")
def _(t: Tables):
    bins = binned.binned_proportion(cells_of(t), min_pixels=10)
    return binned.weighted_logit_slope(bins, KEYS)


_KDE = """
SELECT depth, date, dataset, cls, i AS point, max(xx) AS x, sum(c*exp(-.5E0*pow((xx - v)/bw, 2)))/(max(n)*max(bw)*sqrt(2*pi())) AS density
FROM (SELECT c.depth, c.date, c.dataset, c.cls, c.v, c.c, s.n, s.bw, g.i, CASE WHEN g.i = 299 THEN g.b ELSE g.a + g.i*((g.b - g.a)/299E0) END AS xx
  FROM (SELECT depth, date, dataset, cls, awc_mm AS v, count(*) AS c FROM cells GROUP BY ALL) c
  JOIN (SELECT depth, date, dataset, cls, count(*) AS n, stddev_samp(awc_mm)*pow(count(*), -.2E0) AS bw FROM cells GROUP BY ALL
        HAVING count(*) > 1 AND var_pop(awc_mm) > 1E-6) s USING (depth, date, dataset, cls)
  JOIN (SELECT depth, unnest(range(0, 300))::INT AS i, v0 - .1E0*(v1 - v0) AS a, v1 + .1E0*(v1 - v0) AS b FROM span) g USING (depth))
GROUP BY depth, date, dataset, cls, i"""


@query("A22_kde_curve", _sql(
    f"""SELECT depth, date, cls, point, {r('max(x)', 5)} AS x, {r('avg(density)', 8)} AS mean_density, {r('stddev_pop(density)', 8)} AS sd_density, count(*) AS n_ptf,
        {r('greatest(avg(density) - stddev_pop(density), 0E0)', 8)} AS lower, {r('avg(density) + stddev_pop(density)', 8)} AS upper
        FROM kde GROUP BY depth, date, cls, point""", span=_SPAN, kde=_KDE))
def _(t: Tables):
    out = binned.mean_kde(binned.kde_curves(cells_of(t)))
    return rounded(rounded(out, 8, "mean_density", "sd_density", "lower", "upper"), 5, "x")


@query("A23_pixel_totals_by_date", _sql(
    f"""SELECT date, count(*) FILTER (cls = 0) AS not_discolored, count(*) FILTER (cls = 1) AS discolored, count(*) AS total,
        {r('100E0*count(*) FILTER (cls = 1)/count(*)')} AS pct_discolored FROM cells GROUP BY date"""))
def _(t: Tables):
    return rounded(binned.pixel_totals_by_date(cells_of(t)), 6, "pct_discolored")


@query("A23_pixel_totals_rollup", _sql(
    f"""SELECT depth, date, grouping(depth, date)::INT AS level, count(*) FILTER (cls = 0) AS not_discolored, count(*) FILTER (cls = 1) AS discolored,
        count(*) AS total, {r('100E0*count(*) FILTER (cls = 1)/count(*)')} AS pct_discolored FROM cells GROUP BY ROLLUP (depth, date)"""))
def _(t: Tables):
    return rounded(binned.pixel_totals_rollup(cells_of(t)), 6, "pct_discolored")


@query("S9_summary_csv", _sql(
    f"""SELECT dataset, depth, date, n0::BIGINT AS n0, n1::BIGINT AS n1, {_even('md0')} AS median0, {_even('md1')} AS median1,
        {_even('1 - 2*u/(n0*n1)')} AS r_rb, {_even('u/(n0*n1)')} AS cles FROM ranksum
        JOIN (SELECT dataset, depth, date, quantile_cont(awc_mm, .5) FILTER (cls = 0) AS md0, quantile_cont(awc_mm, .5) FILTER (cls = 1) AS md1
              FROM cells GROUP BY dataset, depth, date) USING (dataset, depth, date)""", ranked=_RANKED, ranksum=_RANKSUM))
def _(t: Tables):
    """The summary as a file has it: written, listed and read again, in the order of its columns and rows."""
    stats = class_stats.two_class_stats(cells_of(t), with_p=False)
    columns = [*KEYS, "n0", "n1", "median0", "median1", "r_rb", "cles"]
    path = f"{shared_folder(t.spark)}/summary-{uuid.uuid4().hex}"
    writers.write_summary_csv(stats, path, columns, "r_rb")
    return readers.read_summary_csv(t.spark, path, stats.select(*columns).schema)


@query("W4_sort_summary", _sql(
    "SELECT dataset, depth, date, round_even(1 - 2*u/(n0*n1), 4) + 0.0 AS r_rb FROM ranksum ORDER BY abs(1 - 2*u/(n0*n1)) DESC",
    ranked=_RANKED, ranksum=_RANKSUM))
def _(t: Tables):
    stats = class_stats.two_class_stats(cells_of(t), with_p=False)
    return order_statistics.by_magnitude(stats.select(*KEYS, (F.col("r_rb") + F.lit(0.0)).alias("r_rb")), "r_rb")


@query("W5_sample_cap")
def _(t: Tables):
    return order_statistics.sample_cap(cells_of(t), ["dataset", "depth"], 3000, ["row", "col", "date"])


# Already computed: every combination except the weynants maps.
_DONE = "SELECT DISTINCT dataset, depth, date::VARCHAR AS date FROM cells WHERE dataset <> 'weynants'"
_MISSING = """
SELECT a.dataset, b.depth, c.date FROM (SELECT DISTINCT dataset FROM done UNION SELECT 'weynants') a
CROSS JOIN (SELECT DISTINCT depth FROM done) b CROSS JOIN (SELECT DISTINCT date FROM done) c"""


def _done(t: Tables):
    cells = cells_of(t)
    return cells, cells.where(F.col("dataset") != "weynants").select(*KEYS)


@query("J6_missing_keys", _sql("SELECT * FROM missing EXCEPT SELECT * FROM done", done=_DONE, missing=_MISSING))
def _(t: Tables):
    _, done = _done(t)
    return run_keys.missing_keys(done, {"dataset": ["weynants"]})


@query("U3_key_difference", _sql("SELECT * FROM missing EXCEPT SELECT * FROM done", done=_DONE, missing=_MISSING))
def _(t: Tables):
    _, done = _done(t)
    names = done.select(*[F.col(k).cast("string").alias(k) for k in KEYS]).distinct()
    return run_keys.requested_keys(names, {"dataset": ["weynants"]}).exceptAll(names)


@query("S10_append_incremental", _sql(
    f"SELECT dataset, depth, date::VARCHAR AS date, count(*) AS n, {r('avg(awc_mm)')} AS mean_awc FROM cells GROUP BY dataset, depth, date"))
def _(t: Tables):
    cells, done = _done(t)
    keyed = cells.withColumn("date", F.col("date").cast("string"))
    stats = lambda c: c.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg("awc_mm").alias("mean_awc"))
    stored = stats(keyed.where(F.col("dataset") != "weynants"))
    added = lambda todo: stats(keyed.join(todo, KEYS, "left_semi"))
    return rounded(run_keys.append_incremental(stored, {"dataset": ["weynants"]}, added), 6, "mean_awc")


@query("U2_union_columns", _sql(
    f"""SELECT depth, date::VARCHAR AS date, count(*) AS n, {r('avg(awc_mm)')} AS mean_awc, NULL::BIGINT AS n_disc FROM cells WHERE depth = '1m' GROUP BY depth, date
        UNION ALL SELECT depth, date::VARCHAR, count(*), NULL, sum(cls)::BIGINT FROM cells WHERE depth = '2m' GROUP BY depth, date"""))
def _(t: Tables):
    cells = cells_of(t).withColumn("date", F.col("date").cast("string"))
    one = cells.where(F.col("depth") == "1m").groupBy("depth", "date").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("awc_mm"), 6).alias("mean_awc"))
    two = cells.where(F.col("depth") == "2m").groupBy("depth", "date").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cls").alias("n_disc"))
    return run_keys.union_columns([one, two])
