"""Queries over soil profiles: functions, retention, depth integration, encodings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridspark.catalog import soil_sql as q
from gridspark.catalog.fixtures import CELL_UNITS, Tables, plain, sql
from gridspark.catalog.registry import log6, query, rounded
from gridspark.functions.names import parse_depth_range, parse_run_key
from gridspark.models import forest
from gridspark.operators import depth, ensemble, order_statistics, run_keys, soil
from gridspark.plans import soil_to_awc
from gridspark.session import shared_folder
from gridspark.sources import readers, writers

ID = ["row", "col", "layer"]
PROFILE = {"profile": q.PROFILE}


def _sql(select: str, **ctes: str) -> str:
    return sql("soil layers", select, **PROFILE, **ctes)


# --- pedotransfer functions ---------------------------------------------------

@query("P1_schoch", _sql(
    f"SELECT row, col, layer, {q.r('ths')} AS ths, {q.r('thr')} AS thr, {q.log6('alpha')} AS ln_alpha, {q.r('n')} AS n, "
    f"{q.r('tau')} AS tau, {q.log6('ksat')} AS ln_ksat FROM fitted", fitted=q.SCHOCH))
def _(t: Tables):
    out = soil.ptf_schoch(t.soil)
    return rounded(out.select(*ID, "ths", "thr", log6("alpha").alias("ln_alpha"), "n", "tau",
                              log6("ksat").alias("ln_ksat")), 6, "ths", "thr", "n", "tau")


def _retention(df):
    return rounded(df.select(*ID, "ths", "thr", log6("alpha").alias("ln_alpha"), "n"), 6, "ths", "thr", "n")


_RETENTION_SQL = (f"SELECT row, col, layer, {q.r('ths')} AS ths, {q.r('thr')} AS thr, "
                  f"{q.log6('alpha')} AS ln_alpha, {q.r('n')} AS n FROM fitted")


@query("P2_wosten", _sql(_RETENTION_SQL, fitted=q.WOSTEN))
def _(t: Tables):
    return _retention(soil.ptf_wosten(t.profile))


@query("P3_weynants", _sql(_RETENTION_SQL, fitted=q.WEYNANTS))
def _(t: Tables):
    return _retention(soil.ptf_weynants(t.soil))


@query("P4_puhlmann", _sql(_RETENTION_SQL, fitted=q.PUHLMANN))
def _(t: Tables):
    return _retention(soil.ptf_puhlmann(t.soil))


@query("P5_teepe", _sql(_RETENTION_SQL, fitted=q.TEEPE))
def _(t: Tables):
    return _retention(soil.ptf_teepe(t.soil))


@query("P5_teepe_direct", _sql(
    f"SELECT row, col, layer, {q.r('silt', 10)} AS silt, {q.r('awc_direct', 10)} AS awc_vol FROM fitted", fitted=q.TEEPE))
def _(t: Tables):
    return rounded(soil.ptf_teepe(t.soil, awc_direct=True).select(*ID, "silt", "awc_vol"), 10, "silt", "awc_vol")


@query("P6_toth", _sql(
    f"SELECT row, col, layer, {q.r('fc', 10)} AS fc, {q.r('wp', 10)} AS wp, {q.r('awc_vol', 10)} AS awc_vol, {q.r('silt', 10)} AS silt "
    "FROM fitted", fitted=q.TOTH))
def _(t: Tables):
    return rounded(soil.ptf_toth(t.soil).select(*ID, "fc", "wp", "awc_vol", "silt"), 10, "fc", "wp", "awc_vol", "silt")


_SAXTON_SQL = (f"SELECT row, col, layer, {q.r('wp', 10)} AS wp, {q.r('fc', 10)} AS fc, {q.r('sat', 10)} AS sat, "
               f"{q.r('awc_vol', 10)} AS awc_vol FROM fitted")


@query("P7_saxton_rawls", _sql(_SAXTON_SQL, fitted=q.saxton()))
def _(t: Tables):
    return rounded(soil.ptf_saxton_rawls(t.soil).select(*ID, "wp", "fc", "sat", "awc_vol"), 10,
                   "wp", "fc", "sat", "awc_vol")


@query("P7_saxton_rawls_dense", _sql(_SAXTON_SQL, fitted=q.saxton(1.1)))
def _(t: Tables):
    return rounded(soil.ptf_saxton_rawls(t.soil, density_factor=1.1).select(*ID, "wp", "fc", "sat", "awc_vol"), 10,
                   "wp", "fc", "sat", "awc_vol")


@query("P8_classify_ka5", _sql("SELECT row, col, layer, ka5 FROM classed", classed=q.KA5))
def _(t: Tables):
    return soil.classify_ka5(soil.derive_silt(t.soil, clip=False)).select(*ID, "ka5")


@query("J5_classify_ka5_range_join", _sql("SELECT row, col, layer, ka5 FROM classed", classed=q.KA5))
def _(t: Tables):
    return soil.classify_ka5_by_join(soil.derive_silt(t.soil, clip=False)).select(*ID, "ka5")


def _classed(t: Tables):
    return soil.classify_ka5(soil.derive_silt(t.soil, clip=False))


@query("P9_wessolek", _sql(
    "SELECT row, col, layer, ths, thr + 0E0 AS thr, alpha, n FROM classed LEFT JOIN lut USING (ka5)",
    classed=q.KA5, lut=q.LUT))
def _(t: Tables):
    return soil.ptf_wessolek(_classed(t)).select(*ID, "ths", "thr", "alpha", "n")


@query("J4_lookup_join", _sql(
    f"SELECT ka5, count(*) AS n_layers, {q.r('avg(alpha)')} AS alpha, {q.r('avg(n)')} AS n "
    "FROM classed LEFT JOIN lut USING (ka5) GROUP BY ka5", classed=q.KA5, lut=q.LUT))
def _(t: Tables):
    out = soil.ptf_wessolek(_classed(t)).groupBy("ka5").agg(
        F.count(F.lit(1)).alias("n_layers"), F.avg("alpha").alias("alpha"), F.avg("n").alias("n"))
    return rounded(out, 6, "alpha", "n")


@query("P10_score_ensemble", _sql(
    f"""SELECT row, col, layer, {q.r('avg(bias + w_sand*sand + w_clay*clay + w_trd*trd)')} AS ths,
        {q.r('pow(10, avg(-bias + w_sand*sand - w_clay*clay + w_trd*trd))')} AS alpha
        FROM profile CROSS JOIN members GROUP BY row, col, layer""",
    members="SELECT n_nationkey AS member, (n_nationkey % 5 - 2) * 0.001E0 AS w_sand, "
            "(n_nationkey % 7 - 3) * 0.0007E0 AS w_clay, (n_nationkey % 3 - 1) * 0.02E0 AS w_trd, "
            "0.4E0 + n_nationkey * 0.002E0 AS bias FROM nation"))
def _(t: Tables):
    m = t.members
    heads = m.select("member", F.lit("ths").alias("output"), F.array("w_sand", "w_clay", "w_trd").alias("weights"),
                     "bias").unionByName(
        m.select("member", F.lit("alpha").alias("output"),
                 F.array(F.col("w_sand"), -F.col("w_clay"), F.col("w_trd")).alias("weights"),
                 (-F.col("bias")).alias("bias")))
    out = ensemble.score_ensemble(t.soil.select(*ID, "sand", "clay", "trd"), heads, ["sand", "clay", "trd"],
                                  ["ths", "alpha"], log10_outputs=["alpha"])
    return rounded(out.select(*ID, "ths", "alpha"), 6, "ths", "alpha")


@query("P11_normalize_texture", _sql(
    f"""SELECT row, col, layer, {q.r('100*sand/total', 10)} AS sand, {q.r('100*silt/total', 10)} AS silt,
        {q.r('100*clay/total', 10)} AS clay
        FROM (SELECT *, greatest(sand + silt + clay, 1E0) AS total
              FROM (SELECT *, least(greatest(100E0 - sand - clay, 0E0), 100E0) AS silt FROM profile))"""))
def _(t: Tables):
    out = soil.normalize_texture(soil.derive_silt(t.soil))
    return rounded(out.select(*ID, "sand", "silt", "clay"), 10, "sand", "silt", "clay")


@query("P12_point_ptf", _sql(
    f"""SELECT row, col, layer, {q.r('v', 9)} AS awc_vol,
        {q.r('v * (1 - coalesce(gravel, 0)/100) * thick_mm', 9)} AS layer_awc_mm
        FROM (SELECT *, least(greatest(fc - wp, 0E0), .8E0) AS v FROM fitted)""", fitted=q.TOTH))
def _(t: Tables):
    predicted = soil.ptf_toth(t.profile).drop("awc_vol")
    out = soil.awc_from_point_ptf(predicted).select(*ID, "awc_vol", "layer_awc_mm")
    return rounded(out, 9, "awc_vol", "layer_awc_mm")


# Two stages of two splits: what a forest of full trees on the four corners must say, whatever the order of its splits.
_CORNERS = "CASE WHEN sand <= 40 THEN 0.21E0 ELSE 0.13E0 END + CASE WHEN clay <= 25 THEN 0.05E0 ELSE 0.16E0 END"


def _stored_forests(t: Tables, samples, name: str, **settings):
    """Forests fitted, stored and loaded again."""
    folder = f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"
    forest.store_forests(forest.fit_point_forests(samples, **settings), folder)
    return forest.load_forests(folder)


@query("P12_stated_forest", _sql(
    f"""SELECT row, col, layer, {q.r('fc')} AS fc, {q.r('wp')} AS wp, {q.r('least(greatest(fc - wp, 0E0), .8E0)')} AS awc_vol,
        {q.r('least(greatest(fc - wp, 0E0), .8E0) * (1 - coalesce(gravel, 0)/100) * thick_mm')} AS layer_awc_mm
        FROM (SELECT *, {_CORNERS} AS fc, ({_CORNERS}) * 0.4E0 AS wp FROM profile)"""))
def _(t: Tables):
    """Two trees that are known in advance: the samples take four values, 20 on either side of each split."""
    side = lambda c, at: F.when(F.col(c) <= at, at - 20.0).otherwise(at + 20.0).alias(c)
    corners = t.soil.select(side("sand", 40.0), side("clay", 25.0)).distinct()
    fc = F.when(F.col("sand") <= 40, 0.21).otherwise(0.13) + F.when(F.col("clay") <= 25, 0.05).otherwise(0.16)
    samples = corners.withColumns({"fc": fc, "wp": fc * 0.4})
    forests = _stored_forests(t, samples, "stated", features=("sand", "clay"), n_trees=2, max_depth=2, bootstrap=False,
                              featureSubsetStrategy="all")
    out = forest.awc_from_forests(t.profile, forests, ("sand", "clay"))
    return rounded(out.select(*ID, "fc", "wp", "awc_vol", "layer_awc_mm"), 6, "fc", "wp", "awc_vol", "layer_awc_mm")


@query("P12_fitted_forest")
def _(t: Tables):
    """Forests learned from all profiles, with the water contents of another function as measured ones."""
    measured = soil.ptf_toth(t.profile).select("sand", "clay", "soc", "trd", "fc", "wp")
    out = forest.awc_from_forests(t.profile, _stored_forests(t, measured, "fitted", n_trees=10))
    return rounded(out.select(*ID, "fc", "wp", "awc_vol", "layer_awc_mm"), 6, "fc", "wp", "awc_vol", "layer_awc_mm")


@query("P13_mvg_theta", _sql(
    f"SELECT row, col, layer, {q.r(q.theta(330))} AS theta FROM fitted", fitted=q.SCHOCH))
def _(t: Tables):
    return rounded(soil.mvg_theta(soil.ptf_schoch(t.soil), 330.0).select(*ID, "theta"), 6, "theta")


@query("P14_awc_vol_mvg", _sql(
    f"SELECT row, col, layer, {q.r('w')} AS fc_vol, {q.r('d')} AS pwp_vol, {q.r('w - d')} AS awc_vol "
    f"FROM (SELECT *, {q.theta(330)} AS w, {q.theta(16000)} AS d FROM fitted)", fitted=q.WOSTEN))
def _(t: Tables):
    out = soil.awc_vol_mvg(soil.ptf_wosten(t.profile)).select(*ID, "fc_vol", "pwp_vol", "awc_vol")
    return rounded(out, 6, "fc_vol", "pwp_vol", "awc_vol")


@query("P15_derive_silt", _sql(
    "SELECT row, col, layer, round(least(greatest(100E0 - sand - clay, 0E0), 100E0), 6) + 0.0 AS silt, "
    "round(100E0 - sand - clay, 6) + 0.0 AS silt_raw FROM profile"))
def _(t: Tables):
    raw = soil.derive_silt(t.soil, clip=False).withColumnRenamed("silt", "silt_raw")
    return rounded(soil.derive_silt(raw).select(*ID, "silt", "silt_raw"), 6, "silt", "silt_raw")


@query("P22_parse_run_key", """
SELECT ptf, grp, date, display, label, count(*) AS n FROM (
  SELECT CASE WHEN hit THEN regexp_extract(name, '^proportion_(.*)_(1m|2m|mrd)_(\\d{4}-\\d{2}-\\d{2})\\.png', 1) END AS ptf,
         CASE WHEN hit THEN regexp_extract(name, '^proportion_(.*)_(1m|2m|mrd)_(\\d{4}-\\d{2}-\\d{2})\\.png', 2) END AS grp,
         CASE WHEN hit THEN regexp_extract(name, '^proportion_(.*)_(1m|2m|mrd)_(\\d{4}-\\d{2}-\\d{2})\\.png', 3) END AS date,
         CASE WHEN NOT hit THEN NULL WHEN l_returnflag = 'A' THEN 'Zhang and Schaap' WHEN l_returnflag = 'N' THEN 'Toth'
              ELSE 'Saxton' END AS display,
         CASE WHEN NOT hit THEN NULL WHEN l_returnflag = 'A' THEN 'zhang' WHEN l_returnflag = 'N' THEN 'toth'
              ELSE 'saxton' END AS label
  FROM (SELECT *, regexp_matches(name, '^proportion_(.*)_(1m|2m|mrd)_(\\d{4}-\\d{2}-\\d{2})\\.png') AS hit FROM (
    SELECT l_returnflag, CASE WHEN l_linestatus = 'O' THEN 'proportion_' ELSE 'proportion_x' END ||
      CASE WHEN l_returnflag = 'A' THEN 'zhang_and_schaap' WHEN l_returnflag = 'N' THEN 'toth' ELSE 'saxton' END || '_' ||
      CASE WHEN l_linenumber <= 3 THEN '1m' WHEN l_linenumber <= 5 THEN '2m' WHEN l_linenumber = 6 THEN 'mrd' ELSE '3m' END ||
      '_' || strftime(l_shipdate, '%Y-%m-%d') || '.png' AS name FROM lineitem WHERE l_linestatus = 'O'
    UNION ALL
    SELECT l_returnflag, CASE WHEN l_linenumber <= 3 THEN 'overview_' ELSE 'proportion-' END || strftime(l_shipdate, '%Y-%m-%d') || '.png'
      FROM lineitem WHERE l_linestatus <> 'O')))
GROUP BY ALL""")
def _(t: Tables):
    item = t.raw("lineitem")
    flag, line, day = F.col("l_returnflag"), F.col("l_linenumber"), F.date_format("l_shipdate", "yyyy-MM-dd")
    function = F.when(flag == "A", "zhang_and_schaap").when(flag == "N", "toth").otherwise("saxton")
    group = F.when(line <= 3, "1m").when(line <= 5, "2m").when(line == 6, "mrd").otherwise("3m")
    other = F.when(line <= 3, "overview_").otherwise("proportion-")
    name = F.when(F.col("l_linestatus") == "O",
                  F.concat(F.lit("proportion_"), function, F.lit("_"), group, F.lit("_"), day, F.lit(".png"))
                  ).otherwise(F.concat(other, day, F.lit(".png")))
    keys = parse_run_key(F.col("name"))
    return (item.select(name.alias("name")).withColumns(keys)
            .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


@query("P23_parse_depth_range", _sql(
    "SELECT row, col, layer, upper_cm, lower_cm, thick_mm FROM profile"))
def _(t: Tables):
    named = t.profile.select(*ID, F.concat_ws("_", "upper_cm", "lower_cm").alias("depth_range"))
    return named.withColumns(parse_depth_range(F.col("depth_range"))).drop("depth_range")


# --- depth integration ----------------------------------------------------------

_MM = "awc_vol * (1 - gravel/100) * thick_mm"
_TOTH_MM = f"SELECT *, {_MM} AS mm FROM ({q.TOTH})"


def _toth_layers(t: Tables):
    return depth.layer_awc_mm(soil.ptf_toth(t.profile))


@query("A1_layer_awc_mm", _sql(f"SELECT row, col, layer, {q.r('mm', 9)} AS layer_awc_mm FROM fitted", fitted=_TOTH_MM))
def _(t: Tables):
    return rounded(_toth_layers(t).select(*ID, "layer_awc_mm"), 9, "layer_awc_mm")


@query("A2_awc_2m", _sql(f"SELECT row, col, {q.r('sum(mm)', 9)} AS awc_2m FROM fitted GROUP BY row, col", fitted=_TOTH_MM))
def _(t: Tables):
    return rounded(depth.awc_totals(_toth_layers(t)).select("row", "col", "awc_2m"), 9, "awc_2m")


@query("A3_awc_1m", _sql(
    f"SELECT row, col, {q.r('sum(CASE WHEN upper_cm < 100 THEN mm END)', 9)} AS awc_1m FROM fitted GROUP BY row, col",
    fitted=_TOTH_MM))
def _(t: Tables):
    return rounded(depth.awc_totals(_toth_layers(t)).select("row", "col", "awc_1m"), 9, "awc_1m")


# The check builds the full cube (every cell has all six layers) first.
_CUBE = """
SELECT c.row, c.col, l.upper_cm, l.lower_cm, l.thick_mm, f.mm
FROM (SELECT DISTINCT row, col FROM soil) c CROSS JOIN layers l
LEFT JOIN fitted f ON f.row = c.row AND f.col = c.col AND f.upper_cm = l.upper_cm"""


def _above(d: str) -> str:
    return (f"CASE WHEN {d} >= lower_cm THEN mm WHEN {d} > upper_cm THEN mm / thick_mm * ({d} - upper_cm) * 10 ELSE 0 END")


@query("A4_awc_to_depth", _sql(
    f"SELECT row, col, {q.r('sum(' + _above('45E0') + ')', 9)} AS awc_mm FROM cube GROUP BY row, col",
    fitted=_TOTH_MM, cube=_CUBE))
def _(t: Tables):
    return rounded(depth.awc_to_depth(_toth_layers(t), 45.0), 9, "awc_mm")


@query("A5_awc_mrd", sql("soil layers mrd",
    f"""SELECT row, col, mrd_cm, CASE WHEN mrd_cm IS NOT NULL THEN {q.r('sum(' + _above('mrd_cm') + ')', 9)} END AS awc_mrd
        FROM cube LEFT JOIN mrd USING (row, col) GROUP BY row, col, mrd_cm""", **PROFILE, fitted=_TOTH_MM, cube=_CUBE))
def _(t: Tables):
    return rounded(depth.awc_to_rooting_depth(_toth_layers(t), t.mrd), 9, "awc_mrd")


@query("A5_awc_mrd_strict", sql("soil layers mrd",
    f"""SELECT row, col, mrd_cm, {q.r("sum(CASE WHEN mrd_cm > upper_cm THEN (" + _above('mrd_cm') + ") END)", 9)} AS awc_mrd
        FROM cube LEFT JOIN mrd USING (row, col) GROUP BY row, col, mrd_cm""", **PROFILE, fitted=_TOTH_MM, cube=_CUBE))
def _(t: Tables):
    return rounded(depth.awc_to_rooting_depth(_toth_layers(t), t.mrd, strict_nulls=True), 9, "awc_mrd")


@query("J7_layer_rooting_depth", sql("soil layers mrd", """
SELECT row, col, layer, mrd_cm >= lower_cm AS full_layer, mrd_cm > upper_cm AND mrd_cm < lower_cm AS cut_layer
FROM profile JOIN mrd USING (row, col)""", **PROFILE))
def _(t: Tables):
    joined = t.profile.join(t.mrd, ["row", "col"])
    d = F.col("mrd_cm")
    return joined.select(*ID, (d >= F.col("lower_cm")).alias("full_layer"),
                         ((d > F.col("upper_cm")) & (d < F.col("lower_cm"))).alias("cut_layer"))


# --- maps of several functions ---------------------------------------------------

def _maps_cte(names: dict[str, str]) -> str:
    parts = []
    for name, relation in names.items():
        # Points predicted elsewhere take missing gravel as none.
        mm = _MM.replace("gravel", "coalesce(gravel, 0)") if name == "szabo" else _MM
        parts.append(f"SELECT '{name}' AS ptf, '1m' AS depth, row, col, "
                     f"sum(CASE WHEN upper_cm < 100 THEN {mm} END) AS awc_mm FROM {relation} GROUP BY row, col")
        parts.append(f"SELECT '{name}' AS ptf, '2m' AS depth, row, col, sum({mm}) AS awc_mm FROM {relation} GROUP BY row, col")
    return "\nUNION ALL\n".join(parts)


def _mvg(text: str) -> str:
    return f"SELECT *, {q.theta(330)} - {q.theta(16000)} AS awc_vol FROM ({text})"


# Every member scores every layer; means are taken in the members' own space.
_MEAN = "avg(bias + w_sand*sd + w_silt*si + w_clay*cl + w_trd*trd) FILTER (output = '{}')"
_ZHANG = f"""
SELECT p.*, thr, ths, alpha, n FROM profile p JOIN (
  SELECT row, col, layer, {_MEAN.format('thr')} AS thr, {_MEAN.format('ths')} AS ths,
         pow(10, {_MEAN.format('alpha')}) AS alpha, pow(10, {_MEAN.format('n')}) AS n
  FROM (SELECT row, col, layer, trd, 100*sand/total AS sd, 100*silt/total AS si, 100*clay/total AS cl
        FROM (SELECT *, greatest(sand + silt + clay, 1E0) AS total
              FROM (SELECT *, least(greatest(100E0 - sand - clay, 0E0), 100E0) AS silt FROM profile)))
  CROSS JOIN ({plain('heads')}) GROUP BY row, col, layer) USING (row, col, layer)"""
_SZABO = f"""
SELECT p.*, CASE WHEN sand + clay + trd + fc - wp IS NOT NULL THEN least(greatest(fc - wp, 0E0), .8E0) END AS awc_vol
FROM profile p LEFT JOIN ({plain('points')}) USING (row, col, layer)"""

MAP_SQL = {
    "schoch": _mvg(q.SCHOCH), "wosten": _mvg(q.WOSTEN), "weynants": _mvg(q.WEYNANTS), "puhlmann": _mvg(q.PUHLMANN),
    "teepe": _mvg(q.TEEPE), "toth": q.TOTH, "saxton": q.saxton(),
    "wessolek": _mvg(f"SELECT * FROM ({q.KA5}) LEFT JOIN ({q.LUT}) USING (ka5)"), "zhang": _mvg(_ZHANG), "szabo": _SZABO,
}
_ALL = {f"m_{n}": text for n, text in MAP_SQL.items()}


def awc_of(t: Tables, *names: str):
    """(ptf, depth, row, col, awc_mm) of the named functions, or of all ten."""
    return soil_to_awc.all_maps(t.profile, names or tuple(MAP_SQL), members=t.heads, points=t.points)


@query("U1_stack_awc_maps", _sql(
    f"SELECT ptf, depth, row, col, {q.r('awc_mm', 5)} AS awc_mm FROM maps",
    **_ALL, maps=_maps_cte({n: f"m_{n}" for n in MAP_SQL})))
def _(t: Tables):
    return rounded(awc_of(t), 5, "awc_mm")


@query("A6_ptf_ensemble", _sql(
    f"""SELECT depth, row, col, {q.r('avg(awc_mm)', 5)} AS awc_mean, {q.r('stddev_pop(awc_mm)', 5)} AS awc_sd
        FROM maps GROUP BY depth, row, col
        HAVING count(awc_mm) = (SELECT count(DISTINCT ptf) FROM maps)""",
    **_ALL, maps=_maps_cte({n: f"m_{n}" for n in MAP_SQL})))
def _(t: Tables):
    return rounded(ensemble.ptf_ensemble(awc_of(t)), 5, "awc_mean", "awc_sd")


@query("A6_ensemble_from_profiles", _sql(
    f"""SELECT depth, row, col, {q.r('avg(awc_mm)', 5)} AS awc_mean, {q.r('stddev_pop(awc_mm)', 5)} AS awc_sd
        FROM maps GROUP BY depth, row, col
        HAVING count(awc_mm) = (SELECT count(DISTINCT ptf) FROM maps)""",
    **_ALL, maps=_maps_cte({n: f"m_{n}" for n in MAP_SQL})))
def _(t: Tables):
    return rounded(soil_to_awc.ensemble_maps(t.profile, tuple(MAP_SQL), members=t.heads, points=t.points), 5, "awc_mean", "awc_sd")


@query("U4_exclude_names", _sql(
    "SELECT ptf, depth, count(*) AS n_cells FROM maps WHERE ptf NOT IN ('toth') GROUP BY ptf, depth",
    m_toth=MAP_SQL["toth"], m_saxton=MAP_SQL["saxton"], m_weynants=MAP_SQL["weynants"],
    maps=_maps_cte({n: f"m_{n}" for n in ("toth", "saxton", "weynants")})))
def _(t: Tables):
    kept = run_keys.exclude(awc_of(t, "toth", "saxton", "weynants"), "ptf", ["toth"])
    return kept.groupBy("ptf", "depth").agg(F.count(F.lit(1)).alias("n_cells"))


# --- sources and sinks -----------------------------------------------------------

@query("S1_load_soil_cube", _sql(
    "SELECT row, col, layer, sand, clay, gravel, trd, soc, upper_cm, lower_cm, thick_mm FROM profile"))
def _(t: Tables):
    variables = list(readers.SOIL_VARIABLES)
    long = t.soil.select(*ID, *variables).unpivot(ID, variables, "var", "value")
    return readers.pivot_soil(long).select(*ID, *variables, "upper_cm", "lower_cm", "thick_mm")


@query("J2_merge_variables", _sql(
    "SELECT row, col, layer, sand, clay, soc FROM profile"))
def _(t: Tables):
    part = lambda v: t.soil.select(*ID, v)
    return part("sand").join(part("clay"), ID, "full").join(part("soc"), ID, "full")


@query("S2_load_mrd", sql("soil mrd", """
SELECT row, col, CASE WHEN d > 0 THEN d END AS mrd_cm FROM (
  SELECT s.row, s.col, m.d FROM (SELECT DISTINCT row, col FROM soil) s
  LEFT JOIN (SELECT row, col, mrd_cm - 25 AS d FROM mrd) m USING (row, col))"""))
def _(t: Tables):
    shifted = t.mrd.withColumn("mrd_cm", F.col("mrd_cm") - 25)
    cells = t.soil.select("row", "col").distinct()
    return readers.load_mrd(shifted, CELL_UNITS, cells, CELL_UNITS)


@query("S4_read_cells", sql("soil", """
SELECT row, col, layer, CASE WHEN clay <> 33 THEN clay END AS value FROM soil WHERE clay <> 33"""))
def _(t: Tables):
    return readers.clean_cells(t.soil.select(*ID, F.col("clay").alias("value")), nodata=33, drop_missing=True)


@query("S5_class_parameters", _sql(
    "SELECT classed.ka5, count(*) AS n_layers, max(lut.ths) AS ths FROM classed JOIN lut ON classed.ka5 = lut.ka5 "
    "GROUP BY classed.ka5", classed=q.KA5, lut=q.LUT))
def _(t: Tables):
    from gridspark.functions.ka5 import builtin_lookup

    table = builtin_lookup(t.spark)
    return (_classed(t).join(F.broadcast(table), "ka5").groupBy("ka5")
            .agg(F.count(F.lit(1)).alias("n_layers"), F.max("ths").alias("ths")))


@query("S6_encode_int16", _sql(
    """SELECT row, col, coalesce(CASE WHEN t BETWEEN -32768 AND 32767 THEN trunc(t) END, -9999)::SMALLINT AS trunc_mm,
              coalesce(CASE WHEN t BETWEEN -32768 AND 32767 THEN round_even(t, 0) END, -9999)::SMALLINT AS round_mm
       FROM (SELECT row, col, sum(mm) AS t FROM fitted GROUP BY row, col)""", fitted=_TOTH_MM))
def _(t: Tables):
    totals = depth.awc_totals(_toth_layers(t))
    v = F.col("awc_2m")
    return totals.select("row", "col", writers.encode_int16(v).alias("trunc_mm"),
                         writers.encode_int16(v, rounding="half_even").alias("round_mm"))


@query("S7_scale_to_int", sql("soil", """
SELECT var, row, col, layer, coalesce(round_even(value * factor, 0), -32768)::SMALLINT AS stored, 1E0 / factor AS scale
FROM long JOIN (
  SELECT var, CASE WHEN m * 10000 <= 32767 THEN 10000 WHEN m * 1000 <= 32767 THEN 1000 WHEN m * 100 <= 32767 THEN 100
                   WHEN m * 10 <= 32767 THEN 10 ELSE 1 END AS factor
  FROM (SELECT var, max(abs(value)) AS m FROM long GROUP BY var)) USING (var)""",
    long="SELECT row, col, layer, 'sand' AS var, sand AS value FROM soil UNION ALL SELECT row, col, layer, 'trd', trd FROM soil "
         "UNION ALL SELECT row, col, layer, 'gravel', gravel FROM soil"))
def _(t: Tables):
    long = t.soil.select(*ID, "sand", "trd", "gravel").unpivot(ID, ["sand", "trd", "gravel"], "var", "value")
    return writers.scale_to_int(long, ["var"]).select("var", *ID, "stored", "scale")


@query("W6_first_match", sql("soil", """
SELECT row, col, path, sand FROM (
  SELECT *, row_number() OVER (PARTITION BY row, col ORDER BY path) AS k
  FROM (SELECT row, col, sand, 'sand_' || (7 - layer) || '.tif' AS path FROM soil)) WHERE k = 1"""))
def _(t: Tables):
    named = t.soil.withColumn("path", F.concat(F.lit("sand_"), 7 - F.col("layer"), F.lit(".tif")))
    return order_statistics.first_match(named, ["row", "col"], "path", ["sand"])
