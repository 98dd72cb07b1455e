"""Pedotransfer functions, texture classes and depth integration against hand values."""

import math
import re

import pytest
from pyspark.sql import functions as F

from gridspark import session
from gridspark.catalog import statistics
from gridspark.catalog.fixtures import Tables
from gridspark.functions import ka5
from gridspark.functions.names import parse_depth_range, parse_run_key
from gridspark.operators import class_stats, depth, ensemble, run_keys, soil
from gridspark.plans import soil_to_awc

SOIL = "row int, col int, layer int, sand double, clay double, soc double, trd double, gravel double"


def one(spark, sand=40.0, clay=20.0, soc=2.0, trd=1.3, layer=1, gravel=10.0):
    df = spark.createDataFrame([(0, 0, layer, sand, clay, soc, trd, gravel)], SOIL)
    return depth.with_layers(df)


def test_schoch_hand_value_and_domain(spark, close):
    r = soil.ptf_schoch(one(spark)).first()
    close(r.ths, 0.919 - 0.355 * 1.3 + 0.000647 * 20 + 0.000434 * 40 - 0.00229 * math.log(2))
    close(r.n, (0.240 + 0.220 * 1.3 + 0.00291 * 20 - 0.00305 * 40 + 0.0329 * math.log(2)) ** -0.25)
    out = soil.ptf_schoch(one(spark, sand=5.0, clay=2.0)).first()  # residual content below zero
    assert (out.ths, out.thr, out.alpha, out.n, out.tau, out.ksat) == (None,) * 6


def test_schoch_zero_carbon_is_infinite_not_null(spark):
    r = soil.awc_vol_mvg(soil.ptf_schoch(one(spark, soc=0.0, clay=60.0))).first()
    assert r.ths == math.inf and r.alpha == 0.0 and r.n == 0.0 and r.awc_vol is None


@pytest.mark.parametrize("layer,top", [(3, 1), (4, 0)])
def test_wosten_topsoil_flag(spark, close, layer, top):
    r = soil.ptf_wosten(one(spark, layer=layer)).first()
    cl, sl, bd, om = 20.0, 40.0, 1.3, 3.44
    close(r.ths, 0.7919 + 0.001691 * cl - 0.29619 * bd - 1.491e-6 * sl**2 + 8.21e-5 * om**2 + 0.02427 / cl
          + 0.01113 / sl + 0.01472 * math.log(sl) - 7.33e-5 * om * cl - 0.000619 * bd * cl
          - 0.001183 * bd * om - 1.664e-4 * top * sl)


def test_weynants_teepe_puhlmann_hand_values(spark, close):
    w = soil.ptf_weynants(one(spark)).first()
    close(w.alpha, math.exp(-4.3003 - 0.0097 * 20 + 0.0138 * 40 - 0.0992 * 2))
    p = soil.ptf_puhlmann(one(spark)).first()
    close(p.n, 1 + math.exp(0.0003758 * 1600 + 0.004751 * 40 + 0.017826 * 40 / 1.3 - 2.9804))
    assert soil.ptf_puhlmann(one(spark, trd=0.0)).first().n is None
    t = soil.ptf_teepe(one(spark, sand=0.0)).first()
    assert t.alpha == 0.0
    assert soil.awc_vol_mvg(soil.ptf_teepe(one(spark, sand=0.0))).first().awc_vol == 0.0
    d = soil.ptf_teepe(one(spark), awc_direct=True).first()
    close(d.awc_vol, 0.4172514 + 0.1641025 * 1.3 - 0.0012394 * 20 + 0.00061115 * 40)


def test_saxton_rawls_orders_and_density(spark):
    r = soil.ptf_saxton_rawls(one(spark, sand=90.0, clay=60.0)).first()
    assert r.wp < r.fc < r.sat
    dense = soil.ptf_saxton_rawls(one(spark), density_factor=1.2).first()
    assert dense.sat < soil.ptf_saxton_rawls(one(spark)).first().sat
    with pytest.raises(ValueError):
        soil.ptf_saxton_rawls(one(spark), density_factor=1.5)


def test_nan_equals_null(spark):
    for function in (soil.ptf_schoch, soil.ptf_wosten, soil.ptf_weynants, soil.ptf_puhlmann, soil.ptf_teepe):
        a = function(one(spark, clay=float("nan"))).select("ths", "alpha", "n").first()
        b = function(one(spark, clay=None)).select("ths", "alpha", "n").first()
        assert a == b


def test_retention_needs_n_above_one(spark):
    df = spark.createDataFrame([(0.4, 0.1, 0.05, 1.0), (0.4, 0.1, 0.05, 1.5)], "ths double, thr double, alpha double, n double")
    bad, good = soil.awc_vol_mvg(df).orderBy("n").collect()
    assert bad.fc_vol is None and good.fc_vol >= good.pwp_vol


def test_texture_boxes_cover_the_triangle_and_both_forms_agree(spark):
    grid = spark.range(201 * 201).select(((F.col("id") % 201) / 2).alias("clay"), (F.floor(F.col("id") / 201) / 2).alias("silt"))
    grid = grid.where("clay + silt <= 100")
    by_case = soil.classify_ka5(grid)
    assert by_case.where("ka5 = 0").count() == 0
    assert by_case.exceptAll(soil.classify_ka5_by_join(grid)).count() == 0
    assert soil.classify_ka5_by_join(grid).count() == grid.count()


@pytest.mark.parametrize("clay,silt,name", [
    (4.9, 9.9, "Ss"), (5.0, 9.9, "St2"), (65.0, 10.0, "Tt"), (64.9, 14.9, "Ts2"), (8.0, 65.0, "Ut2"), (12.0, 65.0, "Ut3"),
    (17.0, 29.9, "Ls4"), (17.0, 30.0, "Ls3"), (25.0, 30.0, "Lt2"), (45.0, 30.0, "Tu2"), (30.0, 50.0, "Tu3"), (7.9, 80.0, "Uu")])
def test_texture_limits(spark, clay, silt, name):
    df = spark.createDataFrame([(clay, silt)], "clay double, silt double")
    assert soil.classify_ka5(df).first().ka5 == ka5.CODE_OF[name]
    assert soil.classify_ka5_by_join(df).first().ka5 == ka5.CODE_OF[name]


def test_unknown_class_gives_null_parameters(spark):
    df = spark.createDataFrame([(None, 10.0)], "clay double, silt double")
    r = soil.ptf_wessolek(soil.classify_ka5(df)).first()
    assert r.ka5 == 0 and r.ths is None


def test_every_produced_class_has_parameters():
    assert {b[1] for b in ka5.BOXES} | {name for _, name in ka5.SAND_SUBCLASSES} == {p[0] for p in ka5.PARAMETERS}


PROFILE = "row int, col int, layer int, layer_awc_mm double"


def profile(spark, values, cell=(0, 0)):
    rows = [(*cell, i + 1, v) for i, v in enumerate(values)]
    return depth.with_layers(spark.createDataFrame(rows, PROFILE))


@pytest.mark.parametrize("mrd,want", [(3.0, 6.0), (5.0, 10.0), (10.0, 20.0), (15.0, 30.0), (200.0, 210.0), (250.0, 210.0), (None, None)])
def test_rooting_depth_positions(spark, close, mrd, want):
    water = profile(spark, [10.0, 20.0, 30.0, 40.0, 50.0, 60.0])
    roots = spark.createDataFrame([(0, 0, mrd)], "row int, col int, mrd_cm double")
    close(depth.awc_to_rooting_depth(water, roots).first().awc_mrd, want)


def test_missing_layers_below_shallow_roots(spark):
    water = profile(spark, [None] * 6)
    roots = spark.createDataFrame([(0, 0, 3.0)], "row int, col int, mrd_cm double")
    assert depth.awc_to_rooting_depth(water, roots).first().awc_mrd == 0.0
    assert depth.awc_to_rooting_depth(water, roots, strict_nulls=True).first().awc_mrd is None
    only_top = profile(spark, [None])
    assert depth.awc_to_rooting_depth(only_top, roots).first().awc_mrd == 0.0


def test_depth_equivalences_and_null_rules(spark, close):
    water = profile(spark, [10.0, 20.0, 30.0, 40.0, 50.0, 60.0])
    totals = depth.awc_totals(water).first()
    close(totals.awc_2m, depth.awc_to_depth(water, 200.0).first().awc_mm)
    close(totals.awc_1m, depth.awc_to_depth(water, 100.0).first().awc_mm)
    gaps = depth.awc_totals(profile(spark, [None, 5.0, None, None, None, None])).first()
    assert gaps.awc_1m == 5.0
    assert depth.awc_totals(profile(spark, [None] * 6)).first().awc_2m is None


def test_gravel_null_rules(spark, close):
    df = one(spark, gravel=None).withColumn("awc_vol", F.lit(0.2))
    assert depth.layer_awc_mm(df).first().layer_awc_mm is None
    close(depth.layer_awc_mm(df, null_gravel_is_zero=True).first().layer_awc_mm, 10.0)
    r = soil.awc_from_point_ptf(one(spark, gravel=None).withColumns({"fc": F.lit(1.9), "wp": F.lit(0.1)})).first()
    close(r.awc_vol, 0.8)
    close(r.layer_awc_mm, 40.0)


def test_ensemble_keeps_complete_cells_only(spark, close):
    rows = [("a", "1m", 0, 0, 10.0), ("b", "1m", 0, 0, 20.0), ("a", "1m", 0, 1, 10.0), ("b", "1m", 0, 1, None)]
    out = ensemble.ptf_ensemble(spark.createDataFrame(rows, "ptf string, depth string, row int, col int, awc_mm double")).collect()
    assert len(out) == 1
    close(out[0].awc_mean, 15.0)
    close(out[0].awc_sd, 5.0)


def test_ensemble_network_scoring(spark, close):
    members = spark.createDataFrame(
        [(1, "thr", [1.0, -2.0], 0.5, [[0.1, 0.2], [0.3, -0.1]], [0.0, 0.1]), (2, "thr", [0.5, 0.5], 0.0, [[0.2, 0.0], [0.0, 0.2]], [0.1, 0.0])],
        "member int, output string, weights array<double>, bias double, hidden_weights array<array<double>>, hidden_bias array<double>")
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0)], "a double, b double")
    scored = ensemble.score_ensemble(df, members, ["a", "b"], ["thr"], log10_outputs=["thr"]).collect()
    first = 1.0 * math.tanh(0.5) - 2.0 * math.tanh(0.2) + 0.5
    second = 0.5 * math.tanh(0.3) + 0.5 * math.tanh(0.4)
    by_a = {r.a: r.thr for r in scored}
    close(by_a[1.0], 10 ** ((first + second) / 2))
    assert by_a[None] is None
    in_blocks = ensemble.score_ensemble(df, members, ["a", "b"], ["thr"], log10_outputs=["thr"], block_weights=1).collect()
    close({r.a: r.thr for r in in_blocks}[1.0], by_a[1.0])


def test_names(spark):
    df = spark.createDataFrame([("proportion_zhang_and_schaap_1m_2018-07-31.png",), ("other.png",)], "name string")
    good, bad = df.select(*[c.alias(k) for k, c in parse_run_key(F.col("name")).items()]).collect()
    assert tuple(good) == ("zhang_and_schaap", "1m", "2018-07-31", "Zhang and Schaap", "zhang")
    assert tuple(bad) == (None,) * 5
    r = df.limit(1).select(*[c.alias(k) for k, c in parse_depth_range(F.lit("15_30")).items()]).first()
    assert tuple(r) == (15, 30, 150)


def _members(spark):
    rows = [(k, out, [0.001 * k, 0.0005, 0.002 - 0.0003 * k, -0.1], 0.6 + 0.01 * k) for k in range(5) for out in ("ths", "alpha")]
    return spark.createDataFrame(rows, "member int, output string, weights array<double>, bias double")


def test_linear_members_as_columns(spark):
    rows = [(1, 40.0, 30.0, 30.0, 1.3), (2, None, 30.0, 30.0, 1.3), (3, 5.0, 15.0, 80.0, 0.6)]
    df = spark.createDataFrame(rows, "row int, sand double, silt double, clay double, trd double")
    names, outputs = ["sand", "silt", "clay", "trd"], ["ths", "alpha"]
    plain = ensemble.score_ensemble(df, _members(spark), names, outputs, log10_outputs=["alpha"])
    columns = ensemble.score_linear_ensemble(df, _members(spark), names, outputs, log10_outputs=["alpha"])
    assert "MapInPandas" not in columns._jdf.queryExecution().executedPlan().toString()
    for a, b in zip(plain.orderBy("row").collect(), columns.orderBy("row").collect(), strict=True):
        assert (a.ths is None) == (b.ths is None)
        if a.ths is not None:
            assert b.ths == pytest.approx(a.ths) and b.alpha == pytest.approx(a.alpha)
    assert ensemble.score_linear_ensemble(df, _members(spark).limit(0), names, outputs).where("ths IS NOT NULL").count() == 0


def test_predicted_points_beside_other_functions(spark):
    layers = [(0, 0, k, 30.0, 40.0, 1.0, 1.4, None if k == 1 else 10.0) for k in (1, 2)] + [(0, 1, 1, 30.0, None, 1.0, 1.4, 0.0)]
    profile = depth.with_layers(spark.createDataFrame(
        layers, "row int, col int, layer int, sand double, clay double, soc double, trd double, gravel double"))
    points = spark.createDataFrame([(0, 0, 1, 0.3, 0.1), (0, 0, 2, 0.1, 0.2), (0, 1, 1, 0.3, 0.1)],
                                   "row int, col int, layer int, fc double, wp double")
    got = {(r.ptf, r.depth, r.col): r.awc_mm for r in soil_to_awc.all_maps(profile, ["toth", "szabo"], points=points).collect()}
    # Missing gravel counts as none here, a negative difference as zero water; without clay there is no value.
    assert got["szabo", "1m", 0] == pytest.approx(0.2 * 50) and got["szabo", "2m", 0] == pytest.approx(0.2 * 50)
    assert got["szabo", "1m", 1] is None and got["toth", "1m", 1] is None
    # The other function keeps its own rule: its first layer has no gravel value, so only the second counts.
    toth = soil.ptf_toth(profile).where("layer = 2").first()
    assert got["toth", "1m", 0] == pytest.approx(toth.awc_vol * 0.9 * 100)
    with pytest.raises(ValueError, match="szabo"):
        soil_to_awc.all_maps(profile, ["szabo"])


def test_shared_step_of_all_functions_moves_little(spark):
    """The join with points moves the profile's own columns by the cell alone; no value is computed twice for a test of NaN."""
    names = ["toth", "wosten", "zhang", "szabo"]
    profile = depth.with_layers(spark.createDataFrame(
        [(0, 0, 1, 30.0, 40.0, 1.0, 1.4, 10.0)], "row int, col int, layer int, sand double, clay double, soc double, trd double, gravel double"))
    points = spark.createDataFrame([(0, 0, 1, 0.3, 0.1), (0, 0, 2, 0.9, 0.1)], "row int, col int, layer int, fc double, wp double")
    heads = spark.createDataFrame([(k, o, [0.001] * 4, 0.5) for k in range(3) for o in ("ths", "thr", "alpha", "n")],
                                  "member int, output string, weights array<double>, bias double")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        maps = soil_to_awc.all_maps(profile, names, members=heads, points=points)
        plan = maps._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    dealt = re.findall(r"hashpartitioning\(row([^)]*)\)", plan)
    assert dealt and not any("layer" in x for x in dealt) and "element_at(" not in plan
    theta = soil.mvg_theta(spark.range(1).selectExpr("rand() ths", "rand() thr", "rand() alpha", "rand() + 1 n"), 330.0)
    assert theta._jdf.queryExecution().executedPlan().toString().count("POWER(") == 2
    assert {(r.ptf, r.depth): r.awc_mm for r in maps.collect()}["szabo", "1m"] == pytest.approx(0.2 * 0.9 * 50)


def test_queries_set_the_method_limit(spark):
    limit = spark.conf.get(session.HUGE_METHOD)
    try:
        spark.conf.set(session.HUGE_METHOD, session.SPARK_DEFAULT)
        Tables(spark, "unused")
        assert spark.conf.get(session.HUGE_METHOD) == session.JIT_LIMIT
    finally:
        spark.conf.set(session.HUGE_METHOD, limit)


def test_missing_keys_read_results_once(spark):
    done = spark.createDataFrame([("a", "1m", 1), ("a", "1m", 1), ("b", "2m", 2)], "dataset string, depth string, date int").repartition(3)
    missing = run_keys.missing_keys(done, {"dataset": ["c"]})
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert plan.count("functions=[collect_set") >= 1 and "keys=[dataset" in plan.split("collect_set")[-1]
    assert missing.count() == 3 * 2 * 2 - 2


def test_cells_are_joined_before_their_maps_unfold(spark):
    """A cell meets its labels as one row, whatever the number of maps; rows are those of the long form."""
    wide = spark.createDataFrame([(0, 0, 1.0, 2.0, 3.0, None), (0, 1, None, None, 4.0, 5.0), (0, 1, 6.0, 7.0, 8.0, 9.0), (None, 2, 1.0, 1.0, 1.0, 1.0)],
                                 "row int, col int, `a@1m` double, `a@2m` double, `b@1m` double, `b@2m` double")
    disco = spark.createDataFrame([(1, 0, 0, 4000.0), (2, 0, 0, 10.0), (1, 0, 1, 10.0), (1, 0, 1, 5000.0), (1, 0, 2, None), (1, None, 2, 1.0)],
                                  "date int, row int, col int, value double")

    def unfold(df, kept):
        return depth.unfold_maps(df, ["a", "b"], kept).withColumnRenamed("ptf", "dataset")

    split = class_stats.class_split(wide, disco, unfold=unfold)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join") and plan.count("Join") == 1
    long = class_stats.class_split(unfold(wide, ["row", "col"]), disco)
    assert split.columns == long.columns
    rows = sorted(map(tuple, split.collect()))
    assert rows == sorted(map(tuple, long.collect())) and len(rows) == 3 * 2 + 6 * 2


def test_queries_join_cells_before_their_maps_unfold(spark, tmp_path):
    spark.sql("SELECT CAST(id AS BIGINT) o_orderkey, 1000.0D o_totalprice, TIMESTAMP_NTZ'2020-01-01 00:00:00' o_orderdate FROM range(3)").write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.sql("SELECT CAST(id AS BIGINT) l_orderkey, id + 5 l_partkey, id + 1 l_suppkey, CAST(1 AS INT) l_linenumber, 10.0D l_quantity, "
              "0.05D l_discount, 0.05D l_tax FROM range(3)").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.sql("SELECT CAST(id AS BIGINT) n_nationkey FROM range(3)").write.parquet(f"{tmp_path}/nation.parquet")
    cells = statistics.cells_of(Tables(spark, str(tmp_path)))
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join Inner")
    # All functions and both depths of the cells with a value: order 0 has none.
    assert {(r.row, r.col) for r in cells.collect()} == {(0, 1), (0, 2)}
