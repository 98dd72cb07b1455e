"""Stored models, forests, layers on other grids, summary files."""

import pytest
from pyspark.sql import functions as F

from gridspark.models import forest, scoring
from gridspark.operators.grid import Grid
from gridspark.plans import dsi
from gridspark.plans.store import TABLES, ModelStore, apply_years
from gridspark.sources import readers, writers

KEY = {"ptf": "toth", "depth": "1m", "date": "2020-01-01"}
OTHER = {**KEY, "depth": "2m"}


def parts(spark, weight):
    scaler = spark.createDataFrame([("awc", 0.0, 200.0, 100.0, 50.0)], "feature string, clip_lower double, clip_upper double, center double, scale double")
    coefficients = spark.createDataFrame([("intercept", 0.5, None), ("awc", weight, 1.0)], "term string, coefficient double, odds_ratio double")
    return scaler, coefficients


@pytest.fixture
def store(spark, tmp_path):
    return ModelStore(spark, str(tmp_path / "models"))


def test_versions_are_kept(spark, store):
    assert store.versions(KEY) == []
    with pytest.raises(LookupError):
        store.load(KEY)
    assert [store.save(KEY, *parts(spark, w)) for w in (1.0, 2.0)] == [1, 2] and store.save(OTHER, *parts(spark, 3.0)) == 1
    assert store.versions(KEY) == [1, 2]
    weight = lambda *a: store.load(*a).coefficients.where("term = 'awc'").first()["coefficient"]
    assert (weight(KEY), weight(KEY, 1), weight(OTHER)) == (2.0, 1.0, 3.0)
    assert store.load(KEY).folds is None
    with pytest.raises(LookupError):
        store.load(KEY, 3)
    rows = store.listing().where("term = 'awc'").select("depth", "version", "coefficient").collect()
    assert sorted(tuple(r) for r in rows) == [("1m", 1, 1.0), ("1m", 2, 2.0), ("2m", 1, 3.0)]
    for bad in ({"ptf": "x"}, {**KEY, "date": "a/b"}, {**KEY, "date": ""}):
        with pytest.raises(ValueError):
            store.save(bad, *parts(spark, 1.0))


def test_an_unfinished_version_is_not_found(spark, store):
    store.save(KEY, *parts(spark, 1.0))
    # Writing ended after the scaler.
    parts(spark, 2.0)[0].write.parquet(f"{store._path('model_scaler', KEY)}/version=2")
    assert store.versions(KEY) == [1] and store.load(KEY).version == 1
    assert store.save(KEY, *parts(spark, 3.0)) == 3 and store.load(KEY).version == 3


def test_apply_equals_scoring(spark, store):
    scaler, coefficients = parts(spark, -0.7)
    store.save(KEY, scaler, coefficients)
    cells = spark.createDataFrame([(0, 0, 80.0), (0, 1, 500.0), (1, 0, None)], "row int, col int, awc double")
    want = scoring.predict_proba(cells, scaler, coefficients, ["awc"]).orderBy("row", "col").collect()
    assert store.apply(KEY, cells).orderBy("row", "col").collect() == want and want[2]["p"] is None


def test_a_run_is_stored_whole(spark, store):
    rows = [(i, j, float(30 + (i * 7 + j * 3) % 90), 5000.0 if (i * 5 + j) % 3 else 1000.0) for i in range(16) for j in range(16)]
    cells = spark.createDataFrame(rows, "row int, col int, awc double, disco double")
    config = dsi.DsiConfig(cv_block_size_m=100.0, outer_n_splits=2, inner_n_splits=2, n_iter=2, min_pixels=5)
    result = dsi.run_dsi(cells.select("row", "col", F.col("awc").alias("value")), cells.select("row", "col", F.col("disco").alias("value")),
                         None, Grid(0.0, 0.0, 25.0, 25.0, 16, 16), config)
    assert store.save_run(KEY, result) == 1
    model = store.load(KEY)
    assert model.features == ["awc"] and model.folds.count() == 2 and model.summary.count() == result.cv_summary.count()
    assert model.coefficients.orderBy("term").collect() == result.coefficients.orderBy("term").collect()
    assert {t for t in TABLES if store._versions(t, KEY) == [1]} == set(TABLES)


def test_broken_scenarios_do_not_stop_others(spark, store):
    store.save(KEY, *parts(spark, -1.0))
    cells = spark.createDataFrame([(0, i, float(10 * i), 5000.0 if i % 3 else 10.0) for i in range(12)], "row int, col int, awc double, disco double")
    result, status = apply_years(store, KEY, {"a": cells, "none": None, "bare": cells.drop("disco"), "gaps": cells.withColumn("awc", F.lit(None).cast("double"))}, ["awc"])
    assert [r["label"] for r in result.collect()] == ["a"]
    assert {r["label"]: (r["status"], r["reason"]) for r in status.collect()} == {
        "a": ("done", None), "none": ("failed", "no table"), "bare": ("failed", "no column disco"), "gaps": ("empty", "no complete cell")}
    result, status = apply_years(store, KEY, {"none": None}, ["awc"])
    assert result.count() == 0 and status.count() == 1


def test_forests(spark, tmp_path):
    rows = [(float(s), float(c), 1.0 + s % 5, 1.3, 0.1 + 0.002 * s, 0.01 + 0.001 * c) for s in range(0, 90, 3) for c in range(2, 60, 5)]
    samples = spark.createDataFrame(rows + [(None, 1.0, 1.0, 1.0, 0.2, 0.1)], "sand double, clay double, soc double, trd double, fc double, wp double")
    fitted = forest.fit_point_forests(samples, n_trees=5, max_depth=6)
    forest.store_forests(fitted, str(tmp_path / "f"))
    with pytest.raises(Exception, match="already exists"):
        forest.store_forests(fitted, str(tmp_path / "f"))
    loaded = forest.load_forests(str(tmp_path / "f"))
    profile = spark.createDataFrame([(1, 30.0, 20.0, 2.0, 1.3, None, 100, 9.0), (2, None, 20.0, 2.0, 1.3, 10.0, 100, 9.0), (3, 60.0, 40.0, 1.0, 1.3, 50.0, 100, 9.0)],
                                    "layer int, sand double, clay double, soc double, trd double, gravel double, thick_mm int, fc double")
    one, two = (forest.awc_from_forests(profile, f).orderBy("layer").collect() for f in (fitted, loaded))
    assert one == two
    assert one[1]["fc"] is None and one[1]["awc_vol"] is None
    for r in (one[0], one[2]):
        assert r["fc"] == pytest.approx(0.1 + 0.002 * r["sand"], abs=0.03) and 0 <= r["awc_vol"] <= 0.8
        assert r["layer_awc_mm"] == pytest.approx(r["awc_vol"] * (1 - (r["gravel"] or 0) / 100) * 100)
    plan = forest.awc_from_forests(profile, loaded)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan


def test_layers_on_other_grids(spark):
    fine, wide = Grid(0.0, 0.0, 10.0, 10.0, 4, 4), Grid(0.0, 0.0, 20.0, 20.0, 2, 2)
    awc = spark.createDataFrame([(r, c, 50.0 + r + c) for r in range(2) for c in range(2)], "row int, col int, value double")
    disco = spark.createDataFrame([(r, c, 8000.0 if c == 0 else 100.0) for r in range(4) for c in range(4)], "row int, col int, value double")
    config = dsi.DsiConfig(cv_block_size_m=20.0)
    got = dsi.cells_from_grids(awc, wide, (disco, fine), {"same": (awc, wide)}, config).orderBy("row", "col").collect()
    assert [(r["row"], r["col"], r["awc"], r["same"], r["y"]) for r in got] == [(r, c, 50.0 + r + c, 50.0 + r + c, int(c == 0)) for r in range(2) for c in range(2)]


def test_summary_file_keeps_its_order(spark, tmp_path):
    table = spark.createDataFrame([("a", 0.1, 5), ("b", -0.9, 6), ("c", 0.4, 7)], "dataset string, r_rb double, n long")
    path = str(tmp_path / "s")
    writers.write_summary_csv(table, path, ["n", "dataset", "r_rb"], "r_rb")
    back = readers.read_summary_csv(spark, path, table.select("n", "dataset", "r_rb").schema)
    assert [tuple(r) for r in back.collect()] == [(6, "b", -0.9), (7, "c", 0.4), (5, "a", 0.1)]
    with pytest.raises(Exception):
        readers.read_summary_csv(spark, path, table.schema).collect()
