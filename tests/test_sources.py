"""Readers, encodings, partitioned writes and key bookkeeping."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridspark.operators import run_keys
from gridspark.operators.grid import Grid
from gridspark.sources import readers, writers


def test_soil_cube_prunes_partitions(spark, tmp_path):
    rows = [(v, layer, 0, c, float(10 * layer + c)) for v in ("SAND", "CLAY", "OTHER") for layer in (1, 2, 9) for c in (0, 1)]
    rows = [r for r in rows if r[:2] != ("CLAY", 2)]
    path = str(tmp_path / "soil")
    spark.createDataFrame(rows, "var string, layer int, row int, col int, value double").write.partitionBy("var", "layer").parquet(path)
    cube = readers.load_soil_cube(spark, path, ["sand", "clay"], ranges=("0_5", "5_15"), names={"sand": "SAND", "clay": "CLAY"})
    got = {(r.layer, r.col): (r.sand, r.clay, r.thick_mm) for r in cube.collect()}
    assert got[1, 0] == (10.0, 10.0, 50) and got[2, 1] == (21.0, None, 100) and len(got) == 4
    plan = cube._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "var" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_daily_source(spark, tmp_path):
    rows = [("pr", 2000, dt.date(2000, 6, 1), 0, 0, 1.0), ("tas", 2001, dt.date(2001, 6, 1), 0, 0, 2.0)]
    path = str(tmp_path / "daily")
    spark.createDataFrame(rows, "var string, year int, date date, row int, col int, value double").write.partitionBy("var", "year").parquet(path)
    assert readers.load_daily(spark, path, "tas", [2001]).first().value == 2.0
    with pytest.raises(ValueError):
        readers.load_daily(spark, path, "tas", [2000])


def test_cells_nodata_and_nan(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.createDataFrame([(0, 0, -9999.0), (0, 1, float("nan")), (0, 2, 5.0)], "row int, col int, value double").write.parquet(path)
    assert [r.value for r in readers.read_cells(spark, path, -9999).orderBy("col").collect()] == [None, None, 5.0]
    assert readers.read_cells(spark, path, -9999, drop_missing=True).count() == 1


def test_rooting_depth_snaps_and_drops_zero(spark):
    mrd = spark.createDataFrame([(0, 0, 40.0), (0, 1, 0.0)], "row int, col int, mrd_cm double")
    targets = spark.createDataFrame([(r, c) for r in (0, 1) for c in range(4)], "row int, col int")
    out = {(r.row, r.col): r.mrd_cm for r in readers.load_mrd(mrd, Grid(0, 0, 2, 2, 2, 1), targets, Grid(0, 0, 1, 1, 4, 2)).collect()}
    assert out[1, 1] == 40.0 and out[0, 2] is None


def test_lookup_csv(spark, tmp_path):
    path = tmp_path / "lut.csv"
    path.write_text("texture,thr,ths,alpha,n,tort,ksat\nSs,0,0.4,0.2,1.3,0,1\nfS,0,0.41,0.15,1.33,0,1\nXx,0,0,0,0,0,0\n")
    assert {r.ka5: r.ths for r in readers.load_lookup(spark, str(path)).collect()} == {2: 0.4, 32: 0.41}


def test_int16_encoding(spark):
    df = spark.createDataFrame([(3.7,), (-3.7,), (2.5,), (None,), (40000.0,)], "v double")
    assert [r[0] for r in df.select(writers.encode_int16(F.col("v"))).collect()] == [3, -3, 2, -9999, -9999]
    assert [r[0] for r in df.select(writers.encode_int16(F.col("v"), rounding="half_even")).collect()] == [4, -4, 2, -9999, -9999]


def test_scale_to_int(spark):
    rows = [("small", 0, 1.23456), ("small", 1, None), ("big", 0, 3000.25), ("edge", 0, 3.2767)]
    df = spark.createDataFrame(rows, "layer string, cell int, value double")
    got = {(r.layer, r.cell): (r.stored, r.scale) for r in writers.scale_to_int(df, ["layer"]).collect()}
    assert got["small", 0] == (12346, 1e-4) and got["small", 1][0] == -32768
    assert got["big", 0] == (30002, 0.1) and got["edge", 0] == (32767, 1e-4)
    with pytest.raises(Exception, match="no valid data"):
        writers.scale_to_int(spark.createDataFrame([("x", 0, None)], df.schema), ["layer"]).collect()


def test_fields_are_written_once(spark, tmp_path):
    path = str(tmp_path / "fields")
    schema = "var string, stat string, year int, season string, row int, col int, value double"
    one = spark.createDataFrame([("pr", "sum", 2000, "JJA", 0, 0, 1.0)], schema)
    two = spark.createDataFrame([("pr", "sum", 2000, "JJA", 0, 0, 9.0), ("pr", "sum", 2001, "JJA", 0, 0, 2.0)], schema)
    writers.write_missing_fields(one, path)
    writers.write_missing_fields(two, path)
    assert sorted(r.value for r in spark.read.parquet(path).collect()) == [1.0, 2.0]


def test_maps_and_summary_files(spark, tmp_path):
    maps = spark.createDataFrame([("toth", "1m", 0, 0, 12.9), ("toth", "2m", 0, 0, None)], "ptf string, depth string, row int, col int, awc_mm double")
    writers.write_cells_int16(maps, str(tmp_path / "maps"))
    assert {r.depth: r.awc_mm for r in spark.read.parquet(str(tmp_path / "maps")).collect()} == {"1m": 12, "2m": -9999}
    table = spark.createDataFrame([("a", 0.1), ("b", -0.9)], "name string, r double")
    writers.write_summary_csv(table, str(tmp_path / "csv"), ["r", "name"], largest_first="r")
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text == ["r,name", "-0.9,b", "0.1,a"]


def test_incremental_keys(spark):
    schema = "dataset string, depth string, date string, n long"
    existing = spark.createDataFrame([("a", "1m", "d1", 1), ("b", "1m", "d1", 2)], schema)
    assert {tuple(r) for r in run_keys.missing_keys(existing, {"date": ["d2"]}).collect()} == {("a", "1m", "d2"), ("b", "1m", "d2")}
    done = run_keys.append_incremental(existing, {"date": ["d2"]}, lambda todo: todo.withColumn("n", F.lit(7).cast("long")))
    assert sorted(r.n for r in done.collect()) == [1, 2, 7, 7]
    assert run_keys.missing_keys(existing, {}).count() == 0


def test_union_and_stack(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3, 4)], "x int, z int")
    out = run_keys.union_columns([a, b])
    assert out.columns == ["x", "y", "z"] and {tuple(r) for r in out.collect()} == {(1, 2, None), (3, None, 4)}
    assert {r.k for r in run_keys.stack({"p": a, "q": a}, "k").collect()} == {"p", "q"}
