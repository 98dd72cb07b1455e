"""Registered queries against their SQL, and properties of their plans."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import SMOKE_DIR, entry, oracle_sql, queries  # noqa: E402
from tools.compare import compare, connect  # noqa: E402

QUERIES, SQL = queries(), oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(SMOKE_DIR)


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["row", "col", "awc_1m", "awc_2m"] and df.count() > 0


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_matches_sql(spark, duck, name):
    status, rows, _ = compare(spark, duck, SMOKE_DIR, name, QUERIES[name], SQL[name])
    assert status == "ok"


@pytest.mark.parametrize("name", ["A14_mann_whitney_p", "W5_sample_cap", "M1_group_kfold", "M11_fold_metrics_table"])
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, SMOKE_DIR).count() > 0


def formatted(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    return df._jdf.queryExecution().explainString(mode)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in QUERIES if n[0] in "PAGJEU" and n not in (
    "P10_score_ensemble", "A26_vif", "A14_mann_whitney_p", "A21_weighted_logit_slope_tests")])
def test_no_python_and_no_nested_loops(spark, name):
    plan = plan_of(QUERIES[name](spark, SMOKE_DIR))
    for bad in ("ArrowEvalPython", "BatchEvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan


def test_flagship_plan(spark):
    plan = plan_of(entry(spark))
    # one shuffle builds the derived soil table, one integrates its layers
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.count("BroadcastExchange") == 1
    details = formatted(entry(spark))
    scan = details.split("ReadSchema: struct<")[1].split(">")[0]
    assert {c.split(":")[0] for c in scan.split(",")} <= {
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"}
    assert "PushedFilters: [IsNotNull(l_linenumber), LessThanOrEqual(l_linenumber,6)" in details
