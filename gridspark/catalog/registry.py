"""Query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.catalog.fixtures import Tables


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.run(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, sql)
        return run

    return add


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Round named columns; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in columns})


def log6(c: str) -> Column:
    """ln of a positive value, NULL otherwise, at six digits."""
    return F.round(F.ln(F.when(F.col(c) > 0, F.col(c))), 6) + F.lit(0.0)
