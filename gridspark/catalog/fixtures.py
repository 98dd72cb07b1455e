"""Grid tables derived from the given tables by SQL.

The same text runs in Spark (as parameterised SQL over DataFrames) and, with
plain table names, in the engine that checks the results.  Layers 1-6 of the
soil profile and the rooting depth are different line numbers of one table.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from gridspark.operators.grid import Grid
from gridspark.session import tune

TABLES = ("nation", "orders", "lineitem")

SQL = {
    "layers": """
SELECT * FROM (VALUES (1,0,5,50),(2,5,15,100),(3,15,30,150),(4,30,60,300),(5,60,100,400),(6,100,200,1000))
  AS t(layer, upper_cm, lower_cm, thick_mm)""",
    "soil": """
SELECT CAST(floor(l_orderkey / 100.0) AS INT) AS row, CAST(l_orderkey % 100 AS INT) AS col, l_linenumber AS layer,
       max(5.0E0 + 1.4E0 * l_quantity)                    AS sand,
       max(CAST(2 + l_partkey % 71 AS DOUBLE))            AS clay,
       max(round(l_discount * 200E0, 1)) + 0.0E0          AS soc,
       max(0.6E0 + 12E0 * l_tax)                          AS trd,
       max(CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE CAST(l_suppkey % 60 AS DOUBLE) END) AS gravel
FROM {lineitem} WHERE l_linenumber <= 6
GROUP BY l_orderkey, l_linenumber""",
    "mrd": """
SELECT CAST(floor(l_orderkey / 100.0) AS INT) AS row, CAST(l_orderkey % 100 AS INT) AS col,
       max(5.0E0 + 4E0 * l_quantity) AS mrd_cm
FROM {lineitem} WHERE l_linenumber = 7
GROUP BY l_orderkey""",
    "disco": """
SELECT CAST(floor(o_orderkey / 100.0) AS INT) AS row, CAST(o_orderkey % 100 AS INT) AS col,
       CAST(year(o_orderdate) AS INT) AS year,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL
            ELSE 0.4E0 * (CAST(floor(o_totalprice) AS BIGINT) % 10001) + 30E0 * s.max_sand END AS value
FROM {orders} JOIN (SELECT l_orderkey, max(5.0E0 + 1.4E0 * l_quantity) AS max_sand FROM {lineitem} GROUP BY l_orderkey) s
  ON o_orderkey = s.l_orderkey""",
    "climate_daily": """
SELECT CAST(l_shipdate AS DATE) AS date,
       CAST(floor(l_suppkey / 10.0) AS INT) AS row, CAST(l_suppkey % 10 AS INT) AS col,
       max(CASE WHEN l_partkey % 997 = 0 THEN NULL ELSE l_quantity / 10E0 END) AS pr,
       max(5E0 + round(l_discount * 200E0, 1))                AS tas,
       max(8E0 + round(l_discount * 200E0, 1))                AS tasmax,
       min(6E0 + round(l_discount * 200E0, 1) - round(l_tax * 100E0, 1)) AS td
FROM {lineitem}
GROUP BY l_shipdate, l_suppkey""",
    "polygon_edges": """
SELECT * FROM (VALUES (1, 10.3E0, 10.2E0, 80.4E0, 15.1E0),(2, 80.4E0, 15.1E0, 60.7E0, 95.6E0),
                      (3, 60.7E0, 95.6E0, 20.2E0, 70.9E0),(4, 20.2E0, 70.9E0, 10.3E0, 10.2E0)) AS t(edge, x1, y1, x2, y2)""",
    "scored": """
SELECT l_returnflag AS key, CAST(l_quantity AS DOUBLE) / 51E0 AS p,
       CASE WHEN l_quantity + (l_partkey % 40) > 45 THEN 1 ELSE 0 END AS y
FROM {lineitem}""",
    "members": """
SELECT n_nationkey AS member, (n_nationkey % 5 - 2) * 0.001E0 AS w_sand, (n_nationkey % 7 - 3) * 0.0007E0 AS w_clay,
       (n_nationkey % 3 - 1) * 0.02E0 AS w_trd, 0.4E0 + n_nationkey * 0.002E0 AS bias
FROM {nation}""",
    "points": """
SELECT CAST(floor(l_orderkey / 100.0) AS INT) AS row, CAST(l_orderkey % 100 AS INT) AS col, l_linenumber AS layer,
       max(CASE WHEN l_suppkey % 23 = 0 THEN NULL ELSE 0.1E0 + 0.03E0 * sqrt(l_quantity + 0.37E0) END) AS fc,
       max(0.02E0 + 0.012E0 * sqrt(l_partkey % 71 + 0.41E0)) AS wp
FROM {lineitem} WHERE l_linenumber <= 6
GROUP BY l_orderkey, l_linenumber""",
    "heads": """
SELECT n_nationkey AS member, 'ths' AS output, 0.65E0 + n_nationkey * 0.002E0 AS bias, (n_nationkey % 5 - 2) * 0.001E0 - 0.0008E0 AS w_sand,
       0E0 AS w_silt, (n_nationkey % 7 - 3) * 0.0007E0 + 0.001E0 AS w_clay, (n_nationkey % 3 - 1) * 0.02E0 - 0.15E0 AS w_trd FROM {nation}
UNION ALL
SELECT n_nationkey, 'thr', 0.03E0 + n_nationkey * 0.0005E0, 0E0, 0.0001E0, (n_nationkey % 7) * 0.0003E0, 0E0 FROM {nation}
UNION ALL
SELECT n_nationkey, 'alpha', -1.6E0 - n_nationkey * 0.002E0, 0.004E0, (n_nationkey % 5 - 2) * 0.001E0, -0.006E0, 0.01E0 FROM {nation}
UNION ALL
SELECT n_nationkey, 'n', 0.08E0 + n_nationkey * 0.002E0, 0.001E0, (n_nationkey % 3 - 1) * 0.0002E0, -0.0012E0, 0E0 FROM {nation}""",
}


class Tables:
    """The given tables of one folder and the grid tables derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        tune(spark)

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def derived(self, name: str) -> DataFrame:
        text = SQL[name]
        used = {t: self.raw(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    layers = cached_property(lambda self: self.derived("layers"))
    soil = cached_property(lambda self: self.derived("soil"))
    mrd = cached_property(lambda self: self.derived("mrd"))
    disco = cached_property(lambda self: self.derived("disco"))
    climate = cached_property(lambda self: self.derived("climate_daily"))
    polygon_edges = cached_property(lambda self: self.derived("polygon_edges"))
    scored = cached_property(lambda self: self.derived("scored"))
    members = cached_property(lambda self: self.derived("members"))
    points = cached_property(lambda self: self.derived("points"))

    @cached_property
    def heads(self) -> DataFrame:
        """Ensemble members of retention parameters, one row per member and output."""
        return self.derived("heads").selectExpr("member", "output", "array(w_sand, w_silt, w_clay, w_trd) AS weights", "bias")

    @cached_property
    def profile(self) -> DataFrame:
        from gridspark.operators.depth import with_layers

        return with_layers(self.soil)


# Grids of the derived tables: 100 columns of 25 m cells and as many rows as the data have.
SOIL_GRID = Grid(0.0, 0.0, 25.0, 25.0, 100)
CELL_UNITS = Grid(0.0, 0.0, 1.0, 1.0, 100)
CLIMATE_GRID = Grid(0.0, 0.0, 250.0, 250.0, 10)


def plain(name: str) -> str:
    """Derived table as SQL over plain table names."""
    text = SQL[name]
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.strip()


def sql(names: str, select: str, **ctes: str) -> str:
    """``WITH`` the named derived tables and further expressions, then ``select``."""
    parts = [f"{n} AS (\n{plain(n)}\n)" for n in names.split()]
    parts += [f"{n} AS (\n{text.strip()}\n)" for n, text in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + select.strip()
