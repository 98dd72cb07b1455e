"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.session import cut_lineage, drop_stored, gathered

# Edges of one partition, about.
EDGES = 5000


def star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One contraction: neighbours of each node are linked to its smallest neighbour.

    ``large`` moves the larger neighbours, otherwise the smaller ones and the node itself.  ``n`` is the number of edges, about.
    """
    seen = edges.union(edges.select("b", "a")) if large else edges
    least = seen.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
    joined = seen.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    out = gathered(out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), n, EDGES)
    return gathered(out.distinct(), n, EDGES)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component, itself included.

    Needs a number of rounds that grows with the logarithm of the graph's size; each round groups and joins on nodes
    and cuts the lineage, in as many tasks as its edges need.  Without edges the result is empty.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if (found["n"], found["h"]) == state:
            break
        state = (found["n"], found["h"])
        if not found["n"]:
            break
        before, n = now, found["n"]
        now = cut_lineage(star(star(gathered(before, n, EDGES), True, n), False, n))
        drop_stored(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
