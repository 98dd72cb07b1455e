"""Exact top-k search by inner product through a pivot-distance index.

Vectors become integers; an extra coordinate sqrt(M - |x|^2) (0 for queries) turns the largest inner product into the
least distance: |q - x|^2 = |q|^2 + M - 2 q.x.  Every vector is keyed by its nearest pivot and its distance to it; the
distances around each pivot are cut into annuli of bounded size.  A query first scans the annulus that it falls into,
which gives a score to beat, and then those annuli, in order of their bounds, whose triangle-inequality bound still
allows a better one.  Each search is exact: pivots decide the work, never the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

PIVOTS = 32
SAMPLE = 4096  # rows that pivots are chosen from
ANNULUS = 4096  # distinct vectors of one annulus
QUERY_BLOCK = 512


def integer_vector(embedding: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component as longs; null for vectors with null or non-finite components."""
    x = F.col(embedding)
    good = x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return F.when(good, F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")))


def padded(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where all sums stay below 2**53, else in longs."""
    bound = rows.shape[1] * float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0))
    if bound < 2 ** 53:
        return (queries.astype(float) @ rows.T.astype(float)).astype(np.int64)
    return queries @ rows.T


def choose_pivots(vectors: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first pivots, then two rounds of means."""
    if not len(vectors):
        return np.zeros((1, vectors.shape[1]))
    x = vectors.astype(float)
    chosen = [x[0]]
    near = ((x - chosen[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and near.max() > 0:
        chosen.append(x[near.argmax()])
        near = np.minimum(near, ((x - chosen[-1]) ** 2).sum(axis=1))
    pivots = np.array(chosen)
    for _ in range(2):
        nearest = ((x[:, None, :] - pivots[None]) ** 2).sum(axis=2).argmin(axis=1) if len(x) * len(pivots) < 1 << 17 else \
            np.array([((pivots - v) ** 2).sum(axis=1).argmin() for v in x])
        pivots = np.array([x[nearest == i].mean(axis=0) if (nearest == i).any() else p for i, p in enumerate(pivots)])
    return pivots


class Space:
    """Pivots and the norm bound; distances in the space with the extra coordinate (pivots have 0 there)."""

    def __init__(self, pivots: np.ndarray, bound: float):
        self.pivots, self.bound = pivots, bound

    def distances(self, v: np.ndarray, extra: bool) -> np.ndarray:
        x = v.astype(float)
        d = ((x * x).sum(axis=1)[:, None] - 2 * x @ self.pivots.T + (self.pivots ** 2).sum(axis=1)[None])
        if extra:
            d = d + np.maximum(0, self.bound - (x * x).sum(axis=1))[:, None]
        return np.sqrt(np.maximum(d, 0))


def index(vectors: DataFrame, space: Space, width: int) -> DataFrame:
    """(ids, v, pivot, radius) for every distinct vector."""
    def run(batches):
        for batch in batches:
            d = space.distances(padded(batch.column(1).to_pylist(), width), True)
            near = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int64()),
                                              pa.array(d[np.arange(len(d)), near])], ["ids", "v", "pivot", "radius"])

    return vectors.select("ids", "v").mapInArrow(run, "ids array<long>, v array<long>, pivot long, radius double")


def scan(cells: DataFrame, asked: DataFrame, space: Space, width: int, k: int) -> DataFrame:
    """(query_id, vec_id, score): the k best rows of each asked annulus for each query.

    A group is one annulus and one block of queries, both bounded.  Inside it, vectors stand in order of their radius and a
    query looks at those radii only that its score to beat allows.
    """
    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table([[], [], []], schema=out)
        radius = np.array(rows.column("radius").to_pylist())
        order = np.argsort(radius)
        ids, v = rows.column("ids").to_pylist(), padded(rows.column("v").to_pylist(), width)
        q = padded(queries.column("v").to_pylist(), width)
        scores, found = products(q, v[order]), []
        radius = radius[order]
        reach = space.distances(q, False)[:, rows.column("pivot")[0].as_py()]
        limits = queries.column("limit").to_pylist()
        for i, (query, limit) in enumerate(zip(queries.column("query_id").to_pylist(), limits, strict=True)):
            low, high = 0, len(order)
            if limit is not None:
                low, high = np.searchsorted(radius, [reach[i] - limit, reach[i] + limit], side="left")
                high = np.searchsorted(radius, reach[i] + limit, side="right")
            part = scores[i, low:high]
            take = min(len(part), k + 1)
            if not take:
                continue
            least = np.partition(part, len(part) - take)[len(part) - take]
            best = sorted((-int(part[j]), x) for j in np.nonzero(part >= least)[0] for x in ids[order[low + j]] if x != query)[:k]
            found += [(query, x, -s) for s, x in best]
        return pa.table(list(zip(*found, strict=True)) or [[], [], []], schema=out)

    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    blocks = asked.select(F.col("cell").alias("c"), F.col("block").alias("b")).distinct()
    dealt = (blocks.join(cells, F.col("c") == F.col("cell"))
             .select(F.col("c").alias("cell"), F.col("b").alias("block"), "ids", "v", "pivot", "radius").groupBy("cell", "block"))
    return asked.groupBy("cell", "block").cogroup(dealt).applyInArrow(run, "query_id long, vec_id long, score long")


def best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding",
           pivots: int = PIVOTS, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that satisfies ``queries``, the k best other rows of the table.

    Vectors with null or non-finite components and rows without an id take no part; a shorter vector counts as filled up
    with zeros; ties go to the smaller id; fewer than k candidates return all.  Equal vectors enter the index once, with
    their k + 1 smallest ids, which is all that any query can return of them.  A repeated id counts once per distinct
    vector.  ``pivots`` are fitted on ``sample`` rows with the smallest hashes; every row is indexed.
    """
    rows = (vectors.select(F.col(f"`{key}`").cast("long").alias("id"), integer_vector(f"`{embedding}`").alias("v"), queries.alias("asked"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    top = rows.agg(F.max(norm).alias("norm"), F.max(F.size("v")).alias("width")).first()
    width, bound = top["width"] or 1, top["norm"] or 0.0
    drawn = rows.select("v", F.xxhash64("v", "id").alias("h")).orderBy("h").limit(sample).collect()
    space = Space(choose_pivots(padded([r["v"] for r in drawn], width), pivots), bound)

    copies = Window.partitionBy("v").orderBy("id")
    few = rows.select("v", "id").withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    distinct = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    placed = cut_lineage(index(distinct, space, width))
    # Annuli: slices of equal numbers of radii around each pivot; one radius shared by many is dealt by hash as well.
    counted = placed.groupBy("pivot").agg(F.count("*").alias("n"))
    sizes = {r["pivot"]: r["n"] for r in counted.collect()}
    slices_ = {p: max(1, min(256, n // ANNULUS)) for p, n in sizes.items()}
    cuts = {r["pivot"]: r["cuts"] for r in placed.groupBy("pivot").agg(
        F.percentile_approx("radius", [i / 256 for i in range(1, 256)], 10_000).alias("cuts")).collect()}
    inner = {p: cuts[p][255 // slices_[p]::max(1, 256 // slices_[p])][:slices_[p] - 1] if slices_[p] > 1 else [] for p in sizes}
    ring = F.lit(0)
    for p, at in inner.items():
        for c in at:
            ring = ring + F.when((F.col("pivot") == p) & (F.col("radius") > c), 1).otherwise(0)
    cells = placed.withColumn("ring", ring)
    deal = {(r["pivot"], r["ring"]): r for r in cells.groupBy("pivot", "ring").agg(
        F.count("*").alias("n"), F.min("radius").alias("low"), F.max("radius").alias("high")).collect()}
    part = F.lit(1)
    for (p, g), r in deal.items():
        if r["n"] > 2 * ANNULUS:
            part = F.when((F.col("pivot") == p) & (F.col("ring") == g), r["n"] // ANNULUS).otherwise(part)
    cells = cells.select("ids", "v", "pivot", "radius", F.struct("pivot", "ring", F.pmod(F.xxhash64("v"), part).cast("int").alias("part")).alias("cell"))
    annuli = [(p, g, max(1, r["n"] // ANNULUS if r["n"] > 2 * ANNULUS else 1), r["low"], r["high"]) for (p, g), r in sorted(deal.items())]
    asked = rows.where("asked").select(F.col("id").alias("query_id"), "v").distinct()
    n_blocks = max(1, asked.count() // QUERY_BLOCK)
    slack = 1e-6 * (1 + bound ** 0.5) + 1e-3

    def route(first: bool):
        """Annuli to visit: the one with the least bound, or all others that the limit leaves open, nearest first."""
        def run(batches):
            low, high = np.array([a[3] for a in annuli]), np.array([a[4] for a in annuli])
            at = np.array([a[0] for a in annuli])
            for batch in batches:
                vs = batch.column(1).to_pylist()
                d = space.distances(padded(vs, width), False)
                limits = [None] * len(vs) if first else batch.column(2).to_pylist()
                out = []
                for i, (query, v, limit) in enumerate(zip(batch.column(0).to_pylist(), vs, limits, strict=True)):
                    gap = np.maximum(0, np.maximum(low - d[i, at], d[i, at] - high))
                    order = np.argsort(gap, kind="stable")
                    chosen = order[:1] if first else [j for j in order[1:] if limit is None or gap[j] <= limit]
                    out += [(query, v, limit, {"pivot": annuli[j][0], "ring": annuli[j][1], "part": x}) for j in chosen for x in range(annuli[j][2])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                    zip(*out, strict=True) if out else [[]] * 4, arrow, strict=True)], ["query_id", "v", "limit", "cell"])

        return run

    arrow = [pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.struct([("pivot", pa.int64()), ("ring", pa.int32()), ("part", pa.int32())])]
    shape = "query_id long, v array<long>, limit double, cell struct<pivot:long,ring:int,part:int>"
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    if not annuli:
        empty = rows.limit(0)
        return empty.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    seeds = cut_lineage(best(scan(cells, asked.mapInArrow(route(True), shape).withColumn("block", block), space, width, k), k).drop("rank"))
    beaten = seeds.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
    # A vector that reaches the k-th score so far lies within this distance of the query.
    reach = F.sqrt(F.greatest(F.lit(0.0), norm + F.lit(bound) - 2 * F.col("least"))) + F.lit(slack)
    rest = (asked.join(beaten, "query_id", "left").select("query_id", "v", F.when(F.col("n") >= k, reach).alias("limit"))
            .mapInArrow(route(False), shape).withColumn("block", block))
    ranked = best(seeds.union(scan(cells, rest, space, width, k)), k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
