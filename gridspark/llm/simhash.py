"""SimHash near duplicates through pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to 64 reference fingerprints: the 16 Walsh patterns of
each of four 16-bit segments.  Two fingerprints within two bits agree on two whole segments at least, and then
their distances to the references of these segments, taken relative to the distance to zero, are equal.  Pairs are
looked up by these equal distances, discarded where any coordinate differs by more than the radius (the triangle
inequality), and the survivors are verified bit by bit.  Look-up keys that hold many fingerprints link them through
the values one bit away instead of pair by pair, which loses no link and stays linear.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.llm.common import map_texts
from gridspark.llm.graph import components
from gridspark.session import cut_lineage

RADIUS = 2
SEGMENTS, WIDTH = 4, 16
# Members of one look-up key up to which all its pairs are formed.
PAIRED = 24


def references() -> list[list[int]]:
    """Reference fingerprints by segment: Walsh patterns, whose distances determine the segment's bits."""
    walsh = [sum((bin(i & j).count("1") & 1) << j for j in range(WIDTH)) for i in range(1, WIDTH)] + [(1 << WIDTH) - 1]
    return [[w << (WIDTH * s) for w in walsh] for s in range(SEGMENTS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint_maker(words: int, seed: int):
    import numpy as np
    from xxhash import xxh64_intdigest

    def bits(hashes) -> int:
        h = np.array(hashes, np.uint64)
        ones = np.zeros(64, np.int64)
        for start in range(0, len(h), 1 << 14):
            part = h[start:start + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])

    def make(texts):
        out = []
        for t in texts:
            w = (t or "").encode("utf-8", "surrogatepass").lower().split()
            grams = zip(*(w[i:] for i in range(words)), strict=False) if len(w) > words else [w] if w else []
            hashes = [xxh64_intdigest(b" ".join(g), seed) for g in grams]
            out.append(bits(hashes) if hashes else 0)
        return (out,)

    return make


def with_fingerprints(docs: DataFrame, text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """``docs`` with ``fp`` (long), the 64-bit fingerprint of the whole text's word shingles.

    A-Z count as lower case, words are separated by ASCII white space, shingles keep their repeats; a text of fewer
    words is one shingle and a null or blank text has fingerprint zero.
    """
    return map_texts(docs, text, [("fp", "long")], lambda: fingerprint_maker(words, seed))


def distance_table(fps: DataFrame) -> DataFrame:
    """(fp, dist, sig): distances to all references, and one signature of relative distances per segment."""
    origin = F.bit_count("fp")
    refs = references()
    dist = F.array(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(r)))).cast("tinyint") for seg in refs for r in seg))
    sigs = [F.xxhash64(*(F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(r)))) - origin for r in seg)) for seg in refs]
    return fps.select("fp", dist.alias("dist"), F.array(*sigs).alias("sig"))


def keyed(table: DataFrame) -> DataFrame:
    """A row for each choice of SEGMENTS - RADIUS segments on which a neighbour may agree."""
    keys = [F.xxhash64(F.lit(i), *(F.col("sig")[s] for s in chosen))
            for i, chosen in enumerate(combinations(range(SEGMENTS), SEGMENTS - RADIUS))]
    return table.select("fp", "dist", F.explode(F.array(*keys)).alias("key"))


def far(a: Column, b: Column) -> Column:
    """Largest difference between two rows of the distance table."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints ``fp`` within RADIUS bits; every edge is such a pair."""
    rows = keyed(distance_table(fps))
    counted = rows.join(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")
    few, many = counted.where(F.col("n") <= PAIRED), counted.where(F.col("n") > PAIRED)
    pairs = (few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
             .where(far(F.col("x.dist"), F.col("y.dist")) <= RADIUS)
             .where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= RADIUS)
             .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))
    # Two values are within two bits if and only if a third lies within one bit of both; at most 65 values share one.
    flips = F.array(F.lit(0).cast("long"), *(F.lit(signed(1 << i)) for i in range(64)))
    near = many.select("fp").distinct().select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    hubs = near.select("fp", F.min("fp").over(Window.partitionBy("mid")).alias("hub")).where("hub < fp")
    return pairs.union(hubs.select(F.col("hub").alias("a"), F.col("fp").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id): ``component_id`` is the smallest key reachable over links.

    One row per row of ``docs``, repeated rows included.  Equal fingerprints are linked, so all blank texts are.  A null
    key is never a component id unless its component has no other.  An empty table gives an empty result.  Fingerprints
    are stored once; the graph runs on distinct fingerprints only, so copies never multiply.
    """
    fps = cut_lineage(with_fingerprints(docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")), "text")
                      .select("key", "fp"))
    distinct = fps.groupBy("fp").agg(F.min("key").alias("least"))
    members = components(links(distinct.select("fp")))
    linked = distinct.join(members, distinct["fp"] == members["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    found = linked.join(linked.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return (fps.join(found, "fp")
            .select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
