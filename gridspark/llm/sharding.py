"""Shards of equal bytes by histogram sort, in DataFrame operations only.

Rows are ordered by a key: a 60-bit hash of the text, then the id.  Exact bytes below evenly spaced probes are
counted over all partitions; the bracket around each wanted boundary is probed again, more finely, until it holds
one key.  Then every row knows its shard from the splitters, and rows are exchanged once.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.session import cut_lineage

PROBES = 64  # brackets into which each open bracket is cut in a round
ROWS_PER_TASK = 200_000  # rows of a shard that one task numbers


def size_of(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def hashed(text: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def probe(rows: DataFrame, level: str, brackets: list[dict]) -> list[dict]:
    """Exact bytes, and smallest and largest key, in the parts of each open bracket.

    A bracket is a range [low, high] of ``h``, or of ``id`` within one ``h``; at most one row per part returns.
    """
    column = F.col(level)
    part = F.lit(None).cast("long")
    for i, b in enumerate(brackets):
        width = (b["high"] - b["low"]) // PROBES + 1
        inside = column.between(b["low"], b["high"]) & ((F.col("h") == b["h"]) if level == "id" else F.lit(True))
        part = F.when(inside, F.expr(f"{i * PROBES} + cast((cast({level} as decimal(20)) - {b['low']}) div {width} as bigint)")).otherwise(part)
    found = (rows.select(part.alias("part"), column.alias("x"), "size").where("part is not null").groupBy("part")
             .agg(F.sum("size").alias("bytes"), F.min("x").alias("low"), F.max("x").alias("high")).collect())
    return sorted((r.asDict() for r in found), key=lambda r: r["part"])


def splitters(rows: DataFrame, shards: int) -> list[tuple[int, int]]:
    """Keys (h, id) at which shards 1, 2, ... begin: the first keys with bytes below of at least i / shards of all.

    Rounds stop when every bracket is a single key, which is the tolerance that a whole row allows.
    """
    top = rows.agg(F.sum("size").alias("bytes"), F.min("h").alias("low"), F.max("h").alias("high")).first()
    if not top["bytes"]:
        return []
    goals = {i: -(-i * top["bytes"] // shards) for i in range(1, shards)}
    first = {"level": "h", "h": None, "below": 0, "low": top["low"], "high": top["high"], "bytes": top["bytes"]}
    # A goal g falls into the bracket of the last key whose bytes below are under g; its shard begins after that key.
    pending, last = dict.fromkeys(goals, 0), {}
    brackets = [first]
    while pending:
        finer: list[dict] = []
        where: dict[int, int] = {}
        for level in ("h", "id"):
            chosen = [k for k, b in enumerate(brackets) if b["level"] == level and k in pending.values()]
            if not chosen:
                continue
            parts: dict[int, list[dict]] = {}
            for r in probe(rows, level, [brackets[k] for k in chosen]):
                parts.setdefault(chosen[r["part"] // PROBES], []).append(r)
            for k in chosen:
                below, starts = brackets[k]["below"], []
                for r in parts[k]:
                    starts.append(below)
                    below += r["bytes"]
                for i in (i for i, at in pending.items() if at == k):
                    r = parts[k][j := bisect_right(starts, goals[i] - 1) - 1]
                    b = {"level": level, "h": brackets[k]["h"], "below": starts[j], "low": r["low"], "high": r["high"], "bytes": r["bytes"]}
                    if level == "id" and b["low"] == b["high"]:
                        last[i] = (b["h"], b["low"])
                        continue
                    if level == "h" and b["low"] == b["high"]:
                        b |= {"level": "id", "h": b["low"], "low": None}
                    if b not in finer:
                        finer.append(b)
                    where[i] = finer.index(b)
        single = sorted({b["h"] for b in finer if b["low"] is None})
        if single:
            ends = {r["h"]: r for r in rows.where(F.col("h").isin(single)).groupBy("h").agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()}
            for b in finer:
                if b["low"] is None:
                    b |= {"low": ends[b["h"]]["low"], "high": ends[b["h"]]["high"]}
        brackets, pending = finer, where
    return [last[i] for i in sorted(last)]


def shard_of(at: list[tuple[int, int]]) -> Column:
    """Number of splitters below the row's key."""
    out = F.lit(0)
    for h, i in at:
        out = out + F.when((F.col("h") > h) | ((F.col("h") == h) & (F.col("id") > i)), 1).otherwise(0)
    return out.cast("int")


def assign_shards(docs: DataFrame, shards: int = 40, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard): law ``bytes``, one row per row of ``docs``.

    Shards differ from an equal share of the bytes by less than one row; only rows equal in text and id, which no key
    tells apart, stay together whatever their number.  Null ids sort first, null texts count as empty; an empty table
    gives an empty result.  ``slot`` numbers the rows of a shard without gaps: tasks number rows by themselves, and
    counts of all tasks' groups, known before the exchange, give each group its offset.
    """
    least = -(1 << 62)
    rows = cut_lineage(docs.select(
        F.col(f"`{key}`").alias("key"), hashed(text).alias("h"), F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(least)).alias("id"),
        size_of(text).alias("size"), F.crc32(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")).alias("text_crc32")))
    n = rows.count()
    groups = max(1, n // (shards * ROWS_PER_TASK))
    placed = rows.withColumn("shard", shard_of(splitters(rows, shards))).withColumn("group", F.pmod(F.xxhash64("h", "id"), F.lit(groups)))
    before = Window.partitionBy("shard").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "group").agg(F.count("*").alias("n"))
               .select("shard", "group", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    numbered = placed.withColumn("row", F.row_number().over(Window.partitionBy("shard", "group").orderBy("h", "id")))
    return (numbered.join(offsets, ["shard", "group"])
            .select(F.col("key").alias(key), "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                    (F.col("row") - 1 + F.col("offset")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
