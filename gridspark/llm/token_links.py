"""Alignment of two tokenizers' tokens, and how often each pair of ids is linked in the whole corpus.

Every task links the tokens of its texts and writes, for each part of the second vocabulary, one sorted run of (pair, text,
times) records, packed in zstd frames.  A part's runs are merged frame by frame through a heap, which counts its pairs;
pairs are in order of their second id, so the highest count of each id is known when its pairs end.  The counts then go
back over the same runs and return to the texts.  A part with many records is merged in several groups of runs whose
counts are added, so no id, however frequent, falls to one task.
"""

from __future__ import annotations

import hashlib
import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.chunks import Remembered, Vocabularies, chunks, segments
from gridspark.llm.common import slices
from gridspark.session import cut_lineage

# Parts of the second vocabulary, by the id's remainder; packed bytes merged in one task, about; records of a frame.
PARTS, MERGED, FRAME = 32, 32 << 20, 1 << 16
# Text bytes whose links make one run in each part.
RUN_BYTES = 4 << 20


def pack(*columns) -> bytes:
    """Equally long columns of unsigned 32-bit integers, as a zstd frame of their bytes by weight."""
    import numpy as np
    import zstandard

    planes = np.concatenate([np.asarray(c, "<u4") for c in columns]).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(frame: bytes, columns: int):
    import numpy as np
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(frame), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").reshape(columns, -1).astype(np.int64)


def pack_run(keys, texts, times) -> list[bytes]:
    """Frames of records sorted by (key, text); a frame's keys are differences from the one before."""
    import numpy as np

    return [pack(np.diff(keys[i:i + FRAME], prepend=0), texts[i:i + FRAME], times[i:i + FRAME]) for i in range(0, len(keys), FRAME)]


def unpack_frame(frame: bytes):
    import numpy as np

    keys, texts, times = unpack(frame, 3)
    return np.cumsum(keys), texts, times


def summed(keys, counts):
    """Distinct keys of a sorted column and the sums of their counts."""
    import numpy as np

    if not len(keys):
        return keys, counts
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def merged(runs: list[list[bytes]]):
    """(keys, counts) over all runs: a heap gives the frame whose keys end first, and what is not above its last key
    is counted in all open frames at once; each run has one frame open."""
    import numpy as np

    waiting = [iter(frames) for frames in runs]
    heap, opened, out = [], {}, []

    def load(r):
        if frame := next(waiting[r], None):
            keys, _, times = unpack_frame(frame)
            opened[r] = summed(keys, times)
            heapq.heappush(heap, (int(keys[-1]), r))

    for r in range(len(runs)):
        load(r)
    while heap:
        last = heap[0][0]
        taken = []
        for r, (keys, counts) in opened.items():
            at = int(np.searchsorted(keys, last, "right"))
            taken.append((keys[:at], counts[:at]))
            opened[r] = keys[at:], counts[at:]
        keys, counts = (np.concatenate(x) for x in zip(*taken, strict=True))
        order = np.argsort(keys, kind="stable")
        out.append(summed(keys[order], counts[order]))
        spent = []
        while heap and heap[0][0] <= last:
            spent.append(heapq.heappop(heap)[1])
        for r in spent:
            del opened[r]
            load(r)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A pair that goes on in a run's next frame stands at the end of one step and at the start of the next.
    return summed(*(np.concatenate(x) for x in zip(*out, strict=True)))


def whole(ids, counts, texts, sizes, raw):
    """Whether the tokens of each chunk, so many one after another, give the bytes in ``raw``."""
    import numpy as np

    given = np.array([len(r) for r in raw])
    ends = np.cumsum(counts)
    total = np.concatenate([[0], np.cumsum(sizes[ids])])
    good = total[ends] - total[ends - counts] == given
    joined = b"".join([texts[i] for i in ids[np.repeat(good, counts)].tolist()])
    if joined != b"".join([r for r, ok in zip(raw, good.tolist(), strict=True) if ok]):
        tokens = ids.tolist()
        good &= [b"".join([texts[i] for i in tokens[e - n:e]]) == r for e, n, r in zip(ends.tolist(), counts.tolist(), raw, strict=True)]
    return good


def linker(byte_path: str, piece_path: str):
    """What :class:`Remembered` asks of distinct chunks: whole, n_a, n_b, n_groups; one pair a link, b id first; groups.

    ``whole`` is 1 where both vocabularies give the chunk's bytes back; others have no links and groups.
    """
    import numpy as np

    v = Vocabularies(byte_path, piece_path)
    if len(v.byte_bytes) > 1 << 16 or len(v.piece_bytes) > 1 << 15:
        raise ValueError("a pair of ids must fit 31 bits")
    sizes_a, sizes_b = (np.array([len(x) for x in t]) for t in (v.byte_bytes, v.piece_bytes))
    inside_a, last_a = ([f"{i}{sign}" for i in range(len(sizes_a))] for sign in ",|")
    inside_b, last_b = ([f"{i}{sign}" for i in range(len(sizes_b))] for sign in ",;")
    names = np.array(inside_a + last_a + inside_b + last_b, dtype=object)
    offsets = np.cumsum([0, len(sizes_a), len(sizes_a), len(sizes_b)])

    def link(texts: list[str]):
        (a, n_a), (b, n_b) = v.byte_ids(texts), v.piece_ids(texts)
        raw = [c.encode("utf-8", "surrogatepass") for c in texts]
        good = whole(a, n_a, v.byte_bytes, sizes_a, raw) & whole(b, n_b, v.piece_bytes, sizes_b, raw)
        values, sizes, named = np.zeros((len(texts), 4), np.int64), np.zeros(len(texts), np.int64), [""] * len(texts)
        if not good.any():
            return values, sizes, np.zeros(0, np.int64), named
        a, b, n_a, n_b = a[np.repeat(good, n_a)], b[np.repeat(good, n_b)], n_a[good], n_b[good]
        end_a, end_b = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
        # Between two neighbouring ends lies one token of either side: a link.
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        twice = ends[1:] == ends[:-1]
        cuts, shared = np.concatenate([ends[:1], ends[1:][~twice]]), ends[1:][twice]
        keys = (b[np.searchsorted(end_b, cuts)] << 16 | a[np.searchsorted(end_a, cuts)]).astype("<u4")
        ends = end_a[np.cumsum(n_a) - 1]
        upto_link, upto_group = np.searchsorted(cuts, ends, "right"), np.searchsorted(shared, ends, "right")
        group_a, group_b = np.searchsorted(shared, end_a), np.searchsorted(shared, end_b)
        signs = np.concatenate([names[offsets[0 + np.isin(end_a, shared)] + a], names[offsets[2 + np.isin(end_b, shared)] + b]])
        signs = signs[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        start = 0
        for k, end in zip(np.flatnonzero(good).tolist(), np.cumsum(n_a + n_b).tolist(), strict=True):
            named[k] = "".join(signs[start:end])
            start = end
        values[good] = np.stack([np.ones(len(n_a), np.int64), n_a, n_b, np.diff(upto_group, prepend=0)], axis=1)
        sizes[good] = np.diff(upto_link, prepend=0)
        return values, sizes, keys, named

    return link


def aligner(byte_path: str, piece_path: str, parts: int):
    """Function from texts to (digests: n_a, n_b, n_groups, n_links, groups_sha256 of each text; runs by part)."""
    import numpy as np

    known = Remembered(linker(byte_path, piece_path), values=4)

    def align(texts: list[str | None]):
        totals = np.zeros((len(texts), 4), np.int64)
        hashes, started, broken, records = [hashlib.sha256() for _ in texts], [False] * len(texts), np.zeros(len(texts), bool), []

        def take(part: list[tuple[int, str]]) -> None:
            """Segments (text number, characters) of any texts, in order."""
            split = [chunks(s) for _, s in part]
            codes = known.numbers([c for s in split for c in s])
            counts = np.array([len(s) for s in split])
            numbers = np.array([i for i, _ in part])
            owner = np.repeat(numbers, counts)
            values = known.values.all[codes]
            broken[owner[values[:, 0] == 0]] = True
            ends = np.cumsum(counts)
            values = np.column_stack([values[:, 1:], known.size.all[codes]])
            np.add.at(totals, numbers, np.add.reduceat(values, ends - counts, axis=0))
            named = [known.names[c] for c in codes.tolist()]
            for i, start, end in zip(numbers.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                # Every chunk ends with the mark between groups; the last one of a text is left out.
                hashes[i].update((";" * started[i] + "".join(named[start:end])[:-1]).encode())
                started[i] = True
            keys, owner = known.spread(codes, owner)
            packed = np.sort(keys << 32 | owner)
            records.append(summed(packed, np.ones(len(packed), np.int64)))

        part, size = [], 0
        for i, text in enumerate(texts):
            for s in segments(" " + text) if text else ():
                part.append((i, s))
                size += len(s)
                if size > 1 << 19:
                    take(part)
                    part, size = [], 0
        if part:
            take(part)
        return totals, hashes, broken, records

    def run(texts: list[str | None]):
        totals, hashes, broken, records = align(texts)
        totals[broken] = 0
        digests = [(*t, h.hexdigest() if t[0] else "") for t, h in zip(totals.tolist(), hashes, strict=True)]
        if not records:
            return digests, {}
        packed, times = (np.concatenate(x) for x in zip(*records, strict=True))
        text = packed & 0xFFFFFFFF
        kept = ~broken[text]
        packed, times = packed[kept], times[kept]
        part = (packed >> 48) % parts
        order = np.lexsort((packed, part))
        packed, times, part = packed[order], times[order], part[order]
        runs = {}
        numbers, starts = np.unique(part, return_index=True)
        for p, start, end in zip(numbers.tolist(), starts.tolist(), [*starts[1:].tolist(), len(part)], strict=True):
            keys, sums = summed(packed[start:end], times[start:end])
            runs[p] = pack_run(keys >> 32, keys & 0xFFFFFFFF, sums)
        return digests, runs

    return run


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def linked_runs(named: DataFrame, byte_path: str, piece_path: str, parts: int) -> DataFrame:
    """Digest rows (block, key, counts, groups_sha256) and run rows (block, part, run) of the texts in ``named`` (key, text)."""
    import pyarrow as pa
    from pyspark.sql import types as T

    fields = [T.StructField("block", T.LongType()), named.schema["key"], *(T.StructField(c, T.LongType()) for c in COUNTS),
              T.StructField("groups_sha256", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("run", T.ArrayType(T.BinaryType()))]
    schema = T.StructType(fields)

    def run(batches):
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, call = to_arrow_schema(schema), aligner(byte_path, piece_path, parts)
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, "text", RUN_BYTES):
                digests, runs = call(rows.column(1).to_pylist())
                n = len(digests)
                columns = list(zip(*digests, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * n, pa.int64()), rows.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]),
                     pa.array(columns[4], pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, arrow.field("run").type)], schema=arrow)
                m = len(runs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block] * m, pa.int64()), *(pa.nulls(m, arrow.field(i).type) for i in range(1, 7)),
                     pa.array(list(runs), pa.int32()), pa.array(list(runs.values()), arrow.field("run").type)], schema=arrow)
                block += 1
        pa.default_memory_pool().release_unused()

    return named.mapInArrow(run, schema)


def count_runs(table):
    """Counts of the pairs in a group of runs of one part."""
    import pyarrow as pa

    keys, counts = merged(table.column("run").to_pylist())
    return pa.table({"part": pa.array([table.column("part")[0].as_py()] * len(keys), pa.int32()), "pair": keys, "n": counts})


def pack_counts(table):
    """All pairs of a part in order, their counts, and whether a count is the highest of its second id."""
    import numpy as np
    import pyarrow as pa

    keys, counts = (table.column(c).to_numpy() for c in ("pair", "n"))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    side = keys >> 16
    first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
    highest = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(side))))
    packed = pack(np.diff(keys, prepend=0), counts & 0xFFFFFFFF, counts >> 32, counts == highest)
    return pa.table({"part": pa.array([table.column("part")[0].as_py()], pa.int32()), "counted": pa.array([packed], pa.binary())})


def send_back(key, runs, counted):
    """What each run's texts get from one part: (block, share), the share holding texts, sums in two halves, and best links."""
    import numpy as np
    import pyarrow as pa

    blocks, shares = [], []
    if runs.num_rows:
        steps, low, high, best = unpack(counted.column("counted")[0].as_py(), 4)
        keys, counts = np.cumsum(steps), low | high << 32
        for block, frames in zip(runs.column("block").to_pylist(), runs.column("run").to_pylist(), strict=True):
            gained = np.zeros((0, 2), np.int64)
            for frame in frames:
                pairs, texts, times = unpack_frame(frame)
                at = np.searchsorted(keys, pairs)
                if (size := int(texts.max()) + 1) > len(gained):
                    gained = np.concatenate([gained, np.zeros((size - len(gained), 2), np.int64)])
                np.add.at(gained, texts, np.stack([counts[at], best[at]], axis=1) * times[:, None])
            texts = np.flatnonzero(gained[:, 0])
            sums, bests = gained[texts].T
            blocks.append(block)
            shares.append(pack(texts, sums & 0xFFFFFFFF, sums >> 32, bests))
    return pa.table({"block": pa.array(blocks, pa.int64()), "share": pa.array(shares, pa.binary())})


def token_links(docs: DataFrame, byte_path: str, piece_path: str, key: str = "doc_id", text: str = "text", parts: int = PARTS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per row of ``docs``.

    A: tokens of a space and the text by the byte-level vocabulary; B: tokens of the text by the piece vocabulary.  A link
    is a pair of token occurrences whose byte ranges overlap; groups end where both sides end.  A pair's count is the number
    of its links in all texts; ``n_best`` counts links with the highest count of their B id, ``count_sum`` sums counts over
    links.  A text that is null, empty, or that either side does not give back byte for byte has zeros and no digest.
    Repeated rows and null keys are rows like others; other columns play no part.  Long texts are linked a segment at a
    time.  Disk holds the packed runs three times: stored, and dealt to the parts twice or, where Spark reuses it, once.
    """
    from pyspark.sql import types as T

    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    stored = cut_lineage(linked_runs(named, byte_path, piece_path, parts))
    digests = stored.where("part is null").drop("part", "run")
    runs = stored.where("part is not null").select("block", "part", "run")
    packed = F.aggregate(F.transform("run", lambda f: F.octet_length(f).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    # One row for each part.
    groups = F.broadcast(runs.groupBy("part").agg(F.ceil(F.sum(packed) / MERGED).alias("groups")))
    dealt = runs.join(groups, "part").select("part", F.pmod(F.xxhash64("block"), "groups").alias("group"), "block", "run")
    counts = dealt.groupBy("part", "group").applyInArrow(count_runs, "part int, pair long, n long")
    whole = counts.groupBy("part", "pair").agg(F.sum("n").alias("n")).groupBy("part").applyInArrow(pack_counts, "part int, counted binary")
    whole = whole.join(groups, "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("group"), "counted")
    shares = dealt.groupBy("part", "group").cogroup(whole.groupBy("part", "group")).applyInArrow(send_back, "block long, share binary")

    fields = [named.schema["key"], *(T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())]
    schema = T.StructType(fields)

    def finish(key, rows, shares):
        import numpy as np
        import pyarrow as pa

        best, total = np.zeros((2, rows.num_rows), np.int64)
        for share in shares.column("share").to_pylist():
            texts, low, high, bests = unpack(share, 4)
            best[texts] += bests
            total[texts] += low | high << 32
        return pa.table([*(rows.column(c) for c in ("key", *COUNTS)), pa.array(best), pa.array(total), rows.column("groups_sha256")], names=schema.names)

    out = digests.groupBy("block").cogroup(shares.groupBy("block")).applyInArrow(finish, schema)
    return out.withColumnRenamed("key", key)
