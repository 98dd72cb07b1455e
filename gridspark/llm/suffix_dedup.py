"""Removal of repeated passages by sorted suffixes.

A byte goes if a string of ``window`` bytes that covers it also starts in a document with a smaller id.

Sorting every suffix would move many times the input, so suffixes are compared at anchors only: of the short grams in
each window the one with the least hash.  Equal windows have equal anchors, so nothing is missed.  Texts are dealt to
chunks by id.  1: every chunk sends the distinct hashes of its anchors to buckets by hash.  2: a bucket returns those
that repeat.  3: chunks send the surroundings of these anchors, distinct ones only, each with its smallest id.  4: a
bucket sorts the surroundings as suffixes from the anchor to the right and, mirrored, to the left; neighbours' common
extensions give the classes of equal windows and the smallest id of each.  5: chunks mark what they have to remove.
Exact repeats collapse in every chunk before they are sent, so a passage in a third of all texts costs one row a chunk.
"""

from __future__ import annotations

import numpy as np
import zstandard
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridspark.llm.suffix_sort import sort_suffixes
WINDOW = 50
GRAM = 24
CHUNK_BYTES = 8 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_SPAN = 1 << 16
_GRAMS = 1 << 14  # hashed at once, so that they stay in the cache
SHORT = 6  # bytes of a hash that travel


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Mixed 64-bit hashes of all k-grams of a byte array, built from grams of doubled length."""
    power, size, total, have = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    bits = k
    while bits:
        if bits & 1:
            n = len(data) - have - size + 1
            total = power[:n] if total is None else total[:n] * _pow(size) + power[have:have + n]
            have += size
        bits >>= 1
        if bits:
            n = len(power) - size
            power, size = power[:n] * _pow(size) + power[size:size + n], 2 * size
    total = total ^ (total >> np.uint64(31))
    total = total * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _pow(n: int) -> np.uint64:
    return np.uint64(pow(int(_M), n, 1 << 64))


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """``pick`` over every run of w neighbours."""
    size = 1
    while 2 * size <= w:
        x, size = pick(x[:len(x) - size], x[size:]), 2 * size
    return pick(x[:len(x) - (w - size)], x[w - size:]) if size < w else x


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that are least in some window; every one of equal least grams counts.

    Texts lie one after another; windows that cross their borders have no say.
    """
    w, places, hashes = window - k + 1, [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    edges = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= window
    np.add.at(edges, starts[long], 1)
    np.add.at(edges, ends[long] - window + 1, -1)
    whole = np.cumsum(edges, dtype=np.int8, out=edges)
    # Each span of grams is looked at together with the windows that reach into it.
    for start in range(0, len(data) - k + 1 if len(data) >= window else 0, _GRAMS):
        low = max(0, start - w + 1)
        h = gram_hashes(data[low:start + _GRAMS + w - 1 + k - 1], k)
        least = sliding(h, w, np.minimum)
        least = np.where(whole[low:low + len(least)] > 0, least, np.uint64(0))
        padded = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
        chosen = np.nonzero(sliding(padded, w, np.maximum)[:len(h)] == h)[0]
        chosen = chosen[(chosen + low >= start) & (chosen + low < start + _GRAMS)]
        places.append(chosen + low)
        hashes.append(h[chosen])
    return np.concatenate(places), np.concatenate(hashes)


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one row of each kind, and the kind of every row: by 64-bit hashes, verified, else by whole rows."""
    n, m = rows.shape
    words = np.zeros((n, -(-m // 8) * 8), np.uint8)
    words[:, :m] = rows
    words = words.view(np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * _M
        h ^= h >> np.uint64(32)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    if any((words[first[which[i:i + _SPAN]]] != words[i:i + _SPAN]).any() for i in range(0, n, _SPAN)):
        _, first, which = np.unique(np.ascontiguousarray(rows).view(f"V{m}").ravel(), return_index=True, return_inverse=True)
    return first, which


def in_order(table: pa.Table) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Order of the rows by (id, body), with both columns in this order."""
    ids, bodies = table.column("id").to_pylist(), table.column("body").to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i], bodies[i]))
    return order, np.array([ids[i] for i in order], np.int64), [bodies[i] for i in order]


class Chunk:
    """Texts of one chunk, in order of (id, text), as one byte array."""

    def __init__(self, table: pa.Table, window: int, k: int):
        self.order, self.ids, self.bodies = in_order(table)
        sizes = np.array([len(b) for b in self.bodies], np.int64)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.data = np.frombuffer(b"".join(self.bodies), np.uint8)
        self.window, self.k = window, k
        self.at, hashes = anchors(self.data, self.starts, self.ends, window, k)
        # One bit less than travels: the lowest one is a mark.
        self.hash = hashes >> np.uint64(65 - 8 * SHORT)
        self.row = np.searchsorted(self.ends, self.at, "right")

    def keep(self, hashes: np.ndarray) -> None:
        """Forget anchors whose hash is not among ``hashes``."""
        hashes = np.sort(hashes)
        i = np.minimum(np.searchsorted(hashes, self.hash), max(0, len(hashes) - 1))
        ok = hashes[i] == self.hash if len(hashes) else np.zeros(len(self.hash), bool)
        self.at, self.hash, self.row = self.at[ok], self.hash[ok], self.row[ok]

    def surroundings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct surroundings of the anchors, the index of each anchor's one, and the smallest id of each.

        A row holds how many bytes to the left and right lie in the text, then window - k bytes before the anchor and
        window bytes from it; bytes beyond the text are zero.
        """
        reach = self.window - self.k
        left = np.minimum(self.at - self.starts[self.row], reach)
        right = np.minimum(self.ends[self.row] - self.at, self.window)
        rows = np.empty((len(self.at), 2 + reach + self.window), np.uint8)
        rows[:, 0], rows[:, 1] = left, right
        offset = np.arange(-reach, self.window)
        for start in range(0, len(self.at), _SPAN):
            part = slice(start, start + _SPAN)
            at = self.at[part, None] + offset
            inside = (offset >= -left[part, None]) & (offset < right[part, None])
            rows[part, 2:] = np.where(inside, self.data[np.clip(at, 0, max(0, len(self.data) - 1))], 0)
        if not len(rows):
            return rows, np.zeros(0, np.int64), np.zeros(0, np.int64)
        first, which = distinct(rows)
        least = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(least, which, self.ids[self.row])
        return rows[first], which, least


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes * _M >> np.uint64(33)).astype(np.int64) % buckets


def by_bucket(which: np.ndarray, buckets: int):
    """(bucket, indices) for each bucket that occurs."""
    order = np.argsort(which, kind="stable")
    cuts = np.flatnonzero(np.diff(which[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(which[part[0]]), part


def short(hashes: np.ndarray) -> bytes:
    """The low SHORT bytes of each hash: enough to find repeats, as a chance match costs work but changes nothing."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT].tobytes()


def longs(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // SHORT, 8), np.uint8)
    out[:, :SHORT] = np.frombuffer(blob, np.uint8).reshape(-1, SHORT)
    return out.view("<u8").ravel()


def packed(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def repeated(blobs: list[bytes]) -> list[np.ndarray]:
    """For each blob those of its hashes that stand in others too, or that it marks (lowest bit) as held more than once."""
    each = longs(b"".join(blobs))
    bare, again = each >> np.uint64(1), (each & np.uint64(1)) == 1
    order = np.argsort(bare)
    pairs = np.flatnonzero(bare[order[1:]] == bare[order[:-1]])
    again[order[pairs]] = again[order[pairs + 1]] = True
    ends = np.cumsum([len(b) // SHORT for b in blobs])
    return [b[a] for b, a in zip(np.split(bare, ends[:-1]), np.split(again, ends[:-1]), strict=True)]


def smallest_by_window(rows: np.ndarray, ids: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct surroundings with their smallest ids: these ids, and a mask of windows (by bytes before the
    anchor) that also occur in surroundings with a smaller one."""
    reach = window - k
    first, which = distinct(rows)
    least = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(least, which, ids)
    flat = rows[first]
    mask = np.zeros(len(flat), np.int64)
    _, group = distinct(flat[:, 2 + reach:2 + reach + k])
    some = np.nonzero(np.bincount(group)[group] > 1)[0]
    if len(some):
        sub, low = flat[some], least[some]
        right_order, right_common = sort_suffixes(np.ascontiguousarray(sub[:, 2 + reach:]), group[some])
        left_order, left_common = sort_suffixes(np.ascontiguousarray(sub[:, 2:2 + reach][:, ::-1]), group[some])
        left, right = sub[:, 0].astype(np.int64), sub[:, 1].astype(np.int64)
        for a in range(reach + 1):
            valid = np.nonzero((left >= a) & (right >= window - a))[0]
            if len(valid) < 2:
                continue
            classes = np.empty((2, len(sub)), np.int64)
            classes[0, right_order] = np.cumsum(right_common < window - a)
            classes[1, left_order] = np.cumsum(left_common < a) if a else 0
            key = classes[0, valid] * (len(sub) + 1) + classes[1, valid]
            _, member = np.unique(key, return_inverse=True)
            first = np.full(member.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, member, low[valid])
            hit = first[member] < low[valid]
            mask[some[valid[hit]]] |= np.int64(1) << np.int64(a)
    return least[which], mask[which]


def removal(chunk: Chunk, which: np.ndarray, least: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Bytes of the chunk to remove, as booleans."""
    window, reach = chunk.window, chunk.window - chunk.k
    left = np.minimum(chunk.at - chunk.starts[chunk.row], reach)
    right = np.minimum(chunk.ends[chunk.row] - chunk.at, window)
    edges = np.zeros(len(chunk.data) + 1, np.int32)
    later = chunk.ids[chunk.row] > least[which]
    # The windows of an anchor overlap, so one whose windows all go removes a single run.
    most, fewest = np.minimum(left, reach), np.maximum(0, window - right)
    go = np.nonzero(later & (most >= fewest))[0]
    np.add.at(edges, chunk.at[go] - most[go], 1)
    np.add.at(edges, chunk.at[go] - fewest[go] + window, -1)
    some = np.nonzero(~later & (mask[which] != 0))[0]
    at, left, right, bits = chunk.at[some], left[some], right[some], mask[which[some]]
    for a in range(reach + 1 if len(some) else 0):
        go = (left >= a) & (right >= window - a) & ((bits >> np.int64(a)) & 1 == 1)
        np.add.at(edges, at[go] - a, 1)
        np.add.at(edges, at[go] - a + window, -1)
    return np.cumsum(edges[:-1], out=edges[:-1]) > 0


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = GRAM,
                   chunk_bytes: int = CHUNK_BYTES, keep: tuple[str, ...] = (),
                   whole_characters: bool = False) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept, and the columns ``keep``): ``kept`` holds the remaining bytes (binary).

    One row per row of ``docs``.  Null and empty texts have no bytes; texts shorter than ``window`` lose nothing.
    Strings are judged on the input; copies of the smallest id itself stay, also those in other rows with the same id.
    Rows without an id are compared with nothing and returned whole.  ``whole_characters`` also drops those remaining
    bytes from ``kept`` that form no whole character any more; counts stay those of the rule.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    inner = [f"__{i}" for i in range(len(keep))]
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), body.alias("body"), *(F.col(f"`{c}`").alias(x) for c, x in zip(keep, inner)))
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    chunks = max(1, total // chunk_bytes)
    # Buckets receive about a chunk's worth of anchors each.
    buckets = max(1, total // (2 * chunk_bytes))
    tiny = F.octet_length("body") < window
    alone = rows.where(F.col("id").isNull() | tiny)
    dealt = (rows.where(F.col("id").isNotNull() & ~tiny).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))
             .repartition(F.col("chunk")))

    def send(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, window, k)
        hashes, counts = np.unique(chunk.hash, return_counts=True)
        marked = (hashes << np.uint64(1)) | (counts > 1).astype(np.uint64)
        cells = [(table.column("chunk")[0].as_py(), b, short(marked[i])) for b, i in by_bucket(bucket_of(hashes, buckets), buckets)]
        return pa.table(list(zip(*cells, strict=True)) or [[], [], []], schema=sent)

    def reply(table: pa.Table) -> pa.Table:
        own = repeated(table.column("blob").to_pylist())
        out = [(chunk, short(x)) for chunk, x in zip(table.column("chunk").to_pylist(), own, strict=True) if len(x)]
        return pa.table(list(zip(*out, strict=True)) or [[], []], schema=pa.schema([("chunk", pa.int64()), ("blob", pa.binary())]))

    def narrowed(texts: pa.Table, wanted: pa.Table) -> Chunk:
        chunk = Chunk(texts, window, k)
        chunk.keep(longs(b"".join(wanted.column("blob").to_pylist())))
        return chunk

    def surround(texts: pa.Table, wanted: pa.Table) -> pa.Table:
        if not texts.num_rows or not wanted.num_rows:
            return pa.table([[], [], [], []], schema=around)
        chunk = narrowed(texts, wanted)
        contexts, which, least = chunk.surroundings()
        hashes = np.zeros(len(contexts), np.uint64)
        hashes[which] = chunk.hash
        cells = [(texts.column("chunk")[0].as_py(), b, packed(contexts[i]), packed(least[i]))
                 for b, i in by_bucket(bucket_of(hashes, buckets), buckets)]
        return pa.table(list(zip(*cells, strict=True)) or [[], [], [], []], schema=around)

    def resolve(table: pa.Table) -> pa.Table:
        rows = np.concatenate([unpacked(x.as_py(), "u1") for x in table.column("contexts")]).reshape(-1, 2 + 2 * window - k)
        ids = [unpacked(x.as_py(), "<i8") for x in table.column("ids")]
        least, mask = smallest_by_window(rows, np.concatenate(ids), window, k)
        ends = np.cumsum([len(x) for x in ids])
        out = [(c, b, packed(least[e - len(x):e]), packed(mask[e - len(x):e]))
               for c, b, x, e in zip(table.column("chunk").to_pylist(), table.column("bucket").to_pylist(), ids, ends, strict=True)]
        return pa.table(list(zip(*out, strict=True)), schema=solved)

    def apply(texts: pa.Table, known: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([pa.array([], t) for t in final.types] + [texts.column(c) for c in inner], names=final.names + inner)
        wanted, results = known.filter(pc.is_null(known.column("bucket"))), known.filter(pc.is_valid(known.column("bucket")))
        if results.num_rows:
            chunk = narrowed(texts, wanted.select(["least"]).rename_columns(["blob"]))
            contexts, which, _ = chunk.surroundings()
            hashes = np.zeros(len(contexts), np.uint64)
            hashes[which] = chunk.hash
            least, mask = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
            told = {b: (x, y) for b, x, y in zip(*(results.column(c).to_pylist() for c in ("bucket", "least", "mask")), strict=True)}
            for b, i in by_bucket(bucket_of(hashes, buckets), buckets):
                least[i], mask[i] = unpacked(told[b][0], "<i8"), unpacked(told[b][1], "<i8")
            gone, order, ids, bodies = removal(chunk, which, least, mask), chunk.order, chunk.ids, chunk.bodies
        else:
            gone, (order, ids, bodies) = None, in_order(texts)
        out, at = [], 0
        for i, b in zip(ids, bodies, strict=True):
            part = gone[at:at + len(b)] if gone is not None else np.zeros(0, bool)
            at += len(b)
            n = int(part.sum())
            spans = int(part[:1].sum() + (part[1:] & ~part[:-1]).sum())
            kept = np.frombuffer(b, np.uint8)[~part].tobytes() if n else b
            out.append((int(i), len(b), n, spans, kept.decode("utf-8", "ignore").encode() if n and whole_characters else kept))
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), final.types, strict=True)]
        return pa.table(columns + [texts.column(c).take(pa.array(order)) for c in inner], names=final.names + inner)

    sent = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("blob", pa.binary())])
    around = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("contexts", pa.binary()), ("ids", pa.binary())])
    solved = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("least", pa.binary()), ("mask", pa.binary())])
    final = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])
    hashes = dealt.groupBy("chunk").applyInArrow(send, "chunk long, bucket long, blob binary")
    # One plan without stored steps in between: the texts are dealt once and all three passes read the same exchange.
    wanted = hashes.groupBy("bucket").applyInArrow(reply, "chunk long, blob binary")
    contexts = dealt.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(
        surround, "chunk long, bucket long, contexts binary, ids binary")
    results = contexts.groupBy("bucket").applyInArrow(resolve, "chunk long, bucket long, least binary, mask binary")
    known = results.union(wanted.select("chunk", F.lit(None).cast("long"), "blob", F.lit(None).cast("binary")))
    removed = dealt.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(
        apply, T.StructType([*T._parse_datatype_string("id long, n_bytes long, n_removed long, n_spans long, kept binary").fields,
                             *(rows.schema[c] for c in inner)]))
    zero = F.lit(0).cast("long")
    whole = alone.select("id", F.octet_length("body").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("body").alias("kept"), *inner)
    return removed.union(whole).withColumnsRenamed({"id": key, **dict(zip(inner, keep))})
