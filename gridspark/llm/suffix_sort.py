"""Hash-compared suffix sort of short byte strings, vectorised over all of them."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


def prefix_hashes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes (modulo 2**64) of all prefixes of each row, as (rows, length + 1)."""
    n, m = rows.shape
    out = np.zeros((n, m + 1), np.uint64)
    for j in range(m):
        # Bytes are mixed first: plain small digits make polynomials modulo a power of two collide.
        digit = (rows[:, j].astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        out[:, j + 1] = out[:, j] * BASE + (digit ^ (digit >> np.uint64(32)))
    return out


def extension(h: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows x and y, by binary search on equal prefix hashes."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), h.shape[1] - 1)
    for _ in range(int(h.shape[1]).bit_length()):
        mid = (low + high + 1) >> 1
        same = h[x, mid] == h[y, mid]
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def sorts_before(rows: np.ndarray, h: np.ndarray, x: np.ndarray, y: np.ndarray, y_left: np.ndarray) -> np.ndarray:
    """Whether row x sorts before row y; of equal rows the one in the left run does."""
    n = extension(h, x, y)
    at = np.minimum(n, rows.shape[1] - 1)
    return np.where(n == rows.shape[1], ~y_left, rows[x, at] < rows[y, at])


def sort_suffixes(rows: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, bytes), and each one's common prefix with the one before it (0 for a group's first).

    Merge sort from single rows upward: all pairs of runs of a level, in all groups, are merged at once.  An element's
    place in the merged run is its place in its own run plus its rank in the other, found by binary search; each
    comparison costs a number of steps logarithmic in the length.  Equal hashes are verified byte by byte at the end,
    where neighbours that share a prefix stand together; a collision is mended by a plain sort.
    """
    n, m = rows.shape
    group = np.zeros(n, np.int64) if group is None else np.asarray(group, np.int64)
    h, order, run = prefix_hashes(rows), np.argsort(group, kind="stable"), 1
    opens = np.flatnonzero(np.diff(group[order], prepend=-1)) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(opens, n))
    base, end = np.repeat(opens, sizes), np.repeat(opens + sizes, sizes)
    while n and run < sizes.max():
        at = np.arange(n)
        block = base + (at - base) // (2 * run) * (2 * run)
        at = at[block + run < end]
        block, stop = block[at], end[at]
        left = at - block < run
        first = np.where(left, block + run, block)
        last = np.where(left, np.minimum(block + 2 * run, stop), block + run)
        low, high = first.copy(), last.copy()
        for _ in range(int(run).bit_length()):
            todo = np.nonzero(low < high)[0]
            mid = (low[todo] + high[todo]) >> 1
            before = sorts_before(rows, h, order[mid], order[at[todo]], left[todo])
            low[todo] = np.where(before, mid + 1, low[todo])
            high[todo] = np.where(before, high[todo], mid)
        own = at - np.where(left, block, block + run)
        merged = order.copy()
        merged[block + own + low - first] = order[at]
        order, run = merged, 2 * run
    common = np.zeros(n, np.int64)
    if n > 1:
        same = group[order][1:] == group[order][:-1]
        common[1:], ok = shared(rows[order])
        if not ok[same].all():
            order = np.lexsort((*rows.T[::-1], group))
            common[1:], _ = shared(rows[order])
        common[1:][~same] = 0
    return order, common


def shared(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that neighbours share, compared one by one, and whether each pair is in order."""
    n, m = ordered.shape
    out, ok = np.empty(n - 1, np.int64), np.empty(n - 1, bool)
    for s in range(0, n - 1, 1 << 15):
        x, y = ordered[s:s + (1 << 15)][:n - 1 - s], ordered[s + 1:s + 1 + (1 << 15)]
        out[s:s + len(x)] = np.argmin(np.concatenate([x == y, np.zeros((len(x), 1), bool)], axis=1), axis=1)
        at = np.minimum(out[s:s + len(x)], m - 1)[:, None]
        ok[s:s + len(x)] = (np.take_along_axis(x, at, 1) <= np.take_along_axis(y, at, 1))[:, 0]
    return out, ok
