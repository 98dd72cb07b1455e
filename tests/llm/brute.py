"""Plain versions of the contracts, for small tables."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from xxhash import xxh64_intdigest


def topk(rows, k=5):
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ints = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows]
    out = set()
    for q, x in ints:
        if q % 50 == 0:
            scored = sorted((-int(np.dot(x, y)), i) for i, y in ints if i != q)[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not words:
        return 0
    grams = [words[i:i + 3] for i in range(len(words) - 2)] if len(words) >= 3 else [words]
    h = [xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash(docs):
    fps = [(i, fingerprint(t)) for i, t in docs]
    root = {f: f for _, f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    values = list(root)
    for n, a in enumerate(values):
        for b in values[n + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        r = find(f)
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in fps), key=str)


def suffix(docs, w=50):
    first = {}
    for i, t in docs:
        if i is not None:
            b = (t or "").encode()
            for s in range(len(b) - w + 1):
                g = b[s:s + w]
                first[g] = min(first.get(g, i), i)
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for s in range(len(b) - w + 1):
                if first[b[s:s + w]] < i:
                    gone[s:s + w] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def edit_distance_within(pattern, text):
    """Smallest distance of the pattern to a substring of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def licenses(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places = defaultdict(list)
    for p, label in phrases.items():
        p = p.split()
        for i in range(len(words)):
            if words[i:i + len(p)] == p:
                places[label].append(i)
    starts = [i for v in places.values() for i in v]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(places))
