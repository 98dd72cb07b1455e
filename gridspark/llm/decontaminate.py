"""Benchmark decontamination by pigeonhole edit matching.

A test item with an error budget of k edits is cut into k + 1 pieces: any place within the budget holds one piece
unchanged.  One automaton finds all exact piece hits in a text; Myers' bit-parallel distance verifies around each.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import map_texts

LEAKS = "array<struct<item_id:bigint,distance:bigint,start:bigint,end:bigint>>"


def normalise(text: str | None) -> str:
    """Lower case, white space as one space: the form in which texts and items are compared."""
    return " ".join((text or "").lower().split())


def pieces_of(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget`` + 1 consecutive pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Smallest edit distance of ``pattern`` to any substring of ``text``, and the end of the first such substring."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | (full & ~(across | plus)), plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
        if score < best:
            best, end = score, j + 1
    return best, end


def finder(items: list[tuple[int, str]], rate: float):
    """Function from texts to one list of leaks per text."""
    import ahocorasick

    automaton, wanted = ahocorasick.Automaton(), []
    owners: dict[str, list[tuple[int, int]]] = {}
    for item_id, text in items:
        if not text:
            continue
        budget = int(len(text) * rate)
        wanted.append((item_id, text, budget))
        for offset, piece in pieces_of(text, budget):
            owners.setdefault(piece, []).append((len(wanted) - 1, offset))
    for piece, where in owners.items():
        automaton.add_word(piece, (len(piece), where))
    if owners:
        automaton.make_automaton()

    def leaks(text: str | None) -> list[dict]:
        body, best, tried = normalise(text), {}, set()
        for last, (n, where) in automaton.iter(body) if owners and body else ():
            for k, offset in where:
                item_id, item, budget = wanted[k]
                start = last + 1 - n - offset
                if (k, start) in tried or best.get(k, (9, 0))[0] == 0:
                    continue
                tried.add((k, start))
                if start >= 0 and body.startswith(item, start):
                    distance, end = 0, start + len(item)
                elif budget:
                    low = max(0, start - budget)
                    distance, end = myers(item, body[low:start + len(item) + budget])
                    end += low
                else:
                    continue
                if not budget and len(item) < 1 / max(rate, 1e-9) and not whole_words(body, end - len(item), end):
                    continue
                if distance <= budget and (distance, end) < best.get(k, (budget + 1, 0)):
                    best[k] = (distance, end)
        return sorted(({"item_id": wanted[k][0], "distance": d, "start": max(0, end - len(wanted[k][1])), "end": end}
                       for k, (d, end) in best.items()), key=lambda x: (x["item_id"], x["end"]))

    return lambda texts: ([leaks(t) for t in texts],)


def whole_words(text: str, start: int, end: int) -> bool:
    return not (text[start - 1:start].isalnum() and text[start].isalnum()) and not (text[end:end + 1].isalnum() and text[end - 1].isalnum())


def blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[list[tuple[int, str]]]:
    """Normalised items in blocks of about ``limit`` characters, fetched one partition at a time."""
    block, size = [], 0
    for row in items.select(key, text).where(F.col(key).isNotNull()).toLocalIterator():
        item = normalise(row[1])
        if block and size + len(item) > limit:
            yield block
            block, size = [], 0
        block.append((row[0], item))
        size += len(item)
    if block:
        yield block


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", item_text: str = "text",
               rate: float = 0.05, block_chars: int = 4_000_000) -> DataFrame:
    """``docs`` with ``leaks``: for each test item found in the whole text its best place and edit distance.

    An item of n characters may differ by ``rate`` * n edits, rounded down; one that is too short for any edit must
    stand there exactly, as whole words.  Places are characters of the normalised text; the start is the end less
    the item's length.  Equal places go to the earlier end.  Null and empty texts and items match nothing; items
    without an id take no part; repeated items are reported once per row.  All rows and other columns are kept; a
    column named ``leaks`` is replaced.  Items travel in blocks of ``block_chars`` characters, one pass over the
    texts for all of them, however large the benchmark is; nothing is shuffled.
    """
    out, found = docs.drop("leaks"), []
    for i, block in enumerate(blocks(items, item_key, item_text, block_chars)):
        name = f"__leaks_{i}"
        out = map_texts(out, text, [(name, LEAKS)], lambda block=block: finder(block, rate))
        found.append(name)
    merged = F.concat(*found) if found else F.array().cast(LEAKS)
    return out.withColumn("leaks", merged).drop(*found)
