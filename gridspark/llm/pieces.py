"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the model holds the white-space marker after another character, so merges never
cross from one marked word (a run of markers and what follows it) to the next.  Each distinct
marked word is therefore segmented once, and the ids of a text are the ids of its words joined
in order of position.  The table lives in the task (a shuffle of all words would move several
times the input) in two generations of half of ``table_size`` entries each: when the newer one is
full it becomes the older one, and words met again move back, so frequent words stay.
"""

from __future__ import annotations

import re
from itertools import accumulate, chain, islice, pairwise

from pyspark.sql import DataFrame

from gridspark.llm.common import map_texts

MARK = "▁"
# Entries of both generations of a task's table, of about 200 bytes each.
TABLE_SIZE = 150_000
# Text bytes encoded at once; their words take up to 20 times as much memory.
SLICE_BYTES = 1 << 20


def words_are_independent(processor) -> bool:
    """Whether every piece has its markers in front only and texts pass unchanged but for the marker."""
    shape = re.compile(f"{MARK}*[^{MARK}]*")
    probe = "a  b\t\nﬁ É é Ａ "
    return (all(shape.fullmatch(processor.id_to_piece(i)) for i in range(processor.vocab_size()))
            and processor.decode(processor.encode(probe)) == probe
            and processor.encode_as_pieces("ab")[0].startswith(MARK))


def encoder(model: str, table_size: int = TABLE_SIZE):
    """Function from texts to (ids as little-endian uint32 bytes, decoded texts), begin and end ids included."""
    import numpy as np
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    begin, end = (np.array([x], "<u4").tobytes() for x in (processor.bos_id(), processor.eos_id()))
    if not words_are_independent(processor):
        def whole(texts):
            ids = processor.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1)
            return [np.array(i, "<u4").tobytes() for i in ids], [processor.decode(i) for i in ids]

        return whole
    chunk = re.compile(f"{MARK}+[^{MARK}]*")
    anchor = processor.encode("a")
    lone = [processor.piece_to_id(MARK)]
    # Ids of each chunk, newer and older ones, and its decoded forms inside and at the front of a text where they are
    # not the chunk itself.
    table: dict[str, bytes] = {}
    older: dict[str, bytes] = {}
    unlike: dict[str, tuple[str, str]] = {}

    def learn(new: list[str]) -> None:
        # The library puts one marker in front of what it encodes: that is the first marker of the chunk.
        ids = processor.encode([c[1:] for c in new], num_threads=1)
        ids = [i if c != MARK else lone for c, i in zip(new, ids, strict=True)]
        flat = np.fromiter(chain.from_iterable(ids), "<u4").tobytes()
        ends = pairwise(accumulate((4 * len(i) for i in ids), initial=0))
        for c, i, front, (start, end) in zip(new, ids, processor.decode(ids), ends, strict=True):
            table[c] = flat[start:end]
            if front != (plain := c.replace(MARK, " "))[1:] and (inner := processor.decode(anchor + i)[1:], front) != (plain, plain[1:]):
                unlike[c] = (inner, front)

    def prepare(words: set[str]) -> None:
        nonlocal table, older, unlike
        if len(table) + len(words) > table_size // 2:
            table, older = {}, table
            unlike = {c: forms for c, forms in unlike.items() if c in older}
        for c in words & older.keys():
            table[c] = older[c]
        new = iter([c for c in words if c not in table])
        while part := list(islice(new, 10_000)):
            learn(part)

    def encode(texts):
        packed, decoded = [], []
        split = [chunk.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        prepare({c for chunks in split for c in chunks})
        for chunks in split:
            packed.append(b"".join([begin, *[table[c] for c in chunks], end]))
            if chunks and not unlike.keys().isdisjoint(chunks):
                inner = [unlike[c][0] if c in unlike else c.replace(MARK, " ") for c in chunks]
                inner[0] = unlike[chunks[0]][1] if chunks[0] in unlike else inner[0][1:]
                decoded.append("".join(inner))
            else:
                decoded.append("".join(chunks).replace(MARK, " ")[1:])
        return packed, decoded

    return encode


def encode_decode(docs: DataFrame, model: str, text: str = "text", table_size: int = TABLE_SIZE) -> DataFrame:
    """``docs`` with ``ids`` (binary: little-endian unsigned 32-bit ids, with begin and end) and ``decoded``.

    Null and empty texts give the begin and end ids and an empty ``decoded``.  Rows, their order of
    columns and repeated rows are kept; columns named ``ids`` or ``decoded`` are replaced.  One pass, no
    shuffle; memory is bounded by ``table_size`` entries and the words of the longest text.
    """
    return map_texts(docs, text, [("ids", "binary"), ("decoded", "string")], lambda: encoder(model, table_size),
                     SLICE_BYTES)
