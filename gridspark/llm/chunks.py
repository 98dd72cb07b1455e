"""Texts cut at places that no token crosses, and a task's memory of what each distinct chunk gives."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from gridspark.llm.token_counts import SAFE

# Distinct chunks remembered in a task, and new chunks worked out at once.
MEMORY, AT_ONCE = 400_000, 20_000
# Characters of text whose chunks are held as strings at once.
SEGMENT = 1 << 20


def segments(text: str, limit: int = SEGMENT) -> Iterator[str]:
    """Consecutive parts of ``text`` of about ``limit`` characters that end at safe places; all of it, none empty."""
    start = 0
    while len(text) - start > limit and (cut := SAFE.search(text, start + limit)):
        yield text[start:cut.start()]
        start = cut.start()
    if start < len(text):
        yield text[start:]


# White space other than the space, as Python sees it: in ASCII, each beside a space; and beyond.
_BESIDE = [pair for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f" for pair in (c + " ", " " + c)] + ["  "]
_WIDE_SPACE = re.compile(r"[^\S\x00-\x7f]")


def chunks(text: str) -> list[str]:
    """``text``, which begins with a space, split at its safe places."""
    if any(pair in text for pair in _BESIDE) or text[-1] == " " or not (text.isascii() or _WIDE_SPACE.search(text) is None):
        return SAFE.split(text)
    # Every space but the first stands between two other characters.
    return [" " + c for c in text[1:].split(" ")]


class Growing:
    """Rows appended to one array whose room doubles."""

    def __init__(self, shape: tuple[int, ...], kind):
        import numpy as np

        self.rows, self.held = 0, np.zeros((1024, *shape), kind)

    def append(self, more) -> None:
        import numpy as np

        end = self.rows + len(more)
        if end > len(self.held):
            room = np.empty((max(end, 2 * len(self.held)), *self.held.shape[1:]), self.held.dtype)
            room[:self.rows] = self.held[:self.rows]
            self.held = room
        self.held[self.rows:end] = more
        self.rows = end

    @property
    def all(self):
        return self.held[:self.rows]


class Remembered:
    """Numbers of chunks, and per number what ``compute`` gave for it.

    ``compute`` takes distinct chunks and returns (values: one row of integers a chunk, sizes, members, names): the
    members of all chunks one after another, so many for each.  All is forgotten when ``limit`` chunks are known.
    """

    def __init__(self, compute: Callable, values: int, limit: int = MEMORY):
        self.compute, self.width, self.limit = compute, values, limit
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.place: dict[str, int] = {}
        self.values, self.begin, self.size, self.members = (Growing((self.width,), np.int64), Growing((), np.int64),
                                                            Growing((), np.int64), Growing((), np.uint32))
        self.names: list[str] = []

    def numbers(self, chunks: list[str]):
        import numpy as np
        import pandas as pd

        codes, distinct = pd.factorize(np.array(chunks, dtype=object))
        found = list(map(self.place.get, distinct))
        new = [c for c, k in zip(distinct, found, strict=True) if k is None]
        if new:
            if len(self.place) + len(new) > self.limit and self.place:
                self.forget()
                new = list(distinct)
            for start in range(0, len(new), AT_ONCE):
                self.learn(new[start:start + AT_ONCE])
            found = list(map(self.place.__getitem__, distinct))
        return np.array(found, np.int64)[codes]

    def learn(self, new: list[str]) -> None:
        import numpy as np

        values, sizes, members, names = self.compute(new)
        self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
        self.begin.append(self.members.rows + np.cumsum(sizes) - sizes)
        self.size.append(sizes)
        self.values.append(values)
        self.members.append(members)
        self.names += names

    def spread(self, numbers, *along):
        """Members of the numbered chunks, one after another, and each array of ``along`` repeated beside them."""
        import numpy as np

        size = self.size.all[numbers]
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - self.begin.all[numbers], size)
        return (self.members.all[at].astype(np.int64), *(np.repeat(x, size) for x in along))


class Vocabularies:
    """A byte-level vocabulary (``.json``) and a piece vocabulary (``.model``), with the bytes of every token.

    Both must let a text be cut at safe places: the classes that check this are those of the token operators.
    """

    def __init__(self, byte_path: str, piece_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        from gridspark.llm.pieces import MARK, words_are_independent
        from gridspark.llm.token_counts import splits_safely

        byte = Tokenizer.from_file(byte_path)
        self.piece = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        if not (splits_safely(byte_path) and words_are_independent(self.piece)):
            raise ValueError("these vocabularies have tokens that cross the places where texts are cut")
        back = {c: b for b, c in byte_alphabet().items()}
        size = byte.get_vocab_size(with_added_tokens=True)
        self.byte_bytes = [bytes(back[c] for c in t) if (t := byte.id_to_token(i) or "") and all(c in back for c in t)
                           else t.encode() for i in range(size)]
        self.byte_ids = byte_encoder(byte, byte_path, back)
        n = self.piece.vocab_size()
        self.fallback = np.array([self.piece.is_byte(i) for i in range(n)])
        self.piece_bytes = [bytes([int(self.piece.id_to_piece(i)[3:-1], 16)]) if self.fallback[i]
                            else self.piece.id_to_piece(i).replace(MARK, " ").encode() for i in range(n)]

    def piece_ids(self, texts: list[str]):
        """Ids of texts that begin with a space, which stands for the one that the library puts in front, and numbers."""
        return flattened(self.piece.encode([t[1:] for t in texts], num_threads=1))


def byte_encoder(tokenizer, path: str, back: dict[str, int]) -> Callable:
    """Function from texts to the ids of all, one after another, and their numbers; special tokens' strings are plain text.

    Where ids are in order of merging, ranks say the same as merges and a rank encoder is several times as fast.
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ordered = sorted(model["vocab"], key=model["vocab"].get)
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    plain = [t for t in ordered if t not in special]
    if [model["vocab"][t] for t in plain] == list(range(len(plain))) and plain[256:] == merged and sorted(plain[:256]) == sorted(back):
        ranks = {bytes(back[c] for c in t): i for i, t in enumerate(plain)}
        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return joined_encoder(encoding, [len(t) for t in plain])
    tokenizer.no_truncation()
    tokenizer.no_padding()
    tokenizer.encode_special_tokens = True
    return lambda texts: flattened([e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)])


def flattened(ids: list[list[int]]):
    from itertools import chain

    import numpy as np

    return np.fromiter(chain.from_iterable(ids), np.int64), np.fromiter(map(len, ids), np.int64, len(ids))


def joined_encoder(encoding, lengths: list[int]):
    """Encoder of many texts at once: those whose ends are safe places are joined and their ids dealt out by bytes."""
    import numpy as np

    lengths = np.array(lengths)

    def encode(texts: list[str]):
        safe = [len(t) > 1 and t[0] == " " and not (t[1].isspace() or t[-1].isspace()) for t in texts]
        joined = [t for t, ok in zip(texts, safe, strict=True) if ok]
        ids = encoding.encode_to_numpy("".join(joined)).astype(np.int64) if joined else np.zeros(0, np.int64)
        ends = np.cumsum(np.fromiter((len(t.encode()) for t in joined), np.int64, len(joined)))
        sizes = np.diff(np.searchsorted(np.cumsum(lengths[ids]), ends, "right"), prepend=0)
        if len(joined) == len(texts):
            return ids, sizes
        split = iter(np.split(ids, np.cumsum(sizes)[:-1]) if joined else ())
        parts = [next(split) if ok else np.array(encoding.encode_ordinary(t), np.int64) for t, ok in zip(texts, safe, strict=True)]
        return np.concatenate(parts), np.array([len(x) for x in parts])

    return encode


def byte_alphabet() -> dict[int, str]:
    """Characters that stand for bytes in byte-level vocabularies: printable bytes stand for themselves, the others
    for the code points from 256 on, in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
