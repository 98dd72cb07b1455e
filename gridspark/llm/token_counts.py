"""Token counts: batch encoding inside Arrow functions that return lengths only."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame

from gridspark.llm.common import map_texts

# Before a single space between two characters that are not white space.  A pre-token of these
# vocabularies holds a space at its front only, so no token crosses this place; Python's \s covers
# every character that the tokenizers treat as white space.
SAFE = re.compile(r"(?<=\S)(?= \S)")


def counter(path: str, table_size: int = 500_000, batch_bytes: int = 1 << 20):
    """Function from texts to token counts.

    ``.model`` files count whole texts with sentencepiece.  ``.json`` files: each text is split at safe
    boundaries, the distinct pieces are put in batches of about ``batch_bytes``, and only lengths return.
    Byte-level vocabularies without a normalizer or prefix space allow the splits; others count whole texts.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path.endswith(".model"):
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: ([len(i) for i in processor.encode([t or "" for t in texts], num_threads=1)],)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()

    def lengths(texts: list[str]) -> list[int]:
        out: list[int] = []
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + 4 * len(t) > batch_bytes:
                out += map(len, tokenizer.encode_batch_fast(texts[start:i], add_special_tokens=False))
                start, size = i, 0
            size += 4 * len(t)
        return out + [len(e) for e in tokenizer.encode_batch_fast(texts[start:], add_special_tokens=False)]

    if not splits_safely(path):
        return lambda texts: (lengths([t or "" for t in texts]),)
    table: dict[str, int] = {}

    def count(texts):
        split = [SAFE.split(t) if t else [] for t in texts]
        new = {p for pieces in split for p in pieces}
        if len(table) + len(new) > table_size:
            table.clear()
        fresh = [p for p in new if p not in table]
        if fresh:
            table.update(zip(fresh, lengths(fresh), strict=True))
        return ([sum(map(table.__getitem__, pieces)) for pieces in split],)

    return count


def splits_safely(path: str) -> bool:
    """Whether ``path`` holds a byte-level vocabulary whose pre-tokens hold a space at the front only."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    plain = [a for a in spec.get("added_tokens", []) if not (a["lstrip"] or a["rstrip"] or a["normalized"] or " " in a["content"])]
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
            and not pre.get("add_prefix_space") and len(plain) == len(spec.get("added_tokens", [])))


def count_tokens(docs: DataFrame, path: str, text: str = "text", table_size: int = 500_000) -> DataFrame:
    """``docs`` with ``n_tokens`` (long): the library's count without begin, end or added special tokens.

    Null and empty texts count 0.  Special strings inside texts are handled as the library does by default.
    All rows and other columns are kept; a column named ``n_tokens`` is replaced.  One pass, no shuffle.
    """
    return map_texts(docs, text, [("n_tokens", "long")], lambda: counter(path, table_size))
