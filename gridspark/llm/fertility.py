"""Quality rules from words, lines, repeated phrases, and from how well public vocabularies cover a text.

A vocabulary learned on natural text needs few tokens for natural words, rarely falls back to bytes, and spreads its
tokens; junk does not.  What is usual is read off all texts of the same language, or of the same script where the
language is not given, and a text far outside those bands is rejected.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.chunks import Remembered, Vocabularies, chunks, segments
from gridspark.llm.common import map_texts
from gridspark.session import cut_lineage

WINDOW = 5
# A text fails the base rules with fewer words, or more repeated words in a hundred.
LEAST_WORDS, REPEATED = 10, 20
# Band: from the lower to the upper quantile, each moved outward by so many times the distance of the two.
LOWER, UPPER, WIDER = 0.05, 0.95, 1.5
# Texts of a group, and letters or digits of a text, from which measures are compared with bands.
GROUP_TEXTS, COMPARED_WORDS = 50, 50
# Measures are compared in steps, so that bands come from counts of steps; bands held at once in every task.
STEP, BROADCAST = 256, 10_000
MEASURES = {"byte_chars": "characters per byte-level token", "piece_chars": "characters per piece",
            "fallback": "share of pieces that are single bytes", "entropy": "entropy of the pieces over that of as many different ones"}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script")
_SYMBOLS = [c.encode() for c in "#*$%&|<>"]
_WIDE = re.compile(r"[^\x00-\x7F]+")
_NOT_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
# Scripts by ranges of code points.
SCRIPTS = {"latin": "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ", "greek": "Ͱ-Ͽἀ-῿",
           "cyrillic": "Ѐ-ԯ", "armenian": "Ա-֏", "hebrew": "֐-׿", "arabic": "؀-ۿݐ-ݿ",
           "devanagari": "ऀ-ॿ", "bengali": "ঀ-৿", "tamil": "஀-௿", "thai": "฀-๿",
           "georgian": "Ⴀ-ჿ", "hangul": "ᄀ-ᇿ가-힯", "kana": "぀-ヿ", "han": "㐀-䶿一-鿿"}


def repeated_words(codes, texts, window: int = WINDOW):
    """Words of each text that stand in a window of ``window`` words found twice or more in it.

    ``codes`` numbers the words, equal words alike, and ``texts`` their texts, in order; windows are compared exactly.
    """
    import numpy as np
    import pandas as pd

    n = len(codes) - window + 1
    owners = int(texts[-1]) + 1 if len(texts) else 0
    if n < 1:
        return np.zeros(owners, np.int64)
    same = np.zeros(len(codes), np.int64)
    # Numbers of windows of one word more, window by window, with the text in the first.
    words = int(codes.max()) + 1
    grams = pd.factorize(texts * words + codes)[0]
    for k in range(1, window):
        grams = pd.factorize(grams[:len(codes) - k] * words + codes[k:])[0]
    inside = texts[:n] == texts[window - 1:]
    often = inside & (np.bincount(grams[inside], minlength=int(grams.max()) + 1)[grams] > 1)
    starts = np.flatnonzero(often)
    np.add.at(same, starts, 1)
    if len(starts):
        ends = starts + window
        np.add.at(same, ends[ends < len(same)], -1)
    return np.bincount(texts[np.cumsum(same) > 0], minlength=owners)


def script(text: str, patterns) -> str:
    """Script of most letters of ``text``, or ``none``; of several with as many, the first."""
    counts = {"latin": len(text.encode("ascii", "ignore").translate(None, _NOT_LETTERS))}
    if not text.isascii():
        wide = "".join(_WIDE.findall(text))
        for name, p in patterns.items():
            counts[name] = counts.get(name, 0) + sum(map(len, p.findall(wide)))
    best = max(counts, key=counts.get)
    return best if counts[best] else "none"


def measurer(byte_path: str, piece_path: str):
    """Function from texts to the columns of :func:`measures`."""
    import numpy as np
    import pandas as pd

    v = Vocabularies(byte_path, piece_path)
    patterns = {name: re.compile(f"[{r}]+") for name, r in SCRIPTS.items()}

    def weigh(texts):
        ids, sizes = v.piece_ids(texts)
        return v.byte_ids(texts)[1][:, None], sizes, ids, []

    known = Remembered(weigh, values=1)

    def tokens(texts):
        """Byte-level tokens, pieces, fallback pieces and entropy of every text."""
        out = np.zeros((4, len(texts)))
        histogram: dict[int, list] = {}

        def take(part):
            split = [chunks(s) for _, s in part]
            codes = known.numbers([c for s in split for c in s])
            owner = np.repeat(np.array([i for i, _ in part]), [len(c) for c in split])
            out[0] += np.bincount(owner, known.values.all[codes, 0], len(texts))
            ids, owner = known.spread(codes, owner)
            out[1] += np.bincount(owner, minlength=len(texts))
            out[2] += np.bincount(owner, v.fallback[ids], len(texts))
            pairs, n = np.unique(owner * len(v.piece_bytes) + ids, return_counts=True)
            first = np.flatnonzero(np.diff(pairs // len(v.piece_bytes), prepend=-1))
            for i, p, c in zip((pairs // len(v.piece_bytes))[first], np.split(pairs, first[1:]), np.split(n, first[1:]), strict=True):
                histogram.setdefault(int(i), []).append((p, c))

        part, held = [], 0
        for i, text in enumerate(texts):
            for s in segments(" " + text) if text else ():
                part.append((i, s))
                held += len(s)
                if held > 1 << 19:
                    take(part)
                    part, held = [], 0
        if part:
            take(part)
        for i, parts in histogram.items():
            pairs, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            if len(parts) > 1:
                n = np.bincount(np.unique(pairs, return_inverse=True)[1], n)
            share = n / n.sum()
            out[3, i] = -float((share * np.log2(share)).sum())
        return out

    def measure(texts):
        texts = [t or "" for t in texts]
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        # Bytes split at the same six characters of white space, each of one byte.
        words = [r.split() for r in raw]
        n_words = np.array([len(w) for w in words])
        chars = [len(t) - len(r) + sum(map(len, w)) for t, r, w in zip(texts, raw, words, strict=True)]
        symbols = [sum(map(r.count, _SYMBOLS)) for r in raw]
        dup = []
        for t in texts:
            lines = t.split("\n")
            told = pd.Series(lines, dtype=object).duplicated() if len(lines) != len(set(lines)) else ()
            dup.append(sum(bool(x.encode("utf-8", "surrogatepass").split()) for x, again in zip(lines, told, strict=True) if again) if len(told) else 0)
        flat = [w for ws in words for w in ws]
        codes = pd.factorize(np.array(flat, dtype=object))[0].astype(np.int64) if flat else np.zeros(0, np.int64)
        repeats = np.zeros(len(texts), np.int64)
        found = repeated_words(codes, np.repeat(np.arange(len(texts)), n_words))
        repeats[:len(found)] = found
        byte_tokens, pieces, fallback, entropy = tokens(texts)
        sizes = np.array([len(t) + 1 for t in texts])
        with np.errstate(divide="ignore", invalid="ignore"):
            values = np.nan_to_num(np.stack([sizes / byte_tokens, sizes / pieces, fallback / pieces, entropy / np.log2(np.minimum(pieces, len(v.piece_bytes)))]),
                                   nan=0.0, posinf=0.0, neginf=0.0)
        compared = n_words >= COMPARED_WORDS
        values = [[float(x) if ok else None for x, ok in zip(row, compared, strict=True)] for row in values]
        return [n_words.tolist(), chars, symbols, dup, repeats.tolist(), [script(t, patterns) for t in texts], *values]

    return measure


def measures(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text") -> DataFrame:
    """``docs`` with base counts, ``script`` and the four measures, which are null for texts under COMPARED_WORDS words."""
    added = [(c, "long") for c in COUNTS[:-1]] + [("script", "string")]
    return map_texts(docs, text, added + [(m, "double") for m in MEASURES], lambda: measurer(byte_path, piece_path), 1 << 20)


def bands(measured: DataFrame, group: str) -> DataFrame:
    """(group, n, and per measure its least and greatest usual value) from all measured texts.

    Texts are counted by group and step first, so a group with most of all texts is spread over all tasks; quantiles
    come from at most the number of steps of each group.
    """
    step = {m: F.round(F.col(m) * STEP) for m in MEASURES}
    long = measured.where(F.col(next(iter(MEASURES))).isNotNull()).select(
        F.col(group), F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), s.alias("step")) for m, s in step.items()))).alias("e"))
    counts = long.groupBy(group, "e.measure", "e.step").agg(F.count("*").alias("n"))
    limits = counts.groupBy(group, "measure").agg(F.percentile("step", F.array(F.lit(LOWER), F.lit(UPPER)), F.col("n")).alias("q"), F.sum("n").alias("n"))
    spread = F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(1.0)) * WIDER
    banded = limits.where(F.col("n") >= GROUP_TEXTS).select(group, "n", "measure", ((F.col("q")[0] - spread) / STEP).alias("low"), ((F.col("q")[1] + spread) / STEP).alias("high"))
    return banded.groupBy(group).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("measure") == m, F.col(c))).alias(f"{m}_{c}") for m in MEASURES for c in ("low", "high")))


def judge(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", lang: str | None = "lang",
          keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` with base counts, measures, ``base_failed``, ``outside`` and ``kept``; all rows stay.

    ``keep`` names the columns of ``docs`` that stay (all of them by default); what stays is stored once on the way.

    ``outside`` lists the measures beyond the bands of the text's language, or of its script where ``lang`` is null or not
    given: too few characters a token in either vocabulary, too many fallback bytes, too little entropy, or too much of
    any.  Texts that are null or empty have no words and fail the base rules; texts under COMPARED_WORDS words, and groups with
    under GROUP_TEXTS texts, are judged by the base rules alone.  Equal rows are judged alike; columns with added names
    are replaced.  Measures are stored once and read twice; one text at a time is held whole, its tokens a segment at a time.
    """
    measured = measures(docs, byte_path, piece_path, text)
    given = F.col(f"`{lang}`").cast("string") if lang and lang in docs.columns else F.lit(None).cast("string")
    stay = [c for c in docs.columns if keep is None or c in keep]
    narrow = [*stay, *(c for c in measured.columns if c not in docs.columns or c in MEASURES or c in COUNTS)]
    measured = measured.withColumn("__group", F.coalesce(given, F.concat(F.lit("script "), F.col("script"))))
    measured = cut_lineage(measured.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*narrow, "__group"]))))
    usual = bands(measured, "__group")
    usual = usual.select(*(F.col(c).alias(f"__band_{c}") for c in usual.columns))
    if usual.count() <= BROADCAST:
        usual = F.broadcast(usual)
    joined = measured.join(usual, F.col("__group") == F.col("__band___group"), "left")
    beyond = F.array_compact(F.array(*(F.when((F.col(m) < F.col(f"__band_{m}_low")) | (F.col(m) > F.col(f"__band_{m}_high")), F.lit(m)) for m in MEASURES)))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    out = joined.withColumn("base_failed", failed).withColumn("outside", beyond)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
    return out.drop("__group", *usual.columns)
