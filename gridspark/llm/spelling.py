"""Groups of spelling variants: words that differ by one code point, found with search schemes over word indexes."""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import slices
from gridspark.llm.fm_index import WordIndex
from gridspark.session import cut_lineage

# Least code points and occurrences of a word, and how many times as frequent a form must be.
LENGTH, LEAST, TIMES = 6, 5, 5
# One run in so many loses a code point.
EVERY = 199
# Code points of the words of one index, about; look-up halves that hold more are split into blocks of so many.
INDEXED = 400_000
# Distinct words counted in a task before they are passed on.
COUNTED = 400_000
# Latin letters stand for themselves in one byte each, and A-Z for a-z; what has no such byte turns into a question mark.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def counter(length: int, every: int):
    """Function from (key as text, text) pairs to a count of words of at least ``length`` code points, as Latin-1 bytes."""
    # A run that loses a code point must have had one more.
    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % length)

    def count(rows) -> Counter:
        words, lost = [], Counter()
        for key, text in rows:
            if not text:
                continue
            found = run.findall(text.encode("latin-1", "replace").translate(_LOWER))
            words += found
            base = crc32(b"%s:" % (key or "").encode())
            for w in set(found):
                h = crc32(w if w.isascii() else w.decode("latin-1").encode(), base)
                if h % every == 0:
                    n, at = found.count(w), h % len(w)
                    lost[w] -= n
                    lost[w[:at] + w[at + 1:]] += n
        total = Counter(words)
        for w, n in lost.items():
            total[w] += n
        return total

    return count


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST,
               every: int = EVERY) -> DataFrame:
    """(word, n) of the words with at least ``length`` code points and ``least`` occurrences in all texts.

    A word is a maximal run of Latin letters, A-Z lower-cased.  Where ``every`` divides the CRC-32 of ``<key>:<run>`` the
    run's code point at that value modulo its length is left out.  Null texts have no words and a null key reads as empty.
    Counts are merged in each task before they travel.
    """
    import pyarrow as pa

    def run(batches):
        count, total = counter(length, every), Counter()

        def rows():
            mine = {w.decode("latin-1"): n for w, n in total.items() if n > 0 and len(w) >= length}
            total.clear()
            return pa.RecordBatch.from_pydict({"word": list(mine), "n": list(mine.values())}, schema=pa.schema([("word", pa.string()), ("n", pa.int64())]))

        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                total.update(count(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)))
                if len(total) > COUNTED:
                    yield rows()
        yield rows()

    named = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{text}`").alias("text"))
    return named.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def dealt(words: DataFrame, indexed: int = INDEXED) -> DataFrame:
    """(rightward, split, bucket, word, n, asks, holds): where each word is searched (``asks``) and indexed (``holds``).

    Two words that differ by one code point agree in the first half of either, or in its second half.  So a word asks
    under its own halves and is held under the halves of words as long, one shorter or one longer.  Halves that one
    word has alone are left out; halves with many words are dealt to several buckets, each of which all of them ask.
    """
    size = F.length("word")

    def halves(rightward: bool):
        def entry(other: int):
            cut = F.floor((size + other) / 2) if rightward else F.ceil((size + other) / 2)
            half = F.left("word", cut) if rightward else F.right("word", cut)
            return F.struct(F.lit(rightward).alias("rightward"), half.alias("half"), F.lit(other == 0).alias("own"))

        # Of the neighbouring lengths one gives the word's own half again.
        ahead = F.when((size % 2 == 0) == F.lit(rightward), -1).otherwise(1)
        return [entry(0), F.when(ahead == -1, entry(-1)).otherwise(entry(1))]

    keyed = words.select("word", "n", F.explode(F.array(*halves(True), *halves(False))).alias("e")).select("word", "n", "e.*")
    groups = (keyed.groupBy("rightward", "half").agg(F.count("*").alias("members"), F.sum(F.length("word") + 1).alias("points"), F.max("own").alias("asked"))
              .where("members > 1 AND asked"))
    total = groups.agg(F.sum("points")).first()[0] or 0
    blocks = F.ceil(F.col("points") / indexed)
    # A split half has its blocks to itself; all others share buckets.
    rows = (keyed.join(groups.drop("asked"), ["rightward", "half"]).withColumn("split", F.when(blocks > 1, F.col("half")))
            .withColumn("home", F.when(blocks > 1, F.pmod(F.xxhash64("word"), blocks)).otherwise(
                F.pmod(F.xxhash64("rightward", "half"), F.lit(max(1, -(-total // indexed)))))))
    asked = F.when(F.col("own") & (blocks > 1), F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array("home"))
    return (rows.select("rightward", "split", F.explode(asked).alias("bucket"), "home", "word", "n", F.col("own").alias("asks"))
            .withColumn("holds", F.col("bucket") == F.col("home")).drop("home"))


def search_bucket(table):
    """Near words of those that ask in one bucket: (word, n_near, form_n, form), the form being the most frequent one."""
    import numpy as np
    import pyarrow as pa

    rightward = table.column("rightward")[0].as_py()
    rows = list(zip(*(table.column(c).to_pylist() for c in ("word", "n", "asks", "holds")), strict=True))
    held = {w: n for w, n, _, holds in rows if holds}
    words = sorted(held)
    asking = sorted({w for w, _, asks, _ in rows if asks})
    out = {"word": [], "n_near": [], "form_n": [], "form": []}
    if words and asking:
        number = np.array([held[w] for w in words])
        q, found = WordIndex(words).near(asking, rightward)
        if not rightward:
            # Words that also agree in the first half are found there.
            q, found = zip(*p, strict=True) if (p := [(a, b) for a, b in zip(q.tolist(), found.tolist(), strict=True)
                                                     if not words[b].startswith(asking[a][:len(asking[a]) // 2])]) else ((), ())
            q, found = np.array(q, np.int64), np.array(found, np.int64)
        # By asking word, then most frequent first, then code-point order.
        order = np.lexsort((found, -number[found], q))
        q, found = q[order], found[order]
        first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else q
        out = {"word": [asking[i] for i in q[first]], "n_near": np.diff(np.append(first, len(q))),
               "form_n": number[found[first]], "form": [words[i] for i in found[first]]}
    return pa.table(out, schema=pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())]))


def near_words(words: DataFrame, indexed: int = INDEXED) -> DataFrame:
    """(word, n_near, form, form_n) of the words that have a near word: their number and the most frequent of them."""
    found = dealt(words, indexed).groupBy("rightward", "split", "bucket").applyInArrow(search_bucket, "word string, n_near long, form_n long, form string")
    best = F.min_by(F.struct("form", "form_n"), F.struct(-F.col("form_n"), F.col("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", "b.form", "b.form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST,
             times: int = TIMES, every: int = EVERY, indexed: int = INDEXED) -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word of :func:`vocabulary`.

    Near words differ by exactly one inserted, deleted or replaced code point.  A word's form is its most frequent near
    word (the smallest in code-point order of several) if that is at least ``times`` as frequent, else null; its root is
    what following the forms ends in, or the word itself.  Other columns of ``docs`` play no part; without words the
    result is empty.  Repeated rows count as often as they stand there.
    """
    words = cut_lineage(vocabulary(docs, key, text, length, least, every))
    near = words.join(near_words(words, indexed), "word", "left")
    strong = F.col("form_n") >= times * F.col("n")
    table = cut_lineage(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                    F.when(strong, F.col("form")).alias("form"), F.when(strong, F.col("form_n")).alias("form_n")))
    # Each form is several times as frequent as its word, so chains are short; every round doubles the way covered.
    links = table.where("form is not null").select("word", F.col("form").alias("root"))
    longer = links
    while True:
        ahead = longer.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = cut_lineage(longer.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if longer.where("moved").isEmpty():
            break
        longer = longer.drop("moved")
    return (table.join(longer.select("word", "root"), "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
