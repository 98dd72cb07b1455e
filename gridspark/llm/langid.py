"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies are counted over all training texts.  The weights are fitted on a bounded sample of labelled
rows, each by the counts of its whole text, with follow-the-regularised-leader and elastic-net penalties.  Rows held
back from the fit choose the l1 penalty and one temperature for the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm.common import map_texts, slices

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    bits: int = 14  # n-grams are hashed to 2 ** bits features
    orders: tuple[int, ...] = (1, 2, 3)
    rows_per_language: int = 1000  # bound of the fitting sample: distinct labelled texts per language, smallest hashes first
    rows: int = 20_000  # bound of the whole sample, shared equally by the languages where they are many
    held_back: int = 6  # one row in so many chooses l1 and the temperature
    epochs: int = 3
    alpha: float = 0.5
    beta: float = 1.0
    l1: tuple[float, ...] = (0.0, 0.03, 0.1, 0.3, 1.0)  # candidates
    l2: float = 1e-4


@dataclass(frozen=True)
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # features x languages, with a last row for the bias
    temperature: float
    l1: float
    settings: Settings

    def zero_share(self) -> float:
        """Share of zeros among the weights of features, the bias left out."""
        return float((self.weights[:-1] == 0).mean())


def features(text: str, settings: Settings) -> np.ndarray:
    """Hashed n-grams of a text (of code points of its lower case, digits as one), repeats included."""
    codes = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    codes[(codes >= 48) & (codes <= 57)] = 48
    codes[(codes == 10) | (codes == 13) | (codes == 9)] = 32
    out, h = [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(settings.orders) + 1):
        tail = codes[n - 1:]
        h = (h[:len(tail)] * np.uint64(0x9E3779B97F4A7C15) + tail + np.uint64(n)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        if n in settings.orders:
            out.append((h * np.uint64(0xC4CEB9FE1A85EC53)) >> np.uint64(64 - settings.bits))
    return np.concatenate(out).astype(np.int64)


def counts_of(text: str, settings: Settings) -> np.ndarray:
    """Dense counts of a whole text, in windows that overlap by n - 1 characters, so memory stays bounded."""
    size, total = 1 << settings.bits, np.zeros(1 << settings.bits)
    step, overlap = 1 << 20, max(settings.orders) - 1
    for start in range(0, max(1, len(text)), step):
        total += np.bincount(features(text[start:start + step + overlap], settings), minlength=size)
    return total


def document_frequencies(texts: DataFrame, text: str, settings: Settings) -> tuple[np.ndarray, int]:
    """Texts that hold each feature, and all texts: one row of sums per task, added up feature by feature."""
    def run(batches):
        import pyarrow as pa

        total, n = np.zeros(1 << settings.bits, np.int64), 0
        for batch in batches:
            for part in slices(batch, text):
                for t in part.column(0).to_pylist():
                    total += counts_of(t or "", settings) > 0
                    n += 1
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], ["feature", "n"])

    rows = texts.select(text).mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r["feature"]: r["n"] for r in rows}
    out = np.zeros(1 << settings.bits)
    for f, n in found.items():
        if f >= 0:
            out[f] = n
    return out, found.get(-1, 0)


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.nonzero(counts)[0]
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(np.sqrt((x * x).sum()), 1e-12)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple], labels: np.ndarray, n_languages: int, s: Settings, l1: float) -> np.ndarray:
    """Follow-the-regularised-leader with a learning rate per coordinate; ``l1`` leaves weights at zero, the bias aside."""
    z = np.zeros(((1 << s.bits) + 1, n_languages))
    n = np.zeros_like(z)
    bias = 1 << s.bits

    def weights(at):
        za, root = z[at], np.sqrt(n[at])
        free = np.where(at == bias, 0.0, l1)[:, None]
        return np.sign(za) * np.minimum(free - np.abs(za), 0.0) / ((s.beta + root) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for i in order.permutation(len(rows)):
            at, x = np.append(rows[i][0], bias), np.append(rows[i][1], 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[labels[i]] -= 1
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / s.alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(bias + 1))


def log_losses(logits: np.ndarray, labels: np.ndarray, temperature: float) -> np.ndarray:
    return -np.log(np.maximum(softmax(logits / temperature)[np.arange(len(labels)), labels], 1e-12))


def fit_penalty(rows: list[tuple], labels: np.ndarray, held: list[tuple], held_labels: np.ndarray, n_languages: int,
                s: Settings) -> tuple[float, np.ndarray, float]:
    """(l1, weights, temperature): the largest candidate whose calibrated log loss on the held-back rows lies within one
    standard error of the least."""
    found = []
    for l1 in sorted(s.l1):
        w = fit_ftrl(rows, labels, n_languages, s, l1).astype(np.float32)
        logits = np.array([x @ w[at] + w[-1] for at, x in held])
        t = fit_temperature(logits, held_labels)
        found.append((l1, w, t, log_losses(logits, held_labels, t)))
    least = min((f[3] for f in found), key=np.mean)
    limit = least.mean() + least.std() / np.sqrt(len(least))
    return next(f[:3] for f in reversed(found) if f[3].mean() <= limit)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """Temperature with the smallest log loss, by golden-section search on its logarithm."""
    def loss(t: float) -> float:
        return log_losses(logits, labels, np.exp(t)).mean()

    low, high, g = -4.0, 3.0, (5 ** 0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def sparse(counts: np.ndarray) -> bytes:
    """Positions and values of the counts above zero."""
    at = np.nonzero(counts)[0]
    return at.astype("<u4").tobytes() + counts[at].astype("<u4").tobytes()


def dense(packed: bytes, settings: Settings) -> np.ndarray:
    at, n = np.frombuffer(packed, "<u4").reshape(2, -1)
    out = np.zeros(1 << settings.bits)
    out[at] = n
    return out


def fitting_sample(rows: DataFrame, settings: Settings) -> list:
    """(lang, k, counts): per language the distinct texts with the smallest hashes, each as sparse counts of the whole text.

    A language's distinct texts are estimated first, so that only texts whose hash lies below the share wanted, and a
    quarter more, are counted, once a task: what is shuffled and fetched depends on the bounds (at most 2 ** bits numbers
    a row), not on the input or on the length of texts.
    """
    rows = rows.where(F.length(F.trim("text")) > 0).withColumn("h", F.xxhash64("text", "lang"))
    share = F.col("h").cast("double") / 2.0 ** 64 + 0.5
    estimates = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.01).alias("n")).collect()
    if not estimates:
        return []
    wanted = max(1, min(settings.rows_per_language, settings.rows // len(estimates)))
    shares = F.create_map(*[F.lit(x) for r in estimates for x in (r["lang"], 1.25 * wanted / r["n"])])

    def run(batches):
        import pyarrow as pa

        seen: set[tuple] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for lang, h, t in zip(*(part.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True):
                    if (lang, h) not in seen:
                        seen.add((lang, h))
                        out.append((lang, h, sparse(counts_of(t, settings))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], ["lang", "h", "counts"])

    counted = (rows.where(share <= shares[F.col("lang")]).select("lang", "h", "text")
               .mapInArrow(run, "lang string, h long, counts binary"))
    found = counted.groupBy("lang", "h").agg(F.min("counts").alias("counts")).collect()
    by_language: dict[str, list] = {}
    for r in sorted(found, key=lambda r: (r["lang"], r["h"])):
        by_language.setdefault(r["lang"], []).append(bytes(r["counts"]))
    return [(lang, k, c) for lang, packed in by_language.items() for k, c in enumerate(packed[:wanted], 1)]


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model | None:
    """Model from rows with a text and a language; None if there are none.

    Rows with a null text or language and blank texts teach nothing; equal texts of one language are fitted once but count
    as often as they stand in the document frequencies.  Texts are read whole, however long.
    """
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    sample = fitting_sample(rows, settings)
    if not sample:
        return None
    df, n = document_frequencies(rows, "text", settings)
    languages = sorted({lang for lang, _, _ in sample})
    idf = np.log((1 + n) / (1 + df)) + 1
    vectors = [vector(dense(c, settings), idf) for _, _, c in sample]
    labels = np.array([languages.index(lang) for lang, _, _ in sample])
    back = np.array([k % settings.held_back == 0 for _, k, _ in sample])
    # Too few rows to hold any back: the rows of the fit stand for them.
    held = back if back.any() else ~back
    l1, w, temperature = fit_penalty([vectors[i] for i in np.nonzero(~back)[0]], labels[~back],
                                     [vectors[i] for i in np.nonzero(held)[0]], labels[held], len(languages), settings)
    return Model(languages, idf, w, temperature, l1, settings)


def predictor(model: Model | None):
    def predict(texts):
        languages, scores = [], []
        for t in texts:
            if model is None or not t or not any(map(str.isalpha, t)):
                languages.append(UNKNOWN)
                scores.append(0.0)
                continue
            at, x = vector(counts_of(t, model.settings), model.idf)
            p = softmax((x @ model.weights[at] + model.weights[-1]) / model.temperature)
            k = int(p.argmax())
            languages.append(model.languages[k])
            scores.append(float(min(1.0, p[k])))
        return languages, scores

    return predict


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the calibrated probability.

    Null texts and texts without a letter get ``und`` and 0, as does every text if nothing was learned; equal
    probabilities go to the smaller language.  Only the text is used.  All rows and other columns are kept; columns
    with the added names are replaced.
    """
    return map_texts(docs, text, [("lang_pred", "string"), ("score", "double")], lambda: predictor(model))


def held_out(doc_id: str) -> Column:
    """Rows that no model may learn from: the CRC-32 of the id as text divides by 5; null ids are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
