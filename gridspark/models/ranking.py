"""Areas and thresholds of many models from score histograms, exact where that matters.

Every task counts both classes per model and score bin, so what is shuffled depends on models, bins and tasks, not on
cells.  Bins with one class are settled by their counts; bins with both bound the result, and only scores in bins that
can still decide it are looked at one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridspark.models.logistic import Model, Scale, _design, _groups, _probabilities

# Bins of the first look at all models, of the closer look at those still in question, and of thresholds.
COARSE, FINE, EDGES = 1024, 1 << 16, 4096
# Filled bins of all models that a task may hold in the closer look: outer folds are looked at in turn beyond that.
HELD = 1 << 23
# Segments of a validation part's score axis at most, the fewest it must allow, the rows wanted in one and the most it may hold.
SEGMENTS, FEWEST, WANTED_ROWS, SEGMENT_ROWS = 1024, 8, 1 << 14, 1 << 21
# Bins with both classes that are listed for a model; with more of them every bin is looked into.
LISTED = 1 << 14


@dataclass
class Bounds:
    """What the counts by score bin say about a model's ROC area."""

    pairs: float  # cells of class 0 times cells of class 1
    wins: float  # pairs of different bins in the right order
    within: float  # pairs of one bin
    bins: int
    mixed: np.ndarray | None  # bins with both classes; None for every bin

    def area(self) -> tuple[float, float]:
        """Least and greatest area that the counts allow; NaN for a single class."""
        if not self.pairs:
            return float("nan"), float("nan")
        return self.wins / self.pairs, (self.wins + self.within) / self.pairs


def _pack(at: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> bytes:
    return np.concatenate([at, n0, n1]).astype("<i8").tobytes()


def _merge(packed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins in order and their counts, summed over packed ones."""
    at, n0, n1 = np.concatenate([np.frombuffer(bytes(b), "<i8").reshape(3, -1) for b in packed], axis=1)
    bins, where = np.unique(at, return_inverse=True)
    out = np.zeros((2, len(bins)), "int64")
    np.add.at(out[0], where, n0)
    np.add.at(out[1], where, n1)
    return bins, out[0], out[1]


def score_ranges(models: Sequence[Model], scales: Mapping[int, Sequence[Scale]]) -> np.ndarray:
    """Least and greatest probability of each model; clip limits bound its features."""
    out = np.zeros((len(models), 2))
    for i, m in enumerate(models):
        ends = np.array([[s(np.array([v]))[0] for v in (s.lower, s.upper)] for s in scales[m.outer]]) * m.weights[1:, None]
        z = m.weights[0] + np.array([ends.min(axis=1).sum(), ends.max(axis=1).sum()])
        out[i] = _probabilities(z)[0]
    return out


def _bin(p: np.ndarray, ends: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each score; never decreases with the score."""
    width = ends[1] - ends[0]
    if not width > 0:
        return np.zeros(len(p), int)
    return np.clip(np.floor((p - ends[0]) * (bins / width)), 0, bins - 1).astype(int)


def _parts(batch: pd.DataFrame, groups, models, features, scales, training: bool):
    """(model number, scores, cells of class 0 and 1) of a batch: validation cells, or the training cells of outer folds."""
    fold = batch["fold"].to_numpy()
    y, w = batch["y"].to_numpy(), batch["w"].to_numpy()
    for outer, numbers in groups.items():
        own = None if training else batch[f"inner_{outer}"].to_numpy()
        for inner in sorted({models[i][0] for i in numbers}):
            rows = fold != outer
            if not training:
                rows &= own == inner
            if not rows.any():
                continue
            x = _design(batch, rows, features, scales[outer])
            n1 = w[rows] * (y[rows] == 1)
            n0 = w[rows] - n1
            for i in (i for i in numbers if models[i][0] == inner):
                yield i, _probabilities(x @ models[i][1])[0], n0, n1


def histograms(rows: DataFrame, models: Sequence[Model], features: Sequence[str], scales: Mapping[int, Sequence[Scale]],
               bins: int, training: bool = False) -> DataFrame:
    """(model, counts): filled score bins of each model over its inner validation cells, or with ``training`` over its
    training cells, packed with the cells of both classes.

    Each task emits at most one row per model, of at most as many numbers as there are bins.
    """
    groups, features = _groups(models), list(features)
    held = [(m.inner, m.weights) for m in models]
    scales = {o: list(scales[o]) for o in groups}
    ranges = score_ranges(models, scales)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list[bytes]] = {}
        for batch in batches:
            for i, p, n0, n1 in _parts(batch, groups, held, features, scales, training):
                parts = total.setdefault(i, [])
                parts.append(_pack(_bin(p, ranges[i], bins), n0, n1))
                if len(parts) > 8:
                    total[i] = [_pack(*_merge(parts))]
        yield pd.DataFrame({"model": np.array(list(total), "int32"), "counts": [_pack(*_merge(t)) for t in total.values()]})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"model": frame["model"].iloc[:1], "counts": [_pack(*_merge(frame["counts"]))]})

    schema = "model int, counts binary"
    packed = rows.mapInPandas(count, schema).withColumn("part", F.spark_partition_id() % 64)
    some = packed.groupBy("model", "part").applyInPandas(add, schema)  # no group grows with the tasks alone
    return some.groupBy("model").applyInPandas(add, schema)


def bounds(rows: DataFrame, models: Sequence[Model], features: Sequence[str], scales, bins: int = COARSE) -> list[Bounds]:
    """Bounds of each model's area on its inner validation cells; a few numbers and LISTED bins of each reach the driver."""
    def conclude(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for model, counts in zip(batch["model"], batch["counts"]):
                at, n0, n1 = _merge([counts])
                mixed = at[(n0 > 0) & (n1 > 0)]
                n0, n1 = n0.astype(float), n1.astype(float)
                out.append((model, n0.sum() * n1.sum(), (n1 * (np.cumsum(n0) - n0)).sum(), (n0 * n1).sum(),
                            mixed.astype("<i8").tobytes() if len(mixed) <= LISTED else None))
            yield pd.DataFrame(out, columns=["model", "pairs", "wins", "within", "mixed"])

    counted = histograms(rows, models, features, scales, bins)
    out = [Bounds(0.0, 0.0, 0.0, bins, np.zeros(0, "int64")) for _ in models]
    for r in counted.mapInPandas(conclude, "model int, pairs double, wins double, within double, mixed binary").collect():
        mixed = None if r["mixed"] is None else np.frombuffer(bytes(r["mixed"]), "<i8")
        out[r["model"]] = Bounds(r["pairs"], r["wins"], r["within"], bins, mixed)
    return out


def scores_within(rows: DataFrame, models: Sequence[Model], features: Sequence[str], scales: Mapping[int, Sequence[Scale]],
                  bins: int, wanted: Sequence[np.ndarray | None], training: bool = False) -> DataFrame:
    """(model, bin, p, n0, n1, n0_before, n1_before) of the distinct scores in the wanted bins, counted within the bin."""
    groups, features = _groups(models), list(features)
    held = [(m.inner, m.weights) for m in models]
    scales = {o: list(scales[o]) for o in groups}
    ranges, wanted = score_ranges(models, scales), [None if x is None else np.asarray(x) for x in wanted]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for i, p, n0, n1 in _parts(batch, groups, held, features, scales, training):
                at, want = _bin(p, ranges[i], bins), wanted[i]
                if want is None:
                    keep = np.arange(len(at))
                elif len(want):
                    keep = np.flatnonzero(want[np.minimum(np.searchsorted(want, at), len(want) - 1)] == at)
                else:
                    continue
                found.append((np.full(len(keep), i, "int32"), at[keep].astype("int32"), p[keep], n0[keep].astype("int64"), n1[keep].astype("int64")))
            if found:
                yield pd.DataFrame(dict(zip(("model", "bin", "p", "n0", "n1"), map(np.concatenate, zip(*found)))))

    found = rows.mapInPandas(score, "model int, bin int, p double, n0 bigint, n1 bigint")
    merged = found.groupBy("model", "bin", "p").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    before = Window.partitionBy("model", "bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    return merged.withColumns({f"{n}_before": F.coalesce(F.sum(n).over(before), F.lit(0)) for n in ("n0", "n1")})


def exact_areas(rows: DataFrame, models: Sequence[Model], features: Sequence[str], scales,
                counted: Sequence[Bounds]) -> list[float]:
    """ROC AUC of each model on its inner validation cells; only scores in bins with both classes travel."""
    wins = [c.wins for c in counted]
    if any(c.within for c in counted):
        scored = scores_within(rows, models, features, scales, counted[0].bins, [c.mixed for c in counted])
        inside = scored.groupBy("model").agg(F.sum(F.col("n1") * (F.col("n0_before") + F.col("n0") / 2.0)).alias("wins"))
        for r in inside.collect():  # one row per model
            wins[r["model"]] += r["wins"]
    return [w / c.pairs if c.pairs else float("nan") for w, c in zip(wins, counted)]


@dataclass(frozen=True)
class Segments:
    """Segments of the score axis of one model, by which the cells of all models near it are dealt.

    ``strip``: cells farther apart than this on the axis have the same order for every one of the models.
    """

    axis: np.ndarray
    low: float
    width: float
    count: int
    strip: float
    numbers: tuple[int, ...]

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Segment of each row of the design, and whether it lies in the strip below the next segment."""
        score = x[:, 1:] @ self.axis - self.low
        at = np.clip(np.floor(score / self.width), 0, self.count - 1).astype(int)
        return at, (score >= (at + 1) * self.width - self.strip) & (at < self.count - 1)


def segments_of(models: Sequence[Model], numbers: Sequence[int], scales: Sequence[Scale], wanted: int = SEGMENTS) -> Segments | None:
    """Segments that serve the numbered models, all of one validation part; None if their orders differ too much.

    A model's weights are a multiple of the axis and a rest; over the clip limits the rest moves a score by at most
    ``e``, so a pair more than ``2 e`` apart keeps its order.  A strip of ``4 e`` leaves room for rounding.
    """
    sides = np.array([s(np.array([s.lower, s.upper])) for s in scales])
    size = np.abs(sides[:, 1] - sides[:, 0])
    axis = models[sorted(numbers, key=lambda i: models[i].c)[len(numbers) // 2]].weights[1:]
    length = float((np.abs(axis) * size).sum())
    if not length > 0:
        return None
    far = 0.0
    for i in numbers:
        w = models[i].weights
        multiple = float((axis * size) @ (w[1:] * size)) / float(((axis * size) ** 2).sum())
        if not multiple > 0 or abs(w[0]) + float((np.abs(w[1:]) * np.abs(sides).max(axis=1)).sum()) > 15.0:
            return None  # against the axis, or so steep that different scores give one probability
        far = max(far, 0.5 * float((np.abs(w[1:] / multiple - axis) * size).sum()))
    strip = 4.0 * far + 1e-6 * length
    count = min(SEGMENTS, int(length // strip))
    if count < FEWEST:
        return None
    count = max(1, min(count, wanted))
    return Segments(axis, float((axis[:, None] * sides).min(axis=1).sum()), length / count, count, strip, tuple(numbers))


def _wins(p: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """Pairs in which a cell of class 1 scores above one of class 0, ties half."""
    if not (n0.any() and n1.any()):
        return 0.0
    order = np.argsort(p)
    starts = np.flatnonzero(np.concatenate([[True], np.diff(p[order]) != 0]))
    n0, n1 = np.add.reduceat(n0[order], starts), np.add.reduceat(n1[order], starts)
    return float((n1 * (np.cumsum(n0) - n0 / 2.0)).sum())


def near_areas(rows: DataFrame, models: Sequence[Model], features: Sequence[str], scales: Mapping[int, Sequence[Scale]]) -> dict[int, float]:
    """Exact ROC areas, by model number, of models that order their validation cells much alike.

    The cells of a validation part are dealt once for all its models, by segments of one model's scores; a segment also gets the
    strip below it.  All other pairs have the same order for every model and are counted from the numbers per segment.  A
    part whose models differ more, or with a segment of more than SEGMENT_ROWS rows, is left out.
    """
    features, parts = list(features), {}
    for i, m in enumerate(models):
        parts.setdefault((m.outer, m.inner), []).append(i)
    if not parts:
        return {}
    inner = max(m.inner for m in models) + 1
    segments = -(-rows.count() // (inner * WANTED_ROWS))
    cut = {k: segments_of(models, numbers, scales[k[0]], segments) for k, numbers in parts.items()}
    cut = {k: s for k, s in cut.items() if s is not None}
    names, scales = list(cut), {o: list(scales[o]) for o in {k[0] for k in cut}}

    def placed(batch: pd.DataFrame, wanted):
        fold = batch["fold"].to_numpy()
        for part in wanted:
            outer, inner = names[part]
            held = (fold != outer) & (batch[f"inner_{outer}"].to_numpy() == inner)
            if held.any():
                x = _design(batch, held, features, scales[outer])
                yield part, held, x, *cut[names[part]].place(x)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {}
        for batch in batches:
            y, w = batch["y"].to_numpy(), batch["w"].to_numpy(dtype=float)
            for part, held, _, at, strip in placed(batch, range(len(names))):
                one, n = y[held] == 1, cut[names[part]].count
                kinds = (np.ones(len(at)), w[held] * ~one, w[held] * one, w[held] * ~one * strip, w[held] * one * strip)
                total[part] = total.get(part, 0.0) + np.array([np.bincount(at, k, n) for k in kinds])
        for part, sums in total.items():
            out = pd.DataFrame(sums.T, columns=list("nabcd"))
            out.insert(0, "at", np.arange(len(out), dtype="int32"))
            out.insert(0, "part", np.int32(part))
            yield out[out["n"] > 0]

    if not cut:
        return {}
    sums = {k: np.zeros((s.count, 5)) for k, s in cut.items()}
    counted = rows.mapInPandas(count, "part int, at int, n double, a double, b double, c double, d double")
    for r in counted.groupBy("part", "at").agg(*[F.sum(c).alias(c) for c in "nabcd"]).collect():  # SEGMENTS rows a part at most
        sums[names[r["part"]]][r["at"]] = r[2:]
    wanted = [i for i, k in enumerate(names) if sums[k][:, 0].max() <= SEGMENT_ROWS]
    weights = [m.weights for m in models]

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            y, w = batch["y"].to_numpy(dtype="int32"), batch["w"].to_numpy()
            for part, held, x, at, strip in placed(batch, wanted):
                for own, these, to in ((True, np.ones(len(at), bool), at), (False, strip, at + 1)):
                    out = pd.DataFrame(x[these, 1:], columns=[f"x{i}" for i in range(len(features))])
                    out.insert(0, "own", own)
                    out.insert(0, "at", to[these].astype("int32"))
                    out.insert(0, "part", np.int32(part))
                    out["y"], out["w"] = y[held][these], w[held][these]
                    yield out

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        x = [frame[f"x{i}"].to_numpy() for i in range(len(features))]
        n1 = frame["w"].to_numpy(dtype=float) * (frame["y"].to_numpy() == 1)
        n0, below = frame["w"].to_numpy(dtype=float) - n1, ~frame["own"].to_numpy(dtype=bool)
        numbers, wins = cut[names[part]].numbers, []
        for i in numbers:
            # Summed by column: a product of matrices may round like cells differently, which would undo ties.
            p = _probabilities(sum((v * c for v, c in zip(x, weights[i][1:])), weights[i][0]))[0]
            wins.append(_wins(p, n0, n1) - _wins(p[below], n0[below], n1[below]))
        return pd.DataFrame({"model": np.array(numbers, "int32"), "wins": wins})

    near = {}
    if wanted:
        columns = "".join(f", x{i} double" for i in range(len(features)))
        cells = rows.mapInPandas(dealt, f"part int, at int, own boolean{columns}, y int, w bigint")
        found = cells.groupBy("part", "at").applyInPandas(compared, "model int, wins double")
        near = {r["model"]: r["wins"] for r in found.groupBy("model").agg(F.sum("wins").alias("wins")).collect()}  # one row a model
    out = {}
    for k in (names[i] for i in wanted):
        _, n0, n1, strip0, _ = sums[k].T
        below = np.concatenate([[0.0], np.cumsum(n0)[:-1] - strip0[:-1]])  # class 0 below a segment and its strip
        pairs = n0.sum() * n1.sum()
        for i in cut[k].numbers:
            out[i] = (float((n1 * below).sum()) + near.get(i, 0.0)) / pairs if pairs else float("nan")
    return out


def best_penalties(rows: DataFrame, models: Sequence[Model], candidates: Sequence[float], features: Sequence[str], scales) -> dict[int, float]:
    """Candidate with the highest mean area over inner folds, per outer fold; the first of equals.

    Bounds from a coarse histogram drop candidates that cannot be best.  Those left mostly order cells alike, so that all of a
    part are compared at once (:func:`near_areas`); where they do not, a fine histogram drops more of them and scores in
    mixed bins decide.  The choice is that of exact areas throughout.  A candidate with an area missing is never chosen, unless
    all are: then the first one is.
    """
    usable = [m for m in models if m.fitted]
    groups: dict[tuple, list[Model]] = {}
    for m in models:
        groups.setdefault((m.outer, m.c), []).append(m)
    left = {k: g for k, g in groups.items() if all(m.fitted for m in g)}
    outers = sorted({m.outer for m in models})
    best = {o: candidates[0] for o in outers}
    if not usable:
        return best

    def narrowed(left, area):
        mean = {k: np.mean([area[id(m)] for m in g], axis=0) for k, g in left.items()}
        mean = {k: v for k, v in mean.items() if not np.isnan(v).any()}
        floor = {o: max((v[0] for k, v in mean.items() if k[0] == o), default=0.0) for o in outers}
        # Means are compared to twelve digits.
        return {k: left[k] for k, v in mean.items() if v[1] >= floor[k[0]] - 1e-11}

    def open_models(left):
        alone = {o for o in outers if sum(k[0] == o for k in left) == 1}
        return [m for k, g in left.items() if k[0] not in alone for m in g]

    def looked_at(asked, bins):
        counted = bounds(rows, asked, features, scales, bins)
        return counted, {id(m): c.area() for m, c in zip(asked, counted)}

    area: dict[int, float] = {}
    asked = open_models(left)
    if asked:
        left = narrowed(left, looked_at([m for g in left.values() for m in g], COARSE)[1])
    asked = open_models(left)
    area |= {id(asked[i]): a for i, a in near_areas(rows, asked, features, scales).items()}
    parts: list[list[int]] = []
    held = 0
    for o in outers:
        n = sum(m.outer == o and id(m) not in area for m in open_models(left)) * FINE
        if not parts or held + n > HELD:
            parts.append([])
            held = 0
        parts[-1].append(o)
        held += n
    for folds in parts:
        now = [m for m in open_models(left) if m.outer in folds and id(m) not in area]
        if not now:
            continue
        counted, found = looked_at(now, FINE)
        asked_folds = {m.outer for m in now}
        found |= {id(m): (area[id(m)],) * 2 for m in open_models(left) if id(m) in area}
        kept = narrowed({k: g for k, g in left.items() if k[0] in asked_folds}, found)
        left = {k: g for k, g in left.items() if k[0] not in asked_folds} | kept
        still = {id(m) for m in open_models(kept)}
        pairs = [(m, c) for m, c in zip(now, counted) if id(m) in still]
        if pairs:
            exact = exact_areas(rows, [m for m, _ in pairs], features, scales, [c for _, c in pairs])
            area |= {id(m): a for (m, _), a in zip(pairs, exact)}
    for o in outers:
        mine = [c for c in candidates if (o, c) in left]
        if len(mine) > 1:
            mean = [np.mean([area[id(m)] for m in left[o, c]]) for c in mine]
            best[o] = mine[int(np.argmax(np.round(mean, 12)))]
        elif mine:
            best[o] = mine[0]
    return best


def best_f1_thresholds(rows: DataFrame, models: Sequence[Model], features: Sequence[str], scales,
                       bins: int = EDGES) -> dict[int, float]:
    """Score with the highest F1 on each outer model's training cells, the lowest of equals.

    A bin whose bound on F1 lies below what some bin's lowest score reaches is not looked into.
    """
    dense = np.zeros((len(models), 2, bins))
    for r in histograms(rows, models, features, scales, bins, training=True).collect():
        at, n0, n1 = _merge([r["counts"]])
        dense[r["model"], :, at] = np.stack([n0, n1], axis=1)
    wanted, above = [], []
    for n0, n1 in dense:
        tp, fp = (np.cumsum(n[::-1])[::-1] for n in (n1, n0))
        positives = float(n1.sum())
        # A bin's lowest score is a threshold with all its cells above; within it, at most all its positives are.
        reached = _f1(tp, fp, positives)
        bound = _f1(tp, fp - n0, positives)
        filled = (n0 > 0) | (n1 > 0)
        wanted.append(np.flatnonzero(filled & (bound >= reached[filled].max(initial=0.0))))
        above.append((tp, fp, positives))
    scored = scores_within(rows, models, features, scales, bins, wanted, training=True)
    offsets = pd.DataFrame([(i, int(b), above[i][0][b], above[i][1][b], above[i][2]) for i, w in enumerate(wanted) for b in w],
                           columns=["model", "bin", "tp_bin", "fp_bin", "positives"])
    offsets = rows.sparkSession.createDataFrame(offsets, "model int, bin int, tp_bin double, fp_bin double, positives double")
    joined = scored.join(F.broadcast(offsets), ["model", "bin"])  # at most the bins of all models
    tp, fp = F.col("tp_bin") - F.col("n1_before"), F.col("fp_bin") - F.col("n0_before")
    f1 = F.coalesce(F.try_divide(2.0 * tp, tp + fp + F.col("positives")), F.lit(0.0))
    best = joined.groupBy("model").agg(F.max(F.struct(f1.alias("f1"), (-F.col("p")).alias("neg"))).alias("b"))
    return {models[r["model"]].outer: -r["b"]["neg"] for r in best.collect()}  # one row per model


def _f1(tp, fp, positives):
    return 2.0 * tp / np.maximum(tp + fp + positives, 1e-300)
