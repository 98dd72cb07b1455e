"""The language model's fit against plain loops."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from gridspark.llm import langid

TINY = langid.Settings(bits=4, epochs=2)


def plain_ftrl(rows, labels, k, s, l1):
    """Weights by the textbook update, one number at a time."""
    size, z, n = (1 << s.bits) + 1, {}, {}

    def weight(i, c):
        zi, free = z.get((i, c), 0.0), 0.0 if i == size - 1 else l1
        if abs(zi) <= free:
            return 0.0
        return -(zi - math.copysign(free, zi)) / ((s.beta + math.sqrt(n.get((i, c), 0.0))) / s.alpha + s.l2)

    order = np.random.default_rng(7)
    for _ in range(s.epochs):
        for r in order.permutation(len(rows)):
            x = {**dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True)), size - 1: 1.0}
            w = {(i, c): weight(i, c) for i in x for c in range(k)}
            raw = [math.exp(sum(v * w[i, c] for i, v in x.items())) for c in range(k)]
            for i, v in x.items():
                for c in range(k):
                    g = v * (raw[c] / sum(raw) - (c == labels[r]))
                    old = n.get((i, c), 0.0)
                    z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / s.alpha * w[i, c]
                    n[i, c] = old + g * g
    return np.array([[weight(i, c) for c in range(k)] for i in range(size)])


@pytest.mark.parametrize("l1", [0.0, 0.05, 0.5])
def test_ftrl_is_the_plain_loop(l1):
    r = np.random.default_rng(1)
    rows = []
    for _ in range(30):
        at = np.sort(r.choice(16, 5, replace=False))
        rows.append((at, r.random(5)))
    labels = r.integers(0, 3, 30)
    np.testing.assert_allclose(langid.fit_ftrl(rows, labels, 3, TINY, l1), plain_ftrl(rows, labels, 3, TINY, l1), atol=1e-9)


def test_penalty_is_the_largest_within_one_error():
    r = np.random.default_rng(2)
    labels = r.integers(0, 2, 200)
    rows = [(np.array([0 if y else 1, 2 + int(r.integers(0, 13))]), np.array([1.0, 0.3])) for y in labels]
    l1, w, t = langid.fit_penalty(rows[:150], labels[:150], rows[150:], labels[150:], 2, TINY)
    assert l1 in TINY.l1 and t > 0
    # The noise features carry nothing, the first two carry all.
    assert (w[2:-1] == 0).mean() > 0.5 and w[0, 1] > 0 > w[0, 0]


def test_sample_counts_whole_texts(spark):
    long = "alpha beta " * 1000 + "zq" * 3000
    texts = [("x", long), ("x", long), ("y", long), ("x", "short one"), ("x", "  "), (None, "no language"), ("y", None)]
    rows = spark.createDataFrame(texts, "lang string, text string").where("lang is not null and text is not null")
    s = langid.Settings()
    got = langid.fitting_sample(rows, s)
    assert Counter(lang for lang, _, _ in got) == {"x": 2, "y": 1}
    want = {("x", langid.sparse(langid.counts_of(long, s))), ("y", langid.sparse(langid.counts_of(long, s))),
            ("x", langid.sparse(langid.counts_of("short one", s)))}
    assert {(lang, c) for lang, _, c in got} == want
    plain = Counter(langid.features(long, s).tolist())
    assert {i: v for i, v in enumerate(langid.dense(langid.sparse(langid.counts_of(long, s)), s)) if v} == plain
    # Many languages share the bound of the whole sample.
    assert len(langid.fitting_sample(rows, langid.Settings(rows=2))) == 2
