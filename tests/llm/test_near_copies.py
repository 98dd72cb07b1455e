import random
import time
from pathlib import Path

import numpy as np
import pytest

import corpus_pipeline as cp
from gridspark.llm import near_copies, suffix_dedup
from gridspark.llm.graph import components
from gridspark.session import FREE_SHUFFLES

from .test_operators import DOCS, ODD, SF


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def roots(rows):
    """A number for every row, alike in a group, from the similarities of all pairs."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(rows))]


def brute(rows):
    """Component id of every row."""
    root, least = roots(rows), {}
    for i, (key, _) in zip(root, rows, strict=True):
        if key is not None:
            least[i] = min(least.get(i, key), key)
    return sorted(((key, least.get(i)) for i, (key, _) in zip(root, rows, strict=True)), key=str)


def copies(spark):
    """Given documents, odd texts, a spread group of near copies and texts of a common line."""
    r = random.Random(3)
    rows = [(x[0] + 100, x[1]) for x in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    for k in range(90):
        words = list(base)
        for _ in range(r.randrange(6)):
            words[r.randrange(150)] = f"x{r.random()}"
        rows.append((1000 + k, " ".join(words)))
    line = "this one line stands in very many texts and says nothing at all to anyone"
    rows += [(2000 + k, f"{line} {' '.join(str(r.random()) for _ in range(k % 7))}") for k in range(60)]
    return [x for x in ODD if x[0] != 9] + rows


@pytest.mark.parametrize("paired, common", [(24, 1 << 16), (3, 0), (10**9, 1 << 16)])
def test_near_copies(spark, monkeypatch, paired, common):
    monkeypatch.setattr(near_copies, "PAIRED", paired)
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "BUCKET", 1000)
    rows = copies(spark)
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_stage_drops_similar_texts(spark):
    """Of two texts with similarity 0.83 and fingerprints more than two bits apart, one stays."""
    text = dict(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    docs = spark.createDataFrame([(i, text[i], "en", None, 0) for i in (6, 145, 1, 177)], DOCS)
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, SF).collect()) == [1, 6]


def test_sketches_never_count_less():
    """What two sketches share is at least what the sets share, in small and in crowded sets, and all of equal ones."""
    r = np.random.default_rng(5)
    for n in (1, 7, 300, 90_000):
        whole = np.unique(r.integers(-2**63, 2**63, 2 * n))
        x, y = (np.sort(r.choice(whole, n, replace=False)) for _ in "xy")
        p, q = (near_copies.unsketched(near_copies.sketch(s)) for s in (x, y))
        counts = [np.bincount(s, minlength=1 << 16) for s in (p, q)]
        assert near_copies.most_common(p, q) == np.minimum(*counts).sum() >= len(np.intersect1d(x, y))
        assert near_copies.most_common(p, p) == n


@pytest.mark.parametrize("factor", [suffix_dedup._M, np.uint64(0)])
def test_distinct_rows(monkeypatch, factor):
    """Kinds of rows are those of the bytes, also if all hashes collide."""
    monkeypatch.setattr(suffix_dedup, "_M", factor)
    rows = np.random.default_rng(6).integers(0, 2, (500, 9)).astype(np.uint8)
    first, which = suffix_dedup.distinct(rows)
    assert (rows[first[which]] == rows).all()
    assert len(first) == len({x.tobytes() for x in rows})


def test_repeated_hashes():
    """A chunk hears of the hashes that others hold too, and of those that it marked itself."""
    blobs = [suffix_dedup.short(np.array(x, np.uint64)) for x in ([2, 4, 7], [4, 8], [10])]
    assert [x.tolist() for x in suffix_dedup.repeated(blobs)] == [[2, 3], [2], []]


def test_sets_take_one_python_pass(spark):
    """Filter and shingles of the wanted texts share a process; two would add up in an executor's memory."""
    texts = [f"word{k} " * 3 + "and some more words here" for k in range(40)]
    docs = spark.createDataFrame([(t, f"{k:032x}") for k, t in enumerate(texts)], "text string, tid string").repartition(3)
    wanted = docs.where("tid < '00000000000000000000000000000009'").select("tid")
    for form, make in ((("grams", "array<long>"), None), (("sketch", "binary"), near_copies.sketch)):
        sets = near_copies.with_sets(docs, wanted, 5, form, make)
        assert sets._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        got = {r.tid: r[1] for r in sets.collect()}
        assert sorted(got) == [f"{k:032x}" for k in range(9)]
        for k in range(9):
            want = near_copies.shingles(texts[k], 5)
            assert got[f"{k:032x}"] == (make(want) if make else want.tolist())


def crowd(copies):
    """A text and copies of it with one to three words changed; most are alike to the text only."""
    r = random.Random(8)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for k in range(1, copies):
        words = list(base)
        for at in r.sample(range(0, 150, 5), r.choice((1, 3, 3, 3))):
            words[at] = f"x{k}y{at}"
        rows.append((k, " ".join(words)))
    return rows


def test_crowd_is_linked_by_its_centre(spark, monkeypatch):
    """The pairs to verify grow with the texts of a crowd, not with their square."""
    formed, verified = [], near_copies.verified

    def counted(pairs, *args):
        formed.append(pairs.count())
        return verified(pairs, *args)

    monkeypatch.setattr(near_copies, "verified", counted)
    rows = crowd(300)
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert sum(formed) < 6 * len(rows)


@pytest.mark.parametrize("crowded, rounds", [(0, 4), (0, 0)])
def test_rounds_of_hubs_lose_no_link(spark, monkeypatch, crowded, rounds):
    """Groups are the same however many rounds of hubs come before the last pairs."""
    monkeypatch.setattr(near_copies, "PAIRED", 3)
    monkeypatch.setattr(near_copies, "CROWDED", crowded)
    monkeypatch.setattr(near_copies, "ROUNDS", rounds)
    rows = crowd(60)[1:] + [(k + 100, text) for k, text in copies(spark) if k and 1000 <= k < 3000]
    got = near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_small_steps_keep_to_few_tasks(spark):
    """However many partitions a shuffle has, a small graph is contracted in few tasks, which cost disk whatever they move."""
    tracker, keep = spark.sparkContext.statusTracker(), {"spark.sql.shuffle.partitions": "120", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keep}
    edges = spark.createDataFrame([(f"{k:03d}", f"{k + 1:03d}") for k in range(20)], "a string, b string")
    try:
        for k, v in keep.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("few-tasks", "components")
        got = components(edges).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {(r.node, r.root) for r in got} == {(f"{k:03d}", "000") for k in range(21)}
    stages = {s for j in tracker.getJobIdsForGroup("few-tasks") for s in tracker.getJobInfo(j).stageIds}
    assert sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i) < 4000


def shuffled(spark):
    """Names of the shuffle files on this machine."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for k in range(files.size()) if (name := files.apply(k).getName()).startswith("shuffle_")}


def left_over(spark, before):
    """Shuffle files that stay beside those of ``before``; they go in the background, which takes a moment."""
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:
        time.sleep(0.2)
    return shuffled(spark) - before


def test_steps_leave_nothing_on_disk(spark):
    """Shuffles go with the action that wrote them and stored steps with their last reader, without the driver's garbage collection."""
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    docs = spark.createDataFrame(crowd(300), "doc_id long, text string").select("text", near_copies.TID("text").alias("tid"))
    # Frames that earlier tests have left may be collected meanwhile: only what is new counts.
    written, stored, setting = shuffled(spark), set(folder.iterdir()), spark.conf.get(FREE_SHUFFLES)
    found = near_copies.groups(docs)
    assert not left_over(spark, written)
    # Pairs verified first and last, the groups between, and those that the result reads.
    assert len(set(folder.iterdir()) - stored) <= 4
    assert spark.conf.get(FREE_SHUFFLES) == setting
    assert found.count() == 300 and found.select("root").distinct().count() == 1
