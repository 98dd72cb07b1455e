import hashlib
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from gridspark.llm import decontaminate, pieces, queries

from . import brute
from .test_near_copies import left_over, roots, shuffled
from .test_operators import DOCS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    r = random.Random(8)
    base = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(x) for x in base.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    texts = [x for x in rows if len(x[1].split()) > 120][:12]
    rows += [(5000 + i, x[1], *x[2:]) for i, x in enumerate(texts)]
    passage = " ".join(texts[0][1].split()[10:70])
    rows += [(6000 + i, f"{texts[i][1][::-1][:600]} {passage} {r.random()}", *texts[i][2:]) for i in range(3)]
    rows += [(7000, None, None, None, None), (7001, "", "en", None, 0), (None, texts[1][1][:500], "en", None, 500), (7002, "123 !!", "en", "s", 6), rows[3]]
    full = spark.createDataFrame(rows, DOCS)
    folder, docs, out = str(tmp_path_factory.mktemp("stages")), full, [full]
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns(staged):
    assert len(cp.STAGES) == 5
    for df in staged[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_language(staged):
    before, after = rows_of(staged[0]), rows_of(staged[1])
    gone = set(before) - set(after)
    assert {7000, 7001, 7002} <= gone
    assert len(gone) < 0.1 * len(before)


def one_of_each(rows):
    """Texts that stay: of each group the row with the smallest id, null last, then the smallest text name."""
    groups = {}
    for (key, text), root in zip(rows, roots(rows), strict=True):
        rank = (key is None, key or 0, hashlib.md5((text or "").encode()).hexdigest())
        groups[root] = min(groups.get(root, (rank, key, text)), (rank, key, text), key=lambda x: x[0])
    return sorted(((key, text or "") for _, key, text in groups.values()), key=str)


def test_near_dedup(staged):
    want = one_of_each([(r.doc_id, r.text) for r in staged[1].collect()])
    assert sorted(((r.doc_id, r.text or "") for r in staged[2].collect()), key=str) == want
    assert not {i for i, _ in want if i and 5000 <= i < 5012}


def test_near_dedup_loses_no_text(spark):
    """One id on two texts, two ids on one text, rows without an id, equal rows."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a), (1, b), (2, b), (3, c), (4, c), (None, c), (None, a + " more"), (None, "alone here"), (None, "alone here"), (5, "x y z"), (5, "x y z"), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, lang, "s", 1) for (i, t), lang in zip(rows, ["en", None] * 7)], DOCS)
    for some in (docs, docs.repartition(5), docs.orderBy("text", "lang")):
        got = cp.near_dedup(spark, some, SF)
        assert got.columns == list(cp.COLUMNS)
        assert sorted(((r.doc_id, r.text or "") for r in got.collect()), key=str) == one_of_each(rows)
    kept = [r.text for r in cp.near_dedup(spark, docs, SF).collect()]
    assert {a, b, c, "alone here", "x y z"} <= set(kept) and len(kept) == 6


def test_passages(staged):
    want = {i: kept.decode("utf-8", "ignore") for i, _, _, _, kept in brute.suffix([(r.doc_id, r.text) for r in staged[2].collect()])}
    got = rows_of(staged[3])
    assert {i: r.text for i, r in got.items()} == want
    assert sum(len(r.text) for r in got.values()) < sum(len(r.text) for r in staged[2].collect())


def test_decontamination(staged, spark):
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = rows_of(staged[3]), rows_of(staged[4])
    held = {i for i, r in before.items() if any(x in decontaminate.normalise(r.text) for x in items)}
    assert held and set(before) - set(after) == held


def test_encoding(staged):
    before, after = rows_of(staged[4]), rows_of(staged[5])
    encode = pieces.encoder(queries.vocabulary("piece_bpe_32k.model"))
    assert set(before) == set(after)
    for i, r in after.items():
        assert bytes(r.ids) == encode([before[i].text])[0][0] and r.n_tokens == len(r.ids) // 4 and r.round_trip


def test_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run_keeps_the_last_stage_only(spark, monkeypatch):
    """What a stage shuffled, and the rows that it read, leave the disk when its own rows are written."""
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    others, seen = set(folder.glob("corpus-*/*")), []

    def stage(number):
        def some(spark, docs, sf_dir):
            assert sf_dir == SF
            seen.append([p.name for p in set(folder.glob("corpus-*/*")) - others])
            return docs.where(F.col("doc_id") % 7 != number).repartition(3, "doc_id")

        return some

    monkeypatch.setattr(cp, "STAGES", [(str(k), stage(k)) for k in range(4)])
    written = shuffled(spark)
    got = cp.run(spark, SF)
    assert seen == [[], ["0"], ["1"], ["2"]]
    assert [p.name for p in set(folder.glob("corpus-*/*")) - others] == ["3"]
    assert not left_over(spark, written)
    want = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id % 7 > 3")
    assert sorted(got.collect()) == sorted(want.collect()) != []
