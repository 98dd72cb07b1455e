"""Spelling variants, token links and fertility rules against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import pytest

from gridspark.llm import fertility, fm_index, spelling, token_links
from gridspark.llm.chunks import byte_alphabet, segments
from gridspark.llm.queries import QUERIES, vocabulary

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, part int, block long, key string, script string"


def table(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", "w", 1, 2, 3, "k", "z") for i, t in rows], SCHEMA)


def is_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain_variants(rows, length=6, least=5, times=5, every=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if key is None else key}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= length and n >= least}
    wild = defaultdict(set)
    for w in words:
        for i in range(len(w) + 1):
            wild[w[:i] + "*" + w[i + 1:]].add(w)
            wild[w[:i] + "+" + w[i:]].add(w)
            wild[w[:i] + "+" + w[i + 1:]].add(w)
    near = {w: {x for i in range(len(w) + 1) for k in (w[:i] + "*" + w[i + 1:], w[:i] + "+" + w[i:], w[:i] + "+" + w[i + 1:])
                for x in wild[k] if is_near(w, x)} for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items())


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("letters,words", [("ab", 40), ("abcé", 300), ("abcdefghij", 5), ("a", 3)])
def test_word_index(letters, words):
    rng = random.Random(words)
    vocabulary = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(words)})
    index = fm_index.WordIndex(vocabulary)
    asked = vocabulary + ["zzzzzz", "a" * 40]
    want = {(a, b) for a in asked for b in vocabulary if is_near(a, b)}
    for rightward in (True, False):
        q, found = index.near(asked, rightward)
        got = [(asked[i], vocabulary[j]) for i, j in zip(q, found, strict=True)]
        assert len(got) == len(set(got))
        assert set(got) == {(a, b) for a, b in want if (b.startswith(a[:len(a) // 2]) if rightward else b.endswith(a[len(a) // 2:]))}


def test_wide_intervals_equal_narrow_ones(monkeypatch):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(4, 7))) for _ in range(500)})
    want = [[x.tolist() for x in fm_index.WordIndex(words).near(words, r)] for r in (True, False)]
    monkeypatch.setattr(fm_index, "READ", 1)
    monkeypatch.setattr(fm_index, "STATES", 7)
    assert [[x.tolist() for x in fm_index.WordIndex(words).near(words, r)] for r in (True, False)] == want


def variant_rows():
    rng = random.Random(11)
    stems = ["".join(rng.choice("abcde") for _ in range(rng.randint(6, 9))) for _ in range(25)] + ["àéîõüÿ", "straße", "x" * 40]
    rows = []
    for i in range(400):
        words = [rng.choice(stems[:1 + rng.randrange(len(stems))]) for _ in range(30)]
        for k in range(0, 30, 7):
            at = rng.randrange(len(words[k]))
            words[k] = words[k][:at] + rng.choice(["", "a", "é", words[k][at] + "b"]) + words[k][at + 1:]
        rows.append((i, rng.choice([" ", ", ", "-"]).join(w.upper() if rng.random() < 0.2 and w.isascii() else w for w in words)))
    return rows + [(7, None), (None, ""), (None, "abcdef " * 9), (7, "12 中文 × ÷ ÷÷÷÷÷÷÷"), (5, "abcdef" * 4000), rows[0], rows[0]]


@pytest.mark.parametrize("every", [199, 3])
def test_variants(spark, every):
    rows = variant_rows()
    want = plain_variants(rows, every=every)
    assert any(r[1] for r in want)
    assert rows_of(spelling.variants(table(spark, rows), every=every)) == want
    # Every half with more than one word is split into blocks.
    assert rows_of(spelling.variants(table(spark, rows), every=every, indexed=20)) == want


def test_chains_of_forms(spark):
    rows = [(1, "chainaaaa " * 750), (2, "chainaaab " * 150 + "chainaabb " * 30), (3, "chainabbb " * 6 + "chainabbc " * 6)]
    want = plain_variants(rows, every=10**9)
    assert {r[0]: r[2] for r in want} == dict.fromkeys([r[0] for r in want], "chainaaaa") | {"chainabbc": "chainabbc"}
    assert rows_of(spelling.variants(table(spark, rows), every=10**9)) == want


def test_variants_without_words(spark):
    assert spelling.variants(table(spark, [(1, None), (2, "a b")])).collect() == []
    assert spelling.variants(table(spark, [])).collect() == []


def plain_links(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    a_side.encode_special_tokens = True
    b_side = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    back = {c: x for x, c in byte_alphabet().items()}
    found, counts = [], Counter()
    for key, text in rows:
        a = a_side.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_side.encode(text) if text else []
        a_bytes = [bytes(back[c] for c in a_side.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(b_side.id_to_piece(i)[3:-1], 16)]) if b_side.is_byte(i) else b_side.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            found.append((key, None))
            continue
        spans = []
        for side in (a_bytes, b_bytes):
            ends = [sum(map(len, side[:i + 1])) for i in range(len(side))]
            spans.append(list(zip([0, *ends], ends)))
        links, j = [], 0
        for i, (start, end) in enumerate(spans[0]):
            while spans[1][j][1] <= start:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < end:
                links.append((a[i], b[k]))
                k += 1
        shared = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = ";".join("|".join(",".join(str(x) for x, (_, e) in zip(ids, span) if low < e <= high) for ids, span in ((a, spans[0]), (b, spans[1])))
                          for low, high in zip([0, *shared], shared))
        counts.update(links)
        found.append((key, (len(a), len(b), len(shared), links, hashlib.sha256(groups.encode()).hexdigest())))
    highest = defaultdict(int)
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    return sorted(((key, 0, 0, 0, 0, 0, 0, "") if v is None else
                   (key, *v[:3], len(v[3]), sum(counts[p] == highest[p[1]] for p in v[3]), sum(counts[p] for p in v[3]), v[4]) for key, v in found), key=str)


ODD = ["", "   ", "\n\n a", "a▁b", "<|endoftext|> hi <s> </s>", "x" * 700, " lead", "trail ", "é中\U0001f600 \x00 b", "a  b\t\tc", "ﬁ  x 　y",
       "a" * 50 + " " * 50 + "b", None, "<0x41> q", "\r\nq", "it's we'll THE the the"]


def link_rows():
    rng = random.Random(5)
    made = [(i % 30, "".join(rng.choice(["the ", "ing", "Zu", " é", "\n", "  ", "12", "tion ", "中", "'s", "."]) for _ in range(rng.randint(1, 60)))) for i in range(60)]
    return made + [(None if i == 3 else i, t) for i, t in enumerate(ODD)] + made[:3]


def linked(spark, rows, **how):
    df = token_links.token_links(table(spark, rows), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), **how)
    return sorted((tuple(r) for r in df.select("doc_id", *token_links.COUNTS, "n_best", "count_sum", "groups_sha256").collect()), key=str)


def test_token_links(spark, monkeypatch):
    rows = link_rows()
    want = plain_links(rows)
    assert linked(spark, rows) == want
    assert linked(spark, rows, parts=1) == want
    # Many blocks, and parts whose runs are merged in several groups.
    monkeypatch.setattr(token_links, "RUN_BYTES", 300)
    monkeypatch.setattr(token_links, "MERGED", 200)
    assert linked(spark, rows, parts=3) == want


def test_token_links_without_tokens(spark):
    assert linked(spark, []) == []
    assert linked(spark, [(1, None), (1, None)]) == [(1, 0, 0, 0, 0, 0, 0, "")] * 2


def test_runs_of_many_frames(monkeypatch):
    import numpy as np

    monkeypatch.setattr(token_links, "FRAME", 3)
    rng = np.random.default_rng(1)
    runs, total = [], Counter()
    for k in (40, 1, 25, 0, 17):
        records = sorted(set(zip(rng.integers(0, 6, k).tolist(), rng.integers(0, 50, k).tolist())))
        times = rng.integers(1, 9, len(records))
        for (key, _), n in zip(records, times.tolist()):
            total[key] += n
        keys, texts = (np.array([r[c] for r in records], np.int64) for c in (0, 1))
        runs.append(token_links.pack_run(keys, texts, times))
    keys, counts = token_links.merged(runs)
    assert dict(zip(keys.tolist(), counts.tolist())) == total and np.all(np.diff(keys) > 0)


def test_long_texts_are_linked_in_segments():
    text = "the quick brown fox " * 20 + "x" * 90 + " jumps"
    assert "".join(segments(text, 50)) == text
    assert all(s for s in segments(text, 50))


def plain_rules(rows):
    out = []
    for key, text in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0D]+", text)
        windows = Counter(zip(*(words[k:] for k in range(5)), strict=False)) if len(words) > 4 else Counter()
        inside = {i + k for i in range(len(words) - 4) if windows[tuple(words[i:i + 5])] > 1 for k in range(5)}
        lines = text.split("\n")
        dup = sum(bool(re.search("[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
        failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
        out.append((key, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), failed))
    return sorted(out, key=str)


RULES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def judged(spark, rows, **how):
    return fertility.judge(table(spark, rows), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), **how)


def test_base_rules(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["a", "b", "c#"]) + rng.choice([" ", "\n", "\t", " ", "  "]) for _ in range(rng.randint(1, 80)))) for i in range(60)]
    rows += [(i, t) for i, t in enumerate(ODD)] + [(None, "same words again and again " * 4), (1, "one two three four five six seven eight nine ten")] + rows[:2]
    got = judged(spark, rows)
    assert sorted((tuple(r) for r in got.select(*RULES).collect()), key=str) == plain_rules(rows)
    # Small groups have no band.
    assert got.where("kept = base_failed").count() == 0
    assert {"lang", "source", "word", "n", "part", "block", "key"} <= set(got.columns)
    assert judged(spark, []).collect() == []


def natural(rng, n=120):
    return " ".join(rng.choice("the of and a people water house country school number great small world story letter earth light thought head".split()) +
                    rng.choice(["", "", "", ",", "."]) for _ in range(n))


def test_bands(spark):
    rng = random.Random(2)
    rows = [(i, natural(rng)) for i in range(200)]
    noise = " ".join("".join(rng.choice("qxzjkv0123456789") for _ in range(12)) for _ in range(80))
    glyphs = " ".join("".join(chr(rng.randrange(0xA980, 0xA9C0)) for _ in range(6)) + rng.choice("abcdef") for _ in range(80))
    got = {r["doc_id"]: (r["kept"], r["outside"]) for r in judged(spark, [*rows, (1000, noise), (1001, glyphs), (1002, natural(rng)), (1003, natural(rng, 20))], lang=None).collect()}
    assert all(got[i][0] for i in (*range(200), 1002, 1003)), [i for i in got if not got[i][0]]
    assert not got[1000][0] and {"byte_chars", "piece_chars"} <= set(got[1000][1])
    assert not got[1001][0] and "fallback" in got[1001][1]


def test_measures_equal_plain_ones(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    a_side = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    b_side = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    text = "Water 中文 and the \U0001f600 house\n" * 11
    row = judged(spark, [(1, text)]).first()
    a, b = len(a_side.encode(" " + text, add_special_tokens=False).ids), b_side.encode(text)
    share = [n / len(b) for n in Counter(b).values()]
    assert row["byte_chars"] == pytest.approx((len(text) + 1) / a) and row["piece_chars"] == pytest.approx((len(text) + 1) / len(b))
    assert row["fallback"] == pytest.approx(sum(map(b_side.is_byte, b)) / len(b))
    assert row["entropy"] == pytest.approx(-sum(p * math.log2(p) for p in share) / math.log2(len(b)))
    assert row["script"] == "latin"


def test_queries(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert rows_of(QUERIES["op11_spelling"](spark, DATA).select("word", "form", "root", "n", "n_near", "form_n")) == plain_variants(docs)
    got = QUERIES["op12_token_links"](spark, DATA).select("doc_id", *token_links.COUNTS, "n_best", "count_sum", "groups_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_links(docs)
    assert sorted((tuple(r) for r in QUERIES["op13_fertility"](spark, DATA).select(*RULES).collect()), key=str) == plain_rules(docs)
