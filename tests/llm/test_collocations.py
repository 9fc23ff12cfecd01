"""Phrases by best-first growth against plain counting of everything."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import bloom
from pagemill.llm import collocations as C

SCHEMA = "doc_id long, text string, lang string, phrase string, a long, _w string, floor int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, top, least):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    out = {}
    for (lang, *p), a in f.items():
        if len(p) > 1 and a >= least:
            cuts = [(1000000 * a * a // (f[lang, *p[:k]] * f[lang, *p[k:]]), k) for k in range(1, len(p))]
            longer = [m for (g, *q), m in f.items() if g == lang and len(q) == 3 > len(p) and m >= least and p in (q[:2], q[1:])]
            if not any(100 * m >= 50 * a for m in longer):
                score, k = min(cuts)
                out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, *p[:k]], f[lang, *p[k:]]))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def run(spark, rows, top, least):
    docs = spark.createDataFrame([(i, t, g, "x", 1, "y", 2) for i, (t, g) in enumerate(rows)], SCHEMA)
    got = C.collocations(docs, top=top, least=least)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in got.collect())


def prose(seed, n=60):
    draw = random.Random(seed)
    words = [f"W{k}" if k % 7 else f"é{k}" for k in range(14)]
    fixed = ["new york city", "w1 w2 w3 w4", "Ab Ab Ab"]
    texts = []
    for _ in range(n):
        parts = [draw.choice(fixed) if draw.random() < 0.3 else draw.choice(words) for _ in range(draw.randrange(40))]
        texts.append("".join(p + draw.choice([" ", " ", " ", "\t ", ". ", ",", "\r\n"]) for p in parts))
    return [(t, draw.choice(["en", "en", None, "und"])) for t in texts]


@pytest.mark.parametrize("seed, top", [(1, 3), (2, 1), (3, 40), (4, 2000)])
def test_against_all_counts(spark, seed, top):
    rows = prose(seed)
    assert run(spark, rows, top, 4) == brute(rows, top, 4)


def test_ties_and_lower_floors(spark):
    """Pairs that all lie inside triples, and a last place that many phrases share."""
    rows = [("a b c. d e f. g h i. j k. l m. n o. p q", "en")] * 5 + [("a b. x y", "en")]
    got = run(spark, rows, 4, 3)
    assert got == brute(rows, 4, 3)
    assert len(got) == 4


def test_one_language_has_all_rows(spark):
    rows = [("to be or not to be, that is", "en")] * 2000 + prose(5, 10)
    assert run(spark, rows, 50, 5) == brute(rows, 50, 5)


def test_edge_rows(spark):
    assert run(spark, [], 5, 1) == []
    assert run(spark, [(None, None), ("", "en"), (" ..,\n", "en"), ("one", "de")], 5, 1) == []
    rows = [(None, "en"), ("a\x0bb a b a b \x00 z", "und"), ("a b \x00 Z", None)]
    assert run(spark, rows, 5, 1) == brute(rows, 5, 1)


def test_slices_carry_their_last_words(monkeypatch):
    """One long text without any piece end, cut into many slices and flushed often."""
    draw = random.Random(8)
    text = " ".join(f"w{draw.randrange(12)}" for _ in range(3000))
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    monkeypatch.setattr(C, "ROWS_HELD", 100)
    want = Counter(zip(*(text.split()[k:] for k in range(3)), strict=False))
    runs, got = C.Runs(3, None), Counter()

    def flush():
        for b in runs.told():
            for p, n in zip(b["phrase"], b["f"], strict=True):
                got[p] += n

    for piece in C._cut(text.encode()):
        runs.add("en", piece)
        if runs.full():
            flush()
    flush()
    assert got == {" ".join(k): n for k, n in want.items()}


def test_a_small_filter_changes_nothing(spark):
    rows = prose(9)
    docs = spark.createDataFrame([(i, t, g, "x", 1, "y", 2) for i, (t, g) in enumerate(rows)], SCHEMA)
    assert sorted(tuple(r) for r in C.collocations(docs, top=20, least=4, filter_blocks=1).collect()) == brute(rows, 20, 4)


def test_exact_products_beyond_64_bits(spark):
    a, b = 3_000_000_000_000, 3_000_000_000_001
    df = spark.createDataFrame([(a, b)], "a long, b long")
    got = df.select(C._ratio(C._exact(C.SCALE, df.a, df.a), C._exact(df.b, df.b)).alias("x")).first()["x"]
    assert got == 1_000_000 * a * a // (b * b) == 999_999


def test_filter_has_all_keys(spark):
    h = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    blocks = bloom.blocks_for(len(h))
    keys = spark.createDataFrame([(int(k), int(v)) for k, v in zip(bloom.block_of(h, blocks), h.view(np.int64), strict=True)], "block long, hash long")
    made = bloom.build(keys, 0, blocks)
    assert len(bloom.probe(made, bloom.block_of(h, blocks), h)) == len(h)
    other = h + np.uint64(12345)
    assert len(bloom.probe(made, bloom.block_of(other, blocks), other)) < 40
    half = bloom.build(keys, 100, blocks - 100)
    assert np.array_equal(half[: blocks - 100], made[100:blocks])
