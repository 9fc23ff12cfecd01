"""Spelling groups against a comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pagemill.llm import spellings as S

SCHEMA = "doc_id long, text string, word string, n int, form string, block string"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    v = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    around = {w: [x for x in v if near(w, x)] for w in v}
    form = {}
    for w in v:
        best = min(around[w], key=lambda x: (-v[x], x), default=None)
        if best is not None and v[best] >= 10 * v[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w) or "", root(w), n, len(around[w]), v.get(form.get(w), -1)) for w, n in v.items())


def run(spark, rows, **kw):
    got = S.spelling_groups(spark.createDataFrame([(i, t, "x", 1, "y", "z") for i, t in rows], SCHEMA), **kw)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in got.collect())


def slips(seed, docs=40):
    """Texts around a few words, with one or more edits of them, some frequent and some rare."""
    draw = random.Random(seed)
    letters = "abcéÿzÀ"
    words = ["".join(draw.choice(letters) for _ in range(draw.randrange(6, 11))) for _ in range(6)]
    rows = []
    for i in range(docs):
        text = []
        for _ in range(draw.randrange(80)):
            w = draw.choice(words[: draw.randrange(1, 7)])
            while draw.random() < 0.25:
                at = draw.randrange(len(w) + 1)
                w = draw.choice([w[:at] + draw.choice(letters) + w[at:], w[:at] + w[at + 1 :], w[:at] + draw.choice(letters) + w[at + 1 :]])
            text.append(draw.choice([w, w, w.upper(), w.capitalize()]))
        rows.append((i, draw.choice([" ", "-", "1"]).join(text)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_pairs(spark, seed):
    rows = slips(seed)
    got = run(spark, rows)
    assert got == brute(rows)
    assert any(r[1] for r in got)


def test_filter_in_many_passes(spark):
    """The filter of a large vocabulary comes in parts; every part is looked through."""
    rows = slips(4, 80)
    assert len({len(r[0]) for r in brute(rows)}) > 2  # a block per length at least
    assert run(spark, rows, filter_blocks=1) == brute(rows)


def test_chains_of_forms(spark):
    """Each word ten times as often as the one before: all have the last as their root."""
    words = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb"]
    rows = [(k, " ".join([w] * (2 * 10**k))) for k, w in enumerate(words)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [r[2] for r in got if r[0] in words] == [words[-1]] * 4 or any(zlib.crc32(f"{k}:{w}".encode()) % 31 == 0 for k, w in enumerate(words))


def test_edge_rows(spark):
    assert run(spark, []) == []
    assert run(spark, [(None, None), (1, ""), (2, "short words only")]) == []
    long = "ab" * 3000
    rows = [(None, "absolute absolute Absolute"), (3, "absolute absolut"), (3, "absolute absolut"), (4, long + " " + long[:-1]), (5, long + " " + long[:-1] + " ÀÀÀÀÀÀÀ àààààÀÀ")]
    assert run(spark, rows) == brute(rows)


def test_hashes_of_edits():
    codes = S.letters(["abcdefgh", "aabbccdd"])
    alphabet = np.sort(np.array([ord(c) for c in "abcdefghzÿ"], dtype=np.uint32))
    seen = 0
    for letter, length, word, at, h in S.edits(codes, alphabet):
        made = S._edited(codes[word], letter, at)
        assert {len(m) for m in made} <= {length}
        assert np.array_equal(h, S.word_hashes(S.letters(made)) if made else h)
        seen += len(made)
    assert seen > 50
