"""Repeated words and bytes against plain searches; the matchers against dictionaries; hot anchors; edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest

from pagemill.llm import automata, repeats, suffix_arrays
from pagemill.llm.common import LAST, words_of

SCHEMA = "doc_id long, text string, grp string, n_words string, anchors string"


def gone(units, ids, window):
    """Positions that a window of a smaller id covers, per row; ``units`` are lists or byte strings."""
    first = {}
    for i, u in zip(ids, units, strict=True):
        for s in range(len(u) - window + 1):
            w = tuple(u[s : s + window])
            first[w] = min(first.get(w, i), i)
    return [{p for s in range(len(u) - window + 1) if first[tuple(u[s : s + window])] < i for p in range(s, s + window)} for i, u in zip(ids, units, strict=True)]


def words(text):
    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]


def expected_words(rows, window):
    ids, u = [LAST if r[0] is None else r[0] for r in rows], [words(r[1]) for r in rows]
    return sorted(
        ((r[0], len(x), len(g), hashlib.sha256(" ".join(w for k, w in enumerate(x) if k not in g).encode()).hexdigest()) for r, x, g in zip(rows, u, gone(u, ids, window), strict=True)), key=str
    )


def expected_bytes(rows, window):
    ids, u = [LAST if r[0] is None else r[0] for r in rows], [(r[1] or "").encode() for r in rows]
    out = []
    for r, x, g in zip(rows, u, gone(u, ids, window), strict=True):
        out.append((r[0], len(x), len(g), sum(k - 1 not in g for k in g), hashlib.sha256(bytes(b for k, b in enumerate(x) if k not in g)).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=60):
    """Texts cut from a few passages, with edits, runs of one word, and odd spaces."""
    draw = random.Random(seed)
    vocabulary = ["the", "a", "é", "of", "x y", "longer", "word", "\U0001f600"]
    passages = [[draw.choice(vocabulary) for _ in range(40)] for _ in range(5)]
    rows = []
    for _ in range(n):
        t = []
        for _ in range(draw.randint(0, 4)):
            p = draw.choice(passages)
            a, b = sorted((draw.randrange(41), draw.randrange(41)))
            t += p[a:b] + [draw.choice(vocabulary) for _ in range(draw.randint(0, 6))] + ["a"] * draw.choice([0, 0, 0, 30])
        rows.append((draw.randrange(n // 2), "".join(w + draw.choice([" ", " ", "\n", " \t "]) for w in t), "", "", ""))
    return rows + [(5, None, "", "", ""), (6, "", "", "", ""), (7, " \n", "", "", ""), (None, rows[0][1], "", "", ""), rows[1], rows[1]]


@pytest.mark.parametrize("hot", [32, 2])
def test_words(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_GROUPS", hot)
    rows = rows_of(hot)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, automata.repeated_words(docs).collect()), key=str) == expected_words(rows, 13)


@pytest.mark.parametrize("hot", [32, 2])
def test_bytes(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT_GROUPS", hot)
    rows = rows_of(hot + 1)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, suffix_arrays.repeated_bytes(docs).collect()), key=str) == expected_bytes(rows, 50)


def test_real_texts(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, suffix_arrays.repeated_bytes(docs).collect()), key=str) == expected_bytes(rows, 50)


def test_texts_that_stay(spark):
    rows = [(1, "one two three four five"), (2, "zero one two three nine\nten"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.kept, r.n_removed) for r in automata.without_repeated_words(docs, 3, 2).collect()} == {1: (rows[0][1], 0), 2: ("zero nine ten", 3), 3: ("", 0)}
    got = {r.doc_id: (bytes(r.kept), r.spans) for r in suffix_arrays.without_repeated_bytes(docs, 10, 4).collect()}
    assert got == {1: (rows[0][1].encode(), []), 2: (b"zero nine\nten", [[5, 19]]), 3: (b"", [])}


def test_edges(spark):
    long = "w" * 300_000
    rows = [(1, long, "", "", ""), (2, long, "", "", ""), (3, "x " * 100_000, "", "", ""), (4, "x " * 50_000, "", "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.doc_id: r.n_removed for r in suffix_arrays.repeated_bytes(docs).collect()} == {1: 0, 2: 300_000, 3: 0, 4: 100_000}
    assert {r.doc_id: r.n_removed for r in automata.repeated_words(docs).collect()} == {1: 0, 2: 0, 3: 0, 4: 50_000}
    empty = spark.createDataFrame([], SCHEMA)
    assert suffix_arrays.repeated_bytes(empty).count() == 0 and automata.repeated_words(empty).count() == 0


def test_suffix_array():
    draw = random.Random(4)
    for _ in range(200):
        pieces = [bytes(draw.choice(b"ab\x00") for _ in range(draw.randint(1, 30))) for _ in range(draw.randint(1, 6))]
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        size = np.array([len(p) for p in pieces])
        stop = np.cumsum(size)
        start = stop - size
        end = np.repeat(stop, size)
        order = suffix_arrays.suffix_array(data, end, 64)
        strings = [data[i : end[i]].tobytes() for i in order]
        assert strings == sorted(strings)
        prefix = suffix_arrays.common_prefixes(data, start, stop, end, order, 1000)
        for k in range(1, len(strings)):
            a, b = strings[k - 1], strings[k]
            assert prefix[k] == next((n for n in range(min(len(a), len(b))) if a[n] != b[n]), min(len(a), len(b)))


@pytest.mark.parametrize("block", [1 << 20, 40])
def test_matchers(monkeypatch, block):
    """Both matchers tell the smallest document of every window, in one block or in many."""
    monkeypatch.setattr(suffix_arrays, "BLOCK_BYTES", block)
    draw = random.Random(block)
    for _ in range(100):
        texts = list({" ".join(draw.choice("ab") for _ in range(draw.randint(5, 14))) for _ in range(draw.randint(1, 8))})
        docs = [draw.randrange(100) for _ in texts]
        for match, split in ((suffix_arrays.matcher(9), lambda t: t.encode()), (automata.matcher(5), lambda t: t.split(" "))):
            window = 9 if match.__module__.endswith("arrays") else 5
            first = {}
            for t, d in zip(texts, docs, strict=True):
                u = split(t)
                for s in range(len(u) - window + 1):
                    w = tuple(u[s : s + window])
                    first[w] = min(first.get(w, d), d)
            got = match([t.encode() for t in texts], np.array(docs))
            for t, runs in zip(texts, got, strict=True):
                u = split(t)
                told = {s: d for a, b, d in runs for s in range(a, b)}
                assert told == {s: first[tuple(u[s : s + window])] for s in range(len(u) - window + 1)}


def test_words_are_split_as_told():
    for text in ["a b", "  a\tb\n", "", "é b c", "\x0b\x0c\r"]:
        w = words_of([text, None, "z"])
        assert [w.data[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)] == [*words(text), "z"]
        u = repeats.word_units([text, None, "z"], 2)
        assert u.data.tobytes().decode() == "".join(x + " " for x in [*words(text), "z"])


@pytest.mark.parametrize("merged", [500_000, 20])
def test_automata_in_blocks(spark, monkeypatch, merged):
    """Small automata answer as one large automaton would, within an anchor and over several."""
    monkeypatch.setattr(automata, "AUTOMATON_WORDS", 10)
    monkeypatch.setattr(automata, "MERGED_WORDS", merged)
    draw = random.Random(merged)
    for _ in range(100):
        texts = list({" ".join(draw.choice("ab") for _ in range(draw.randint(3, 14))) for _ in range(draw.randint(1, 12))})
        docs, anchors = [draw.randrange(100) for _ in texts], [draw.randrange(3) for _ in texts]
        for under in (anchors, None):
            first = {}
            for t, d, a in zip(texts, docs, under or [0] * len(texts), strict=True):
                u = t.split(" ")
                for s in range(len(u) - 4):
                    first[a, tuple(u[s : s + 5])] = min(first.get((a, tuple(u[s : s + 5])), d), d)
            got = automata.matcher(5)([t.encode() for t in texts], np.array(docs), None if under is None else np.array(under, dtype=np.uint32))
            for t, a, runs in zip(texts, under or [0] * len(texts), got, strict=True):
                u = t.split(" ")
                told = {s: d for lo, hi, d in runs for s in range(lo, hi)}
                assert set(told) == set(range(len(u) - 4))
                # pieces of other anchors may share the automaton and only add windows of their own
                assert all(min(f for (_, w), f in first.items() if w == tuple(u[s : s + 5])) <= d <= first[a, tuple(u[s : s + 5])] for s, d in told.items())
    rows = rows_of(merged)
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, automata.repeated_words(docs).collect()), key=str) == expected_words(rows, 13)


def test_two_documents_of_one_group_in_different_tasks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "LEAST", 1)  # all documents are one group
    rows = [(k, " ".join(f"word{w}" for w in range(40)), "", "", "") for k in (1, 2)]
    docs = spark.createDataFrame(rows[:1], SCHEMA).coalesce(1).union(spark.createDataFrame(rows[1:], SCHEMA).coalesce(1))
    assert docs.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, automata.repeated_words(docs).collect()), key=str) == expected_words(rows, 13)
    assert sorted(map(tuple, suffix_arrays.repeated_bytes(docs).collect()), key=str) == expected_bytes(rows, 50)
