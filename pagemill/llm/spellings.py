"""Operator 11: spelling variants by Bloom-guided neighbourhoods.

The vocabulary is counted in the tasks and summed by word. Blocked Bloom filters, sharded by word length, are built over it and
broadcast. Every word's edits (one code point deleted, or replaced by a greater one of the vocabulary's own letters) are
hashed by difference from the word's hash and probed; an inserted code point is a deletion seen from the other word, a replacement by a
smaller one a replacement seen from there, so every near pair is generated once. Only edits that the filters let through become rows and
meet the vocabulary in an equi-join, which removes the false positives.

The broadcast is at most ``FILTER_BLOCKS`` blocks (16 MB), whatever the vocabulary: one that needs more is gone through in several
passes, each with the next blocks of the filter. Forms are followed to their roots by pointer doubling; n grows tenfold with every form, so
a chain has fewer than 20 links.

Cases: a null or empty text has no runs; a null ``doc_id`` stands as the empty string in the hash; rows that repeat a document count
again; equal n go to the smaller word; a very long run is one word; an empty table gives an empty result; columns
besides ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import bloom
from pagemill.llm.common import ODD, mix, parts, powers, seeds, set_up
from pagemill.session import forget, staged

LEAST_LETTERS = 7
LEAST_N = 2
FACTOR = 10
SLIPS = 31
FILTER_BLOCKS = 1 << 19  # 16 MB of filter broadcast at a time
SHARDS = 64  # words of this length and more share one shard; their hashes tell the length
WORDS_HELD = 200_000
CELLS = 1 << 17  # letters of words that are edited at once
WORDS_AT_ONCE = 1 << 15
WORDS_A_TASK = 1 << 16
_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word counts of a task's texts, handed on whenever ``WORDS_HELD`` words are held."""

    def told(n: dict[str, int]) -> pd.DataFrame:
        return pd.DataFrame({"word": list(n), "n": np.fromiter(n.values(), dtype=np.int64, count=len(n))})

    held: Counter[str] = Counter()
    for b in batches:
        for doc, text in zip(b["doc"], b["text"], strict=True):
            start = zlib.crc32(f"{doc}:".encode())
            for run, n in Counter(_RUN.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass"))).items():
                h = zlib.crc32(run.encode(), start)
                if h % SLIPS == 0:
                    at = h % len(run)
                    run = run[:at] + run[at + 1 :]
                    if len(run) < LEAST_LETTERS:
                        continue
                held[run] += n
            if len(held) > WORDS_HELD:
                yield told(held)
                held.clear()
    if held:
        yield told(held)


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: words with at least ``LEAST_N`` occurrences."""
    rows = docs.where("text IS NOT NULL").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_N)


def letters(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).reshape(len(words), -1)


def values(codes: np.ndarray) -> np.ndarray:
    return mix(codes.astype(np.uint64) * ODD)


def finish(sums: np.ndarray, length: int) -> np.ndarray:
    return mix(sums + seeds(length, 11)[-1])


def word_hashes(codes: np.ndarray) -> np.ndarray:
    up, _ = powers(codes.shape[1] + 1)
    return finish((values(codes) * up[: codes.shape[1]]).sum(axis=1, dtype=np.uint64), codes.shape[1])


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """Words of one length at a time, in chunks of about ``CELLS`` letters: the length and places in ``words``."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    order = np.argsort(sizes, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(part):
            step = max(1, CELLS // int(sizes[part[0]]))
            for lo in range(0, len(part), step):
                yield int(sizes[part[0]]), part[lo : lo + step]


def gathered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches joined to tables of some ``WORDS_AT_ONCE`` words or 4 ``CELLS`` letters, so that numpy works on long arrays."""
    held, n, size = [], 0, 0
    for b in batches:
        held.append(b)
        n += len(b)
        size += int(b["word"].str.len().sum())
        if n >= WORDS_AT_ONCE or size >= 4 * CELLS:
            yield pd.concat(held, ignore_index=True)
            held, n, size = [], 0, 0
    if n:
        yield pd.concat(held, ignore_index=True)


Shards = dict[int, tuple[int, int]]  # by length: first block and number of blocks


def shards_of(counts: dict[int, int]) -> tuple[Shards, int]:
    """Where each length's blocks lie, and how many blocks there are."""
    out, total = {}, 0
    for length, n in sorted(counts.items()):
        out[length] = (total, bloom.blocks_for(n))
        total += out[length][1]
    return out, total


def _keys(shards: Shards):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words = b["word"].tolist()
            for length, part in by_length(words):
                h = word_hashes(letters([words[i] for i in part]))
                first, n = shards[min(length, SHARDS)]
                yield pd.DataFrame({"block": first + bloom.block_of(h, n), "hash": h.view(np.int64)})

    return run


def edits(codes: np.ndarray, alphabet: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Edits of words of one length: ``(letter or -1 for a deletion, new length, word places, letter places, hashes)``."""
    length = codes.shape[1]
    up, down = powers(length + 1)
    each = values(codes) * up[:length]
    sums = np.cumsum(each, axis=1, dtype=np.uint64)
    whole = sums[:, -1:]
    if length > LEAST_LETTERS:
        fresh = np.ones(codes.shape, dtype=bool)  # of equal letters in a row the first one stands for all
        fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
        word, at = np.nonzero(fresh)
        h = sums[word, at] - each[word, at] + (whole[word, 0] - sums[word, at]) * down[1]
        yield -1, length - 1, word, at, finish(h, length - 1)
    for letter, value in zip(alphabet.tolist(), values(alphabet), strict=True):
        word, at = np.nonzero(codes < letter)
        h = whole[word, 0] - each[word, at] + value * up[at]
        yield letter, length, word, at, finish(h, length)


def _edited(codes: np.ndarray, letter: int, at: np.ndarray) -> list[str]:
    n, length = codes.shape
    if letter < 0:
        out = codes[np.arange(length) != at[:, None]].reshape(n, length - 1)
    else:
        out = codes.copy()
        out[np.arange(n), at] = letter
    return np.ascontiguousarray(out).view(f"<U{out.shape[1]}").ravel().tolist()


def _positives(table, shards: Shards, first: int, blocks: int, alphabet: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in gathered(batches):
            words, ns = b["word"].tolist(), b["n"].to_numpy()
            for _, part in by_length(words):
                codes = letters([words[i] for i in part])
                for letter, length, word, at, h in edits(codes, alphabet):
                    if min(length, SHARDS) not in shards:
                        continue
                    base, n = shards[min(length, SHARDS)]
                    block = base + bloom.block_of(h, n) - first
                    if first or first + blocks < base + n:  # this pass has some of the blocks only
                        inside = np.flatnonzero((block >= 0) & (block < blocks))
                        word, at, h, block = word[inside], at[inside], h[inside], block[inside]
                    hit = bloom.probe(table.value, block, h)
                    if len(hit):
                        source = part[word[hit]]
                        yield pd.DataFrame({"edit": _edited(codes[word[hit]], letter, at[hit]), "word": [words[i] for i in source], "n": ns[source]})

    return run


def near_pairs(words: DataFrame, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """``word, n, near, near_n`` of every two words of ``words`` (``word, n``) that differ by one edit, once for each of the two."""
    spark = words.sparkSession
    counts = {r["k"]: r["n"] for r in words.groupBy(F.least(F.length("word"), F.lit(SHARDS)).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most SHARDS rows
    shards, total = shards_of(counts)
    # the class of letters has 90 code points
    alphabet = np.sort(np.array([ord(r["c"]) for r in words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").distinct().collect()], dtype=np.uint32))
    keys = staged(words.mapInPandas(_keys(shards), "block long, hash long"), "keys")
    found = []
    for first in range(0, total, filter_blocks):
        blocks = min(filter_blocks, total - first)
        table = spark.sparkContext.broadcast(bloom.build(keys, first, blocks))
        found.append(staged(words.mapInPandas(_positives(table, shards, first, blocks, alphabet), "edit string, word string, n long"), "edits"))
        table.unpersist()
    forget(keys)
    schema = "word string, n long, near string, near_n long"
    if not found:
        return spark.createDataFrame([], schema)
    exact = words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = reduce(DataFrame.unionByName, found).join(exact, "edit")
    there = F.struct("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    back = F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.inline(F.array(there, back)))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the last of the forms that follow each ``word`` of ``forms`` (``word, form``)."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("_then"))
        step = staged(now.join(then, "root", "left").select("word", F.coalesce("_then", "root").alias("root"), F.col("_then").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").isEmpty()
        forget(now)
        now = step.select("word", "root")
        now._staged_at = step._staged_at
        if moved:
            return now


def spelling_groups(docs: DataFrame, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the vocabulary."""
    set_up(docs.sparkSession)
    counted = staged(vocabulary(docs), "words")
    # few bytes, but much work each: Spark's own parts by bytes would leave a handful of long tasks
    words = staged(counted.repartition(max(parts(counted.sparkSession), counted.count() // WORDS_A_TASK + 1), "word"), "words")
    forget(counted)
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best")
    near = near_pairs(words, filter_blocks).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    fits = -F.col("best.n") >= FACTOR * F.col("n")
    near = staged(near.select("word", "n_near", F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.n")).alias("form_n")), "near")
    out = words.join(near, "word", "left").join(roots(near.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
