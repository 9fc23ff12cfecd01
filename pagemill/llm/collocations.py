"""Operator 12: phrase collocations by best-first branch and bound.

A phrase grows from its prefix, and prefix counts bound what can grow out of it: every phrase that starts with the words (w, x) scores at
most ``floor(SCALE * f(w x) / f(w))``, since neither the phrase nor its rest occurs more often than allowed by the prefix. Words
are the first frontier; their bound is SCALE each, so all words with ``LEAST`` occurrences are grown to pairs. Pairs are the second
frontier, expanded from the best bound down, in waves. A wave has a floor per language and expands

- the pairs whose bound reaches the floor, so that every longer phrase that scores the floor is known;
- the pairs that score the floor themselves, and all pairs (w, x) that lie before such a pair (x, y) and are frequent enough to
  hold half of its occurrences, so that it is known which of them lie inside a longer phrase.

Then all phrases that score the floor are settled. A language is done once ``top`` of them survive, ties at the last place included, or
its floor is 0; others get a lower floor. So longer phrases are counted under a small share of the pairs.

Counting: tasks turn words into numbers, count runs of them in bounded tables, and only sums are shuffled, by language and phrase, so a
language may hold all rows. A blocked Bloom filter of at most ``FILTER_BLOCKS`` blocks (16 MB, whatever the data) tells tasks which
prefixes are expanded; the false positives leave in an exact join. Counts are sums of longs, products decimals of 38 digits.

Cases: a null text has no words; a null language is ``und``, as is a language of that name; repeated rows count again; empty pieces have no words;
a text of any length is taken in slices, whose last words are carried on; equal scores go by a, then by the phrase's bytes; an empty
table gives an empty result; columns besides ``lang`` and ``text`` are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm import bloom
from pagemill.llm.common import ODD, byte_sums, mix, set_up, spans
from pagemill.session import forget, staged

LEAST, SHARE, SCALE, TOP = 10, 50, 1_000_000, 2000
FILTER_BLOCKS = 1 << 19
SLICE_BYTES = 1 << 20
ROWS_HELD = 1 << 20  # distinct phrases that a task holds, 32 MB at most
WORDS_HELD = 1 << 18  # distinct words that it holds, about 40 MB
BITS = 20  # of a word's number: those held and those of one more slice, which has fewer than SLICE_BYTES / 2 + 2
STEPS = 48  # scores that a floor is chosen from: three quarters, 9 / 16, ... of the pairs lie above
EDGE = b"\xff"  # a byte that no UTF-8 text has stands for the end of a piece
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_MARKS = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", EDGE * 10)  # fixed values: what ends a piece
NOTHING = np.zeros(0, dtype=np.int64)


def _mixed(words: list[np.ndarray], lang: np.uint64) -> np.ndarray:
    out = np.full(len(words[0]), lang)
    for h in words:
        out = mix(out * ODD + h)
    return out


def _hashed(words: list[bytes]) -> np.ndarray:
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)))
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    return spans(byte_sums(data), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends)


def phrase_hashes(langs: list[str], phrases: list[str]) -> np.ndarray:
    """Hash of every (language, phrase); all phrases have the same number of words."""
    codes, tongues = pd.factorize(np.array(langs, dtype=object))
    words = list(zip(*(p.encode("utf-8", "surrogatepass").split(b" ") for p in phrases), strict=True))
    known = _hashed([t.encode("utf-8", "surrogatepass") for t in tongues])
    out = np.zeros(len(phrases), dtype=np.uint64)
    parts = [_hashed(list(w)) for w in words]
    for k, h in enumerate(known):
        at = np.flatnonzero(codes == k)
        out[at] = _mixed([p[at] for p in parts], h)
    return out


class Runs:
    """Counts runs of ``width`` words in streams of texts, one stream per language. A run is one number, ``BITS`` bits a word."""

    def __init__(self, width: int, wanted: np.ndarray | None):
        self.width, self.wanted = width, wanted
        self.clear()

    def clear(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.numbers[EDGE]
        self.hashes = np.zeros(0, dtype=np.uint64)
        self.last: dict[str, np.ndarray] = {}  # what the next slice goes on from
        self.found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def _passes(self, words: list[np.ndarray], lang: str) -> np.ndarray:
        """Which runs of word numbers the filter lets through."""
        h = _mixed([self.hashes[w] for w in words], _hashed([lang.encode("utf-8", "surrogatepass")])[0])
        ok = np.zeros(len(h), dtype=bool)
        ok[bloom.probe(self.wanted, bloom.block_of(h, len(self.wanted)), h)] = True
        return ok

    def add(self, lang: str, data: bytes) -> None:
        """One more slice of the stream; it ends between two words."""
        tokens = data.translate(_LOWER).translate(_MARKS).replace(EDGE, b" " + EDGE + b" ").split()
        ids = np.fromiter(map(self.numbers.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        if self.wanted is not None and len(self.numbers) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, _hashed(list(islice(self.numbers, len(self.hashes), None)))])
        ids = np.concatenate([self.last.get(lang, NOTHING), ids])
        n = len(ids) - self.width + 1
        self.last[lang] = ids[max(0, n) :]
        if n < 1:
            return
        parts = [ids[k : k + n] for k in range(self.width)]
        rows = np.flatnonzero(np.logical_and.reduce([p != 0 for p in parts]))
        if self.wanted is not None and self.width == 2:  # both words of a pair have to be frequent
            words = np.unique(ids)
            frequent = np.zeros(len(self.numbers), dtype=bool)
            frequent[words] = self._passes([words], lang)
            rows = rows[frequent[parts[0][rows]] & frequent[parts[1][rows]]]
        elif self.wanted is not None:
            rows = rows[self._passes([p[rows] for p in parts[:-1]], lang)]
        code = parts[0][rows]
        for p in parts[1:]:
            code = (code << BITS) + p[rows]
        found = np.unique(code, return_counts=True)
        self.found.setdefault(lang, []).append(found)
        self.held += len(found[0])

    def full(self) -> bool:
        if self.held > ROWS_HELD:  # repeated runs of several slices first become one
            self.found = {lang: [self._summed(f)] for lang, f in self.found.items()}
            self.held = sum(len(f[0][0]) for f in self.found.values())
        return self.held > ROWS_HELD // 2 or len(self.numbers) > WORDS_HELD

    @staticmethod
    def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if len(found) == 1:
            return found[0]
        code, n = np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
        heads = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else NOTHING
        return code[heads], np.add.reduceat(n, heads) if len(code) else n

    def told(self) -> Iterator[pd.DataFrame]:
        """All counts as rows; the streams go on with what they carried."""
        words = np.array([w.decode("utf-8", "surrogatepass") for w in islice(self.numbers, 1, None)], dtype=object)
        for lang in list(self.found):
            codes, n = self._summed(self.found.pop(lang))
            for lo in range(0, len(codes), 1 << 14):
                part = codes[lo : lo + (1 << 14)]
                each = [words[(part >> BITS * k & (1 << BITS) - 1) - 1] for k in reversed(range(self.width))]
                phrases = each[0]
                for w in each[1:]:
                    phrases = phrases + " " + w
                yield pd.DataFrame({"lang": lang, "phrase": phrases, "f": n[lo : lo + (1 << 14)]})
        known, last = list(self.numbers), self.last
        self.clear()
        for lang, ids in last.items():
            self.last[lang] = np.array([self.numbers[known[i]] for i in ids.tolist()], dtype=np.int64)


def _cut(data: bytes) -> Iterator[bytes]:
    """Slices of about ``SLICE_BYTES`` that end behind a space, or where the text ends."""
    at = 0
    while len(data) - at > SLICE_BYTES:
        end = data.find(b" ", at + SLICE_BYTES)
        if end < 0:
            break
        yield data[at : end + 1]
        at = end + 1
    yield data[at:]


def _counted(width: int, wanted):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs = Runs(width, None if wanted is None else wanted.value)
        held: dict[str, list[bytes]] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b["lang"], b["text"], strict=True):
                data = text.encode("utf-8", "surrogatepass") + EDGE
                held.setdefault(lang, []).append(data)
                size += len(data)
                if size < SLICE_BYTES:
                    continue
                for name, parts in held.items():
                    for piece in _cut(b"".join(parts)):
                        runs.add(name, piece)
                        if runs.full():
                            yield from runs.told()
                held, size = {}, 0
        for name, parts in held.items():
            for piece in _cut(b"".join(parts)):
                runs.add(name, piece)
        yield from runs.told()

    return run


def counted(texts: DataFrame, width: int, prefixes: DataFrame | None = None, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """``lang, phrase, f``: runs of ``width`` words within pieces of ``texts`` (``lang, text``).

    With ``prefixes`` (``lang, phrase`` of one word less) some runs of other prefixes are left out and some are not; with
    width 2 the same holds for the second word.
    """
    wanted = None
    if prefixes is not None:
        blocks = max(1, min(filter_blocks, bloom.blocks_for(prefixes.count())))

        def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                if len(b):
                    h = phrase_hashes(b["lang"].tolist(), b["phrase"].tolist())
                    yield pd.DataFrame({"block": bloom.block_of(h, blocks), "hash": h.view(np.int64)})

        hashed = prefixes.select("lang", "phrase").mapInPandas(keys, "block long, hash long")
        wanted = texts.sparkSession.sparkContext.broadcast(bloom.build(hashed, 0, blocks)[:blocks])
    rows = texts.mapInPandas(_counted(width, wanted), "lang string, phrase string, f long")
    return rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _exact(*values: Column | int) -> Column:
    """Product in 38 digits."""
    parts = [F.lit(v).cast("decimal(7,0)") if isinstance(v, int) else v.cast("decimal(15,0)") for v in values]
    return reduce(lambda a, b: a * b, parts)


def _ratio(above: Column, below: Column) -> Column:
    """Whole part of a quotient of exact products."""
    return F.call_function("div", above.cast("decimal(38,0)"), below.cast("decimal(38,0)"))


def _scored(phrases: DataFrame, heads: list[DataFrame], width: int) -> DataFrame:
    """``lang, phrase, a, l, r, score`` at the lowest-scoring cut; ``heads[k - 1]`` counts runs of k words."""
    rows = phrases.withColumnRenamed("f", "a")
    cuts = []
    for k in range(1, width):
        first, rest = F.substring_index("phrase", " ", k), F.substring_index("phrase", " ", k - width)
        rows = rows.withColumn("_first", first).withColumn("_rest", rest)
        for side, part, n in (("l", "_first", k), ("r", "_rest", width - k)):
            known = heads[n - 1].select("lang", F.col("phrase").alias(part), F.col("f").alias(f"_{side}{k}"))
            rows = rows.join(known, ["lang", part])
        rows = rows.drop("_first", "_rest")
        score = _ratio(_exact(SCALE, F.col("a"), F.col("a")), _exact(F.col(f"_l{k}"), F.col(f"_r{k}")))
        cuts.append(F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"_l{k}").alias("l"), F.col(f"_r{k}").alias("r")))
    rows = rows.withColumn("_cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
    return rows.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")


def _word(k: int) -> Column:
    """The k-th word of a phrase, from 1."""
    return F.substring_index(F.substring_index("phrase", " ", k), " ", -1)


def _floors(pairs: DataFrame, langs: DataFrame, asked: int) -> DataFrame:
    """Per language of ``langs`` a score that about ``asked`` pairs reach; 0 where there are fewer. Any floor gives the same result."""
    share = pairs.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("score", F.array(*[F.lit(1 - 0.75**k) for k in range(1, STEPS)]), F.lit(10_000)).alias("_q"))
    k = F.floor(F.log(F.lit(asked) / F.col("_n")) / math.log(0.75)).cast("int")  # 0.75 ** k of the scores lie above step k
    floor = F.when(F.col("_n") <= asked, F.lit(0)).otherwise(F.element_at("_q", F.least(F.greatest(k, F.lit(1)), F.lit(STEPS - 1))))
    return share.join(langs, "lang", "left_semi").select("lang", floor.cast("long").alias("floor"))


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, filter_blocks: int = FILTER_BLOCKS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``top`` phrases of two and three words."""
    spark = set_up(docs.sparkSession)
    texts = docs.where("text IS NOT NULL").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    every = staged(counted(texts, 1), "words")
    totals = staged(every.groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    words = staged(every.where(F.col("f") >= least), "words")
    forget(every)
    pairs = staged(counted(texts, 2, words, filter_blocks).where(F.col("f") >= least), "pairs")
    scored = _scored(pairs, [words], 2)
    starts = words.select("lang", F.col("phrase").alias("_w"), F.col("f").alias("_n"))
    frontier = scored.withColumn("_w", _word(1)).join(starts, ["lang", "_w"]).withColumn("bound", _ratio(_exact(SCALE, F.col("a")), F.col("_n")))
    frontier = staged(frontier.select("lang", "phrase", "a", "l", "r", "score", "bound", F.col("_w").alias("w"), _word(2).alias("x")), "frontier")
    grown, opened, results = [], None, []
    open_langs, asked = totals.select("lang"), top
    while True:
        floors = staged(_floors(frontier, open_langs, asked), "floors")
        # languages are few against their phrases, but nothing bounds them: a plain join, which Spark may broadcast by size
        live = frontier.join(floors, "lang")
        strong = live.where("score >= floor")
        before = strong.select("lang", F.col("w").alias("x"), F.col("a").alias("_a")).groupBy("lang", "x").agg(F.min("_a").alias("_a"))
        wave = live.where("bound >= floor OR score >= floor").select("lang", "phrase")
        holders = live.join(before, ["lang", "x"]).where(100 * F.col("a") >= SHARE * F.col("_a")).select("lang", "phrase")
        wave = wave.unionByName(holders).distinct()
        if opened is not None:
            wave = wave.join(opened, ["lang", "phrase"], "left_anti")
        wave = staged(wave, "wave")
        found = counted(texts, 3, wave, filter_blocks).where(F.col("f") >= least)
        found = found.withColumn("_head", F.substring_index("phrase", " ", 2)).join(wave.withColumnRenamed("phrase", "_head"), ["lang", "_head"], "left_semi").drop("_head")
        grown.append(staged(_scored(found, [words, pairs], 3), "triples"))
        opened = wave if opened is None else staged(opened.unionByName(wave), "opened")
        triples = reduce(DataFrame.unionByName, grown)
        inside = F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2)))
        around = triples.select("lang", inside.alias("phrase"), F.col("a").alias("_longer")).groupBy("lang", "phrase").agg(F.max("_longer").alias("_longer"))
        kept = strong.join(around, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("_longer") < SHARE * F.col("a"), F.lit(True)))
        columns = ["lang", "phrase", "a", "l", "r", "score", "floor"]
        settled = kept.select(*columns).unionByName(triples.join(floors, "lang").where("score >= floor").select(*columns))
        settled = staged(settled, "settled")
        sizes = settled.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))
        done = staged(floors.join(sizes, "lang", "left").where((F.coalesce("_n", F.lit(0)) >= top) | (F.col("floor") == 0)).select("lang"), "done")
        results.append(settled.join(done, "lang", "left_semi").drop("floor"))
        open_langs = staged(floors.select("lang").join(done, "lang", "left_anti"), "open")
        if open_langs.isEmpty():
            break
        asked *= 4
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = reduce(DataFrame.unionByName, results).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
