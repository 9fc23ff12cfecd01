"""Operator 1: token counts through a digest cache.

A text is known by the digest of its normalised content (null counts as the empty text; nothing else is changed, since a
tokenizer may tell any two different texts apart), a tokenizer by the digest of its file and library version. The cache is a
Parquet table ``(digest, version, n_tokens)``. Documents join it by digest and version, only distinct misses are encoded, and
their counts are appended, so a later run over grown data encodes new texts only.

Cases: a null or empty text has 0 tokens; repeated texts are encoded once, with or without ``doc_id``; repeated rows stay repeated; an empty table gives
an empty result; columns besides ``doc_id`` and ``text`` are not read. Texts travel once, to the place where the misses are.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import known_ids, set_up, slices, texts
from pagemill.session import new_folder

CACHE_SCHEMA = "digest binary, version string, n_tokens long"
PIECES_KEPT = 100_000  # memory bound of a worker's memo of pieces, about 14 MB; it is emptied beyond
ENCODED = 2_000  # texts or pieces encoded at once; an encoding takes about 1 KB and more for long texts
_OPEN_SPACE = re.compile(r" (?=\s|\Z)")


def digest(text: Column | str = "text") -> Column:
    """Digest of the normalised content."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256))


def version_of(path: str) -> str:
    """Digest of a tokenizer: its file and the library that reads it."""
    import tokenizers

    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


class Counter:
    """Token counts of texts.

    A pre-token never reaches over a space that a visible character follows, so a text without other spaces is
    the sum of its space-led pieces. Pieces repeat a great deal and are encoded once per worker. Any other
    text, or a tokenizer with a normaliser or another pre-tokenizer, is encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of the library keep memory of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = self.tokenizer.normalizer is None and type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel"
        added = self.tokenizer.get_added_tokens_decoder().values()
        led = plain and not self.tokenizer.pre_tokenizer.add_prefix_space and self.tokenizer.pre_tokenizer.use_regex
        self.by_piece = led and all(not (a.lstrip or a.rstrip or a.single_word or " " in a.content) for a in added)
        self.pieces: dict[str, int] = {}

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        split: list[tuple[int, list[str]]] = []
        whole: list[int] = []
        for i, t in enumerate(texts):
            if not self.by_piece or _OPEN_SPACE.search(t):
                whole.append(i)
            else:
                head, *rest = t.split(" ")
                split.append((i, [head, *map(" ".__add__, rest)] if head else [*map(" ".__add__, rest)]))
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        new = list(set().union(*(p for _, p in split)).difference(self.pieces)) if split else []
        for at in range(0, len(new), ENCODED):
            self.pieces.update(zip(new[at : at + ENCODED], self.encode(new[at : at + ENCODED]), strict=True))
        for i, p in split:
            out[i] = sum(map(self.pieces.__getitem__, p))
        for i in whole:
            out[i] = self.encode([texts[i]])[0]
        return out


_counters: dict[str, Counter] = {}  # a Python worker serves many tasks


def _count(path: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _counters:
            _counters[path] = Counter(path)
        counter = _counters[path]
        done: set[bytes] = set()  # rows that repeat a document meet in one task
        for b in batches:
            b = b[[d not in done and not done.add(d) for d in b["digest"]]]
            column = [t or "" for t in b["text"]]
            counts = [n for lo, hi in slices(column, 1 << 18) for n in counter(column[lo:hi])]
            yield pd.DataFrame({"digest": b["digest"].tolist(), "n_tokens": np.array(counts, dtype=np.int64)})

    return run


def read_cache(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """Known counts of one tokenizer version, one row per digest; the folder is there from the first run on."""
    known = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("version") == version)
    return known.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def fill_cache(docs: DataFrame, path: str, cache: str) -> str:
    """Encode the distinct texts that the cache lacks and append their counts. Returns the tokenizer version."""
    spark = set_up(docs.sparkSession)
    version = version_of(path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    rows = known_ids(texts(docs)).withColumn("digest", digest())  # a text may stand in rows without doc_id only
    keyed = rows.select("doc_id", "digest")
    # one document stands for each missing digest, so texts are fetched once and copies are never gathered
    missing = keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).join(read_cache(spark, cache, version), "digest", "left_anti")
    fetched = rows.join(missing.hint("shuffle_hash"), ["doc_id", "digest"], "left_semi")
    counted = fetched.select("digest", "text").mapInPandas(_count(path), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    return version


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 512) -> DataFrame:
    """Per document: ``doc_id, n_bytes, n_tokens, over_limit``. ``cache`` is a folder that lasts between runs."""
    spark = set_up(docs.sparkSession)
    cache = cache or new_folder(spark, "token_cache")
    version = fill_cache(docs, path, cache)
    sizes = texts(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), digest().alias("digest"))
    out = sizes.join(read_cache(spark, cache, version), "digest", "left")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


__all__ = ["Counter", "digest", "fill_cache", "read_cache", "token_counts", "version_of"]
