"""A training corpus from ``documents`` in five stages, each of them one operator of ``pagemill.llm``.

Every stage gets the documents that its predecessor kept, and is written as Parquet and read again before the next one, so a
lost executor costs tasks of one stage only. All stages but the last return the columns of ``documents``.

- ``quality``: texts that the discriminant scores below 0.3 go; it learns from ``labels``.
- ``near_copies``: of each component of near copies (five-word shingles, similarity 0.8) the document with the smallest id stays, in one row per text.
- ``decontaminate``: texts of which a twentieth of the words repeats passages of ``benchmark`` go.
- ``mix``: sources are taken to their target weights; a document may come twice, once, in part, or not at all.
- ``shard``: rows get ``shard`` and ``slot`` along a Hilbert curve.

Cases: null and empty texts stay until the mix, which takes words and so leaves texts without words out; empty tables pass
through; further columns of ``documents`` are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm.common import table
from pagemill.llm.curve_shards import sharded_documents
from pagemill.llm.mixing import mixed_documents
from pagemill.llm.near_copies import one_of_each
from pagemill.llm.phrase_index import clean_documents
from pagemill.llm.quality import keep_good
from pagemill.session import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, width=5, similarity=(80, 100), repeats=False)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharded_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_copies", near_copies),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

# The scores of a fitted model and the hashes of the mix have no SQL form; tests hold every stage against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
