"""Hilbert order and shards: the curve against its defining properties, the cut against a plain sort, edge cases."""

import itertools
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.llm import curve_shards as C

SCHEMA = "doc_id long, text string, lang string, source string, shard int, size string"


@pytest.mark.parametrize("dims, bits", [(2, 1), (2, 4), (3, 3), (4, 2)])
def test_curve(spark, dims, bits):
    """Every cell once, neighbours on the curve are neighbours in space, and every sub-cube is one run."""
    cells = list(itertools.product(range(1 << bits), repeat=dims))
    rows = spark.createDataFrame(cells, ", ".join(f"c{k} int" for k in range(dims)))
    at = {tuple(r[:dims]): r[dims] for r in rows.select("*", C.hilbert_index([F.col(f"c{k}") for k in range(dims)], bits)).collect()}
    assert sorted(at.values()) == list(range(len(cells)))
    path = sorted(cells, key=at.get)
    assert all(sum(abs(a - b) for a, b in zip(p, q, strict=True)) == 1 for p, q in itertools.pairwise(path))
    for level in range(1, bits):
        cubes = [tuple(x >> level for x in p) for p in path]
        assert len(list(itertools.groupby(cubes))) == len(set(cubes))


def test_query_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = C.curve_shards(docs).collect()
    text = {r.doc_id: r.text for r in docs.collect()}
    n = len(text)
    assert sorted(r.doc_id for r in got) == sorted(text)
    for s in range(16):
        mine = [r for r in got if r.shard == s]
        assert abs(len(mine) - n / 16) < 1 and sorted(r.slot for r in mine) == list(range(len(mine)))
    for r in got:
        assert r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None
    assert sorted(map(str, got)) == sorted(map(str, C.curve_shards(docs.repartition(5)).collect()))


def test_order_is_the_curve(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", F.col("source").alias("_source"), F.col("lang").alias("_lang"), *C._measured(docs))
    h = {r.doc_id: (r._h, r.doc_id) for r in C._indexed(rows, C.BITS).collect()}
    want = sorted(h, key=h.get)
    got = sorted(C.curve_shards(docs).collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == want


def test_shards_prune(spark):
    """A filter on one value of each dimension meets few shards."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    told = C.curve_shards(docs, 64).select("doc_id", "shard").join(docs, "doc_id").withColumn("plain", F.col("doc_id") % 64)
    met = told.groupBy("source", "lang").agg(F.countDistinct("shard").alias("n"), F.countDistinct("plain").alias("plain")).agg(F.avg("n"), F.avg("plain")).first()
    assert met[0] < 0.25 * met[1]


def test_edges(spark, tmp_path):
    rows = [(1, "a", None, None, 5, "x"), (1, "a", None, None, 5, "x"), (2, None, "en", "s", 1, ""), (3, "", "en", "s", 1, ""), (None, "b" * 200_000, "de", "t", 0, "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = C.curve_shards(docs, 2).collect()
    assert sorted(r["size"] for r in got) == [1, 1, 2, 2, 200_001] and sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert {r.text_crc32 for r in got if r["size"] == 1} == {0}
    assert len({r.shard for r in C.curve_shards(docs, 16).collect()}) == 5
    wide = C.sharded_documents(docs, 2)
    assert wide.columns == ["doc_id", "text", "lang", "source", "size", "shard", "slot"] and wide.count() == 5
    C.write_shards(docs, f"file://{tmp_path}/out", 2)
    assert spark.read.parquet(f"file://{tmp_path}/out").groupBy("shard").count().count() == 2
    empty = spark.createDataFrame([], SCHEMA)
    assert C.curve_shards(empty).count() == 0 and C.sharded_documents(empty).count() == 0
