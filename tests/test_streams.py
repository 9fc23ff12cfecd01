"""Streams over tables that are one file or a folder of files."""

import pytest
from pyspark.sql import functions as F

from pagemill.operators import aggregates as ag
from pagemill.streaming import incremental as st


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_ingest(spark, tmp_path, layout):
    rows = spark.range(60).select("id", (F.col("id") % 7).alias("v"))
    path, inbox = f"{tmp_path}/all.parquet", f"{tmp_path}/inbox"
    rows.repartition(3).write.parquet(path)
    if layout == "file":
        rows.toPandas().to_parquet(f"{tmp_path}/one.parquet")
        path = f"{tmp_path}/one.parquet"
    assert st.table_stream(spark, path).schema.names == ["id", "v"]
    st.ingest_stream(st.table_stream(spark, path), "id", f"{tmp_path}/state", f"{tmp_path}/sink")
    assert spark.read.parquet(f"{tmp_path}/sink").count() == 60
    rows.where("id < 20").unionAll(rows.where("id < 20")).write.parquet(inbox)
    source = lambda: st.file_stream(spark, inbox, rows.schema)
    for expected, new in ((20, rows.where("id BETWEEN 10 AND 39")), (40, rows.where("id < 0")), (40, None)):
        st.ingest_stream(source(), "id", f"{tmp_path}/state2", f"{tmp_path}/sink2")
        got = spark.read.parquet(f"{tmp_path}/sink2")
        assert got.count() == expected == got.select("id").distinct().count()
        if new is not None:
            new.write.mode("append").parquet(inbox)


def batches(spark, folder, column="id"):
    return {r[st.BATCH]: r.ids for r in spark.read.parquet(folder).groupBy(st.BATCH).agg(F.sort_array(F.collect_list(column)).alias("ids")).collect()}


def test_ledger_buckets(spark, tmp_path):
    """A batch reads the ledger of its own buckets; a batch that stopped halfway replaces its part; an old sink gets a ledger."""
    inbox, sink, state = f"{tmp_path}/inbox", f"{tmp_path}/sink", f"{tmp_path}/state"
    rows = spark.range(400).select("id", (F.col("id") % 7).alias("key_bucket"))  # a column named as the ledger's own
    run = lambda: st.ingest_stream(st.file_stream(spark, inbox, rows.schema), "id", state, sink, 16)
    rows.where("id < 300").write.parquet(inbox)
    run()
    rows.where("id IN (5, 299, 350)").write.mode("append").parquet(inbox)
    run()
    assert {k: len(v) for k, v in batches(spark, sink).items()} == {0: 300, 1: 1}
    ledger = f"{sink}/{st.LEDGER}"
    some = st.known_keys(spark, ledger, rows.schema["id"], [3, 7, 99])
    assert {f.split(f"{st.BUCKET}=")[1].split("/")[0] for f in some.inputFiles()} == {"3", "7"}
    hashed = F.pmod(F.xxhash64("id"), F.lit(16))
    assert sorted(r.id for r in some.collect()) == sorted(r.id for r in rows.where((F.col("id") < 300) | (F.col("id") == 350)).where(hashed.isin(3, 7)).collect())
    # the second batch fails after its rows were written: its commit is missing, so it runs again
    for name in (f"{state}/commits/1", f"{state}/commits/.1.crc"):
        spark._jvm.java.io.File(name).delete()
    run()
    assert batches(spark, sink) == {0: list(range(300)), 1: [350]}
    assert spark.read.parquet(ledger).count() == 301


def test_ledger_of_an_old_sink(spark, tmp_path):
    """A sink without a ledger gets one; rows without a key are one sample."""
    inbox, sink, state = f"{tmp_path}/inbox", f"{tmp_path}/sink", f"{tmp_path}/state"
    schema = "id string, v int"
    run = lambda: st.ingest_stream(st.file_stream(spark, inbox, source.schema), "id", state, sink, 4)
    source = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], schema)
    source.write.parquet(inbox)
    run()
    fs = spark._jvm.org.apache.hadoop.fs.Path(f"{sink}/{st.LEDGER}")
    fs.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs, True)
    spark.createDataFrame([("a", 4), (None, 5), ("b", 6)], schema).write.mode("append").parquet(inbox)
    run()
    got = sorted((r.id or "", r[st.BATCH]) for r in spark.read.parquet(sink).collect())
    assert got == [("", 0), ("a", 0), ("b", 1)]


@pytest.mark.parametrize("layout", ["file", "folder"])
def test_running_counts(spark, tmp_path, layout):
    rows = spark.createDataFrame([(0, 0), (0, 2), (2, 2), (2, 255)], "pred int, gt int")
    path = f"{tmp_path}/rows.parquet"
    if layout == "folder":
        rows.repartition(2).write.parquet(path)
    else:
        rows.toPandas().to_parquet(path)
    stream = st.table_stream(spark, path).select(F.col("pred").cast("int"), F.col("gt").cast("int"))
    st.class_counts_stream(stream, 3, f"{tmp_path}/state", f"{tmp_path}/sink")
    got = {r["class"]: (r.p, r.t, r.tp) for r in st.latest_counts(spark, f"{tmp_path}/sink", 3).collect()}
    assert got == {0: (2, 1, 1), 1: (0, 0, 0), 2: (1, 2, 1)}  # class 1 is never seen
    assert len(ag.class_scores(st.latest_counts(spark, f"{tmp_path}/sink", 3)).collect()) == 3
