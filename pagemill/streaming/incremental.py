"""The two operators with a natural incremental form. Every batch is a folder of its sink, named by batch id, so a batch
that runs again after a failure replaces what it wrote, and a reader never meets a table in the making."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from pagemill.operators.aggregates import class_counts

BATCH = "ingest_batch"
BUCKET = "key_bucket"
LEDGER = "_ingested_keys"  # readers of the sink pass over names that begin with an underscore


def _folder(spark: SparkSession, path: str):
    """A path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def file_stream(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New Parquet files below ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream, whether ``path`` is one file or a folder of part files."""
    schema = spark.read.parquet(path).schema
    where, files = _folder(spark, path)
    if files.getFileStatus(where).isDirectory():
        return file_stream(spark, path, schema)
    # a file stream watches folders: the file's folder, narrowed to its name
    return spark.readStream.schema(schema).option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def _noted(rows: DataFrame, key: str, buckets: int, ledger: str) -> None:
    """Write the keys of ``rows(key, ingest_batch)`` to their buckets; a batch replaces what it noted before."""
    keys = rows.select(key, BATCH).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).repartition(BUCKET, BATCH)
    keys.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, BATCH).parquet(ledger)


def known_keys(spark: SparkSession, ledger: str, key: StructField, buckets: list[int]) -> DataFrame:
    """``key, ingest_batch`` of the named buckets; folders of other buckets are not even listed."""
    where, files = _folder(spark, ledger)
    there = {f.getPath().getName() for f in files.listStatus(where)}
    paths = [f"{ledger}/{BUCKET}={b}" for b in buckets if f"{BUCKET}={b}" in there]
    schema = StructType([key, StructField(BUCKET, IntegerType()), StructField(BATCH, LongType())])
    found = spark.read.schema(schema).option("basePath", ledger).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return found.select(key.name, BATCH)


def ingest_stream(source: DataFrame, key: str, checkpoint: str, sink: str, buckets: int = 256) -> None:
    """Append every sample once; files seen in an earlier run are not read again.

    Runs over what is there now and ends. Keys that were ingested stand in a ledger below the sink, dealt to hash buckets; a batch reads
    only the buckets that its own keys fall into, never the sink, and no state grows with the stream. A batch that runs again reads
    the ledger of the batches before it and replaces its part of sink and ledger, wherever it stopped. A sink that has no ledger yet gets
    one from its rows. ``buckets`` is fixed for the life of a sink. Rows without a key count as one sample.
    """
    schema = StructType([*source.schema.fields]).add(BATCH, "long")
    ledger = f"{sink}/{LEDGER}"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        if number:
            where, files = _folder(spark, ledger)
            if not files.exists(where):
                _noted(spark.read.schema(schema).parquet(sink).where(F.col(BATCH) < number), key, buckets, ledger)
            touched = fresh.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias(BUCKET)).distinct()
            seen = known_keys(spark, ledger, source.schema[key], sorted(r[0] for r in touched.collect()))  # at most ``buckets`` numbers
            seen = seen.where(F.col(BATCH) < number).select(F.col(key).alias(LEDGER))
            fresh = fresh.join(seen, F.col(key).eqNullSafe(F.col(LEDGER)), "left_anti")
        fresh.write.mode("overwrite").parquet(f"{sink}/{BATCH}={number}")
        written = spark.read.schema(source.schema).parquet(f"{sink}/{BATCH}={number}")
        _noted(written.select(key, F.lit(number).cast("long").alias(BATCH)), key, buckets, ledger)

    source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start().awaitTermination()


def class_counts_stream(source: DataFrame, classes: int, checkpoint: str, sink: str, ignore: int = 255) -> None:
    """Running class counts of ``(pred, gt)`` rows; each batch writes the counts so far. Only they are state."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/{BATCH}={number}")

    query = (
        class_counts(source, classes, ignore).writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def latest_counts(spark: SparkSession, sink: str, classes: int) -> DataFrame:
    """The counts after the last batch, with zeros for classes not seen."""
    rows = spark.read.parquet(sink)
    last = rows.where(F.col(BATCH) == rows.agg(F.max(BATCH)).first()[0]).drop(BATCH)
    every = spark.range(classes).select(F.col("id").cast("int").alias("class"))
    return every.join(last, "class", "left").na.fill(0)
