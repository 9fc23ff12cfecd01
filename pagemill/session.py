"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


SPREAD = "spark.pagemill.spreadDocuments"  # number of parts to deal the texts out to; unset on a cluster


def prepare(spark: SparkSession) -> SparkSession:
    """Settings results depend on; call it once on a session of your own.

    Spark 4.1 may take a union for already partitioned by a key when both sides are, and then
    aggregate it without a shuffle. Under adaptive execution that was seen to leave a key
    in two partitions (a group came out twice), so unions must not claim a partitioning.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    # many operators join a summary back by its group; Spark has to split such joins where one group is large
    for name in ("enabled", "skewJoin.enabled", "forceOptimizeSkewedJoin"):
        spark.conf.set(f"spark.sql.adaptive.{name}", "true")
    return spark


def local_session(cores: int | str = "*", name: str = "pagemill", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores if cores != "*" else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.session.timeZone": "UTC",
        SPREAD: str(cores if cores != "*" else 8),
        "spark.driver.memory": "12g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_dir(spark: SparkSession) -> str:
    """Folder for staged tables: the checkpoint folder the session names.

    Only a local master may fall back on a temporary folder; on a cluster every
    executor has to see the folder, so a missing setting is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    made = tempfile.mkdtemp(prefix="pagemill-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below one folder per application, so a finished job is cleared as a whole."""
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the plan for loops, keeps the rows when executors are lost, and leaves a
    columnar table with known size, so later joins choose on real statistics.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more, such as the last round of a loop once the next one is written.

    A frame that is not itself a staged table is left alone.
    """
    if not hasattr(df, "_staged_at"):
        return
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
