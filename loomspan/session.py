"""The session, and tables that cut a plan's lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables, below the shared ``spark.checkpoint.dir``.

    Where no such folder is set, one in the machine's temporary folder is made
    and set on the context, but only in local mode: on a cluster each machine
    would write to a disk of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomspan-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/loomspan-{context.applicationId}"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here,
    and a lost executor costs no more than its unfinished tasks."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # Its shuffle files, which nothing reads any more, go once the driver's JVM knows that.
    spark.sparkContext._jvm.System.gc()
    settled = spark.read.schema(df.schema).parquet(path)
    settled.settled_at = path
    return settled


def settle_measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """``settle``, and aggregates of the rows that are taken while they are written."""
    seen = Observation()
    settled = settle(df.observe(seen, *[m.alias(n) for n, m in measures.items()]), label)
    return settled, seen.get


def discard(*tables: DataFrame) -> None:
    """Deletes what ``settle`` wrote for these tables, which nothing may read any more."""
    for df in tables:
        _delete(df.sparkSession, df.settled_at)


def release(spark: SparkSession) -> None:
    """Deletes this application's intermediate tables. Frames that were built on them can't be read after."""
    _delete(spark, scratch(spark))


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
