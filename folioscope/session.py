"""Session helpers: a local session for tests and benches, and cutting of lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether an execution's shuffle files go when it ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cores: int | str = 8, memory: str = "8g", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benches. On a cluster the submitter's own session is used instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir where the cluster names one.

    Only where it is unset and everything runs on one machine, as in tests, a temporary folder is made;
    on a cluster its lack is an error, as each executor would write to a disk of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    made = os.environ.get("FOLIOSCOPE_SHARED") or tempfile.mkdtemp(prefix="folioscope-")
    os.environ["FOLIOSCOPE_SHARED"] = made
    return f"file://{made}"


def work_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; it goes when the application ends."""
    base = f"{shared_dir(spark)}/folioscope-{spark.sparkContext.applicationId}"
    path, fs = _folder(spark, base)
    if not fs.exists(path):
        fs.mkdirs(path)
        fs.deleteOnExit(path)
    return base


def _folder(spark: SparkSession, base: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def release(spark: SparkSession) -> None:
    """Deletes what the application has written so far; results that still read it must be stored before."""
    path, fs = _folder(spark, work_dir(spark))
    fs.delete(path, True)


def written(df: DataFrame) -> DataFrame:
    """df, written once as a Parquet table in the shared folder and read again.

    Later reads don't depend on executors that may be lost, and only fetch the columns they use. The
    shuffles that made the table go at once; the table goes with `release`, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
