"""Arrivals as a stream: each event once, whatever is delivered again, in incremental batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_dir


def arrivals(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The stream with each key once as long as copies come no later than `late`; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def hourly(stream: DataFrame, at: str = "ts", late: str = "1 hour") -> DataFrame:
    """window_start, event_type, n, total of hourly windows that are complete."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def drained(spark: SparkSession, folder: str, pattern: str, key: str, at: str) -> DataFrame:
    """All arrivals in a folder of Parquet files, run through the stream once and read from its sink.

    The sink and the checkpoint lie in the shared folder, so that no executor's loss takes them.
    """
    base = f"{work_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    local = dict(stream.dtypes)[at] == "timestamp_ntz"  # event times must be instants
    stream = stream.withColumn(at, F.col(at).cast("timestamp"))
    query = arrivals(stream, key, at).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.parquet(f"{base}/out")
    return out.withColumn(at, F.col(at).cast("timestamp_ntz")) if local else out
