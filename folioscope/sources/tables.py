"""Readers of the engine's Parquet tables, each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once(df: DataFrame, *keys: str) -> DataFrame:
    """One row per key: redelivered rows have the same content, so any of them will do.

    Rows with a null in the key can't be addressed and are left out. Where there is a column loaded_at, the
    latest row is taken. Select the columns that are needed first: all of df's columns are shuffled.
    """
    df = df.where(" and ".join(f"`{k}` is not null" for k in keys))
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    loaded = "loaded_at" in df.columns
    best = F.max_by(row, F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp"))) if loaded else F.first(row)
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)
