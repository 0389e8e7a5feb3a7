"""Tables on disk: chunks by book, the index, what is done already, and published snapshots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import catalogue

# What is published, and the suffixes and depths of source files.
PUBLISHED = ["extracted", "figures", "chunks", "index", "manifest.json"]
MATERIAL = ["pdf", "ipynb", "md", "py", "csv", "pt", "png"]
DEPTHS = [1, 2, 3, 4]


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Replaces the given books' chunks and leaves other books alone."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_slug").parquet(path)


def read_chunks(spark: SparkSession, path: str, slug: str | None = None) -> DataFrame:
    """All chunks, or one book's, of which only that partition is read."""
    c = spark.read.parquet(path)
    return c if slug is None else c.where(F.col("book_slug") == slug)


def listed_chunks(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """The chunks of the books that the manifest lists."""
    return chunks.join(manifest.select("book_slug").distinct(), "book_slug", "left_semi")


def document_meta(parts: DataFrame, figures: DataFrame, books: DataFrame) -> DataFrame:
    """slug, parts, chars, page_start, page_end, figures of each book's Markdown, whose parts are joined by empty lines.
    parts: slug, page, part; figures: slug; books: slug. A book without parts has zeros."""
    p = parts.groupBy("slug").agg(F.count("*").alias("parts"), F.sum(F.length("part")).alias("chars"), F.min("page").alias("page_start"), F.max("page").alias("page_end"))
    f = figures.groupBy("slug").agg(F.count("*").alias("figures"))
    m = books.select("slug").distinct().join(p, "slug", "left").join(f, "slug", "left").fillna(0, ["parts", "chars", "page_start", "page_end", "figures"])
    return m.withColumn("chars", F.col("chars") + F.greatest(F.lit(0), 2 * (F.col("parts") - 1)))


def write_documents(parts: DataFrame, meta: DataFrame, path: str) -> None:
    """Markdown and sidecars: each book's parts in order as text, a book a folder, an empty line after each part; and book_meta.

    Parts are sorted over the whole, so that a large book is several files in order, and none is one string.
    """
    lines = parts.select("slug", "ord", F.concat("part", F.lit("\n")).alias("value"))
    lines.repartitionByRange("slug", "ord").sortWithinPartitions("slug", "ord").select("slug", "value").write.mode("overwrite").partitionBy("slug").text(f"{path}/extracted")
    meta.write.mode("overwrite").parquet(f"{path}/book_meta")


def build_index(chunks: DataFrame, vectors: DataFrame, path: str, append: bool = False) -> tuple[int, int]:
    """Writes children (with vectors, text under the breadcrumb) and parents, sorted by id within files; returns their
    numbers. Without children nothing is written. vectors: id, vector. append: adds to what is there."""
    children, parents = chunks.where("not is_parent"), chunks.where("is_parent")
    counts = chunks.agg(F.count_if(~F.col("is_parent")).alias("c"), F.count_if("is_parent").alias("p")).first()
    if not counts["c"]:
        return 0, counts["p"]
    rows = children.withColumn("body", F.col("text")).withColumn("text", T.embedding_text(F.col("breadcrumb"), F.col("text")))
    rows = rows.join(vectors.withColumnRenamed("id", "chunk_id"), "chunk_id", "left")
    mode = "append" if append else "overwrite"
    parents.withColumnRenamed("text", "body").sortWithinPartitions("chunk_id").write.mode(mode).parquet(f"{path}/parents")
    rows.sortWithinPartitions("chunk_id").write.mode(mode).parquet(f"{path}/children")
    return counts["c"], counts["p"]


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(children, parents) of an index; None for a table that isn't there."""
    return tuple(spark.read.parquet(f"{path}/{name}") if _there(spark, f"{path}/{name}") else None for name in ("children", "parents"))


def fingerprint(settings: dict) -> str:
    """16 hex digits of the settings, in whatever order they are given."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest()[:16]


def undone(sources: DataFrame, done: DataFrame, settings: dict) -> DataFrame:
    """Sources (slug, sha256) without a done row (slug, stage_key) of the key that they have under these settings."""
    keyed = sources.withColumn("stage_key", T.stage_key(F.col("sha256"), F.lit(fingerprint(settings))))
    return keyed.join(done.select("slug", "stage_key").distinct(), ["slug", "stage_key"], "left_anti")


def publish(tables: dict[str, DataFrame], path: str, revision: str) -> DataFrame:
    """Writes each table under path/revision, then points to it; the pointer comes last, so a failure leaves the old one."""
    if not tables:
        raise ValueError("nothing to publish")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{revision}/{name}")
    spark = next(iter(tables.values())).sparkSession
    pointer = spark.createDataFrame([(revision,)], "revision string")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{path}/_pointer")
    return pointer


def recorded(spark: SparkSession, path: str) -> str | None:
    """The revision that a pointer names; None if there is none or it can't be read."""
    if not _there(spark, f"{path}/_pointer"):
        return None
    row = spark.read.schema("revision string").parquet(f"{path}/_pointer").first()
    return row["revision"] if row else None


def pull(spark: SparkSession, path: str, name: str, revision: str | None = None, to: str | None = None) -> DataFrame:
    """A published table: of the given revision, else the one recorded under `to` (what was pulled last), else the one that the
    publisher points to, else main. With `to` the table is stored there, and then the revision is recorded."""
    revision = revision or (to and recorded(spark, to)) or recorded(spark, path) or "main"
    df = spark.read.parquet(f"{path}/{revision}/{name}")
    if to is None:
        return df
    df.write.mode("overwrite").parquet(f"{to}/{name}")
    spark.createDataFrame([(revision,)], "revision string").coalesce(1).write.mode("overwrite").parquet(f"{to}/_pointer")
    return spark.read.parquet(f"{to}/{name}")


def publish_patterns(sources: bool = False) -> list[str]:
    """Patterns of the files that a snapshot has, with the source files if asked for."""
    out = [f"derived/{n}" if "." in n else f"derived/{n}/**" for n in PUBLISHED]
    return out + [f"courses/*/raw/{'*/' * d}*.{s}" for s in MATERIAL for d in DEPTHS] if sources else out


def manifest_json(chunks: DataFrame, path: str) -> None:
    """The manifest, one JSON row a book in the order of slugs."""
    catalogue.manifest(chunks).orderBy("book_slug").write.mode("overwrite").json(path)


MANIFEST = "book_slug string, chunks long, parents long, children long"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; empty if it isn't there, without rows that can't be read."""
    if not _there(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(path, mode="DROPMALFORMED").where("book_slug is not null")
