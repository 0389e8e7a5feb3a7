"""Readers of the files that a knowledge base is made of. Schemas are declared, never inferred."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ordered import running

#: Bytes of a file that are hashed at once, and of text lines that are numbered in one task.
HASHED_AT_ONCE, LINE_BUCKET = 1 << 20, 50_000_000
RAW_BLOCK = (
    "type string, page_idx int, text string, text_level string, img_path string, image_caption string, chart_caption string, table_caption string, table_body string"
)
INTAKE = "files array<struct<path:string,title:string,course:string,kind:string,topic:string,sha256:string>>"
CHUNK = (
    "chunk_id string, book_slug string, breadcrumb string, text string, page_start int, page_end int, parent_id string, is_parent boolean, tokens int, "
    "courses array<string>, source_tier int, content_types array<string>"
)
META = (
    "slug string, courses array<string>, titles array<string>, tier int, extraction_tier string, pages int, page_span array<int>, source_sha256 string, "
    "source_path string, stage_key string, tool string, figures int, chars int, warnings array<string>"
)


def _caption(name: str):
    """A caption as a converter writes it: text, or a JSON list of texts, which are joined."""
    raw = F.col(f"r.{name}")
    return F.nullif(F.trim(F.coalesce(F.array_join(F.from_json(raw, "array<string>"), " "), raw)), F.lit(""))


def _named(pattern: str) -> Column:
    """What pattern finds in a file's path, or in that of the folder of such a name that Spark has written it to."""
    return F.regexp_extract("_metadata.file_path", pattern, 1)


_SLUG = r"([^/=]+)_content_list\.json[l]?(?:/[^/]*)?$"


def _blocks(rows: DataFrame) -> DataFrame:
    """The columns of blocks, from slug, ord and r, a block as a converter writes it."""
    caption = F.coalesce(_caption("image_caption"), _caption("chart_caption"), _caption("table_caption"), F.lit(""))
    text = lambda c: F.coalesce(f"r.{c}", F.lit(""))
    return rows.select(
        "slug", "ord", F.coalesce("r.type", F.lit("text")).alias("type"), F.coalesce("r.page_idx", F.lit(0)).alias("page"), text("text").alias("text"),
        F.expr("try_cast(r.text_level as int)").alias("text_level"), text("img_path").alias("img_path"), F.when(caption.isin("[]", "None"), "").otherwise(caption).alias("caption"), text("table_body").alias("table_body"),
    )


def content_lists(spark: SparkSession, path: str) -> DataFrame:
    """Blocks (slug, ord, ...) of converter output, files named <slug>_content_list.json that hold one array each."""
    files = spark.read.text(path, wholetext=True).select(_named(_SLUG).alias("slug"), "value")
    return _blocks(files.select("slug", F.posexplode(F.from_json("value", f"array<struct<{RAW_BLOCK}>>")).alias("ord", "r")))


def block_lines(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of files of JSON lines named <slug>_content_list.jsonl, a block a line, for books too large for one array."""
    lines = _in_order(spark, path, _named(_SLUG).alias("slug")).where("trim(line) <> ''").select("slug", "seq", F.from_json("line", RAW_BLOCK).alias("r"))
    numbered = running(lines, ["slug"], ["seq"], {"n": ("sum", F.lit(1))}, LINE_BUCKET)
    return _blocks(numbered.withColumn("ord", (F.col("n") - 1).cast("int")))


def _in_order(spark: SparkSession, path: str, name: Column) -> DataFrame:
    """The name's column, seq, line of text files. seq rises within a file, with gaps: it is where a split of the file begins, in
    bytes, and the line's number in that split, of which there are no more than bytes before the next."""
    here = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")
    lines = spark.read.text(path).select(name, *here, F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    split = Window.partitionBy("_file", "_start")  # a split is what one task reads at most
    return lines.withColumn("seq", F.col("_start") + F.col("_id") - F.min("_id").over(split)).drop("_file", "_start", "_id")


def ledgers(spark: SparkSession, path: str) -> DataFrame:
    """course, ln, line of ledgers, one file a course, in a folder of the course's name."""
    return _in_order(spark, path, _named(r"([^/=]+)/[^/]+$").alias("course")).withColumnRenamed("seq", "ln")


def intake(spark: SparkSession, path: str) -> DataFrame:
    """The entries of intake records; a corrupt record has none."""
    return spark.read.schema(INTAKE).json(path, multiLine=True, mode="PERMISSIVE").select(F.inline("files"))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """Book metadata, one JSON file a book; files that can't be read are left out."""
    return spark.read.schema(META).json(path, multiLine=True, mode="DROPMALFORMED").where("slug is not null")


def chunk_lines(spark: SparkSession, path: str) -> DataFrame:
    """Chunks of JSON lines files, one file a book, with seq for their order in the file. Blank lines are left out."""
    lines = _in_order(spark, path, F.lit(0).alias("_")).where("trim(line) <> ''")
    return lines.select("seq", F.from_json("line", CHUNK).alias("c")).select("c.*", "seq")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path in batch["path"]:
            scheme, rest = path.split(":", 1)
            system, where = FileSystem.from_uri(f"{scheme}:{'//' * (not rest.startswith('//'))}{quote(rest)}")
            digest = hashlib.sha256()
            with system.open_input_stream(where) as stream:
                while part := stream.read(HASHED_AT_ONCE):
                    digest.update(part)
            out.append(digest.hexdigest())
        yield batch.assign(sha256=out)


def hashed_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, sha256, bytes of files. Only names are listed by Spark; each task streams its files in blocks, so none is held
    whole. Empty files have no row."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    names = f.select("path", F.col("length").alias("bytes"))
    return names.mapInPandas(_digests, "path string, bytes long, sha256 string").select("path", "sha256", "bytes")
