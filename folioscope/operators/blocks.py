"""From typed page blocks to the parts of a Markdown document.

A document is a set of ordered rows, never one string, so that a book of any size stays divisible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ordered import running
from ..sources.tables import once

# Block types that are furniture of the page, and those whose picture is content.
FURNITURE = ["aside_text", "page_number", "header", "footer"]
FIGURES = ["image", "chart"]
MAX_DEPTH = 6


def all_blocks(block: DataFrame) -> DataFrame:
    return once(block, "slug", "ord")


def kept_blocks(blocks: DataFrame) -> DataFrame:
    """Without furniture and without margin notes that came as ordinary text."""
    note = T.is_margin_note(F.col("type"), F.col("text_level"), F.col("text"))
    return blocks.where(~F.coalesce(F.col("type").isin(FURNITURE), F.lit(False)) & ~note)


def margin_notes(blocks: DataFrame) -> DataFrame:
    return blocks.where(T.is_margin_note(F.col("type"), F.col("text_level"), F.col("text")))


def _title_key(title: Column) -> Column:
    return F.lower(T.stripped(title))


def heading_depths(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """slug, ord, title, depth of every heading: the outline's depth, else the number's, at most six."""
    known = outline.groupBy("slug", _title_key(F.col("title")).alias("key")).agg(F.max_by("depth", "ord").alias("known"))
    h = blocks.where("text_level is not null").select("slug", "ord", T.stripped(F.col("text")).alias("title"))
    h = h.withColumn("key", _title_key(F.col("title"))).join(known, ["slug", "key"], "left")
    return h.select("slug", "ord", "title", F.least(F.coalesce("known", T.numbering_depth(F.col("title"))), F.lit(MAX_DEPTH)).alias("depth"))


def page_turns(blocks: DataFrame) -> DataFrame:
    """slug, ord, page of each kept block whose page isn't that of the kept block before it."""
    k = running(kept_blocks(blocks).select("slug", "ord", "page"), ["slug"], ["ord"], {"before": ("prev", F.col("page"))})
    return k.where("before is null or page <> before").select("slug", "ord", "page")


def injected_headings(blocks: DataFrame, outline: DataFrame) -> DataFrame:
    """slug, ord, at, title, depth: outline entries of a page that begins at block ord and doesn't show them as a heading
    from there on; at is the entry's place in the outline."""
    entries = outline.select("slug", "page", F.col("ord").alias("at"), "title", _title_key(F.col("title")).alias("key"))
    due = page_turns(blocks).join(entries, ["slug", "page"])
    shown = blocks.where("text_level is not null").select("slug", "page", _title_key(F.col("text")).alias("key"), F.col("ord").alias("h"))
    missing = due.alias("d").join(shown.alias("s"), F.expr("d.slug = s.slug and d.page = s.page and d.key = s.key and s.h >= d.ord"), "left_anti")
    known = outline.groupBy("slug", _title_key(F.col("title")).alias("key")).agg(F.max_by("depth", "ord").alias("depth"))
    return missing.join(known, ["slug", "key"]).select("slug", "ord", "at", T.stripped(F.col("title")).alias("title"), F.least("depth", F.lit(MAX_DEPTH)).alias("depth"), "page")


def figure_names(blocks: DataFrame, sizes: DataFrame | None = None, least_bytes: int = 3072) -> DataFrame:
    """slug, img_path, name of each figure's file, named for its page and its number on that page.

    sizes (slug, img_path, bytes): figures smaller than least_bytes, or without a file, get no name.
    """
    f = blocks.where(F.col("type").isin(FIGURES) & (F.coalesce("img_path", F.lit("")) != "")).groupBy("slug", "img_path").agg(F.min(F.struct("ord", "page")).alias("p"))
    f = f.select("slug", "img_path", "p.ord", "p.page")
    if sizes is not None:
        f = f.join(sizes.where(F.col("bytes") >= least_bytes).select("slug", "img_path"), ["slug", "img_path"], "left_semi")
    number = F.row_number().over(Window.partitionBy("slug", "page").orderBy("ord"))
    return f.select("slug", "img_path", F.format_string("p%04d-fig%d%s", "page", number, F.regexp_extract("img_path", r"(\.[^./]+)$", 1)).alias("name"))


def rendered_blocks(blocks: DataFrame, outline: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """slug, ord, page, part: the Markdown of each kept block that has any."""
    k = kept_blocks(blocks).join(heading_depths(blocks, outline).select("slug", "ord", "depth"), ["slug", "ord"], "left")
    names = F.lit(None).cast("string")
    if figures is not None:
        k, names = k.join(figures, ["slug", "img_path"], "left"), F.col("name")
    path = F.coalesce(names, F.col("img_path"), F.lit(""))
    caption = T.caption_text(F.col("caption"))
    figure = F.when(path != "", F.concat(F.lit("!["), caption, F.lit("]("), path, F.lit(")"))).otherwise("")
    table = T.table_markdown(F.coalesce("table_body", F.lit("")))
    table = F.when(table == "", "").when(caption != "", F.concat(caption, F.lit("\n\n"), table)).otherwise(table)
    text = T.stripped(F.coalesce("text", F.lit("")))
    heading = (F.col("depth").isNotNull()) & (F.col("type") != "equation") & (text != "")
    text = F.when(heading, F.concat(F.repeat(F.lit("#"), F.col("depth")), F.lit(" "), text)).otherwise(text)
    part = F.when(F.col("type").isin(FIGURES), figure).when(F.col("type") == "table", table).otherwise(text)
    # through explode, which computes the part once, where the filter would compute it again
    return k.select("slug", "ord", "page", F.explode(F.array(T.without_controls(part))).alias("part")).where("part <> ''")


def page_spans(blocks: DataFrame, books: DataFrame) -> DataFrame:
    """slug, start, end: first and last page of what is kept of each book; 0 and 0 for a book without any."""
    s = kept_blocks(blocks).groupBy("slug").agg(F.min("page").alias("start"), F.max("page").alias("end"))
    return books.select("slug").distinct().join(s, "slug", "left").select("slug", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end"))
