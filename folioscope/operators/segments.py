"""From document parts to pieces, sections, and content-addressed parent and child chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ordered import BUCKET, running
from ..session import written
from . import blocks as B

#: Tiers of books, whose sections are parents; other tiers gather sections into runs.
BOOK_TIERS = [1, 2]


def pieces(blocks: DataFrame, outline: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """slug, ord, sub, page, text, atomic: what may move but not be cut, in the order of (ord, sub).

    Parts split at empty lines; headings that only the outline has come before the block at which their page begins.
    """
    # headings, page turns and parts all read the unique blocks, which are written once, each row with what the branches need
    blocks = written(blocks.select("slug", "ord", "type", "page", "text", "text_level", "img_path", "caption", "table_body"))
    parts = B.rendered_blocks(blocks, outline, figures)
    p = parts.select("slug", "ord", "page", F.posexplode(F.split("part", r"\n{2,}")).alias("sub", "text"))
    i = B.injected_headings(blocks, outline)
    i = i.select("slug", "ord", "page", (F.col("at") - 1_000_000_000).cast("int").alias("sub"), F.concat(F.repeat(F.lit("#"), F.col("depth")), F.lit(" "), F.col("title")).alias("text"))
    both = p.unionByName(i).withColumn("text", T.stripped(F.col("text"))).where("text <> ''")
    atomic = T.is_atomic(F.col("text"))
    return both.select("slug", "ord", "sub", "page", F.when(atomic, F.col("text")).otherwise(T.without_scripts(F.col("text"))).alias("text"), atomic.alias("atomic"))


_HEADING = r"^(#{1,6})\s+([^\n]+?)\s*$"


def trails(headings: DataFrame, keys: tuple[str, ...] = ("slug",), number: str = "section_no") -> DataFrame:
    """keys, number, trail (array of titles) of every heading: the stack that results if a heading of depth d first
    cuts the stack to d - 1 entries and then goes on top. headings: keys, number (from 1), depth, title.

    The stack's height after the i-th heading is i + min(0, min over headings so far of depth - i).
    """
    k = list(keys)
    h = written(running(written(headings), k, [number], {"low": ("min", F.col("depth") - F.col(number))}))
    h = h.withColumn("level", (F.col(number) + F.least(F.lit(0), F.col("low"))).cast("int"))
    levels = range(1, B.MAX_DEPTH + 1)
    h = running(h, k, [number], {f"t{n}": ("last", F.when(F.col("level") == n, F.col("title"))) for n in levels})
    return h.select(*k, number, F.filter(F.array(*[F.when(F.col("level") >= n, F.col(f"t{n}")) for n in levels]), lambda t: t.isNotNull()).alias("trail"))


def sectioned(piece: DataFrame, titles: DataFrame) -> DataFrame:
    """The pieces that are no headings, with section_no (0 before the first heading) and breadcrumb. titles: slug, title."""
    title = F.regexp_extract("text", _HEADING, 2)
    p = piece.withColumn("is_heading", title != "").withColumn("head", F.when(title != "", title))
    # what several branches read is written once, or each of them would compute it again
    p = written(running(written(p), ["slug"], ["ord", "sub"], {"section_no": ("sum", F.col("is_heading").cast("long"))}))
    heads = p.where("is_heading").select("slug", "section_no", F.length(F.regexp_extract("text", _HEADING, 1)).alias("depth"), F.col("head").alias("title"))
    trail = trails(heads).join(titles.withColumnRenamed("title", "book_title"), "slug", "left")
    crumb = lambda t: F.array_join(F.filter(F.concat(F.array(F.col("book_title")), t), lambda x: x.isNotNull() & (x != "")), " > ")
    named = trail.select("slug", "section_no", crumb(F.col("trail")).alias("breadcrumb"))
    body = p.where("not is_heading").select("slug", "ord", "sub", "page", "text", "atomic", "section_no")
    body = body.join(named, ["slug", "section_no"], "left").join(titles.withColumnRenamed("title", "book_title"), "slug", "left")
    return body.withColumn("breadcrumb", F.coalesce("breadcrumb", "book_title", F.lit(""))).drop("book_title")


def sections(body: DataFrame) -> DataFrame:
    """slug, section_no, breadcrumb, pieces, page_start, page_end, tokens of every section with content."""
    s = body.groupBy("slug", "section_no").agg(
        F.first("breadcrumb").alias("breadcrumb"), F.count("*").alias("pieces"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.sum(F.length("text")).alias("chars")
    )
    tokens = F.greatest(F.lit(1), F.floor((F.col("chars") + 2 * (F.col("pieces") - 1)) / 4).cast("int"))
    return s.select("slug", "section_no", "breadcrumb", "pieces", "page_start", "page_end", tokens.alias("tokens"))


def _groups(columns: list[str], cost: str, budget: int, out: str):
    """A pass over rows sorted by key and order; columns _used and _group say with what the pass begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, group, used = None, 0, 0
        for batch in batches:
            numbers = []
            for row in zip(*[batch[k] for k in columns], batch["_used"], batch["_group"], batch[cost]):
                *own, used_in, group_in, c = row
                if own != key:
                    key, group, used = own, group_in, used_in
                if used and used + c > budget:
                    group, used = group + 1, 0
                used += c
                numbers.append(group)
            yield batch.drop(columns=[cost, "_used", "_group"]).assign(**{out: numbers})

    return run


def _carries(columns: list[str], cost: str, budget: int):
    """For each key and bucket: with what used and group numbers it ends, for each used cost that it may begin with."""

    def row(key, used, group) -> pd.DataFrame:
        return pd.DataFrame({**{k: [v] for k, v in zip(columns, key)}, "used": [used.tolist()], "groups": [group.tolist()]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used, group = None, None, None
        for batch in batches:
            for *own, c in zip(*[batch[k] for k in columns], batch[cost]):
                if own != key:
                    if key is not None:
                        yield row(key, used, group)
                    key, used, group = own, np.arange(budget + 1), np.zeros(budget + 1, np.int64)
                full = (used > 0) & (used + c > budget)
                group += full
                used = np.where(full, 0, used) + c
        if key is not None:
            yield row(key, used, group)

    return run


def _starts(columns: list[str], budget: int):
    """A pass over the buckets of each key in order: with what each begins."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, used, group = None, 0, 0
        for batch in batches:
            out = []
            for *own, bucket, ends, groups in zip(*[batch[k] for k in columns], batch["_b"], batch["used"], batch["groups"]):
                if own != key:
                    key, used, group = own, 0, 0
                out.append((*own, bucket, used, group))
                at = min(used, budget)  # a group over the budget is as full as one at it
                used, group = int(ends[at]), group + int(groups[at])
            yield pd.DataFrame(out, columns=[*columns, "_b", "_used", "_group"])

    return run


def packed(df: DataFrame, keys: list[str], order: list[str], cost: Column, budget: int, out: str, bucket: int = BUCKET) -> DataFrame:
    """df with out, the number (from 0) of the group that each row goes to: rows of a key go to a group in their order
    until the next one would exceed the budget; one that exceeds it alone stands alone. Costs are at least 1.

    keys and order name a row; only they and its cost go through the passes, and the number is joined back. Rows with
    a null among them are left out. The first column of order is a number, along which a key is cut into buckets. A
    key of several buckets is no single task: each bucket says with what it ends for every used cost that it may begin
    with, a pass over buckets chains these, and then each bucket is numbered by itself.
    """
    names = [*keys, *order]
    rows = df.select(*names, F.greatest(F.lit(1), cost).cast("long").alias("_cost")).where(" and ".join(f"`{c}` is not null" for c in names))
    rows = written(rows.withColumn("_b", F.floor(F.col(order[0]) / bucket)))
    types = dict(rows.dtypes)
    schema = lambda columns: ", ".join(f"`{c}` {types[c]}" for c in columns)
    at = [*keys, "_b"]
    split = rows.groupBy(*keys).agg(F.min("_b").alias("lo"), F.max("_b").alias("hi")).where("lo < hi").select(*keys)
    if split.isEmpty():
        rows = rows.withColumn("_used", F.lit(0)).withColumn("_group", F.lit(0))
    else:
        long = rows.join(split, keys, "left_semi").repartition(*at).sortWithinPartitions(*at, *order)
        ends = long.mapInPandas(_carries(at, "_cost", budget), schema(at) + ", used array<long>, groups array<long>")
        begins = ends.repartition(*keys).sortWithinPartitions(*at).mapInPandas(_starts(keys, budget), schema(at) + ", _used long, _group long")
        rows = rows.join(begins, at, "left").fillna(0, ["_used", "_group"])
    rows = rows.repartition(*at).sortWithinPartitions(*at, *order)
    numbered = rows.select(*at, *order, "_cost", "_used", "_group").mapInPandas(_groups(at, "_cost", budget, out), schema([*at, *order]) + f", `{out}` long")
    return df.join(numbered.drop("_b"), names).select(*[f"`{c}`" for c in df.columns], out)


def _made(body: DataFrame, keys: list[str], is_parent: bool) -> DataFrame:
    c = body.groupBy("slug", *keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "sub", "text"))), lambda x: x["text"]), "\n\n").alias("text"),
        F.min(F.struct("ord", "sub", "breadcrumb"))["breadcrumb"].alias("breadcrumb"),
        F.min("page").alias("page_start"),
        F.max("page").alias("page_end"),
        F.sort_array(F.collect_set(F.when(F.col("atomic"), "atomic").otherwise("prose"))).alias("content_types"),
        F.min(F.struct("ord", "sub")).alias("place"),
    )
    c = c.withColumn("chunk_id", T.content_id(F.col("slug"), F.lit(is_parent), F.col("page_start"), F.col("page_end"), F.col("text")))
    return c.withColumn("is_parent", F.lit(is_parent)).withColumn("tokens", T.token_estimate(F.col("text")))


_CHUNK = ["chunk_id", "slug", "place", "breadcrumb", "text", "page_start", "page_end", "parent_id", "is_parent", "tokens", "content_types"]


def _with_parents(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    c = children.join(parents.select("slug", *keys, F.col("chunk_id").alias("parent_id")), ["slug", *keys])
    return parents.withColumn("parent_id", F.lit("")).select(*_CHUNK).unionByName(c.select(*_CHUNK))


def section_chunks(body: DataFrame, child: int = T.CHILD_TOKENS, parent: int = T.PARENT_TOKENS) -> DataFrame:
    """Sections packed into parents, parents into children."""
    cost = T.token_estimate(F.col("text"))
    p = packed(body, ["slug", "section_no"], ["ord", "sub"], cost, parent, "parent_no")
    p = written(packed(p, ["slug", "section_no", "parent_no"], ["ord", "sub"], cost, child, "child_no"))
    keys = ["section_no", "parent_no"]
    return _with_parents(_made(p, [*keys, "child_no"], False), _made(p, keys, True), keys)


def run_chunks(body: DataFrame, child: int = T.CHILD_TOKENS, run: int = T.RUN_TOKENS) -> DataFrame:
    """Consecutive sections gathered into one parent; children stay within their section and keep its name."""
    runs = packed(sections(body), ["slug"], ["section_no"], F.col("tokens"), run, "run_no").select("slug", "section_no", "run_no")
    p = written(packed(body.join(runs, ["slug", "section_no"]), ["slug", "section_no"], ["ord", "sub"], T.token_estimate(F.col("text")), child, "child_no"))
    return _with_parents(_made(p, ["run_no", "section_no", "child_no"], False), _made(p, ["run_no"], True), ["run_no"])


def book_chunks(block: DataFrame, outline: DataFrame, book_meta: DataFrame) -> DataFrame:
    """The chunks of every book: those of books by section, those of other material by run."""
    meta = book_meta.groupBy("slug").agg(F.first(F.struct("titles", "tier", "courses")).alias("m")).select("slug", "m.*")
    body = sectioned(pieces(B.all_blocks(block), outline), meta.select("slug", F.get("titles", 0).alias("title")))
    body = written(body.join(meta.select("slug", "tier"), "slug"))
    books = F.col("tier").isin(BOOK_TIERS)
    chunks = section_chunks(body.where(books).drop("tier")).unionByName(run_chunks(body.where(~books).drop("tier")))
    tags = meta.select("slug", "courses", F.col("tier").alias("source_tier"))
    return chunks.join(tags, "slug").withColumnRenamed("slug", "book_slug")
