"""Problem 6: lines repeated within one source, by suffix arrays over line identifiers.

A source's documents (a book's blocks) are sequences of line identifiers. Equal suffixes are counted
before anything else, so that a notice that a third of all documents carry is one row; the distinct
suffixes are then sorted, each source's in shards by their first two lines, which keeps every
interval of two or more common lines in one shard. A pass over a sorted shard holds the common prefix
with the row before and the number of documents of each prefix length, and gives every block of lines
that enough documents have and that no longer prefix has as many documents of. Counts of single lines
are summed over the shards.

A pass follows suffixes for DEPTH lines. Blocks that are as long as that go on in another batch: their
places' next lines are the suffixes there, under a name for the lines before, and each batch is twice
as deep as the last, until no block goes on. So a repeated block has no greatest length. Of a block
whose places all have the same line before them only the longer one goes on, so a long notice is
followed from its first line and not from each of its lines.

Lines are compared trimmed, in lower case, with runs of white space as one space and of digits as
one 0. Empty lines don't count and end no block: they are skipped. Rows with a null source, number or
text are left out; a document that comes twice counts once; a line that a document has twice counts
once for it. Nothing is removed from texts of a null source, null texts stay null.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import once

LEAST, DEPTH, SHARDS = 6, 16, 16


def line_text(line: Column) -> Column:
    """A line as it is compared."""
    text = F.regexp_replace(F.regexp_replace(F.lower(line), r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")
    return F.regexp_replace(text, r"(?U)\d+", "0")


def line_key(line: Column) -> Column:
    """The 64-bit identifier of a line as it is compared; null for an empty line."""
    text = line_text(line)
    return F.when(text != "", F.xxhash64(text))


def line_keys(text: Column) -> Column:
    return F.transform(F.split(text, "\n", -1), line_key)


def _suffixes(depth: int):
    """source, path, suffix, seen: seen is the longest prefix of the suffix that begins at an earlier place of
    the same document, for which the document is counted already. Rows are documents; starts: their places, null for all."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for source, path, ids, starts in zip(batch["source"], batch["path"], batch["ids"], batch["starts"]):
                ids = ids.tolist()
                starts = range(len(ids)) if starts is None else starts.tolist()
                once_each = len(starts) == 1 or len({ids[k] for k in starts}) == len(starts)
                before: set[tuple] = set()
                for k in starts:
                    suffix, seen = ids[k : k + depth], 0
                    if not once_each:
                        while seen < len(suffix) and tuple(suffix[: seen + 1]) in before:
                            seen += 1
                        before.update(tuple(suffix[:d]) for d in range(seen + 1, len(suffix) + 1))
                    if seen < len(suffix):
                        out.append((source, path, suffix, seen))
            yield pd.DataFrame(out, columns=["source", "path", "suffix", "seen"])

    return run


def _intervals(least: int, depth: int):
    """A pass over suffixes sorted by source, path and suffix. Single lines come with their counts so far, as they go over shards."""

    def closed(key, last, counts, longer, down_to):
        for d in range(len(last), down_to, -1):
            if d == 1 or (counts[d] >= least and counts[d] > longer[d]):
                yield *key, last[:d], counts[d]
            longer[d - 1] = max(longer[d - 1], counts[d])
            counts[d] = longer[d] = 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last, counts, longer = None, [], [0] * (depth + 1), [0] * (depth + 1)
        for batch in batches:
            out = []
            for source, path, suffix, seen, n in zip(batch["source"], batch["path"], batch["suffix"], batch["seen"], batch["n"]):
                suffix, common = suffix.tolist(), 0
                if (source, path) == key:
                    while common < min(len(last), len(suffix)) and last[common] == suffix[common]:
                        common += 1
                out += closed(key, last, counts, longer, common)
                for d in range(seen + 1, len(suffix) + 1):
                    counts[d] += n
                key, last = (source, path), suffix
            yield pd.DataFrame(out, columns=["source", "path", "lines", "documents"])
        yield pd.DataFrame(list(closed(key, last, counts, longer, 0)), columns=["source", "path", "lines", "documents"])

    return run


def _batch(places: DataFrame, least: int, depth: int, shards: int) -> DataFrame:
    """source, path, lines, documents of the blocks of up to depth lines at the places (source, path, ids, starts)."""
    suffixes = places.mapInPandas(_suffixes(depth), "source string, path long, suffix array<long>, seen int")
    counted = suffixes.groupBy("source", "path", "suffix", "seen").agg(F.count("*").alias("n"))
    second = F.when(F.size("suffix") > 1, F.element_at("suffix", 2)).otherwise(0)
    sharded = counted.withColumn("shard", F.pmod(F.xxhash64(second), F.lit(shards)))
    in_order = sharded.repartition("source", "path", F.element_at("suffix", 1), "shard").sortWithinPartitions("source", "path", "suffix")
    blocks = in_order.select("source", "path", "suffix", "seen", "n").mapInPandas(_intervals(least, depth), "source string, path long, lines array<long>, documents long")
    return blocks.groupBy("source", "path", "lines").agg(F.sum("documents").alias("documents")).where(F.col("documents") >= least)


def _keyed(documents: DataFrame, *columns: str) -> DataFrame:
    return documents.where("source is not null and text is not null").select("source", *columns, line_keys(F.col("text")).alias("keys"))


def _identified(keyed: DataFrame) -> DataFrame:
    return keyed.select("source", F.filter("keys", lambda x: x.isNotNull()).alias("ids")).where("size(ids) > 0")


def _all_places(ids: DataFrame) -> DataFrame:
    return ids.select("source", F.lit(0).cast("long").alias("path"), "ids", F.lit(None).cast("array<int>").alias("starts"))


def _most(occurrences: DataFrame, side: str, keys: list[str]) -> DataFrame:
    """keys, most_<side>: of how many documents the commonest line on that side of each block is."""
    n = occurrences.where(F.col(side).isNotNull()).groupBy(*keys, side).agg(F.count_distinct("doc").alias("n"))
    return n.groupBy(*keys).agg(F.max("n").alias(f"most_{side}"))


def repeated_blocks(documents: DataFrame, least: int = LEAST, depth: int = DEPTH, shards: int = SHARDS) -> DataFrame:
    """source, lines (identifiers), documents: of each source the maximal blocks of lines that at least `least` of its
    documents have: a line more on either side, and they are in fewer. documents: source, text, one row each."""
    ids = written(_identified(_keyed(documents)).withColumn("doc", F.monotonically_increasing_id()))
    blocks = written(_batch(_all_places(ids), least, depth, shards))
    longer = blocks.where("size(lines) > 1")
    # single lines have been counted over shards, and haven't met their longer blocks yet
    head = longer.select("source", F.element_at("lines", 1).alias("head"), "documents").distinct()
    single = blocks.where("size(lines) = 1").withColumn("head", F.element_at("lines", 1)).join(head, ["source", "head", "documents"], "left_anti").drop("head")
    tails = longer.select("source", F.slice("lines", F.lit(2), F.size("lines") - 1).alias("lines"), "documents").distinct()
    found = single.unionByName(longer.where(F.size("lines") < depth)).join(tails, ["source", "lines", "documents"], "left_anti").select("source", "lines", "documents")
    # what is as long as a batch goes on in the next; first: the place where a block begins, at: where its lines of this batch do
    full = blocks.where(F.size("lines") == depth).withColumn("so_far", F.array().cast("array<bigint>"))
    at = ids.where(F.size("ids") >= depth).select("source", "doc", F.lit(0).cast("long").alias("path"), F.explode(F.sequence(F.lit(0), F.size("ids") - depth)).alias("at")).withColumn("first", F.col("at"))
    while not full.isEmpty():
        full = written(full.withColumn("next_path", F.xxhash64("path", "lines")))
        held = at.join(ids, ["source", "doc"]).withColumn("lines", F.slice("ids", F.col("at") + 1, F.lit(depth)))
        held = held.join(full.select("source", "path", "lines", "next_path"), ["source", "path", "lines"])
        line = lambda n: F.try_element_at("ids", n)
        before = F.when(F.col("first") > 0, line(F.greatest(F.col("first"), F.lit(1))))
        held = written(held.select("source", "doc", F.col("next_path").alias("path"), (F.col("at") + depth).alias("at"), "first", before.alias("before"), line(F.col("at") + depth + 1).alias("after")))
        ended = full.select("source", F.col("next_path").alias("path"), F.concat("so_far", "lines").alias("lines"), "documents")
        keys = ["source", "path"]
        ends = ended.join(_most(held, "before", keys), keys, "left").join(_most(held, "after", keys), keys, "left")
        ends = ends.where("documents > coalesce(most_before, 0) and documents > coalesce(most_after, 0)")
        found = found.unionByName(ends.select("source", "lines", "documents"))
        on = held.where("after is not null")
        varied = on.groupBy(*keys).agg(F.min("before").alias("lo"), F.max("before").alias("hi"), F.count_if(F.col("before").isNull()).alias("none"))
        at = written(on.join(varied.where("none > 0 or lo <> hi").select(*keys), keys, "left_semi").select("source", "doc", "path", "at", "first"))
        depth *= 2
        starts = at.groupBy("source", "doc", "path").agg(F.array_sort(F.collect_list("at")).alias("starts")).join(ids, ["source", "doc"])
        blocks = written(_batch(starts.select("source", "path", "ids", "starts"), least, depth, shards))
        so_far = ended.select("source", "path", F.col("lines").alias("so_far"))
        # the blocks that end in this batch, with what stands before their places
        part = blocks.where(F.size("lines") < depth).withColumn("block", F.xxhash64("path", "lines"))
        here = at.join(ids, ["source", "doc"]).join(part.select("source", "path", "block", F.col("lines").alias("own"), "documents"), keys)
        here = here.where(F.slice("ids", F.col("at") + 1, F.size("own")) == F.col("own")).select("source", "path", "block", "doc", F.when(F.col("first") > 0, line(F.greatest(F.col("first"), F.lit(1)))).alias("before"), line(F.col("at") + F.size("own") + 1).alias("after"))
        here = written(here)
        keys = ["source", "path", "block"]
        part = part.join(_most(here, "before", keys), keys, "left").join(_most(here, "after", keys), keys, "left")
        part = part.where("documents > coalesce(most_before, 0) and documents > coalesce(most_after, 0)").join(so_far, ["source", "path"])
        found = found.unionByName(part.select("source", F.concat("so_far", "lines").alias("lines"), "documents"))
        full = blocks.where(F.size("lines") == depth).join(so_far, ["source", "path"])
    return found


def repeated_lines(documents: DataFrame, least: int = LEAST, depth: int = DEPTH, shards: int = SHARDS) -> DataFrame:
    """source, line (identifier) of every line that lies in a repeated block. The first batch has them all, since each
    line of a longer block lies in a block of that batch too."""
    return _lines(_keyed(documents), least, depth, shards)


def _lines(keyed: DataFrame, least: int, depth: int = DEPTH, shards: int = SHARDS) -> DataFrame:
    blocks = _batch(_all_places(_identified(keyed)), least, depth, shards)
    return blocks.select("source", F.explode("lines").alias("line")).distinct()


def block_texts(blocks: DataFrame, documents: DataFrame) -> DataFrame:
    """source, lines (the text that is compared), n_lines, documents of blocks of identifiers."""
    lines = documents.where("source is not null and text is not null").select("source", F.explode(F.transform(F.split("text", "\n", -1), line_text)).alias("text"))
    names = lines.where("text <> ''").distinct().withColumn("line", F.xxhash64("text"))
    one = blocks.withColumn("block", F.xxhash64("lines")).select("source", "block", "documents", F.posexplode("lines").alias("at", "line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "\n")
    return one.join(names, ["source", "line"]).groupBy("source", "block", "documents").agg(text.alias("lines"), F.count("*").alias("n_lines")).drop("block")


def without_lines(texts: DataFrame, repeated: DataFrame, key: list[str]) -> DataFrame:
    """texts (the columns of key, source, text; one row a key) with clean, the text without the source's
    repeated lines, and removed, their number."""
    lines = texts.select(*key, "source", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line_text"))
    lines = lines.withColumn("line", line_key(F.col("line_text")))
    marked = lines.join(repeated.withColumn("gone", F.lit(True)), ["source", "line"], "left")
    kept = F.when(F.col("gone").isNull(), F.struct("at", "line_text"))
    clean = marked.groupBy(*key).agg(F.array_sort(F.collect_list(kept)).alias("kept"), F.count("gone").alias("removed"))
    clean = clean.select(*key, F.array_join(F.transform("kept", lambda x: x["line_text"]), "\n").alias("clean"), "removed")
    return texts.join(clean, key, "left").withColumn("clean", F.when(F.col("text").isNotNull(), F.col("clean")))


def plain_blocks(block: DataFrame) -> DataFrame:
    """source, ord, text of the text blocks that are no headings, each once."""
    b = block.where("type = 'text' and text_level is null").select("slug", "ord", "text")
    return once(b, "slug", "ord").select(F.col("slug").alias("source"), "ord", "text")


def all_blocks(block: DataFrame) -> DataFrame:
    """source, ord, text of the blocks of every type, each once."""
    return once(block.select("slug", "ord", "text"), "slug", "ord").select(F.col("slug").alias("source"), "ord", "text")


def repeated_line_places(block: DataFrame, least: int = LEAST) -> DataFrame:
    """slug, ord, line_no of every line of a block that lies in a block of lines that repeats in its book."""
    keyed = written(_keyed(plain_blocks(block), "ord"))  # lines are normalised once, for their blocks and for their places
    places = keyed.select("source", "ord", F.posexplode("keys").alias("line_no", "line")).where("line is not null")
    found = places.join(_lines(keyed, least), ["source", "line"], "left_semi")
    return found.select(F.col("source").alias("slug"), "ord", "line_no")
