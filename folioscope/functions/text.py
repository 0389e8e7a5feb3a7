"""Scalar functions on Columns: everything here stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a paragraph that must not be cut begins with.
ATOMIC_STARTS = ["$$", "|", "![", "<table", "```"]
# Words that begin a cross-reference in the margin.
REFERENCE_WORDS = ["Section", "Chapter", "Appendix", "Exercise", "Figure", "Table", "Sección", "Capítulo", "Ejercicio"]
CHILD_TOKENS, PARENT_TOKENS, RUN_TOKENS = 350, 2000, 800


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def without_scripts(text: Column) -> Column:
    return F.regexp_replace(text, r"(?i)</?su[bp]>", "")


def is_atomic(text: Column) -> Column:
    out = F.lit(False)
    for start in ATOMIC_STARTS:
        out = out | F.startswith(text, F.lit(start))
    return out


def is_margin_note(kind: Column, level: Column, text: Column) -> Column:
    note = rf"^({'|'.join(REFERENCE_WORDS)})\s+[0-9A-Z]+(\.[0-9]+)*\.?$"
    return (kind == "text") & level.isNull() & F.coalesce(stripped(text).rlike(note), F.lit(False))


def caption_text(caption: Column) -> Column:
    text = stripped(F.coalesce(caption, F.lit("")))
    return F.when(text.isin("[]", "None"), "").otherwise(text)


def numbering_depth(text: Column) -> Column:
    """The depth that a heading's number tells, 2 without a number."""
    number = F.regexp_extract(stripped(text), r"^([0-9]+(?:\.[0-9]+)*)\.?\s+\S", 1)
    return F.when(number == "", 2).otherwise(F.length(number) - F.length(F.replace(number, F.lit("."), F.lit(""))) + 1)


def table_markdown(html: Column) -> Column:
    """An HTML table as a pipe table; merged cells can't be shown so, and stay HTML."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: stripped(F.regexp_replace(c, "<[^>]+>", ""))))
    # through a one-element array, so that the rows are computed once
    def shown(rs: Column) -> Column:
        width = F.array_max(F.transform(rs, F.size))
        line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
        lines = F.transform(rs, line)
        rule = F.concat(F.lit("|"), F.repeat(F.lit("---|"), width))
        return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")

    full = F.filter(cells, lambda r: F.size(r) > 0)
    piped = F.get(F.transform(F.array(full), lambda rs: F.when(F.size(rs) > 0, shown(rs))), 0)
    spans = html.rlike(r"(?i)(?:rowspan|colspan)\s*=\s*\"?([2-9]|[0-9]{2,})")
    return F.when(spans, stripped(html)).otherwise(F.coalesce(piped, stripped(html)))


def embedding_text(breadcrumb: Column, text: Column) -> Column:
    return F.when(F.coalesce(breadcrumb, F.lit("")) != "", F.concat(breadcrumb, F.lit("\n\n"), text)).otherwise(text)


def citation(breadcrumb: Column, start: Column, end: Column) -> Column:
    pages = F.when(start == end, F.concat(F.lit("p. "), start)).otherwise(F.concat(F.lit("pp. "), start, F.lit("-"), end))
    return F.concat_ws(", ", breadcrumb, pages)


def content_id(slug: Column, is_parent: Column, start: Column, end: Column, text: Column) -> Column:
    """The first 16 hex digits of SHA-256 of what a chunk consists of, never of where it stands."""
    tier = F.when(is_parent, "parent").otherwise("child")
    return F.substring(F.sha2(F.concat(slug, F.lit(":"), tier, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(":"), text), 256), 1, 16)


def stage_key(sha: Column, fingerprint: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", sha, fingerprint), 256), 1, 16)


def path_slug(path: Column) -> Column:
    """A name that is unique in the corpus, from where a file lies."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "raw") & (p != "."))
    parts = F.when(F.get(parts, 0) == "courses", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)
    last = F.regexp_replace(F.element_at(parts, -1), r"(?<=.)\.[^.]+$", "")
    named = F.concat(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.array(last))
    return F.when(F.size(parts) == 0, "").otherwise(F.lower(F.array_join(named, "-")))


def file_title(name: Column) -> Column:
    """A legible title from a file's name."""
    stem = F.regexp_replace(F.regexp_replace(name, r"^.*/", ""), r"(?<=.)\.[^.]+$", "")
    return F.initcap(stripped(F.regexp_replace(F.regexp_replace(stem, "[-_]+", " "), r"\s+", " ")))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
