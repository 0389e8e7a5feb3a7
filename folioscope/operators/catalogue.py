"""Ledgers, books, intake paths, coverage and status: grouping and joining of small and large dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ordered import running

# The courses and their names.
COURSES = {
    "DRL": "Deep Reinforcement Learning", "EE": "Ética y explicabilidad", "GI": "Geometría de la información",
    "IAG": "Inteligencia artificial geométrica", "IAP": "Inteligencia artificial probabilística", "IM": "Ingeniería de modelos",
    "MD": "Modelos diferenciales", "MGP": "Modelos generativos profundos", "MP": "Métodos probabilísticos",
}
# Kinds of material by tier, lowest first.
TIER_NAMES = ["notes", "extra book", "basic book", "guide", "exam", "slides", "assignment", "code"]
# Tiers of material by the folder it lies in.
KIND_TIERS = {"slides": 5, "exams": 4, "assignments": 6, "notes": 0, "code": 7}
SCAN_CHARS, PROBED = 200, [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]


def course_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(COURSES.items()), "course string, name string")


def tier_name(tier: Column) -> Column:
    names = F.array(*[F.lit(n) for n in TIER_NAMES])
    return F.coalesce(F.when(tier >= 0, F.get(names, tier)), F.lit("unknown"))


def section_tier(heading: Column) -> Column:
    """The tier that a ledger's section stands for, null for any other section."""
    h = F.lower(heading)
    return F.when(h.contains("básica") | h.contains("basica"), 2).when(h.contains("complementaria") | h.contains("extra"), 1)


def parsed_ledgers(lines: DataFrame) -> DataFrame:
    """course, tier, title, filename of acquired entries. lines: course, ln, line.

    A section's tier and an entry's title hold until the next of their kind; a section of no tier ends the one before.
    """
    # How a ledger marks sections, titles and acquired files.
    section, heading, entry = r"^## (.+?)\s*$", r"^### (.+?)\s*$", r"^- (?:ES|EN): ✅\s*[^`]*`([^`]+)`"
    name, title = F.regexp_extract("line", section, 1), F.regexp_extract("line", heading, 1)
    marks = {"section": ("last", F.when(name != "", F.struct(section_tier(name).alias("tier")))), "title": ("last", F.when(title != "", title))}
    held = running(lines.where("course is not null"), ["course"], ["ln"], marks)
    entries = held.select("course", F.col("section.tier").alias("tier"), "title", F.regexp_extract("line", entry, 1).alias("path"))
    return entries.where("path <> '' and tier is not null and title is not null").select("course", "tier", "title", F.regexp_replace("path", "^.*/", "").alias("filename"))


def ledger_lines(entries: DataFrame) -> DataFrame:
    """course, ln, line: ledgers that list the given entries, those without tier or title in a section of no tier."""
    e = entries.where("course is not null and filename is not null").select("course", "tier", "title", "filename").distinct()
    head = F.when(F.col("tier") == 2, "## Bibliografía básica").when(F.col("tier") == 1, "## Bibliografía complementaria").otherwise("## Otros")
    body = F.array(head, F.concat(F.lit("### "), F.coalesce("title", F.lit("?"))), F.concat(F.lit("- ES: ✅ en disco `raw/"), F.col("filename"), F.lit("`")))
    lines = e.withColumn("place", 3 * F.monotonically_increasing_id()).select("course", "place", F.posexplode(body).alias("at", "line"))
    return lines.select("course", (F.col("place") + F.col("at")).alias("ln"), "line")


def books(entries: DataFrame, tier: int | None = None) -> DataFrame:
    """filename, slug, tier (the highest), courses, titles: one row a file, whoever lists it."""
    b = entries.where("filename is not null").groupBy("filename").agg(
        F.max("tier").alias("tier"), F.sort_array(F.collect_set("course")).alias("courses"), F.sort_array(F.collect_set("title")).alias("titles")
    )
    b = b.withColumn("slug", F.regexp_replace("filename", r"(?<=.)\.[^.]+$", ""))
    return b if tier is None else b.where(F.col("tier") == tier)


def existing_books(entries: DataFrame, files: DataFrame, tier: int | None = None) -> DataFrame:
    """books that some listing course holds the file of. files: course, filename."""
    held = entries.join(files.select("course", "filename").distinct(), ["course", "filename"], "left_semi").select("filename").distinct()
    return books(entries, tier).join(held, "filename", "left_semi")


def kind_tier(kind: Column) -> Column:
    """The tier of a kind of material; an unknown kind is an error."""
    tier = F.raise_error(F.concat(F.lit("unknown kind of material: "), F.coalesce(kind, F.lit("none"))))
    for name, n in KIND_TIERS.items():
        tier = F.when(kind == name, F.lit(n)).otherwise(tier)
    return tier.cast("int")


def staged(intake: DataFrame, kinds: tuple[str, ...] = (), suffix: str = ".pdf", files: DataFrame | None = None) -> DataFrame:
    """slug, path, course, title, tier of material of a known kind, with files (path) of that which is there. intake: path, kind, title, course."""
    i = intake.where(F.col("kind").isin(*KIND_TIERS) & F.endswith("path", F.lit(suffix)))
    if kinds:
        i = i.where(F.col("kind").isin(*kinds))
    if files is not None:
        i = i.join(files.select("path").distinct(), "path", "left_semi")
    slug = T.path_slug(F.col("path"))
    return i.select(slug.alias("slug"), "path", "course", F.coalesce(F.nullif("title", F.lit("")), slug).alias("title"), kind_tier(F.col("kind")).alias("tier"))


def manifest(chunks: DataFrame) -> DataFrame:
    """book_slug, chunks, parents, children of every book with chunks."""
    return chunks.groupBy("book_slug").agg(F.count("*").alias("chunks"), F.count_if("is_parent").alias("parents"), F.count_if(~F.col("is_parent")).alias("children"))


def _listed(meta: DataFrame, counts: DataFrame) -> DataFrame:
    m = meta.select("slug", "courses", "tier", F.coalesce("pages", F.lit(0)).alias("pages"))
    m = m.join(counts.select(F.col("book_slug").alias("slug"), "chunks"), "slug", "left").fillna(0, ["chunks"])
    return m.select("slug", F.explode(F.array_distinct("courses")).alias("course"), tier_name(F.col("tier")).alias("kind"), "pages", "chunks")


def coverage(meta: DataFrame, counts: DataFrame) -> DataFrame:
    """course, name, books, pages, chunks, indexed of every course, those without anything included."""
    t = _listed(meta, counts).groupBy("course").agg(F.count("*").alias("books"), F.sum("pages").alias("pages"), F.sum("chunks").alias("chunks"))
    c = course_table(meta.sparkSession).join(t, "course", "left").fillna(0, ["books", "pages", "chunks"])
    return c.withColumn("indexed", F.col("books") > 0)


def coverage_by_kind(meta: DataFrame, counts: DataFrame) -> DataFrame:
    """course, kind, books of the known courses."""
    t = _listed(meta, counts).groupBy("course", "kind").agg(F.count("*").alias("books"))
    return t.join(course_table(meta.sparkSession).select("course"), "course", "left_semi")


def coverage_nested(meta: DataFrame, counts: DataFrame) -> DataFrame:
    """coverage with book_slugs (sorted) and by_kind (a map)."""
    rows = _listed(meta, counts)
    slugs = rows.groupBy("course").agg(F.sort_array(F.collect_list("slug")).alias("book_slugs"))
    kinds = coverage_by_kind(meta, counts).groupBy("course").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "books")))).alias("by_kind"))
    c = coverage(meta, counts).join(slugs, "course", "left").join(kinds, "course", "left")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return c.withColumn("book_slugs", F.coalesce("book_slugs", F.array().cast("array<string>"))).withColumn("by_kind", F.coalesce("by_kind", none))


def status(meta: DataFrame, counts: DataFrame) -> DataFrame:
    """extracted, pages, scans, chunks, with_warnings of the whole collection."""
    m = meta.join(counts.select(F.col("book_slug").alias("slug"), "chunks"), "slug", "left")
    return m.agg(
        F.count("*").alias("extracted"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"), F.count_if(F.col("extraction_tier") == "scan").alias("scans"),
        F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.count_if(F.size("warnings") > 0).alias("with_warnings"),
    )


def scan_classes(pages: DataFrame, book: DataFrame) -> DataFrame:
    """slug, median, extraction_tier: scan if the median text length of the probed pages is below SCAN_CHARS.

    pages: slug, page (from 0), chars; book: slug, pages. Pages without text count as 0.
    """
    probes = F.array_distinct(F.transform(F.array(*[F.lit(f) for f in PROBED]), lambda f: F.floor(F.col("pages") * f)))
    p = book.where("pages > 0").select("slug", F.explode(F.filter(probes, lambda n: n < F.col("pages"))).alias("page"))
    m = p.join(pages, ["slug", "page"], "left").groupBy("slug").agg(F.percentile(F.coalesce("chars", F.lit(0)), F.lit(0.5)).alias("median"))
    m = book.select("slug").distinct().join(m, "slug", "left").withColumn("median", F.coalesce("median", F.lit(0.0)))
    return m.withColumn("extraction_tier", F.when(F.col("median") < SCAN_CHARS, "scan").otherwise("born_digital"))


def described(book: DataFrame, pages: DataFrame, outline: DataFrame, hashes: DataFrame, least_pages: int = 20) -> DataFrame:
    """slug, pages, sha256, extraction_tier, warnings of books (slug, pages). pages: slug, page, chars; outline: slug; hashes: slug, sha256."""
    c = scan_classes(pages, book).join(book.select("slug", F.coalesce("pages", F.lit(0)).alias("pages")).distinct(), "slug")
    c = c.join(outline.select("slug").distinct().withColumn("outlined", F.lit(True)), "slug", "left")
    c = c.join(hashes.groupBy("slug").agg(F.min("sha256").alias("sha256")), "slug", "left")
    warnings = F.array(
        F.when(F.col("extraction_tier") == "scan", "no text layer"), F.when(F.col("outlined").isNull(), "no outline"),
        F.when(F.col("pages") < least_pages, F.concat(F.lit("only "), F.col("pages"), F.lit(" pages"))),
    )
    return c.select("slug", "pages", "sha256", "extraction_tier", F.filter(warnings, lambda w: w.isNotNull()).alias("warnings"))


def destination(path: Column) -> Column:
    """Where a contributed file (course/kind/name) is filed: literature by itself, other material under its kind."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    course, kind, name = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    return F.when(kind.isin("basic", "extra"), F.concat_ws("/", F.lit("courses"), course, F.lit("literature"), name)).otherwise(
        F.concat_ws("/", F.lit("courses"), course, F.lit("raw"), kind, name)
    )


def new_entries(outcomes: DataFrame, entries: DataFrame) -> DataFrame:
    """course, tier, title, filename that the ledgers lack: of accepted literature, and of duplicates, since another course may
    list a book that is there already. outcomes: those of drop_outcomes; entries: course, filename."""
    parts = F.filter(F.split("path", "/"), lambda p: ~p.isin("", "."))
    o = outcomes.where("status in ('accepted', 'duplicate')").select(F.get(parts, 0).alias("course"), F.get(parts, 1).alias("kind"), F.get(parts, 2).alias("filename"), "title")
    o = o.where("kind in ('basic', 'extra')").select("course", F.when(F.col("kind") == "basic", 2).otherwise(1).alias("tier"), "title", "filename").distinct()
    return o.join(entries.select("course", "filename").distinct(), ["course", "filename"], "left_anti").select("course", "tier", "title", "filename")


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """status, files, and of rejected ones by reason."""
    return outcomes.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("files"))


def all_warnings(meta: DataFrame) -> DataFrame:
    """slug, warnings (joined) of the books that have any."""
    return meta.where(F.size("warnings") > 0).select("slug", F.array_join("warnings", "; ").alias("warnings"))


def drop_reason(path: Column, known: list[str] = list(COURSES), kinds: tuple[str, ...] = ("basic", "extra", "slides", "exams")) -> Column:
    """Why a contributed path can't be filed, null if it can."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    course, kind, name = F.get(parts, 0), F.get(parts, 1), F.get(parts, 2)
    return (
        F.when(F.array_contains(F.split(path, "/"), "..") | F.startswith(path, F.lit("/")), "outside")
        .when(F.size(parts) != 3, "shape")
        .when(~course.isin(known), "course")
        .when(~kind.isin(*kinds), "kind")
        .when(~F.endswith(F.lower(name), F.lit(".pdf")), "suffix")
        .when(name.rlike(r"[`\x00-\x1f]"), "characters")
    )


def drop_outcomes(drops: DataFrame, held: DataFrame, least_pages: int = 20) -> DataFrame:
    """path, status, reason, title. drops: path, sha256, pages (null: unreadable), sidecar; held: sha256 of what is there.

    Of several files of the same content only the first by path is taken, the rest are duplicates; so is what is held.
    """
    d = drops.withColumn("reason", drop_reason(F.col("path"))).join(held.select("sha256").distinct().withColumn("held", F.lit(True)), "sha256", "left")
    kind = F.get(F.filter(F.split("path", "/"), lambda p: ~p.isin("", ".")), 1)
    bad = F.col("reason").isNotNull()
    late = F.when(F.col("pages").isNull(), "unreadable").when(kind.isin("basic", "extra") & (F.col("pages") < least_pages), "too short")
    d = d.withColumn("late", F.when(~bad, late))
    able = F.when(~bad & F.col("late").isNull(), F.col("path"))
    first = d.groupBy("sha256").agg(F.min(able).alias("first"))
    d = d.join(first, "sha256", "left")
    repeat = ~bad & (F.col("held").isNotNull() | (F.col("first") < F.col("path")))
    status = F.when(bad, "rejected").when(repeat, "duplicate").when(F.col("late").isNotNull(), "rejected").when(kind.isin("basic", "extra"), "accepted").otherwise("stored")
    title = F.coalesce(F.nullif(T.stripped(F.get(F.split(T.stripped(F.col("sidecar")), "\n"), 0)), F.lit("")), T.file_title(F.col("path")))
    return d.select("path", status.alias("status"), F.when(status == "rejected", F.coalesce("reason", "late")).alias("reason"), title.alias("title"))
