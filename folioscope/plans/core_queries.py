"""The registered queries of the engine's own operators, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ordered import running
from ..operators import blocks as B
from ..operators import catalogue as C
from ..operators import encode as E
from ..operators import retrieval as R
from ..operators import segments as S
from ..operators import store
from ..session import work_dir, written
from ..sources import readers
from ..sources.tables import once, table
from ..streaming import inbox
from .core_sql import SQL

REGISTERED: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    REGISTERED[f.__name__] = f
    return f


def _blocks(spark, d):
    return B.all_blocks(table(spark, d, "block"))


def _chunks(spark, d, *columns):
    return once(table(spark, d, "chunk").select("chunk_id", *columns), "chunk_id")


def _children(spark, d, *columns):
    return once(table(spark, d, "children").select("chunk_id", *columns), "chunk_id")


def _meta(spark, d):
    return once(table(spark, d, "book_meta"), "slug")


@query
def kept_blocks(spark, d):
    return B.kept_blocks(_blocks(spark, d)).select("slug", "ord", "type", "page")


@query
def margin_notes(spark, d):
    return B.margin_notes(_blocks(spark, d)).select("slug", "ord", "text")


@query
def captions(spark, d):
    return _blocks(spark, d).select("slug", "ord", T.caption_text(F.col("caption")).alias("caption"))


@query
def heading_depths(spark, d):
    return B.heading_depths(_blocks(spark, d), table(spark, d, "outline"))


@query
def page_turns(spark, d):
    return B.page_turns(_blocks(spark, d))


@query
def injected_headings(spark, d):
    return B.injected_headings(_blocks(spark, d), table(spark, d, "outline")).select("slug", "ord", "at", "title", "depth")


@query
def figure_names(spark, d):
    return B.figure_names(_blocks(spark, d))


@query
def table_markdown(spark, d):
    t = _blocks(spark, d).where("type = 'table'")
    return t.select("slug", "ord", T.table_markdown(F.coalesce("table_body", F.lit(""))).alias("markdown"))


@query
def clean_characters(spark, d):
    return _blocks(spark, d).select("slug", "ord", T.without_controls(F.col("text")).alias("text"))


@query
def rendered_text(spark, d):
    r = B.rendered_blocks(_blocks(spark, d), table(spark, d, "outline"))
    return r.select("slug", "ord", "page", F.md5("part").alias("part_md5"))


@query
def page_spans(spark, d):
    return B.page_spans(_blocks(spark, d), table(spark, d, "book_meta"))


def _pieces(spark, d):
    return S.pieces(_blocks(spark, d), table(spark, d, "outline"))


@query
def pieces(spark, d):
    return _pieces(spark, d).select("slug", "ord", "sub", "page", "text", "atomic")


def _body(spark, d):
    return S.sectioned(_pieces(spark, d), _meta(spark, d).select("slug", F.get("titles", 0).alias("title")))


@query
def sections(spark, d):
    return S.sections(_body(spark, d))


@query
def heading_trails(spark, d):
    h = B.heading_depths(_blocks(spark, d), table(spark, d, "outline"))
    h = running(written(h), ["slug"], ["ord"], {"section_no": ("sum", F.lit(1))})
    return S.trails(h).select("slug", "section_no", F.array_join("trail", " > ").alias("trail"))


@query
def packed_lines(spark, d):
    """Lines of documents packed into groups of 100 tokens."""
    docs = once(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    cost = T.token_estimate(F.col("line"))
    g = S.packed(lines.select("doc_id", "line_no", cost.alias("cost")), ["doc_id"], ["line_no"], F.col("cost"), 100, "group_no")
    return g.select("doc_id", "line_no", "group_no")


@query
def section_runs(spark, d):
    s = S.sections(_body(spark, d))
    return S.packed(s, ["slug"], ["section_no"], F.col("tokens"), T.RUN_TOKENS, "run_no").select("slug", "section_no", "run_no")


@query
def built_chunks(spark, d):
    c = S.book_chunks(table(spark, d, "block"), table(spark, d, "outline"), table(spark, d, "book_meta"))
    return c.select("chunk_id", "book_slug", "breadcrumb", "page_start", "page_end", "parent_id", "is_parent", "tokens", "source_tier", F.array_join("content_types", ",").alias("content_types"))


@query
def token_estimates(spark, d):
    c = _chunks(spark, d, "text", "tokens").select("chunk_id", T.token_estimate(F.col("text")).alias("tokens"), F.col("tokens").alias("stated"))
    return c.select("chunk_id", "tokens", F.coalesce(F.col("tokens") == F.col("stated"), F.lit(False)).alias("agrees"))


@query
def chunk_ids(spark, d):
    c = _chunks(spark, d, "book_slug", "is_parent", "page_start", "page_end", "text")
    return c.select("chunk_id", T.content_id(F.col("book_slug"), F.col("is_parent"), F.col("page_start"), F.col("page_end"), F.col("text")).alias("computed_id"))


@query
def embedding_texts(spark, d):
    return _chunks(spark, d, "is_parent", "breadcrumb", "text").where("not is_parent").select("chunk_id", T.embedding_text(F.col("breadcrumb"), F.col("text")).alias("embedding_text"))


@query
def citations(spark, d):
    return _chunks(spark, d, "breadcrumb", "page_start", "page_end").select("chunk_id", T.citation(F.col("breadcrumb"), F.col("page_start"), F.col("page_end")).alias("citation"))


@query
def content_types(spark, d):
    c = _chunks(spark, d, "book_slug", "content_types").select("book_slug", F.explode("content_types").alias("content_type"))
    return c.groupBy("book_slug", "content_type").agg(F.count("*").alias("chunks"))


@query
def markdown_features(spark, d):
    """Counts of what later stages rely on, per book."""
    b = _blocks(spark, d).select("slug", "text")
    n = lambda pattern: F.sum(F.regexp_count("text", F.lit(pattern))).cast("long")
    return b.groupBy("slug").agg(
        F.sum(F.length("text")).alias("chars"), n(r"\$\$[^$]+\$\$").alias("display_math"), n(r"(?m)^#{1,6} ").alias("headings"),
        n(r"(?m)^\|[^\n]+\|$").alias("table_rows"), n("```").alias("fences"), n(r"!\[[^\]]*\]\(").alias("images"),
    )


@query
def books(spark, d):
    b = C.books(table(spark, d, "ledger_entry"))
    return b.select("filename", "slug", "tier", F.array_join("courses", ",").alias("courses"), F.array_join("titles", "|").alias("titles"))


@query
def basic_books(spark, d):
    return C.books(table(spark, d, "ledger_entry"), 2).select("filename", F.size("courses").alias("n_courses"))


@query
def existing_books(spark, d):
    files = table(spark, d, "book_meta").select(F.explode("courses").alias("course"), F.concat(F.regexp_replace("slug", "^[a-z]+-[a-z]+-", ""), F.lit(".pdf")).alias("filename"))
    return C.existing_books(table(spark, d, "ledger_entry"), files).select("filename", "tier")


@query
def ledger_round_trip(spark, d):
    return C.parsed_ledgers(written(C.ledger_lines(table(spark, d, "ledger_entry"))))


@query
def file_titles(spark, d):
    return table(spark, d, "ledger_entry").select("filename").distinct().select("filename", T.file_title(F.col("filename")).alias("title"))


@query
def staged_books(spark, d):
    m = table(spark, d, "book_meta").select(
        F.col("source_path").alias("path"), F.get(F.split("source_path", "/"), 2).alias("kind"), F.get("titles", 0).alias("title"), F.get("courses", 0).alias("course")
    )
    return C.staged(m).distinct()


@query
def manifest(spark, d):
    return C.manifest(_chunks(spark, d, "book_slug", "is_parent"))


@query
def coverage(spark, d):
    return C.coverage(_meta(spark, d), C.manifest(_chunks(spark, d, "book_slug", "is_parent")))


@query
def coverage_by_kind(spark, d):
    return C.coverage_by_kind(_meta(spark, d), C.manifest(_chunks(spark, d, "book_slug", "is_parent")))


@query
def status(spark, d):
    return C.status(_meta(spark, d), C.manifest(_chunks(spark, d, "book_slug", "is_parent")))


@query
def scan_classes(spark, d):
    chars = _blocks(spark, d).groupBy("slug", "page").agg(F.sum(F.length("text")).alias("chars"))
    return C.scan_classes(chars, _meta(spark, d).select("slug", "pages"))


@query
def stage_keys(spark, d):
    m = _meta(spark, d)
    return m.select("slug", T.stage_key(F.col("source_sha256"), F.lit("0123456789abcdef")).alias("stage_key"))


@query
def undone_books(spark, d):
    m = _meta(spark, d)
    settings = {"tool": "converter", "least_bytes": 3072}
    done = m.where("tier >= 4").select("slug", T.stage_key(F.col("source_sha256"), F.lit(store.fingerprint(settings))).alias("stage_key"))
    return store.undone(m.select("slug", F.col("source_sha256").alias("sha256")), done, settings).select("slug")


@query
def drop_outcomes(spark, d):
    """Every book offered again under each of its courses, those of tier 2 held already."""
    m = _meta(spark, d)
    kind = F.when(F.col("tier") == 2, "basic").when(F.col("tier") == 1, "extra").when(F.col("tier") == 5, "slides").when(F.col("tier") == 4, "exams").otherwise("other")
    drops = m.withColumn("course", F.explode("courses")).select(
        F.concat_ws("/", "course", kind, F.regexp_replace("source_path", "^.*/", "")).alias("path"), F.col("source_sha256").alias("sha256"), "pages", F.lit(None).cast("string").alias("sidecar")
    )
    return C.drop_outcomes(drops, m.where("tier = 2").select(F.col("source_sha256").alias("sha256")))


@query
def course_scope(spark, d):
    return R.of_course(_chunks(spark, d, "book_slug", "courses"), "IAP").select("chunk_id", "book_slug")


@query
def bm25_search(spark, d):
    docs = _children(spark, d, "text").select(F.col("chunk_id").alias("id"), "text")
    return R.bm25(table(spark, d, "eval_item").select(F.col("item_id").alias("qid"), "text"), docs, 8)


@query
def vector_search(spark, d):
    v = once(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    return R.nearest(v.where("id % 50 = 0").withColumnRenamed("id", "qid"), v, 10)


def _book_queries(spark, d):
    """Each book asked for with its first title and the vector of its first child."""
    first = _children(spark, d, "book_slug", "vector")
    first = R.usable(first.select(F.col("chunk_id").alias("id"), "vector"), 64).join(first.select(F.col("chunk_id").alias("id"), "book_slug"), "id")
    vector = first.groupBy("book_slug").agg(F.min_by("vector", "id").alias("vector"))
    return _meta(spark, d).select(F.col("slug").alias("qid"), F.get("titles", 0).alias("text")).join(vector.withColumnRenamed("book_slug", "qid"), "qid")


@query
def hybrid_search(spark, d):
    return R.hybrid(_book_queries(spark, d), _children(spark, d, "text", "vector", "courses"), 8)


@query
def course_search(spark, d):
    return R.hybrid(_book_queries(spark, d), _children(spark, d, "text", "vector", "courses"), 8, course="IAP")


@query
def expanded_search(spark, d):
    c = _chunks(spark, d, "is_parent", "book_slug", "breadcrumb", "page_start", "page_end")
    hits = R.expanded(R.hybrid(_book_queries(spark, d), _children(spark, d, "text", "vector", "courses"), 8), _children(spark, d, "parent_id"), c.where("is_parent"))
    return R.cited(hits, c).select("qid", "chunk_id", "score", "rank", "matched", "book_slug", "citation")


@query
def neighbours(spark, d):
    return R.neighbours(_chunks(spark, d, "book_slug", "is_parent", "seq"))


@query
def fetched(spark, d):
    """Every child, read on from."""
    c = _chunks(spark, d, "book_slug", "is_parent", "seq", "parent_id")
    return R.fetched(c.where("not is_parent").select("chunk_id"), c)


@query
def located(spark, d):
    return R.located(_children(spark, d), _chunks(spark, d, "book_slug"))


@query
def encoded_children(spark, d):
    """The components that aren't zero of the children's hashed vectors."""
    v = E.hashed_words(_children(spark, d, "text").select(F.col("chunk_id").alias("id"), "text"))
    return v.select("id", F.posexplode("vector").alias("place", "value")).where("value <> 0").select("id", "place", F.round(F.col("value").cast("double"), 4).alias("value"))


def _shared(spark, name):
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query
def read_block_lines(spark, d):
    """The blocks written as a converter writes them, a file a book, and read again."""
    b = _blocks(spark, d)
    caption = F.when(F.col("caption") != "", F.to_json(F.array("caption"))).otherwise(F.col("caption"))
    row = F.struct("type", F.col("page").alias("page_idx"), "text", "text_level", "img_path", caption.alias("image_caption"), "table_body")
    path = _shared(spark, "content")
    raw = b.select(F.concat("slug", F.lit("_content_list.jsonl")).alias("file"), "ord", F.to_json(row).alias("value"))
    raw.repartition("file").sortWithinPartitions("file", "ord").select("file", "value").write.partitionBy("file").text(path)
    return readers.block_lines(spark, f"{path}/*").select("slug", "ord", "type", "page", "text_level", F.md5("text").alias("text_md5"), "caption", F.length("table_body").alias("table_chars"))


@query
def read_ledgers(spark, d):
    """The ledgers written as files, a course a folder, and read again."""
    path = _shared(spark, "ledgers")
    lines = C.ledger_lines(table(spark, d, "ledger_entry"))
    lines.repartition("course").sortWithinPartitions("course", "ln").select("course", F.col("line").alias("value")).write.partitionBy("course").text(path)
    return C.parsed_ledgers(readers.ledgers(spark, f"{path}/*"))


@query
def read_intake(spark, d):
    """The books' sources as intake records, staged."""
    path = _shared(spark, "intake")
    m = _meta(spark, d)
    entry = F.struct(F.col("source_path").alias("path"), F.get("titles", 0).alias("title"), F.get("courses", 0).alias("course"), F.get(F.split("source_path", "/"), 2).alias("kind"))
    m.select(F.array(entry).alias("files"), F.col("slug").alias("record")).repartition("record").write.partitionBy("record").json(path)
    files = m.where("pages >= 20").select(F.col("source_path").alias("path"))
    return C.staged(readers.intake(spark, f"{path}/*"), files=files).distinct()


@query
def read_sidecars(spark, d):
    path = _shared(spark, "sidecars")
    m = _meta(spark, d).withColumn("page_span", F.array("page_span.start", "page_span.end")).withColumn("book", F.col("slug"))
    m.repartition("book").write.partitionBy("book").json(path)
    r = readers.sidecars(spark, f"{path}/*")
    return r.select("slug", "tier", "pages", F.get("page_span", 0).alias("page_start"), F.get("page_span", 1).alias("page_end"), F.array_join("titles", "|").alias("titles"), "source_sha256", "chars")


@query
def read_chunk_lines(spark, d):
    """The chunks written as JSON lines, a file a book, and their order as read again."""
    path = _shared(spark, "chunk-lines")
    c = _chunks(spark, d, "book_slug", "seq", "breadcrumb", "text", "page_start", "page_end", "parent_id", "is_parent", "tokens", "courses", "source_tier", "content_types")
    rows = c.withColumn("book", F.col("book_slug")).repartition("book").sortWithinPartitions("book", "seq", "chunk_id")
    rows.drop("seq").write.partitionBy("book").json(path)
    r = readers.chunk_lines(spark, f"{path}/*")
    r = running(r.select("chunk_id", "book_slug", "seq", "text", "courses"), ["book_slug"], ["seq"], {"previous": ("prev", F.col("chunk_id"))}, readers.LINE_BUCKET)
    return r.select("chunk_id", "book_slug", "previous", F.md5("text").alias("text_md5"), F.array_join("courses", ",").alias("courses"))


@query
def hashed_books(spark, d):
    """The digests of files, a book's source path in each."""
    path = _shared(spark, "files")
    _meta(spark, d).select("slug", F.col("source_path").alias("value")).repartition("slug").write.partitionBy("slug").text(path)
    h = readers.hashed_files(spark, path, "*.txt")
    return h.select(F.regexp_extract("path", "slug=([^/]+)/", 1).alias("slug"), "sha256", "bytes")


@query
def stored_chunks(spark, d):
    """The chunks stored by book, one book replaced with upper-case texts, those that the manifest lists read again."""
    path, listed = _shared(spark, "chunks"), _shared(spark, "manifest")
    c = written(_chunks(spark, d, "book_slug", "is_parent", "text"))
    store.write_chunks(c, path)
    last = c.agg(F.max("book_slug").alias("s")).first()["s"]
    store.write_chunks(c.where(F.col("book_slug") == last).withColumn("text", F.upper("text")), path)
    store.manifest_json(c.where("book_slug is not null"), listed)
    found = store.listed_chunks(store.read_chunks(spark, path), store.read_manifest(spark, listed).where("parents > 1"))
    return found.select("chunk_id", "book_slug", "is_parent", F.md5("text").alias("text_md5"))


@query
def stored_manifest(spark, d):
    path = _shared(spark, "manifest")
    store.manifest_json(_chunks(spark, d, "book_slug", "is_parent"), path)
    missing = store.read_manifest(spark, f"{path}-missing")
    return store.read_manifest(spark, path).unionByName(missing)


def _index(spark, d):
    """An index of the chunks, written in two parts, with the vectors of their words."""
    path = _shared(spark, "index")
    c = _chunks(spark, d, "book_slug", "breadcrumb", "text", "page_start", "page_end", "parent_id", "is_parent", "courses")
    c = written(c)
    vectors = E.hashed_words(c.where("not is_parent").select(F.col("chunk_id").alias("id"), T.embedding_text(F.col("breadcrumb"), F.col("text")).alias("text")))
    store.build_index(c.where("is_parent or page_start % 2 = 0"), vectors, path)
    store.build_index(c.where("not is_parent and page_start % 2 <> 0"), vectors, path, append=True)
    return path


@query
def indexed_children(spark, d):
    children, parents = store.open_index(spark, _index(spark, d))
    p = parents.select(F.col("chunk_id").alias("parent_id"), F.length("body").alias("parent_chars"))
    return children.join(p, "parent_id", "left").select("chunk_id", F.md5("text").alias("text_md5"), F.md5("body").alias("body_md5"), F.size("vector").alias("size"), "parent_chars")


def _asked(spark, d):
    q = _meta(spark, d).select(F.col("slug").alias("id"), F.get("titles", 0).alias("text")).where("text is not null")
    return q.join(E.hashed_words(q), "id").withColumnRenamed("id", "qid")


@query
def index_answers(spark, d):
    """The books' first titles asked of an index of the chunks."""
    a = R.answers(_asked(spark, d), *store.open_index(spark, _index(spark, d)))
    return a.select("qid", "rank", "score", "chunk_id", "book_slug", "matched", F.md5("text").alias("text_md5"), F.md5("matched_text").alias("matched_md5"), "citation")


@query
def plain_answers(spark, d):
    """The same without expansion to parents, over the children table."""
    c = _children(spark, d, "book_slug", "breadcrumb", "text", "body", "page_start", "page_end", "courses", "parent_id", "vector")
    a = R.answers(_book_queries(spark, d), c, None, expand=False)
    return a.select("qid", "rank", "score", "chunk_id", "book_slug", F.array_join("courses", ",").alias("courses"), F.md5("text").alias("text_md5"), "matched_text")


@query
def published_chunks(spark, d):
    """Two revisions published; what was pulled of the first, what is pulled next, and the newest."""
    path, to = _shared(spark, "published"), _shared(spark, "pulled")
    c = _chunks(spark, d, "book_slug", "is_parent")
    store.publish({"chunks": c.where("is_parent"), "books": C.manifest(c)}, path, "r1")
    store.publish({"chunks": c, "books": C.manifest(c)}, path, "r2")
    first = written(store.pull(spark, path, "chunks", "r1", to).select("chunk_id", F.lit("r1").alias("pulled")))  # the next pull replaces it
    again = store.pull(spark, path, "chunks", to=to)  # what is recorded, not the newest
    newest = store.pull(spark, path, "chunks")
    named = lambda df, name: df.select("chunk_id", F.concat(F.lit(f"{name} "), F.lit(store.recorded(spark, to if name == "again" else path))).alias("pulled"))
    return first.unionByName(named(again, "again")).unionByName(named(newest, "newest"))


@query
def rendered_figures(spark, d):
    """The figures' Markdown with their files' names; files too small have none and keep their path."""
    b = _blocks(spark, d)
    sizes = b.where(F.col("type").isin(B.FIGURES)).select("slug", "img_path", (F.length("img_path") * 100).alias("bytes")).distinct()
    names = B.figure_names(b, sizes, 2200)
    r = B.rendered_blocks(b, table(spark, d, "outline"), names)
    return r.join(b.where(F.col("type").isin(B.FIGURES)).select("slug", "ord"), ["slug", "ord"], "left_semi").select("slug", "ord", "part")


@query
def document_meta(spark, d):
    b = written(_blocks(spark, d))
    parts = B.rendered_blocks(b, table(spark, d, "outline"))
    return store.document_meta(parts, B.figure_names(b), table(spark, d, "book_meta"))


@query
def written_documents(spark, d):
    """The Markdown of all books, stored and read again."""
    path = _shared(spark, "documents")
    b = written(_blocks(spark, d))
    parts = written(B.rendered_blocks(b, table(spark, d, "outline")))
    store.write_documents(parts, store.document_meta(parts, B.figure_names(b), table(spark, d, "book_meta")), path)
    lines = spark.read.text(f"{path}/extracted").where("value <> ''")
    return lines.groupBy("slug").agg(F.count("*").alias("lines"), F.sum(F.length("value")).alias("chars"))


@query
def described_books(spark, d):
    chars = _blocks(spark, d).groupBy("slug", "page").agg(F.sum(F.length("text")).alias("chars"))
    m = _meta(spark, d)
    r = C.described(m.select("slug", "pages"), chars, table(spark, d, "outline"), m.select("slug", F.col("source_sha256").alias("sha256")))
    return r.select("slug", "pages", "sha256", "extraction_tier", F.array_join("warnings", "; ").alias("warnings"))


def _outcomes(spark, d):
    m = _meta(spark, d)
    kind = F.when(F.col("tier") == 2, "basic").when(F.col("tier") == 1, "extra").when(F.col("tier") == 5, "slides").when(F.col("tier") == 4, "exams").otherwise("other")
    drops = m.withColumn("course", F.explode("courses")).select(
        F.concat_ws("/", "course", kind, F.regexp_replace("source_path", "^.*/", "")).alias("path"), F.col("source_sha256").alias("sha256"), "pages", F.get("titles", 0).alias("sidecar")
    )
    return C.drop_outcomes(drops, m.where("tier = 2").select(F.col("source_sha256").alias("sha256")))


@query
def titled_drops(spark, d):
    """The outcomes of drop_outcomes with the titles of their sidecars, and where they are filed."""
    return _outcomes(spark, d).select("path", "status", "title", F.when(F.col("status").isin("accepted", "stored"), C.destination(F.col("path"))).alias("destination"))


@query
def outcome_totals(spark, d):
    return C.outcome_totals(_outcomes(spark, d))


@query
def new_entries(spark, d):
    return C.new_entries(_outcomes(spark, d), table(spark, d, "ledger_entry"))


@query
def coverage_nested(spark, d):
    c = C.coverage_nested(_meta(spark, d), C.manifest(_chunks(spark, d, "book_slug", "is_parent")))
    kinds = F.array_join(F.transform(F.array_sort(F.map_entries("by_kind")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return c.select("course", "books", F.array_join("book_slugs", ",").alias("book_slugs"), kinds.alias("by_kind"))


@query
def all_warnings(spark, d):
    return C.all_warnings(_meta(spark, d))


@query
def streamed_events(spark, d):
    return inbox.drained(spark, d, "events.parquet", "event_id", "ts")


@query
def event_hours(spark, d):
    e = table(spark, d, "events")
    return inbox.hourly(e).select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def entry(spark: SparkSession, folder: str) -> DataFrame:
    return expanded_search(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTERED)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in SQL.items() if k in REGISTERED}
