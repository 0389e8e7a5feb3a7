import pytest
from pyspark.sql import functions as F

from folioscope.operators import catalogue as C
from folioscope.operators import store


def test_ledger_state(spark):
    text = "\n".join([
        "## Bibliografía básica", "### One", "- ES: ✅ in `raw/one.pdf`", "- EN: ⬇ `raw/two.pdf`", "- EN: ✅ `b/two.pdf`",
        "## Otros", "- ES: ✅ `lost.pdf`", "## Bibliografía complementaria", "- EN: ✅ `x.pdf` and `y.pdf`", "- EN: ✅ none",
    ])
    rows = [("A", n, line) for n, line in enumerate(text.split("\n"))] + [("B", 0, "- ES: ✅ `early.pdf`"), ("C", 0, None), (None, 1, "## Bibliografía básica")]
    got = C.parsed_ledgers(spark.createDataFrame(rows, "course string, ln long, line string"))
    assert sorted((x.course, x.tier, x.title, x.filename) for x in got.collect()) == [("A", 1, "One", "x.pdf"), ("A", 2, "One", "one.pdf"), ("A", 2, "One", "two.pdf")]


def test_books(spark):
    rows = [("A", 1, "T", "f.pdf"), ("B", 2, "T", "f.pdf"), ("B", 2, "U", "f.pdf"), ("A", None, None, "g.pdf"), ("A", 1, "V", None)]
    b = {x.filename: x for x in C.books(spark.createDataFrame(rows, "course string, tier int, title string, filename string")).collect()}
    assert b["f.pdf"].tier == 2 and b["f.pdf"].courses == ["A", "B"] and b["f.pdf"].titles == ["T", "U"]
    assert b["g.pdf"].tier is None and set(b) == {"f.pdf", "g.pdf"}


def test_coverage_reports_holes(spark):
    meta = spark.createDataFrame([("s", ["MP", "??"], 5, 10), ("t", ["MP", "MP"], 99, None), ("u", None, 1, 3)], "slug string, courses array<string>, tier int, pages int")
    counts = spark.createDataFrame([("s", 7)], "book_slug string, chunks long")
    c = {x.course: x for x in C.coverage_nested(meta, counts).collect()}
    assert len(c) == 9 and c["MP"].books == 2 and c["MP"].pages == 10 and c["MP"].chunks == 7 and c["MP"].by_kind == {"slides": 1, "unknown": 1}
    assert c["DRL"].books == 0 and not c["DRL"].indexed and c["DRL"].by_kind == {} and c["DRL"].book_slugs == []


def test_drops(spark):
    rows = [
        ("MP/basic/a.pdf", "1", 30, None), ("GI/basic/a.pdf", "1", 30, "Title\nmore"), ("MP/exams/e.pdf", "2", 2, None), ("MP/basic/short.pdf", "3", 2, None),
        ("../x.pdf", "4", 30, None), ("bare.pdf", "5", 30, None), ("XX/basic/a.pdf", "6", 30, None), ("MP/foo/a.pdf", "7", 30, None), ("MP/basic/a.txt", "8", 30, None),
        ("MP/basic/b`.pdf", "9", 30, None), ("MP/slides/h.pdf", "held", 3, None), ("MP/slides/u.pdf", "10", None, None),
    ]
    held = spark.createDataFrame([("held",)], "sha256 string")
    got = {x.path: (x.status, x.reason) for x in C.drop_outcomes(spark.createDataFrame(rows, "path string, sha256 string, pages int, sidecar string"), held).collect()}
    assert got["GI/basic/a.pdf"] == ("accepted", None) and got["MP/basic/a.pdf"] == ("duplicate", None) and got["MP/exams/e.pdf"] == ("stored", None)
    assert got["MP/basic/short.pdf"] == ("rejected", "too short") and got["MP/slides/h.pdf"] == ("duplicate", None) and got["MP/slides/u.pdf"] == ("rejected", "unreadable")
    assert [got[p][1] for p in ("../x.pdf", "bare.pdf", "XX/basic/a.pdf", "MP/foo/a.pdf", "MP/basic/a.txt", "MP/basic/b`.pdf")] == ["outside", "shape", "course", "kind", "suffix", "characters"]


def test_kinds_and_filing(spark):
    rows = [("courses/A/slides/raw/x.pdf", "slides", "", "A"), ("courses/A/notes/y.pdf", "notes", "Y", "A"), ("courses/A/odd/z.pdf", "odd", "Z", "A"), (None, "notes", "N", "A")]
    intake = spark.createDataFrame(rows, "path string, kind string, title string, course string")
    assert {(x.path, x.tier) for x in C.staged(intake).collect()} == {(rows[0][0], 5), (rows[1][0], 0)}
    assert [x.title for x in C.staged(intake, files=intake.where("kind = 'notes'")).collect()] == ["Y"] and C.staged(intake, ("slides",)).count() == 1
    with pytest.raises(Exception, match="unknown kind"):
        intake.select(C.kind_tier(F.col("kind")).alias("tier")).collect()
    paths = spark.createDataFrame([("A/basic/b.pdf",), ("A/slides/s.pdf",)], "path string")
    assert [x.d for x in paths.select(C.destination(F.col("path")).alias("d")).collect()] == ["courses/A/literature/b.pdf", "courses/A/raw/slides/s.pdf"]
    o = spark.createDataFrame([("A/basic/b.pdf", "accepted", None, "B"), ("B/extra/b.pdf", "duplicate", None, "B"), ("A/exams/e.pdf", "duplicate", None, "E"), ("A/basic/c.pdf", "rejected", "suffix", "C")], "path string, status string, reason string, title string")
    held = spark.createDataFrame([("A", "b.pdf")], "course string, filename string")
    assert [(x.course, x.tier, x.filename) for x in C.new_entries(o, held).collect()] == [("B", 1, "b.pdf")]
    assert {(x.status, x.reason): x.files for x in C.outcome_totals(o).collect()} == {("accepted", ""): 1, ("duplicate", ""): 2, ("rejected", "suffix"): 1}


def test_store(spark, tmp_path):
    chunks = spark.createDataFrame([("1", "a", True, "", "p", ""), ("2", "a", False, "1", "x", "A"), ("3", "b", True, "", "q", "")], "chunk_id string, book_slug string, is_parent boolean, parent_id string, text string, breadcrumb string")
    path = f"file://{tmp_path}"
    store.write_chunks(chunks, f"{path}/chunks")
    store.write_chunks(chunks.where("book_slug = 'b'").withColumn("text", F.lit("new")), f"{path}/chunks")
    assert {(x.chunk_id, x.text) for x in store.read_chunks(spark, f"{path}/chunks").collect()} == {("1", "p"), ("2", "x"), ("3", "new")}
    assert store.read_chunks(spark, f"{path}/chunks", "b").count() == 1
    vectors = spark.createDataFrame([("2", [1.0, 0.0])], "id string, vector array<float>")
    assert store.build_index(chunks, vectors, f"{path}/index") == (1, 2)
    assert spark.read.parquet(f"{path}/index/children").first()["text"] == "A\n\nx"
    assert store.build_index(chunks.where("is_parent"), vectors, f"{path}/none") == (0, 2) and not (tmp_path / "none").exists()
    store.publish({"t": chunks}, f"{path}/pub", "r1")
    store.publish({"t": chunks.limit(1)}, f"{path}/pub", "r2")
    assert store.recorded(spark, f"{path}/nowhere") is None and store.recorded(spark, f"{path}/pub") == "r2"
    assert store.pull(spark, f"{path}/pub", "t", "r1", f"{path}/mine").count() == 3 and store.recorded(spark, f"{path}/mine") == "r1"
    assert store.pull(spark, f"{path}/pub", "t", to=f"{path}/mine").count() == 3  # what is recorded, not the newest
    assert store.build_index(chunks.withColumn("chunk_id", F.concat("chunk_id", F.lit("b"))), vectors, f"{path}/index", append=True) == (1, 2)
    children, parents = store.open_index(spark, f"{path}/index")
    assert children.count() == 2 and parents.count() == 4 and store.open_index(spark, f"{path}/none") == (None, None)
    store.manifest_json(chunks, f"{path}/manifest")
    assert {x.book_slug: x.chunks for x in store.read_manifest(spark, f"{path}/manifest").collect()} == {"a": 2, "b": 1} and store.read_manifest(spark, f"{path}/gone").count() == 0
    assert store.listed_chunks(chunks, store.read_manifest(spark, f"{path}/manifest").where("chunks > 1")).count() == 2
    assert store.pull(spark, f"{path}/pub", "t").count() == 1 and store.pull(spark, f"{path}/pub", "t", "r1").count() == 3
    assert len(store.publish_patterns(True)) == 5 + 28 and store.publish_patterns()[-1] == "derived/manifest.json"
    sources = spark.createDataFrame([("a", "x"), ("b", "y")], "slug string, sha256 string")
    assert store.undone(sources, spark.createDataFrame([("a", "nokey")], "slug string, stage_key string"), {"k": 1}).count() == 2
