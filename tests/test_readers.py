import json

from folioscope.sources import readers


def test_readers(spark, tmp_path):
    (tmp_path / "b_content_list.json").write_text(json.dumps([{"type": "image", "page_idx": 2, "image_caption": ["A", "b"], "img_path": "x.png"}, {"text": "h", "text_level": 0}, {"type": "table", "table_caption": "[]"}]))
    b = {x.ord: x for x in readers.content_lists(spark, f"file://{tmp_path}/*_content_list.json").collect()}
    assert b[0].slug == "b" and b[0].caption == "A b" and b[0].page == 2 and b[1].text_level == 0 and b[1].type == "text" and b[2].caption == "" and b[2].text_level is None
    (tmp_path / "MP").mkdir()
    (tmp_path / "MP/literature.md").write_text("## x\n")
    assert [tuple(x) for x in readers.ledgers(spark, f"file://{tmp_path}/*/literature.md").select("course", "ln", "line").collect()] == [("MP", 0, "## x")]
    (tmp_path / "intake.json").write_text('{"files": [{"path": "a/b.pdf", "kind": "notes"}]}')
    (tmp_path / "intake2.json").write_text("{corrupt")
    assert [x.path for x in readers.intake(spark, f"file://{tmp_path}/intake*.json").collect()] == ["a/b.pdf"]
    (tmp_path / "s.jsonl").write_text('{"chunk_id": "1", "book_slug": "s", "is_parent": true}\n\n{"chunk_id": "2"}\n')
    assert sorted((x.chunk_id, x.seq) for x in readers.chunk_lines(spark, f"file://{tmp_path}/s.jsonl").collect()) == [("1", 0), ("2", 2)]
    (tmp_path / "f.pdf").write_bytes(b"abc")
    f = readers.hashed_files(spark, f"file://{tmp_path}").collect()
    assert len(f) == 1 and f[0].sha256.startswith("ba7816bf") and f[0].bytes == 3
    (tmp_path / "m.meta.json").write_text('{"slug": "s", "tier": 2, "pages": 3}')
    (tmp_path / "n.meta.json").write_text("{broken")
    assert [x.slug for x in readers.sidecars(spark, f"file://{tmp_path}/*.meta.json").collect()] == ["s"]


def test_lines_keep_their_order_over_splits(spark, tmp_path):
    for book in "ab":
        (tmp_path / f"{book}_content_list.jsonl").write_text("\n".join(json.dumps({"text": f"{book} {n} " + "x" * (n % 50), "page_idx": n // 9}) for n in range(700)) + "\n\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        b = readers.block_lines(spark, f"file://{tmp_path}/*.jsonl").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert {(x.slug, x.ord): x.text.split()[:2] for x in b} == {(k, n): [k, str(n)] for k in "ab" for n in range(700)}


def test_digests_of_large_files(spark, tmp_path):
    import hashlib

    body = bytes(range(256)) * 20_000
    (tmp_path / "a b.pdf").write_bytes(body)
    (tmp_path / "empty.pdf").write_bytes(b"")
    got = {x.bytes: x.sha256 for x in readers.hashed_files(spark, f"file://{tmp_path}").collect()}
    assert got == {len(body): hashlib.sha256(body).hexdigest()}  # empty files have no row
