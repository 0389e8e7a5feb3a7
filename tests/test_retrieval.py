import math

import numpy as np
from pyspark.sql import functions as F

from folioscope.operators import encode
from folioscope.operators import retrieval as R


def test_bm25_against_brute_force(spark):
    docs = [("a", "the cat sat"), ("b", "the dog sat sat"), ("c", "birds"), ("d", None), ("e", "")]
    got = R.bm25(spark.createDataFrame([("q", "sat cat sat"), ("none", "zebra")], "qid string, text string"), spark.createDataFrame(docs, "id string, text string"), 5)
    got = {(x.qid, x.id): (x.score, x["rank"]) for x in got.collect()}
    words = {k: t.split() for k, t in docs if t is not None}
    mean = sum(map(len, words.values())) / len(words)

    def score(term, w):
        df = sum(term in x for x in words.values())
        tf = w.count(term)
        return math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) if tf else 0

    expected = {k: round(sum(score(t, w) for t in ("sat", "cat")), 6) for k, w in words.items() if {"sat", "cat"} & {*w}}
    assert {k: v[0] for (q, k), v in got.items()} == expected and got["q", "a"][1] == 1


def test_nearest_against_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, [0.0] * 8), (901, None), (902, [1.0]), (903, [float("nan")] * 8)]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    got = R.nearest(v.where("id % 50 = 0 or id = 7").withColumnRenamed("id", "qid"), v, 5, 8).collect()
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    for q in (0, 7, 50, 250):
        s = np.round(u @ u[q], 6)
        s[q] = -9
        assert [g.id for g in sorted(got, key=lambda g: g["rank"]) if g.qid == q] == list(np.lexsort((np.arange(300), -s))[:5])
    assert R.nearest(v.where("false").withColumnRenamed("id", "qid"), v, 5, 8).count() == 0


def test_fusion_and_expansion(spark):
    leg = lambda *rows: spark.createDataFrame([("q", i, n) for n, i in enumerate(rows, 1)], "qid string, id string, rank int")
    f = {x.id: x.score for x in R.fused([leg("a", "b"), leg("b", "c")], 8).collect()}
    assert f == {"a": round(1 / 61, 8), "b": round(1 / 62 + 1 / 61, 8), "c": round(1 / 62, 8)}
    matches = spark.createDataFrame([("q", "x", 0.9, 1), ("q", "y", 0.8, 2), ("q", "o", 0.7, 3)], "qid string, id string, score double, rank int")
    children = spark.createDataFrame([("x", "P"), ("y", "P"), ("o", "gone")], "chunk_id string, parent_id string")
    parents = spark.createDataFrame([("P",)], "chunk_id string")
    got = sorted((x["rank"], x.chunk_id, x.matched) for x in R.expanded(matches, children, parents).collect())
    assert got == [(1, "P", "x"), (3, "o", None)]


def test_reading_on(spark):
    rows = [("s", True, 0, "P", ""), ("s", False, 1, "c1", "P"), ("s", False, 2, "c2", "P"), ("s", True, 3, "Q", ""), ("t", False, 0, "o", "gone")]
    c = spark.createDataFrame(rows, "book_slug string, is_parent boolean, seq int, chunk_id string, parent_id string")
    n = {x.chunk_id: (x.previous, x.following) for x in R.neighbours(c).collect()}
    assert n == {"P": (None, "Q"), "Q": ("P", None), "c1": (None, "c2"), "c2": ("c1", None), "o": (None, None)}
    ids = spark.createDataFrame([("c2",), ("o",), ("nobody",), ("P",)], "chunk_id string")
    f = {x.asked: (x.chunk_id, x.matched, x.following) for x in R.fetched(ids, c).collect()}
    assert f == {"c2": ("P", "c2", "Q"), "o": ("o", None, None), "P": ("P", None, "Q")}
    assert R.located(ids, c).count() == 3


def test_courses_and_encoder(spark):
    c = spark.createDataFrame([("a", ["MP"]), ("b", None), ("c", ["MPX"])], "chunk_id string, courses array<string>")
    assert [x.chunk_id for x in R.of_course(c, "MP").collect()] == ["a"] and R.of_course(c, "").count() == 3 and R.of_course(c, "%").count() == 0
    v = {x.id: x.vector for x in encode.encoded(spark.createDataFrame([("a", "x y x"), ("b", ""), ("c", None)], "id string, text string")).collect()}
    assert abs(np.linalg.norm(v["a"]) - 1) < 1e-6 and set(v["b"]) == {0.0} and v["c"] is None


def test_hashed_words_in_columns_and_in_lists(spark):
    texts = ["The the cat", "", "¡Ñandú 12!", "a b c d e f g h"]
    got = {x.id: x.vector for x in encode.hashed_words(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(9, None)], "id int, text string")).collect()}
    want = encode.HashedWords().encode(texts)
    assert got[9] is None and all(np.allclose(got[i], want[i], atol=1e-6) for i in range(4)) and set(got[1]) == {0.0}


def test_search_and_fetch(spark, tmp_path):
    import pytest

    from folioscope.operators import store

    rows = [("p1", "s", True, 0, "", "Rivers carry water to the sea", "Book > Rivers", 1, 2, ["MP"]), ("c1", "s", False, 1, "p1", "Rivers carry water", "Book > Rivers", 1, 1, ["MP"]), ("c2", "s", False, 2, "p1", "to the sea", "Book > Rivers", 2, 2, ["MP"]), ("c3", "t", False, 0, "gone", "Cats sleep", "", 5, 5, None)]
    c = spark.createDataFrame(rows, "chunk_id string, book_slug string, is_parent boolean, seq int, parent_id string, text string, breadcrumb string, page_start int, page_end int, courses array<string>")
    path = f"file://{tmp_path}/index"
    assert R.search(spark, path, "rivers").count() == 0  # no index yet
    vectors = encode.hashed_words(c.where("not is_parent").select(F.col("chunk_id").alias("id"), "text"))
    assert store.build_index(c, vectors, path) == (3, 1)
    first = R.search(spark, path, "rivers carry water").first()
    assert first["chunk_id"] == "p1" and first["matched"] == "c1" and first["matched_text"] == "Rivers carry water" and first["citation"] == "Book > Rivers, pp. 1-2" and first["text"].endswith("sea")
    plain = R.search(spark, path, "rivers carry water", expand=False, k=1).collect()
    assert [(x.chunk_id, x.text, x.matched_text) for x in plain] == [("c1", "Rivers carry water", "")]
    assert {x.chunk_id for x in R.search(spark, path, "cats sleep", course="MP").collect()} <= {"p1"} and R.search(spark, path, "cats", course="??").count() == 0
    assert R.fetch(c, "c2").first()["chunk_id"] == "p1"
    with pytest.raises(ValueError):
        R.fetch(c, "nobody")
