import random

from pyspark.sql import functions as F

from folioscope.functions.ordered import running
from folioscope.operators import blocks as B
from folioscope.operators import segments as S

BLOCK = "slug string, ord int, type string, page int, text string, text_level int, img_path string, caption string, table_body string"


def test_running_values_match_plain_loops(spark):
    r = random.Random(1)
    rows = [(k, i, r.choice([None, 1, 2, 5, -3])) for k in ("a", "b") for i in range(100)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = running(df, ["k"], ["i"], {"s": ("sum", F.col("v")), "m": ("min", F.col("v")), "l": ("last", F.col("v")), "p": ("prev", F.col("v")), "n": ("next", F.col("v"))}, bucket=7)
    got = {(x.k, x.i): x for x in got.collect()}
    for key in ("a", "b"):
        own = [v for k, _, v in rows if k == key]
        for i in range(100):
            seen = [v for v in own[: i + 1] if v is not None]
            x = got[key, i]
            assert x.s == sum(seen) and x.m == min(seen, default=None) and x.l == (seen[-1] if seen else None)
            assert x.p == (own[i - 1] if i else None) and x.n == (own[i + 1] if i < 99 else None)


def test_trails_match_a_stack(spark):
    r = random.Random(2)
    rows, expected = [], {}
    for book in "abc":
        stack = []
        for i in range(1, 80):
            d = r.randint(1, 6)
            del stack[d - 1 :]
            stack.append(f"{book}{i}")
            rows.append((book, i, d, f"{book}{i}"))
            expected[book, i] = list(stack)
    df = spark.createDataFrame(rows, "slug string, section_no long, depth int, title string")
    assert {(x.slug, x.section_no): x.trail for x in S.trails(df).collect()} == expected


def test_packing_matches_a_loop(spark):
    r = random.Random(3)
    rows = [(k, i, r.choice([1, 30, 100, 300, 500])) for k in range(5) for i in range(60)]
    got = S.packed(spark.createDataFrame(rows, "k int, i int, c int"), ["k"], ["i"], F.col("c"), 350, "g")
    got = {(x.k, x.i): x.g for x in got.collect()}
    for k in range(5):
        g = used = 0
        for _, i, c in [x for x in rows if x[0] == k]:
            if i and used + c > 350:
                g, used = g + 1, 0
            used += c
            assert got[k, i] == g


def test_packing_of_a_long_key_in_buckets(spark):
    r = random.Random(5)
    rows = [("long", i, i % 2, r.choice([1, 30, 100, 300, 500]), "x" * 9) for i in range(400)] + [("short", 0, 0, 400, ""), (None, 1, 0, 5, ""), ("late", 395, 0, 9, "")]
    df = spark.createDataFrame(rows, "k string, i int, j int, c int, text string")
    got = S.packed(df, ["k"], ["i", "j"], F.col("c"), 350, "g", bucket=30)
    assert got.columns == ["k", "i", "j", "c", "text", "g"]
    got = {(x.k, x.i): x.g for x in got.collect()}
    g = used = 0
    for k, i, _, c, _ in rows[:400]:
        if used and used + c > 350:
            g, used = g + 1, 0
        used += c
        assert got[k, i] == g
    assert got["short", 0] == got["late", 395] == 0 and len(got) == 402


def blocks(spark, rows):
    full = [(s, o, t, p, x, lv, "", cap, tb) for s, o, t, p, x, lv, cap, tb in rows]
    return spark.createDataFrame(full, BLOCK)


def test_a_small_book(spark):
    b = blocks(spark, [
        ("s", 0, "text", 0, "1 One", 2, "", ""),
        ("s", 1, "header", 0, "running", None, "", ""),
        ("s", 2, "text", 0, "Alpha\n\nBeta", None, "", ""),
        ("s", 3, "text", 1, "Section 9.2", None, "", ""),
        ("s", 4, "equation", 1, "$$x$$", None, "", ""),
        ("s", 5, "text", 2, "1.1 Two", 2, "", ""),
        ("s", 6, "table", 2, None, None, "Cap", "<table><tr><td>a</td></tr></table>"),
        ("s", 7, "text", 2, "  ", None, "[]", None),
    ])
    outline = spark.createDataFrame([("s", 0, "Lost", 1, 1), ("s", 1, "1.1 two", 3, 2)], "slug string, ord int, title string, depth int, page int")
    assert {(x.ord, x.page) for x in B.page_turns(b).collect()} == {(0, 0), (4, 1), (5, 2)}
    assert [(x.ord, x.title, x.depth) for x in B.injected_headings(b, outline).collect()] == [(4, "Lost", 1)]
    assert {x.ord: x.depth for x in B.heading_depths(b, outline).collect()} == {0: 1, 5: 3}
    body = S.sectioned(S.pieces(b, outline), spark.createDataFrame([("s", "Book")], "slug string, title string"))
    found = sorted((x.ord, x.sub, x.text, x.atomic, x.breadcrumb) for x in body.collect())
    assert found == [
        (2, 0, "Alpha", False, "Book > 1 One"),
        (2, 1, "Beta", False, "Book > 1 One"),
        (4, 0, "$$x$$", True, "Book > Lost"),
        (6, 0, "Cap", False, "Book > Lost > 1.1 Two"),
        (6, 1, "| a |\n|---|", True, "Book > Lost > 1.1 Two"),
    ]
    chunks = S.section_chunks(body).collect()
    parents = {c.chunk_id for c in chunks if c.is_parent}
    assert len(parents) == 3 and all(c.parent_id in parents for c in chunks if not c.is_parent)
    runs = S.run_chunks(body).collect()
    assert [c.text.split("\n")[0] for c in runs if c.is_parent] == ["Alpha"] and sum(not c.is_parent for c in runs) == 3


def test_empty_tables(spark):
    b = blocks(spark, [("s", 0, "text", 0, "x", None, "", "")]).where("false")
    outline = spark.createDataFrame([], "slug string, ord int, title string, depth int, page int")
    meta = spark.createDataFrame([], "slug string, titles array<string>, tier int, courses array<string>")
    assert S.book_chunks(b, outline, meta).count() == 0
