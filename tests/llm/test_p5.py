import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import p5_pieces as P
from folioscope.llm import queries as Q


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n!é́", max_size=400), st.integers(1, 60), st.integers(0, 20))
def test_pieces_give_the_text_again(text, room, overlap):
    cut = P.split_text(text, room, overlap)
    assert "".join(text[o:e] for _, o, e in cut) == text
    assert all(s <= o <= e and e - s <= room for s, o, e in cut)
    assert all(a[2] == b[1] for a, b in zip(cut, cut[1:]))


def test_cuts_lie_at_the_change_of_subject():
    a = " ".join(f"The cat and the dog saw the cat near dog number {i}." for i in range(8))
    b = " ".join(f"Rivers carry water to oceans where rivers end with water {i}." for i in range(8))
    cut = P.split_text(f"{a} {b}", 560, 40)
    assert any(e == len(a) + 1 for _, _, e in cut)


def test_rows(spark):
    rows = [
        ("big", "Crumb", "A sentence of words. " * 100, False, 1, "x"), ("big", "Crumb", "A sentence of words. " * 100, False, 1, "x"), ("fits", None, "x" * 1403, False, None, "x"),
        ("over", "", "x" * 1404, False, None, "x"), ("parent", "", "word " * 1000, True, None, "x"), ("large parent", "", "word\n" * 2000, True, None, "x"), ("null", "a", None, False, 1, "x"),
        ("empty", "a" * 5000, "", False, 1, "x"), ("crumbs", "c" * 2000, "y " * 1000, None, 1, "x"), (None, "", "x" * 9999, False, 1, "x"),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, breadcrumb string, text string, is_parent boolean, tokens int, piece_no string")
    got = {}
    for x in P.split_chunks(df).collect():
        got.setdefault(x.chunk_id, []).append(x)
    assert set(got) == {"big", "over", "large parent", "crumbs"}
    for key, pieces in got.items():
        pieces.sort(key=lambda x: x.piece_no)
        text = next(r[2] for r in rows if r[0] == key)
        assert "".join(text[x.own_start : x.end] for x in pieces) == text
        assert all(x.tokens <= (2000 if key == "large parent" else 350) and x.pieces == len(pieces) for x in pieces)
    assert all(x.text.startswith("Crumb\n\n") for x in got["big"])
    shared = [a.end - b.start for a, b in zip(got["big"], got["big"][1:])]
    assert all(100 < n <= 160 for n in shared)
    assert P.split_chunks(df.where("false")).count() == 0


def test_long_breadcrumbs(spark, tmp_path):
    rows = [
        ("child", "c" * 900, "y " * 300, False), ("parent", "c" * 5000, "word " * 800, True), ("no room", "c" * 1398, "short", False),
        ("least room", "c" * 1397, "seven words", False), ("empty", "c" * 5000, "", False), ("fits", "c" * 900, "y " * 250, False),
    ]
    df = spark.createDataFrame(rows, "chunk_id string, breadcrumb string, text string, is_parent boolean")
    got = {}
    for x in P.split_oversized(df).collect():
        got.setdefault(x.chunk_id, []).append(x)
    assert set(got) == {"child", "parent", "no room", "least room", "empty"}
    for key, crumb, text, parent in rows[:-1]:
        pieces = sorted(got[key], key=lambda x: x.piece_no)
        head = f"{crumb}\n\n" if key in ("child", "parent") else "… " + "c" * 916 + "\n\n"  # shortened from its front to leave 480 characters
        assert "".join(text[x.own_start : x.end] for x in pieces) == text and [x.piece_no for x in pieces] == list(range(pieces[0].pieces))
        assert all(x.text == head + text[x.start : x.end] and x.tokens <= (2000 if parent else 350) for x in pieces)
    df.write.parquet(str(tmp_path / "chunk.parquet"))
    assert {x.chunk_id for x in Q.p5_found(spark, str(tmp_path)).collect()} == set(got)
    assert {x.chunk_id for x in Q.p5_split(spark, str(tmp_path)).collect()} == set(got)


def test_headings():
    assert P.heading(None, 1400, 160) == P.heading("", 1400, 160) == "" and P.heading("c" * 918, 1400, 160) == "c" * 918 + "\n\n"
    assert P.heading("Book > " + "c" * 1000 + " > Part > End", 1400, 160) == "… Part > End\n\n"
    assert all(len(P.heading("abc > " * 50, n, 16)) < n for n in range(8, 300))


def test_many_pieces_leave_in_slices(monkeypatch):
    monkeypatch.setattr(P, "SLICE", 400)
    batch = pd.DataFrame([("k", "c" * 90, "word " * 40, False)], columns=["chunk_id", "breadcrumb", "text", "is_parent"])
    out = list(P._pieces((25, 50), 10, 3)([batch]))
    assert len(out) > 1 and all(len(x) <= 4 for x in out)
    assert [n for x in out for n in x["piece_no"]] == list(range(out[0]["pieces"][0]))
