import pytest

from folioscope.llm import p9_forms as P


@pytest.mark.parametrize(
    "a, b",
    [
        ("ｔｒａｉｌ　１", "trail 1"), ("café", "café"), ("a​b­c﻿", "abc"), ("a b c", "a b c"), ("co‐op", "co-op"), ("ﬁn", "fin"),
        ("pоrta", "porta"), ("пор", "пор"), ("óptimo", "όptimo"), ("a\r\nb", "a\nb"), ("Ω", "Ω"),
    ],
)
def test_looks_the_same(a, b):
    assert P.form_of(a) == P.form_of(b) and P.form_of(P.form_of(a)) == P.form_of(a)


@pytest.mark.parametrize("a, b", [("a", "A"), ("x²", "x2"), ("a\nb", "a b"), ("café", "cafe"), ("1", "l"), ("a b", "ab"), ("ο", "o"), ("ε", "e")])
def test_looks_different(a, b):
    assert P.form_of(a) != P.form_of(b)


def test_options_and_nulls():
    assert P.form_of("Straße", fold=True) == "strasse" and P.form_of(None) is None and P.form_of("") == ""
    for c in map(chr, [*range(0x20, 0x7F), *range(0xC0, 0x100), 0x3B5]):  # the short way agrees with the long one
        assert P.form_of(c) == P.form_of("​" + c)


def test_pairs(spark):
    rows = [(1, "café", "x"), (2, "café", "x"), (3, "café", "x"), (4, "Café", "x"), (5, None, "x"), (6, "", "x"), (7, "​", "x"), (None, "café", "x"), (2, "café", "x")]
    rows += [(100 + i, "copy", "x") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form_id string")
    assert {(x.doc_id_a, x.doc_id_b) for x in P.same_looking_pairs(df).collect()} == {(1, 2), (2, 3), (6, 7)}
    assert P.same_looking_pairs(df.where("false")).count() == 0
    forms = {x.doc_id: x.form for x in P.consistent_texts(df).collect()}
    assert forms[2] == "café" and forms[5] is None and forms[6] == "" == forms[7]


def test_a_long_text():
    assert len(P.form_of("é́x​" * 200_000)) == 600_000


def test_classes(spark):
    rows = [(1, "ﬁne"), (2, "fine"), (3, "fine"), (4, "Fine"), (5, None), (None, "fine"), (6, ""), (2, "fine")]
    got = {x.doc_id: (x.class_id, x.texts, x.documents) for x in P.same_looking_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 2, 3), 2: (1, 2, 3), 3: (1, 2, 3), 4: (4, 1, 1), 6: (6, 1, 1)}
    assert P.same_looking_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
