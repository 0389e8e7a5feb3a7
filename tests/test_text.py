import hashlib

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "html, expected",
    [
        ("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td></tr></table>", "| a | b |\n|---|---|\n| 1 |  |"),
        ("<table><tr><th> x </th></tr></table>", "| x |\n|---|"),
        ('<table><tr><td colspan="2">a</td></tr></table>', '<table><tr><td colspan="2">a</td></tr></table>'),
        ("  no table ", "no table"),
        ("", ""),
    ],
)
def test_tables(spark, html, expected):
    assert one(spark, T.table_markdown(F.col("h")), h=html) == expected


@pytest.mark.parametrize("text, depth", [("9.1.1 Title", 3), ("9. Title", 1), ("2006 Elections", 1), ("Exercises", 2), ("3.", 2)])
def test_numbering(spark, text, depth):
    assert one(spark, T.numbering_depth(F.col("t")), t=text) == depth


@pytest.mark.parametrize(
    "path, slug",
    [("courses/GI/raw/exams/tema-1/Hoja1.pdf", "gi-exams-tema-1-hoja1"), ("a/b.tar.pdf", "a-b.tar"), ("", ""), ("raw", ""), ("courses/x/.hidden", "x-.hidden")],
)
def test_slugs(spark, path, slug):
    assert one(spark, T.path_slug(F.col("p")), p=path) == slug


def test_small_functions(spark):
    assert one(spark, T.file_title(F.col("p")), p="x/intro_to-SETS.pdf") == "Intro To Sets"
    assert one(spark, T.caption_text(F.col("c")), c=" [] ") == ""
    assert one(spark, T.without_controls(F.col("c")), c="a\x00b\tc\nd\x7f") == "ab\tc\nd"
    assert one(spark, T.without_scripts(F.col("c")), c="di<sub>ag</SUB>o") == "diago"
    assert one(spark, T.token_estimate(F.col("c")), c="abc") == 1
    assert one(spark, T.citation(F.lit("A > B"), F.lit(3), F.lit(3)), c="") == "A > B, p. 3"
    assert one(spark, T.citation(F.lit("A"), F.lit(3), F.lit(5)), c="") == "A, pp. 3-5"
    assert one(spark, T.embedding_text(F.lit(""), F.col("c")), c="t") == "t"
    expected = hashlib.sha256(b"s:child:1-2:t\xc3\xa9xt").hexdigest()[:16]
    assert one(spark, T.content_id(F.lit("s"), F.lit(False), F.lit(1), F.lit(2), F.col("c")), c="téxt") == expected


@pytest.mark.parametrize("text, note", [("Section 9.2", True), ("Ejercicio 4.", True), ("Section 9.2 says", False), ("", False)])
def test_margin_notes(spark, text, note):
    assert one(spark, T.is_margin_note(F.lit("text"), F.lit(None).cast("int"), F.col("t")), t=text) is note
