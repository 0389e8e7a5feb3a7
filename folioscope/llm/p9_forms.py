"""Problem 9: one consistent form of texts that look the same.

The form is the compatibility normal form, composed, with these changes, which the problem's
statement asks for: letter case, superscripts and subscripts, and line breaks stay as they are,
because they are visible. Full case folding is a parameter (off), since folding would equate texts
that look different. Letters of another script become Latin only inside a word that also has a
Latin letter; a lone Greek symbol stays Greek.

Nulls give null, the empty text gives the empty text. Equal texts give equal forms.
"""

from __future__ import annotations

import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from ..session import written

# Ranges of code points that Unicode calls default-ignorable.
IGNORABLE = [
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
]
# Hyphens of the length of the ordinary one.
HYPHENS = [0x2010, 0x2011, 0x2012, 0x2043, 0x2212, 0xFE63, 0xFF0D]
# White space of one character that is no line break.
SPACES = [0x9, 0xB, 0xC, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
# Letters of other scripts and the Latin letters that they look like.
LOOKALIKES = {
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s",
    "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ӏ": "I",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C",
    "օ": "o", "ս": "u", "հ": "h", "ո": "n",
}

_KEPT = "".join(
    c for c in map(chr, range(0xA0, sys.maxunicode + 1)) if unicodedata.decomposition(c).startswith(("<super>", "<sub>"))
)
_NOT_KEPT = re.compile(f"[^{re.escape(_KEPT)}]+")
_DROP = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in IGNORABLE) + "]")
_CHARS = str.maketrans(dict.fromkeys(HYPHENS, "-") | dict.fromkeys(SPACES, " ") | {0x2028: "\n", 0x2029: "\n\n", 0x85: "\n"})
_LOOK = re.compile(f"[{''.join(LOOKALIKES)}]")
_LATIN = re.compile("[A-Za-z\u00aa\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]")
_WORD = re.compile("[^\\W\\d_](?:[^\\W\\d_]|[\u0300-\u036f])*")
# Characters that are their own form whatever stands beside them, as no combining mark is among them.
_PLAIN = re.compile("[\n -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff\u00b2\u00b3\u00b9\u03b2-\u03b8\u03bb\u03bc\u03be\u03c0\u03c3\u03c4\u03c6-\u03c9\u00ab\u00bb\u00bf\u00a1]*")
_TO_LATIN = str.maketrans(LOOKALIKES)


def _latin(word: re.Match) -> str:
    w = word.group()
    return w.translate(_TO_LATIN) if _LATIN.search(w) else w


def form_of(text: str | None, fold: bool = False) -> str | None:
    """The consistent form of one text."""
    if text is None:
        return None
    if _PLAIN.fullmatch(text):
        return text.casefold() if fold else text
    if not text.isascii():
        text = _DROP.sub("", text).translate(_CHARS)
        text = _NOT_KEPT.sub(lambda m: unicodedata.normalize("NFKD", m.group()), text).translate(_CHARS)
        if _LOOK.search(text):
            text = _WORD.sub(_latin, text)
        text = unicodedata.normalize("NFC", text)
    else:
        text = text.translate(_CHARS)
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    return text.casefold() if fold else text


def forms_of(texts: pd.Series, fold: bool = False) -> pd.Series:
    """The forms of a batch, each distinct text handled once."""
    codes, distinct = pd.factorize(texts, use_na_sentinel=True)
    done = [form_of(t, fold) for t in distinct]
    return pd.Series([None if c < 0 else done[c] for c in codes], index=texts.index, dtype=object)


@pandas_udf(StringType())
def consistent_form(texts: pd.Series) -> pd.Series:
    return forms_of(texts)


@pandas_udf(StringType())
def folded_form(texts: pd.Series) -> pd.Series:
    return forms_of(texts, fold=True)


def consistent_texts(documents: DataFrame, text: str = "text", out: str = "form", fold: bool = False) -> DataFrame:
    """documents with the column out added (replaced, if there is one of that name)."""
    return documents.withColumn(out, (folded_form if fold else consistent_form)(F.col(text)))


def same_looking(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of documents that look the same: doc_id, form_id, text_id, of every document with a text.

    form_id and text_id are SHA-256 of the form and of the text itself.
    """
    return consistent_texts(documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()), text, "_form").select(
        F.col(doc_id).alias("doc_id"), F.sha2("_form", 256).alias("form_id"), F.sha2(text, 256).alias("text_id")
    )


def same_looking_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class_id (the smallest doc_id of those that look the same), texts (how many differ in their characters),
    documents, of every document with a text: one row each, however large a class is."""
    d = written(same_looking(documents, doc_id, text).distinct())
    # copies of one text are counted before anything else
    texts = d.groupBy("form_id", "text_id").agg(F.min("doc_id").alias("least"), F.count_distinct("doc_id").alias("n"))
    classes = texts.groupBy("form_id").agg(F.min("least").alias("class_id"), F.count("*").alias("texts"), F.sum("n").alias("documents"))
    return d.join(classes, "form_id").groupBy("doc_id").agg(F.min(F.struct("class_id", "texts", "documents")).alias("c")).select("doc_id", "c.*")


def same_looking_pairs(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs doc_id_a < doc_id_b whose texts differ in their characters but have one form, as the query of the problem asks;
    same_looking_classes has the same without pairs.

    Copies of one text make no pair. Forms with one text only, however many copies it has, are left
    out by an aggregate before anything is joined, so no pairs inside a group of copies are made.
    """
    d = written(same_looking(documents, doc_id, text).distinct())  # three reads follow
    mixed = (
        d.groupBy("form_id").agg(F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("lo <> hi").select("form_id")
    )
    d = d.join(mixed, "form_id", "left_semi")
    a, b = d.alias("a"), d.alias("b")
    return (
        a.join(b, F.expr("a.form_id = b.form_id and a.text_id <> b.text_id and a.doc_id < b.doc_id"))
        .select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b"))
        .distinct()
    )
