"""Encoders: texts to vectors, a batch at a time. Any object with encode(list of str) -> rows will do."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


class Encoder(Protocol):
    def encode(self, sentences: Sequence[str]) -> np.ndarray: ...


def hashed_words(texts: DataFrame, size: int = 64) -> DataFrame:
    """id, vector of texts (id, text): signed counts of hashed words, of unit length. An encoder without a model, in columns; a
    text without words has the zero vector, a null text a null one."""
    words = texts.where("id is not null").select("id", F.explode(T.words(F.col("text"))).alias("word"))
    h = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long")
    counts = words.withColumn("h", h).groupBy("id", (F.col("h") % size).cast("int").alias("at")).agg(F.sum(F.when(F.col("h") >= 1 << 31, 1).otherwise(-1)).alias("n"))
    norm = F.sqrt(F.sum(F.col("n") * F.col("n")))
    rows = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("n"), norm.alias("norm"))  # at most size entries
    at = lambda p: F.coalesce(F.try_element_at("n", p), F.lit(0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    vector = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda p: F.coalesce(at(p), F.lit(0.0)).cast("float"))
    return texts.join(rows, "id", "left").select("id", F.when(F.col("text").isNotNull(), vector).alias("vector"))


class HashedWords:
    """The vectors of hashed_words for a list of texts, such as one question."""

    def __init__(self, size: int = 64):
        self.size = size

    def encode(self, sentences: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(sentences), self.size), np.float32)
        for row, text in zip(out, sentences):
            words, counts = np.unique(re.findall(r"[^\W_]+", text.lower()), return_counts=True)
            h = np.array([int(hashlib.md5(w.encode()).hexdigest()[:8], 16) for w in words.tolist()], np.int64)
            np.add.at(row, h % self.size, counts * np.where(h >> 31, 1, -1))
        norms = np.linalg.norm(out, axis=1)
        return out / np.where(norms == 0, 1, norms)[:, None]


def encoded(texts: DataFrame, make: Callable[[], Encoder] = HashedWords, batch: int = 256) -> DataFrame:
    """id, vector of texts (id, text); a null text has a null vector. make is called once a task, where the model loads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = make()
        for pdf in batches:
            for s in range(0, len(pdf), max(1, batch)):
                part = pdf.iloc[s : s + max(1, batch)]
                vectors = list(encoder.encode([t or "" for t in part["text"]]))
                yield pd.DataFrame({"id": part["id"], "vector": [None if t is None else v.tolist() for t, v in zip(part["text"], vectors)]})

    return texts.select("id", "text").mapInPandas(run, f"id {dict(texts.dtypes)['id']}, vector array<float>")
