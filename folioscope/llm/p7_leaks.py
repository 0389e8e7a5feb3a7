"""Problem 7: evaluation texts leaking into training text.

The test items are the documents of a BM25 index, the training passages its queries. Words are 64-bit
hashes, counted over all items by Spark. Items lie in shards of about SHARD_WORDS words, of each of
which one task builds an index, and within those in blocks of BLOCK items: for each term the index
holds the largest weight within each block, and the weights themselves only where a block has the
term. A batch of passages is first scored against the block maxima, only blocks that can reach a
threshold are opened, and items of opened blocks are scored exactly (block-max WAND, over batches
instead of one query at a time). The threshold of an item is the least score that any of its windows
of `run` words gives, so no passage that holds such a window falls short of it: nothing is lost by
the pruning. Retrieved pairs are verified by comparing the words (their hashes) one by one.

The driver passes on indexes of about PASS_WORDS words at a time without opening them; all of them are
searched in one pass over the documents. Only where the items have more words are there more passes,
which then read the documents' words as written by the first.

Both texts are brought to the consistent form of problem 9 first; words are maximal runs of letters
and digits of the lower-cased form. Null and empty texts, and items of fewer than `run` words, match
nothing. Rows with a null id are left out; a doc_id or item_id that comes twice counts once.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .p9_forms import forms_of

RUN, K1, B, BLOCK = 12, 1.2, 0.75, 16
#: Words of the items that one index holds (its table of block maxima has at most 40 MB, usually less than one),
#: and of those that one pass over the documents holds.
SHARD_WORDS, PASS_WORDS = 40_000, 640_000
_WORD = re.compile(r"[^\W_]+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pd.Series) -> list[list[str]]:
    return [_WORD.findall(t.lower()) if t else [] for t in forms_of(texts)]


def hashed(words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, one text after the other, and each text's number of words."""
    flat = np.array([*chain.from_iterable(words), ""], dtype=object)
    codes, distinct = pd.factorize(flat)
    return pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[codes][:-1].view(np.int64), np.array([len(w) for w in words], np.int64)


def run_hashes(terms: np.ndarray, run: int) -> np.ndarray:
    """A polynomial hash of the run terms from each position on."""
    n = len(terms) - run + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h, t = np.zeros(n, np.uint64), terms.astype(np.uint64) + np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(run):
            h = h * _FACTOR + (t[k : k + n] ^ (t[k : k + n] << np.uint64(21)))
    return h


@dataclass
class Index:
    """A BM25 index over one shard of items, in blocks of BLOCK items."""

    vocabulary: np.ndarray  # sorted hashes of the terms
    block_max: np.ndarray  # term x block; the last row, of no term, is zero
    held: np.ndarray  # term x blocks + block of the rows of weight, sorted
    weight: np.ndarray  # (term, block) x item of the block; the last row is zero
    least: np.ndarray  # block x item: the threshold of each item
    block_least: np.ndarray
    runs: np.ndarray  # hashes of the items' runs, sorted
    run_item: np.ndarray
    run_at: np.ndarray
    terms: np.ndarray  # the items' terms, one item after the other
    ids: np.ndarray
    run: int


def build_index(ids: list[int], words: list[np.ndarray], dfs: list[np.ndarray], n: int, mean: float, run: int = RUN, block: int = BLOCK) -> Index:
    """The index of items of at least run words. dfs: of each word the number of all n items that have it; mean: their mean length."""
    order = np.argsort(ids, kind="stable")
    ids, words, dfs = np.array(ids, np.int64)[order], [words[k] for k in order], [dfs[k] for k in order]
    length = np.array([len(w) for w in words])
    starts = np.concatenate([[0], np.cumsum(length)])
    vocabulary, terms = np.unique(np.concatenate(words), return_inverse=True)
    m, blocks = len(vocabulary), -(-len(words) // block)
    item = np.repeat(np.arange(len(words)), length)
    pair, first, back, tf = np.unique(terms * len(words) + item, return_index=True, return_inverse=True, return_counts=True)
    df, own = np.concatenate(dfs)[first].astype(np.float64), length[item[first]]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    value = (idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * own / mean))).astype(np.float32)
    t, i = np.divmod(pair, len(words))
    held, row = np.unique(t * blocks + i // block, return_inverse=True)
    weight = np.zeros((len(held) + 1, block), np.float32)
    weight[row, i % block] = value
    block_max = np.zeros((m + 1) * blocks, np.float32)
    block_max[held] = weight[:-1].max(1)
    sums = np.concatenate([[0.0], np.cumsum(value[back].astype(np.float64))])
    least = np.full(blocks * block, np.inf, np.float32)
    for k, (a, z) in enumerate(zip(starts, starts[1:])):
        least[k] = (sums[a + run : z + 1] - sums[a : z + 1 - run]).min() * 0.9999  # for rounding
    hashes = [run_hashes(terms[a:z], run) for a, z in zip(starts, starts[1:])]
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    return Index(
        vocabulary, block_max.reshape(m + 1, blocks), held, weight, least.reshape(blocks, block), least.reshape(blocks, block).min(1), h[order],
        np.repeat(np.arange(len(words)), [len(x) for x in hashes])[order],
        np.concatenate([s + np.arange(len(x)) for s, x in zip(starts, hashes)])[order], terms, ids, run,
    )


def _passages(terms: np.ndarray, run: int) -> np.ndarray:
    """Starts of passages of 2 x run terms, every run'th, over stretches of known terms of at least run."""
    known = np.concatenate([[0], (terms >= 0).astype(np.int8), [0]])
    turns = np.flatnonzero(np.diff(known))
    low, high = turns[::2], turns[1::2]
    low, high = low[high - low >= run], high[high - low >= run]
    count = (high - low - run) // run + 1
    return np.repeat(low, count) + run * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))


def search(index: Index, words: np.ndarray, lengths: np.ndarray, step: int = 4096) -> np.ndarray:
    """(number of the text, item) of each text that shares a run of words with an item. words: hashes, lengths: of each text."""
    run, none, (blocks, block) = index.run, len(index.vocabulary), index.least.shape
    found: list[np.ndarray] = []
    number = np.minimum(np.searchsorted(index.vocabulary, words), none - 1)
    # -1 stands for unknown words, and ends each text
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    terms = np.full(len(owner), -1, np.int64)
    terms[np.arange(len(words)) + np.repeat(np.arange(len(lengths)), lengths)] = np.where(index.vocabulary[number] == words, number, -1)
    starts = _passages(terms, run)
    padded = np.concatenate([terms, np.full(2 * run, -1)])
    hashes = run_hashes(padded, run) if len(starts) else None
    for s in range(0, len(starts), step):
        at = starts[s : s + step]
        passage = padded[at[:, None] + np.arange(2 * run)]
        stop = np.where(np.minimum.accumulate(passage, 1) < 0, none, passage)  # nothing beyond an unknown word
        bound = np.zeros((len(at), blocks), np.float32)
        for k in range(2 * run):
            bound += index.block_max[stop[:, k]]
        p, b = np.nonzero(bound >= index.block_least)
        for q in range(0, len(p), step):
            pp, bb = p[q : q + step], b[q : q + step]
            score = np.zeros((len(pp), block), np.float32)
            for k in range(2 * run):
                key = stop[pp, k] * blocks + bb
                row = np.minimum(np.searchsorted(index.held, key), len(index.held) - 1)
                score += index.weight[np.where(index.held[row] == key, row, len(index.held))]
            i, j = np.nonzero(score >= index.least[bb])
            found.append(_verified(index, hashes, padded, owner, at[pp[i]], bb[i] * block + j))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def _verified(index: Index, hashes, terms, owner, at, item) -> np.ndarray:
    """(text, item) of the pairs of passage and item that share a run: first by the run's hash, then word by word."""
    run = index.run
    where = at[:, None] + np.arange(run + 1)
    h = hashes[np.minimum(where, len(hashes) - 1)]
    low = np.searchsorted(index.runs, h.ravel()).reshape(h.shape)
    hit = index.runs[np.minimum(low, len(index.runs) - 1)] == h
    rows, cols = np.nonzero(hit)
    out = []
    for r, c in zip(rows, cols):
        k, start = low[r, c], where[r, c]
        while k < len(index.runs) and index.runs[k] == h[r, c]:
            if index.run_item[k] == item[r]:
                a = index.run_at[k]
                if np.array_equal(index.terms[a : a + run], terms[start : start + run]):
                    out.append((owner[start], index.ids[item[r]]))
            k += 1
    return np.array(out, np.int64).reshape(-1, 2)


def _worded(key: str, least: int):
    """key, words (hashes) of the texts that have at least so many."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words, lengths = hashed(words_of(batch["text"]))
            parts = np.split(words, np.cumsum(lengths)[:-1]) if len(lengths) else []
            enough = lengths >= least
            yield pd.DataFrame({key: batch[key][enough], "words": [w for w, e in zip(parts, enough) if e]})

    return run


def _indexing(n: int, mean: float, run: int, block: int):
    def build(items: pd.DataFrame) -> pd.DataFrame:
        index = build_index(items["item_id"].tolist(), [np.asarray(w) for w in items["words"]], [np.asarray(d) for d in items["dfs"]], n, mean, run, block)
        return pd.DataFrame({"shard": [int(items["shard"].iloc[0])], "built": [pickle.dumps(index, 5)]})

    return build


def _searching(held, worded: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        indexes = [pickle.loads(b) for b in held.value]
        for batch in batches:
            for s in range(0, len(batch), 512):
                part = batch.iloc[s : s + 512]
                if worded:
                    lengths = part["words"].map(len).to_numpy(np.int64)
                    words = np.concatenate([*part["words"], np.zeros(0, np.int64)]).astype(np.int64)
                else:
                    words, lengths = hashed(words_of(part["text"]))
                ids = part["doc_id"].to_numpy()
                for index in indexes:
                    pairs = search(index, words, lengths)
                    yield pd.DataFrame({"doc_id": ids[pairs[:, 0]], "item_id": pairs[:, 1]})

    return run


def indexes(items: DataFrame, run: int = RUN, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> DataFrame | None:
    """shard, built: the pickled index of each shard of items (item_id, text); None if no item has run words."""
    w = written(items.mapInPandas(_worded("item_id", run), "item_id long, words array<long>").withColumn("row", F.monotonically_increasing_id()))
    size = w.agg(F.count("*").alias("n"), F.sum(F.size("words")).alias("words")).first()
    if not size["n"]:
        return None
    one = w.select("row", "item_id", F.posexplode("words").alias("at", "term"))
    df = w.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    place = F.array_sort(F.collect_list(F.struct("at", "term", "df")))
    whole = one.join(df, "term").groupBy("row", "item_id").agg(place.alias("p"))
    shard = F.pmod(F.xxhash64("row"), F.lit(-(-size["words"] // shard_words))).cast("int")
    sharded = whole.select(shard.alias("shard"), "item_id", F.transform("p", lambda x: x["term"]).alias("words"), F.transform("p", lambda x: x["df"]).alias("dfs"))
    return written(sharded.groupBy("shard").applyInPandas(_indexing(size["n"], size["words"] / size["n"], run, block), "shard int, built binary"))


def leaks(documents: DataFrame, items: DataFrame, run: int = RUN, block: int = BLOCK, shard_words: int = SHARD_WORDS, pass_words: int = PASS_WORDS) -> DataFrame:
    """doc_id, item_id of every document that shares at least run consecutive words with an item."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    built = indexes(items, run, block, shard_words)
    if built is None:
        return docs.select("doc_id", F.lit(None).cast("long").alias("item_id")).where("false")
    shards, each = sorted(r["shard"] for r in built.select("shard").collect()), max(1, pass_words // shard_words)
    many = len(shards) > each
    if many:
        docs = written(docs.mapInPandas(_worded("doc_id", run), "doc_id long, words array<long>"))
    found = None
    for k in range(0, len(shards), each):
        some = [r["built"] for r in built.where(F.col("shard").isin(shards[k : k + each])).select("built").collect()]
        part = docs.mapInPandas(_searching(docs.sparkSession.sparkContext.broadcast(some), many), "doc_id long, item_id long")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def leak_report(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """Of every item, leaked or not: item_id, documents (how many it leaked into)."""
    n = leaks(documents, items, run).groupBy("item_id").agg(F.count("*").alias("documents"))
    ids = items.select(F.col("item_id").cast("long").alias("item_id")).where("item_id is not null").distinct()
    return ids.join(n, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))
