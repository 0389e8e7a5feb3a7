"""Problem 8: mixing sources to target weights.

Sizes are tokens of a public tokenizer, whose file is a parameter. Sources are mixed by temperature: a
source of token share s and target weight w gets a share in proportion to s^e w^(1 - e). The exponent e
is 0 where the weights are reached and 1 where every document comes as often as any other; with equal
weights this is the usual s^e. It is bisected to the least at which no source breaks its repetition
limit. A source whose own exponent must be above 0 can't reach its weight: it is held at what its limit
gives, which is its tempered share s (w/s)^(1 - e), and the others share what is left, under one exponent
of their own. With `evenness` the weights are equal, and the exponent is the least at which the mixture's
entropy is no more than that part of the way from the entropy of the token shares to the largest.

Budgets are realised by block permutations: whole epochs of a source, then blocks of documents in a
seeded random order until the budget ends, inside the last block document by document.

Documents without a text have no tokens. Rows with a null doc_id or a source that has no target take
no part; a doc_id that comes twice counts once. A target without documents gets no tokens and is
reported. Null weights count as 0, null repeat limits as 1. An empty target table gives no rows.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Callable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from ..session import written

TOKENIZER = os.environ.get("FOLIOSCOPE_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: how byte-level BPE vocabularies of this family cut text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED, BLOCK_DOCUMENTS = 17, 2000


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str = TOKENIZER) -> Column:
    """The number of tokens of a text; 0 for null."""

    @pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path).encode_ordinary
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


def entropy(shares: Sequence[float]) -> float:
    return -sum(s * math.log(s) for s in shares if s > 0)


def tempered(shares: Sequence[float], weights: Sequence[float], exponent: float) -> list[float]:
    """Token shares to the exponent times weights to what is left of 1, normalised; without tokens or weight nothing."""
    raised = [s**exponent * w ** (1 - exponent) if s > 0 and w > 0 else 0.0 for s, w in zip(shares, weights)]
    total = sum(raised)
    return [r / total for r in raised] if total else raised


def bisect_exponent(allowed: Callable[[float], bool], steps: int = 60) -> float | None:
    """The least exponent in [0, 1] that is allowed; None if not even 1 is."""
    if allowed(0.0):
        return 0.0
    if not allowed(1.0):
        return None
    low, high = 0.0, 1.0
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if allowed(middle) else (middle, high)
    return high


def own_exponent(share: float, weight: float, repeats: float) -> float:
    """The least exponent at which a source by itself keeps its repetition limit: 0 if it can reach its weight."""
    if weight <= 0:
        return 0.0
    if share <= 0:
        return 1.0
    e = bisect_exponent(lambda e: (weight / share) ** (1 - e) <= repeats * (1 + 1e-12))
    return 1.0 if e is None else e


def target_shares(tokens: Sequence[int], weights: Sequence[float], repeats: Sequence[int], evenness: float | None = None) -> tuple[list[float], list[float]]:
    """The share of each source in a mixture as large as all the sources together, and its exponent."""
    total = sum(tokens) or 1
    shares = [t / total for t in tokens]
    most = [r * s for r, s in zip(repeats, shares)]
    goal = None
    if evenness is not None:
        weights = [1 / max(1, sum(s > 0 for s in shares)) if s > 0 else 0.0 for s in shares]
        goal = entropy(shares) + evenness * (entropy(weights) - entropy(shares)) + 1e-12
    own = [own_exponent(s, w, r) for s, w, r in zip(shares, weights, repeats)]
    out, exponents = [0.0] * len(tokens), [0.0] * len(tokens)
    fixed = set()
    if goal is None:
        fixed = {k for k, e in enumerate(own) if e > 0}
    while True:
        for k in fixed:
            out[k], exponents[k] = (most[k], own[k]) if shares[k] else (0.0, 1.0)
        free = [k for k in range(len(tokens)) if k not in fixed]
        left = 1 - sum(out[k] for k in fixed)
        part, want = [shares[k] for k in free], [weights[k] for k in free]
        if not free or left <= 0 or not any(s and w for s, w in zip(part, want)):
            return out, exponents
        fits = lambda e: all(left * q <= most[k] + 1e-12 for k, q in zip(free, tempered(part, want, e)))  # noqa: E731, B023
        even = lambda e: goal is None or entropy(tempered(part, want, e)) <= goal  # noqa: E731, B023
        e = bisect_exponent(lambda e: fits(e) and even(e))  # noqa: B023
        if e is not None:
            for k, q in zip(free, tempered(part, want, e)):
                out[k], exponents[k] = left * q, e
            return out, exponents
        over = {k for k, q in zip(free, tempered(part, want, 1.0)) if left * q > most[k]}
        own = [1.0 if k in over else x for k, x in enumerate(own)]
        fixed |= over


def counted(documents: DataFrame, target: DataFrame, path: str = TOKENIZER, size: Column | None = None) -> DataFrame:
    """doc_id, source, tokens of the documents whose source has a target, each once. size: another size than tokens of text."""
    d = documents.where("doc_id is not null and source is not null").select("doc_id", "source", "text")
    d = d.join(target.select("source").where("source is not null").distinct(), "source", "left_semi")
    sized = d.select("doc_id", "source", (token_count(F.col("text"), path) if size is None else F.coalesce(size, F.lit(0))).cast("long").alias("tokens"))
    return sized.groupBy("doc_id").agg(F.max(F.struct("source", "tokens")).alias("r")).select("doc_id", "r.*")


def source_plan(sized: DataFrame, target: DataFrame, evenness: float | None = None) -> DataFrame:
    """source, weight, max_repeat, documents, tokens, reachable, exponent, planned (share), budget (tokens). One row a target. evenness: a
    target entropy in place of the weights, from 0 (that of the token shares) to 1 (the largest)."""
    t = target.where("source is not null").groupBy("source").agg(
        F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"), F.coalesce(F.max("max_repeat"), F.lit(1)).alias("max_repeat")
    )
    n = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    # one row a target: the table of targets, not the documents, bounds what the driver sees
    rows = t.join(n, "source", "left").select("source", "weight", "max_repeat", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"))
    rows = sorted(rows.collect(), key=lambda r: r["source"])
    tokens, total = [r["tokens"] for r in rows], sum(r["tokens"] for r in rows)
    weights, repeats = [r["weight"] for r in rows], [r["max_repeat"] for r in rows]
    shares, exponents = target_shares(tokens, weights, repeats, evenness)
    reach = [own_exponent(n / (total or 1), w, r) == 0 for n, w, r in zip(tokens, weights, repeats)]
    out = [(*r, ok, e, s, int(round(s * total))) for r, ok, e, s in zip(rows, reach, exponents, shares)]
    return sized.sparkSession.createDataFrame(out, "source string, weight double, max_repeat int, documents long, tokens long, reachable boolean, exponent double, planned double, budget long")


def mixture(sized: DataFrame, plan: DataFrame, seed: int = SEED, block: int = BLOCK_DOCUMENTS) -> DataFrame:
    """source, doc_id, tokens, repeats (how often the document comes), block, of all that come at least once.

    The remainder of a budget beyond whole epochs is filled by blocks in random order, and the block
    in which it ends by documents in random order, as long as they fit.
    """
    p = plan.where("tokens > 0").select(
        "source", F.expr("budget div tokens").alias("epochs"), F.expr("budget % tokens").alias("rest"), F.expr(f"cast(greatest(1, documents div {block}) as int)").alias("blocks")
    )
    d = sized.join(p, "source").withColumn("place", F.xxhash64("doc_id", F.lit(seed)))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.col("blocks")).cast("int"))
    sums = d.groupBy("source", "block").agg(F.sum("tokens").alias("size"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("block", "source", F.lit(seed)), "block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    d = d.join(sums, ["source", "block"])
    inside = Window.partitionBy("source", "block").orderBy("place", "doc_id")
    # only the block in which a budget ends needs an order of its documents
    ends = (F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") > F.col("rest"))
    part = d.where(ends).withColumn("more", (F.col("before") + F.sum("tokens").over(inside) <= F.col("rest")).cast("int"))
    whole = d.where(~ends).withColumn("more", (F.col("before") + F.col("size") <= F.col("rest")).cast("int"))
    both = whole.unionByName(part).select("source", "doc_id", "tokens", (F.col("epochs") + F.col("more")).cast("int").alias("repeats"), "block")
    return both.where("repeats > 0")


def permuted(mixed: DataFrame, seed: int = SEED) -> DataFrame:
    """source, doc_id, epoch, place: every appearance of every document; sorting by place mixes the sources."""
    e = mixed.select("source", "doc_id", "block", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("epoch"))
    return e.select("source", "doc_id", "epoch", F.xxhash64("doc_id", "epoch", F.lit(seed)).alias("place"))


def prepared(documents: DataFrame, target: DataFrame, path: str = TOKENIZER, size: Column | None = None, evenness: float | None = None) -> tuple[DataFrame, DataFrame]:
    """The sized documents, written once, and the plan."""
    sized = written(counted(documents, target, path, size))
    return sized, source_plan(sized, target, evenness)


def reached(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """source, weight, reachable, exponent, tokens_used, share (of the mixture), most_repeats of every target."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens_used"), F.max("repeats").alias("most_repeats"))
    r = plan.join(used, "source", "left").select("source", "weight", "reachable", "exponent", F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"))
    total = max(1, used.agg(F.sum("tokens_used").alias("n")).first()["n"] or 0)
    return r.select("source", "weight", "reachable", "exponent", "tokens_used", (F.col("tokens_used") / total).alias("share"), "most_repeats")
