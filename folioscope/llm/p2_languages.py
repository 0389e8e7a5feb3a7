"""Problem 2: the language of texts, titles and paragraphs, by a byte convolutional network.

A segment's UTF-8 bytes are cut into windows of WINDOW bytes. Bytes have a learned embedding; filters
of several widths run over it, the maximum of each over the window goes into a softmax layer. The
network is trained in numpy on a bounded sample of labelled rows: SAMPLE items per declared language
and kind (chosen by the hash of their key), of each at most CROPS windows, from anywhere in it, and twice
as many short crops. As some labels are wrong, networks trained on one half of the items judge those of
the other half first, and items whose label they don't confirm are left out. It takes EPOCHS passes over
the sample, or STEPS steps if that is more. The windows' log probabilities are summed over a segment,
and over a chunk.

Segments without a letter get no language and confidence 0. Null and empty texts give no segment (an
empty text is one empty segment). Rows with a null key are left out, a key that comes twice counts
once. Without any usable label there is nothing to learn from, and an error is raised.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..sources.tables import once

LANGUAGES = ["de", "en", "es", "fr", "pt"]
# How the languages are named in labels, besides their codes.
NAMES = {
    "de": ["deu", "ger", "german", "deutsch", "alemán", "aleman", "allemand", "alemão", "tedesco"],
    "en": ["eng", "english", "englisch", "inglés", "ingles", "anglais", "inglês"],
    "es": ["spa", "spanish", "spanisch", "español", "espanol", "castellano", "espagnol", "espanhol"],
    "fr": ["fra", "fre", "french", "französisch", "francés", "frances", "français", "francais", "francês"],
    "pt": ["por", "portuguese", "portugiesisch", "portugués", "portugues", "portugais", "português"],
}
# Beginnings of paragraphs that are no prose.
NOT_PROSE = ["$$", "|", "![", "<table", "```"]
WINDOW, SHORT, STEP, DIM, WIDTHS, FILTERS = 160, 72, 144, 12, (2, 3, 4, 5), 16
SAMPLE, CROPS, EPOCHS, STEPS, SEED = 400, 3, 4, 600, 11


def declared(lang: Column) -> Column:
    """The language code that a label names in whatever spelling; null if it names none of LANGUAGES."""
    key = F.lower(F.regexp_replace(F.split(F.trim(lang), "[-_]").getItem(0), r"\s+", ""))
    code = F.lit(None).cast("string")
    for name, others in NAMES.items():
        code = F.when(key.isin([name, *others]), name).otherwise(code)
    return code


class ByteNetwork:
    """Byte embedding, FILTERS filters of each of WIDTHS bytes (as one matrix of the largest width with zeros), maximum, softmax."""

    def __init__(self, classes: int, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.wide, n = max(WIDTHS), FILTERS * len(WIDTHS)
        self.mask = np.zeros((self.wide, DIM, n), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[:w, :, k * FILTERS : (k + 1) * FILTERS] = 1
        self.mask = self.mask.reshape(-1, n)
        self.p = {
            "e": r.normal(0, 0.5, (256, DIM)).astype(np.float32),
            "w": (r.normal(0, 0.15, (self.wide * DIM, n)) * self.mask).astype(np.float32),
            "b": np.zeros(n, np.float32),
            "u": r.normal(0, 0.1, (n, classes)).astype(np.float32),
            "c": np.zeros(classes, np.float32),
        }
        self.p["e"][0] = 0

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """window x place x filter."""
        n, size = x.shape
        e = np.zeros((n, size + self.wide - 1, DIM), self.p["e"].dtype)
        e[:, :size] = self.p["e"][x]
        columns = np.lib.stride_tricks.sliding_window_view(e, self.wide, 1).transpose(0, 1, 3, 2).reshape(n * size, -1)
        return (columns @ self.p["w"]).reshape(n, size, -1)

    def classified(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled + self.p["b"], 0)
        z = hidden @ self.p["u"] + self.p["c"]
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return z, hidden

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What two bytes add to each filter at its first two places, and at the next two of those that have them, and what one
        byte adds at the fifth: the products of all embeddings and filters, so that scoring only looks them up and sums them."""
        one = [self.p["e"] @ self.p["w"][k * DIM : (k + 1) * DIM] for k in range(self.wide)]
        two = lambda k, first: (one[k][:, None, first:] + one[k + 1][None, :, first:]).reshape(256 * 256, -1)
        return two(0, 0), two(2, FILTERS), np.ascontiguousarray(one[4][:, 3 * FILTERS :])

    def log_probabilities(self, x: np.ndarray, tables: tuple | None = None, batch: int = 16) -> np.ndarray:
        """The same as classifying the maxima of outputs, by the tables."""
        first, second, fifth = tables or self.tables()
        pooled = np.zeros((len(x), first.shape[1]), first.dtype)
        for s in range(0, len(x), batch):
            part = x[s : s + batch]
            n, size = part.shape
            byte = np.zeros((n, size + self.wide), np.intp)
            byte[:, :size] = part
            pair = byte[:, :-1] * 256 + byte[:, 1:]
            out = first.take(pair[:, :size], axis=0, mode="clip")
            out[:, :, FILTERS:] += second.take(pair[:, 2 : size + 2], axis=0, mode="clip")
            out[:, :, 3 * FILTERS :] += fifth.take(byte[:, 4 : size + 4], axis=0, mode="clip")
            pooled[s : s + batch] = out.max(1)
        return self.classified(pooled)[0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        out = self.outputs(x)
        at = out.argmax(1)
        z, hidden = self.classified(np.take_along_axis(out, at[:, None], 1)[:, 0])
        d = np.exp(z)
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        h = (d @ self.p["u"].T) * (hidden > 0)
        g = {"u": hidden.T @ d, "c": d.sum(0), "b": h.sum(0), "e": np.zeros_like(self.p["e"]), "w": np.zeros_like(self.p["w"])}
        padded = np.concatenate([x, np.zeros((len(x), self.wide - 1), x.dtype)], 1).astype(np.int64)
        rows, n = np.arange(len(x))[:, None], h.shape[1]
        for k in range(self.wide):
            part = slice(k * DIM, (k + 1) * DIM)
            # what each byte, at this place of each filter, adds: both gradients follow from it
            byte = np.bincount((padded[rows, at + k] * n + np.arange(n)).ravel(), h.ravel(), 256 * n).reshape(256, n).astype(np.float32) * self.mask[k * DIM]
            g["w"][part] = self.p["e"].T @ byte
            g["e"] += byte @ self.p["w"][part].T
        g["e"][0] = 0
        return g

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int, rate: float = 0.004, batch: int = 64) -> None:
        r, step, short = np.random.default_rng(seed), 0, ~x[:, SHORT - 1 :].any(1)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(p) for k, p in self.p.items()}
        epochs = max(epochs, -(-STEPS * batch * epochs // (EPOCHS * max(1, len(x)))))
        for epoch in range(epochs):
            order = r.permutation(len(x))
            parts = [order[short[order]], order[~short[order]]]  # short windows go together, without most of their padding
            batches = [(p[s : s + batch], SHORT if n == 0 else WINDOW) for n, p in enumerate(parts) for s in range(0, len(p), batch)]
            for b in r.permutation(len(batches)):
                pick, size = batches[b]
                step += 1
                for k, g in self.gradients(x[pick, :size], y[pick]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] -= rate / (1 + 5 * epoch / epochs) ** 0.5 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)


_SPACE, _LETTER = re.compile(r"\s+"), re.compile(r"[^\W\d_]")


def windows(text: str) -> list[bytes]:
    """The text's bytes in windows that overlap a little, white space made one space; no window without a letter."""
    if not _LETTER.search(text):
        return []
    b = _SPACE.sub(" ", text).strip().encode("utf-8", "replace")
    starts = range(0, max(1, len(b) - (WINDOW - STEP)), STEP)
    return [b[s : s + WINDOW] for s in starts]


def as_array(parts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(p.ljust(WINDOW, b"\0") for p in parts), np.uint8).reshape(-1, WINDOW)


def cropped(text: str, seed: int) -> list[bytes]:
    """At most CROPS of a text's windows, from anywhere in it."""
    own = windows(text)
    return [own[i] for i in np.random.default_rng(seed).permutation(len(own))[:CROPS]]


def train(texts: list[str], labels: list[int], classes: int = len(LANGUAGES), epochs: int = EPOCHS, seed: int = SEED) -> ByteNetwork:
    """A network trained on texts with labels, of which some may be wrong."""
    return train_crops([cropped(t, seed + n) for n, t in enumerate(texts)], labels, classes, epochs, seed)


def train_crops(texts: list[list[bytes]], labels: list[int], classes: int = len(LANGUAGES), epochs: int = EPOCHS, seed: int = SEED) -> ByteNetwork:
    """A network trained on windows of texts."""
    r = np.random.default_rng(seed)
    parts, owner = [], []
    for n, own in enumerate(texts):
        short = [w[i : i + int(r.integers(20, 70))] for w in own for i in r.integers(0, max(1, len(w) - 40), 2)]
        parts += [*own, *short]
        owner += [n] * (len(own) + len(short))
    x, owner = as_array(parts), np.array(owner)
    y = np.array(labels)[owner]
    score = np.zeros((len(texts), classes))
    for half in (0, 1):
        mine = owner % 2 == half
        if mine.any() and not mine.all():
            judge = ByteNetwork(classes, seed + half)
            judge.fit(x[mine], y[mine], max(1, epochs // 3), seed + half)
            np.add.at(score, owner[~mine], judge.log_probabilities(x[~mine]))
    keep = (score.argmax(1) == np.array(labels))[owner]
    if len(np.unique(y[keep])) < len(np.unique(y)):  # too few items to judge by
        keep[:] = True
    net = ByteNetwork(classes, seed + 2)
    net.fit(x[keep], y[keep], epochs, seed + 2)
    return net


def _score(net):
    @pandas_udf("array<float>")
    def score(texts: pd.Series) -> pd.Series:
        """Summed log probabilities of the languages, and the number of windows."""
        held, tables = net.value, None
        parts = [windows(t) if t else [] for t in texts]
        counts = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts)), counts)
        out = np.zeros((len(parts), len(LANGUAGES) + 1), np.float64)
        flat = [w for p in parts for w in p]
        for s in range(0, len(flat), 4096):
            tables = tables or held.tables()
            np.add.at(out[:, :-1], owner[s : s + 4096], held.log_probabilities(as_array(flat[s : s + 4096]), tables))
        out[:, -1] = counts
        return pd.Series(list(out.astype(np.float32)))

    return score


def _decided(df: DataFrame, scores: str = "scores") -> DataFrame:
    """lang and confidence (the geometric mean of the windows' probabilities, normalised) from scores."""
    n, k = F.element_at(scores, -1), len(LANGUAGES)
    logs = F.slice(scores, 1, k)
    best = F.array_max(logs)
    total = F.aggregate(F.transform(logs, lambda x: F.exp((x - best) / F.greatest(n, F.lit(1.0)))), F.lit(0.0), lambda a, x: a + x.cast("double"))
    names = F.array(*[F.lit(x) for x in LANGUAGES])
    return df.withColumn("lang", F.when(n > 0, F.element_at(names, F.array_position(logs, best).cast("int")))).withColumn(
        "confidence", F.when(n > 0, F.round(1 / total, 4)).otherwise(0.0)
    )


def segments(chunk: DataFrame, book_meta: DataFrame) -> DataFrame:
    """item_kind, item_key, seg_no, text: the paragraphs of child chunks and the titles of books."""
    c = once(chunk.where("not is_parent and text is not null").select("chunk_id", "text"), "chunk_id")
    c = c.select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_key"), F.posexplode(F.split("text", "\n\n", -1)).alias("seg_no", "text"))
    b = once(book_meta.select("slug", "titles"), "slug")
    b = b.select(F.lit("title").alias("item_kind"), F.col("slug").alias("item_key"), F.posexplode("titles").alias("seg_no", "text"))
    return c.unionByName(b.where("text is not null"))


def labels(lang_label: DataFrame) -> DataFrame:
    """item_kind, item_key, declared (the languages that labels name, none: an empty array)."""
    named = lang_label.where("item_kind is not null and item_key is not null").select("item_kind", "item_key", declared(F.col("lang")).alias("d"))
    return named.groupBy("item_kind", "item_key").agg(F.collect_set("d").alias("declared"))


def _crops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        crops = [cropped(t, zlib.crc32(k.encode())) for k, t in zip(batch["item_key"], batch["text"])]
        yield pd.DataFrame({"item_kind": batch["item_kind"], "item_key": batch["item_key"], "label": batch["label"], "crops": crops})


def trained(spark: SparkSession, parts: DataFrame, label: DataFrame, sample: int = SAMPLE) -> ByteNetwork:
    """A network trained on at most `sample` labelled items of each language and kind of item."""
    one = label.where("size(declared) = 1").select("item_kind", "item_key", F.element_at("declared", 1).alias("label"))
    picked = None
    for lang in LANGUAGES:
        for kind in ("chunk", "title"):
            some = one.where((F.col("label") == lang) & (F.col("item_kind") == kind)).orderBy(F.xxhash64("item_key"), "item_key").limit(sample)
            picked = some if picked is None else picked.unionByName(some)
    rows = parts.join(F.broadcast(picked), ["item_kind", "item_key"]).groupBy("item_kind", "item_key", "label")
    texts = rows.agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("seg_no", "text"))), lambda x: x["text"])).alias("text"))
    # crops are taken in the tasks, so that the driver gets a bounded number of windows of a bounded number of items
    crops = texts.mapInPandas(_crops, "item_kind string, item_key string, label string, crops array<binary>").where("size(crops) > 0")
    held = crops.orderBy("item_kind", "item_key").collect()
    if not held:
        raise ValueError("no labelled text to learn languages from")
    return train_crops([[bytes(c) for c in r["crops"]] for r in held], [LANGUAGES.index(r["label"]) for r in held])


def scored(chunk: DataFrame, book_meta: DataFrame, lang_label: DataFrame, prose_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments with scores, labels). prose_only: only segments that can be cases."""
    parts, label = segments(chunk, book_meta), labels(lang_label)
    spark = chunk.sparkSession
    net = spark.sparkContext.broadcast(trained(spark, parts, label))
    if prose_only:
        marked = ~F.coalesce(*[F.when(F.startswith("text", F.lit(m)), True) for m in NOT_PROSE], F.lit(False))
        enough = F.size(F.split(F.regexp_replace("text", r"(?U)^\s+|\s+$", ""), r"(?U)\s+")) >= 20
        parts = parts.where((F.col("item_kind") == "title") | (marked & enough))
    return parts.withColumn("scores", _score(net)(F.col("text"))), label


def wrong_labels(chunk: DataFrame, book_meta: DataFrame, lang_label: DataFrame) -> DataFrame:
    """item_kind, item_key, seg_no, lang of the segments whose language isn't a declared one."""
    s, label = scored(chunk, book_meta, lang_label, prose_only=True)
    s = _decided(s).select("item_kind", "item_key", "seg_no", "lang").where("lang is not null")
    s = s.join(label, ["item_kind", "item_key"], "left")
    return s.where("declared is null or not array_contains(declared, lang)").drop("declared")


def languages(chunk: DataFrame, book_meta: DataFrame, lang_label: DataFrame) -> DataFrame:
    """item_kind, item_key, seg_no, lang, confidence of every paragraph and title, and of every chunk as a
    whole (its seg_no is -1)."""
    s, _ = scored(chunk, book_meta, lang_label)
    s = s.select("item_kind", "item_key", "seg_no", "scores")
    sums = [F.sum(F.col("scores")[k].cast("double")).alias(f"s{k}") for k in range(len(LANGUAGES) + 1)]
    whole = s.where("item_kind = 'chunk'").groupBy("item_kind", "item_key").agg(*sums)
    whole = whole.select("item_kind", "item_key", F.lit(-1).alias("seg_no"), F.array(*[f"s{k}" for k in range(len(LANGUAGES) + 1)]).cast("array<float>").alias("scores"))
    return _decided(s.unionByName(whole)).drop("scores")
