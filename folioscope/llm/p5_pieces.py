"""Problem 5: splitting oversized chunks at natural boundaries by lexical cohesion.

Only oversized rows go to Python. There each text is cut into sentences (line and paragraph ends
count as sentence ends); at each gap between sentences the word counts of the blocks of sentences
before and after are compared, the valleys of that similarity mark topic boundaries, and within
each window of allowed lengths the deepest valley is the cut. Where a window holds no sentence end,
the last line end, else the last white space, else the limit itself is taken.

A null text is no oversized chunk; a null breadcrumb counts as empty. A breadcrumb stays whole on the pieces as
long as it leaves them room for LEAST times the overlap; a longer one is shortened from its front to leave that
room (at a " > " where its rest has one, else after the mark of omission), and never left off. Pieces leave Python
in slices of SLICE characters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHILD_LIMIT, PARENT_LIMIT, OVERLAP, BLOCK, LEAST = 350, 2000, 40, 3, 3
OMITTED = "… "
SLICE = 4_000_000
_ENDS = re.compile(r"(?:\n\s*)+|(?<=[.!?…;:])[\"'”»)\]]*\s+")
_WORD = re.compile(r"[^\W_]+")


def token_count(text):
    """Tokens as characters divided by four, rounded down."""
    return F.expr(f"length({text}) div 4")


def _gaps(text: str) -> list[int]:
    """Offsets at which a sentence begins, without 0."""
    return [m.end() for m in _ENDS.finditer(text) if 0 < m.end() < len(text)]


def _cosine(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values())) if dot else 0.0


def _depths(text: str, gaps: list[int], block: int) -> list[float]:
    """The depth of the valley at each gap; a gap after an empty line is a little deeper."""
    edges = [0, *gaps, len(text)]
    bags = [Counter(_WORD.findall(text[i:j].lower())) for i, j in zip(edges, edges[1:])]
    sims = []
    for g in range(1, len(bags)):
        left, right = Counter(), Counter()
        for b in bags[max(0, g - block) : g]:
            left.update(b)
        for b in bags[g : g + block]:
            right.update(b)
        sims.append(_cosine(left, right))
    up = sims[:]  # the peak on the way left of each gap, and right of it
    for g in range(1, len(sims)):
        up[g] = max(sims[g], up[g - 1]) if sims[g - 1] >= sims[g] else sims[g]
    down = sims[:]
    for g in range(len(sims) - 2, -1, -1):
        down[g] = max(sims[g], down[g + 1]) if sims[g + 1] >= sims[g] else sims[g]
    return [(up[g] - s) + (down[g] - s) + (0.3 if text[: gaps[g]].endswith("\n\n") else 0) for g, s in enumerate(sims)]


def split_text(text: str, room: int, overlap: int, block: int = BLOCK) -> list[tuple[int, int, int]]:
    """(start, own, end) of each piece: text[start:end] has at most room characters; text[own:end] are
    the characters that no earlier piece has, so that those joined give the text again."""
    if not text or room < 1:
        return []
    gaps = _gaps(text)
    depth = dict(zip(gaps, _depths(text, gaps, block)))
    overlap = min(overlap, room // 3)
    pieces, start, own, g = [], 0, 0, 0
    while len(text) - start > room:
        least, most = max(own + 1, start + room // 2), start + room
        while g < len(gaps) and gaps[g] < least:
            g += 1
        window = []
        for k in range(g, len(gaps)):
            if gaps[k] > most:
                break
            window.append(gaps[k])
        if window:
            cut = max(window, key=lambda x: (depth[x], x))
        else:
            tail = text[least:most]
            cut = least + max(tail.rfind("\n"), -1) + 1
            if cut == least:
                cut = least + max((i for i in range(len(tail) - 1, -1, -1) if tail[i].isspace()), default=-1) + 1
            if cut == least:
                cut = most
                while cut > least and unicodedata.combining(text[cut]):
                    cut -= 1
        pieces.append((start, own, cut))
        own, back = cut, max(cut - overlap, start + 1)
        while back < cut and not (text[back - 1].isspace() and not text[back].isspace()):
            back += 1  # the overlap begins with a word
        start = back if back < cut else max(cut - overlap, start + 1)
    pieces.append((start, own, len(text)))
    return pieces


def heading(crumb: str | None, limit: int, overlap: int) -> str:
    """What stands above each piece: the breadcrumb and an empty line, shortened from its front where the characters
    that it leaves of `limit` are fewer than LEAST overlaps (or half the limit, if that is less)."""
    if not crumb:
        return ""
    most = max(0, limit - min(LEAST * overlap, limit // 2) - 2)
    if len(crumb) > most:
        rest = crumb[len(crumb) - max(0, most - len(OMITTED)) :]
        at = rest.find(" > ")
        crumb = (OMITTED + (rest[at + 3 :] if at >= 0 else rest))[:most]
    return f"{crumb}\n\n"


def _pieces(limits: tuple[int, int], overlap: int, block: int):
    columns = ["chunk_id", "piece_no", "start", "own_start", "end", "text", "tokens", "pieces"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, crumb, text, parent in zip(batch["chunk_id"], batch["breadcrumb"], batch["text"], batch["is_parent"]):
                limit = limits[bool(parent)]
                head = heading(crumb, 4 * limit, 4 * overlap)
                cut = split_text(text, 4 * limit - len(head), 4 * overlap, block) or [(0, 0, 0)]
                step = max(1, SLICE // (4 * limit))
                for at in range(0, len(cut), step):
                    yield pd.DataFrame(
                        [(key, n, s, o, e, head + text[s:e], (len(head) + e - s) // 4, len(cut)) for n, (s, o, e) in enumerate(cut[at : at + step], at)],
                        columns=columns,
                    )

    return run


def oversized(chunks: DataFrame, child: int = CHILD_LIMIT, parent: int = PARENT_LIMIT) -> DataFrame:
    """The chunks whose breadcrumb, two newlines and text have more tokens than their limit, each once."""
    c = chunks.select("chunk_id", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"), "text", F.coalesce("is_parent", F.lit(False)).alias("is_parent"))
    whole = F.length("text") + F.when(F.col("breadcrumb") != "", F.length("breadcrumb") + 2).otherwise(0)
    big = c.where((whole / 4).cast("long") > F.when(F.col("is_parent"), parent).otherwise(child))
    return big.where("chunk_id is not null").groupBy("chunk_id").agg(F.first(F.struct("breadcrumb", "text", "is_parent")).alias("r")).select("chunk_id", "r.*")


def split_oversized(chunks: DataFrame, child: int = CHILD_LIMIT, parent: int = PARENT_LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """The pieces of every oversized chunk, at least one of each: chunk_id, piece_no, start, own_start, end (offsets
    in the chunk's text), text (under its breadcrumb), tokens, pieces (of that chunk). An empty text is one empty piece."""
    schema = "chunk_id string, piece_no int, start int, own_start int, end int, text string, tokens int, pieces int"
    return oversized(chunks, child, parent).mapInPandas(_pieces((child, parent), overlap, block), schema)


def split_chunks(chunks: DataFrame, child: int = CHILD_LIMIT, parent: int = PARENT_LIMIT, overlap: int = OVERLAP, block: int = BLOCK) -> DataFrame:
    """The pieces of split_oversized that hold text."""
    return split_oversized(chunks, child, parent, overlap, block).where("end > start")
