"""Problem 4: the k most similar vectors of every vector, by a block matrix join.

Rows whose vectors are equal are one group; only groups are compared, and members get their lists from
their group's. Groups fall into blocks of similar vectors, by a tree of splits along the directions in
which a sample varies most; where a vector lies has no influence on the result. Each block is compared
with itself first, which gives every vector a list and a floor, the k-th similarity so far; then each
pair of blocks is one tile, handled by one task that holds just those two blocks. Vectors are quantised
to int8 codes with one scale each; the product of the scaled codes in float32 gives every similarity
up to a known error, which follows from the length of what quantisation cut off and a slack for
rounding, and serves both vectors. Pairs whose upper bound reaches the floor of either one survive and
are recomputed in float64. Each tile returns up to k candidates a vector; a heap per vector merges
those of all tiles. As only pairs that provably aren't among the k are dropped, the result is exact:
recall is 1.

Usable vectors have `size` components, all of them finite numbers and not all zero; others get no row
and are nobody's neighbour. An id that comes twice counts once. Ties go to the smaller id. With fewer
than k other vectors, all of them are returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

K, SIZE, BLOCK, STRIPE, LANE, SLICE = 10, 64, 16384, 128, 64, 100_000
#: Vectors of a block at most: a tile of two holds about 100 MB of them, and 35 MB of one stripe's similarities.
LARGEST = 65536
#: Rows and columns of a tile's part whose similarities stay in the processor's cache; vectors that the splits are taken from.
PART, SPLIT_FROM = (512, 512), 8000
_TILE_SCHEMA = "id string, ids array<string>, sims array<double>"
_BLOCK_SCHEMA = "block int, ids array<string>, vectors binary, floors binary, i binary, j binary, sims binary"


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales, and the length of what the codes leave out of each row."""
    scale = np.maximum(np.abs(x).max(1), 1e-30) / 127
    q = x / scale[:, None]  # in place from here on: x may be a block of the largest size
    codes = np.rint(q, out=q).astype(np.int8)
    q *= scale[:, None]
    return codes, scale, np.linalg.norm(np.subtract(x, q, out=q), axis=1)


def _scaled(codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return codes.astype(np.float32) * scale[:, None].astype(np.float32)


def _exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    # in slices: where many vectors lie in one direction, thousands tie for a place
    return np.concatenate([np.einsum("ab,ab->a", x[i[t : t + SLICE]], y[j[t : t + SLICE]]) for t in range(0, len(i), SLICE)] or [np.zeros(0)])


def _best(i: np.ndarray, j: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each i the k best, by falling similarity, ties by j."""
    order = np.lexsort((j, -sims, i))
    i, j, sims = i[order], j[order], sims[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[keep], j[keep], sims[keep]


def nearest(x: np.ndarray, y: np.ndarray, k: int, same: bool, stripe: int = STRIPE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the unit rows of x their k nearest unit rows of y: row of x, row of y, cosine; for each row
    of x by falling cosine, ties by the row of y. same: x is y, and no row is its own neighbour."""
    n, m = len(x), len(y)
    want = min(k, m - same)
    if not n or want < 1:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    cx, sx, ex = quantised(x)
    cy, sy, ey = (cx, sx, ex) if y is x else quantised(y)
    lanes = -(-m // LANE)  # lane l holds the columns l, l + lanes, l + 2 lanes and so on
    rows_of, columns = _scaled(cx, sx), np.zeros((lanes * LANE, x.shape[1]), np.float32)
    columns[:m] = _scaled(cy, sy)
    columns = np.ascontiguousarray(columns.T)
    most = float(ey.max(initial=0))
    out, nears = [], np.empty((min(n, stripe), lanes * LANE), np.float32)
    for s in range(0, n, stripe):
        rows = np.arange(s, min(n, s + stripe))
        near = np.matmul(rows_of[rows], columns, out=nears[: len(rows)])
        near[:, m:] = -9
        if same:
            near[rows - s, rows] = -9
        # lower bound of the k-th best: the k-th largest of the lanes' maxima
        near = near.reshape(len(rows), LANE, lanes)
        top = near.max(1)
        bound = (ex[rows] + (1 + ex[rows]) * most + 1e-5).astype(np.float32)
        floor = (np.partition(top, lanes - want, axis=1)[:, lanes - want] if lanes > want else np.full(len(rows), -8, np.float32)) - 2 * bound
        r, lane = np.nonzero(top >= floor[:, None])
        close = near[r, :, lane]
        p, q = np.nonzero((close >= floor[r, None]) & (close > -5))
        i, j = r[p] + s, q * lanes + lane[p]
        out.append(_best(i, j, _exact(x, y, i, j), k))
    return tuple(np.concatenate(part) for part in zip(*out))


class _Candidates:
    """Candidates of one side of a tile; when there are many, only the k best of each vector stay and floors rise."""

    def __init__(self, floors: np.ndarray, k: int):
        self.floors, self.k, self.parts, self.held, self.most = floors.copy(), k, [], 0, 2 * k * len(floors) + SLICE

    def add(self, i: np.ndarray, j: np.ndarray, sims: np.ndarray) -> None:
        keep = sims >= self.floors[i]
        self.parts.append((i[keep], j[keep], sims[keep]))
        self.held += len(self.parts[-1][0])
        if self.held > self.most:
            i, _, sims = self.parts[0] = self.result()
            self.parts, self.held = self.parts[:1], len(i)
            last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == self.k - 1)
            self.floors[i[last]] = np.maximum(self.floors[i[last]], sims[last])

    def result(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        return _best(*(np.concatenate(part) for part in zip(*self.parts or [none])), self.k)


def across(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, k: int):
    """For unit rows of x and of y those of the other side that may be among their k nearest: as nearest returns
    them, for x and for y. of_x, of_y: floors, the similarities that a row's neighbours reach at least."""
    # by floors, so that all of a part have about the same and one comparison with the least leaves few pairs
    by_x, by_y = np.argsort(of_x, kind="stable"), np.argsort(of_y, kind="stable")
    mine, theirs = _Candidates(of_x, k), _Candidates(of_y, k)
    (cx, sx, ex), (cy, sy, ey) = quantised(x), quantised(y)
    rows_of, columns_of = _scaled(cx, sx)[by_x], _scaled(cy, sy)[by_y]
    # pairs below a floor less this can't reach it, whatever quantisation and rounding did
    slack_x, slack_y = ex + (1 + ex) * ey.max(initial=0) + 2e-5, ey + (1 + ey) * ex.max(initial=0) + 2e-5
    high, wide = PART
    columns = [(by_y[c : c + wide], np.ascontiguousarray(columns_of[c : c + wide].T)) for c in range(0, len(y), wide)]
    # places for a part's similarities, made once; a part's pairs are looked through eight at a time
    nears, closes = np.empty(high * wide, np.float32), np.zeros(high * wide + 8, bool)
    for s in range(0, len(x), high):
        rows, part = by_x[s : s + high], rows_of[s : s + high]
        least_x, least_y = mine.floors - slack_x, theirs.floors - slack_y
        least, found, held = least_x[rows].min(), [], 0
        for c, (cols, column) in enumerate(columns):
            n = len(rows) * len(cols)
            near, close = nears[:n].reshape(len(rows), -1), closes[:n]
            np.matmul(part, column, out=near)
            np.greater_equal(nears[:n], np.float32(min(least, least_y[cols].min())), out=close)
            closes[n : n + 8] = False
            at = np.flatnonzero(closes[: n + -n % 8].view(np.uint64) != 0)
            at = (at[:, None] * 8 + np.arange(8))[closes[: n + -n % 8].reshape(-1, 8)[at]]
            if len(at):
                i, j = np.divmod(at, len(cols))
                near, i, j = near[i, j], rows[i], cols[j]
                may = (near >= least_x[i]) | (near >= least_y[j])
                found.append((i[may], j[may]))
                held += len(found[-1][0])
            if found and (held > SLICE or c == len(columns) - 1):
                i, j = (np.concatenate(one) for one in zip(*found))
                sims = _exact(x, y, i, j)
                mine.add(i, j, sims)
                theirs.add(j, i, sims)
                found, held = [], 0
    return mine.result(), theirs.result()


def _unit(flat: np.ndarray, size: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, size)
    x /= np.abs(x).max(1)[:, None]  # before the norm, which tiny or huge components would spoil
    x /= np.linalg.norm(x, axis=1)[:, None]
    return x


def _lists(ids: np.ndarray, others: np.ndarray, found) -> pa.Table:
    i, j, sim = found
    there, first = np.unique(i, return_index=True)
    offsets = pa.array([*first.tolist(), len(i)], pa.int32())
    return pa.table({
        "id": pa.array(ids[there], pa.string()),
        "ids": pa.ListArray.from_arrays(offsets, pa.array(others[j], pa.string())),
        "sims": pa.ListArray.from_arrays(offsets, pa.array(sim, pa.float64())),
    })


def _flat(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False)


def splits(x: np.ndarray, low: int, high: int) -> tuple | None:
    """A tree that sends unit vectors to blocks low to high - 1, about as many of x to each."""
    if high - low < 2:
        return None
    middle = (low + high) // 2
    if not len(x):
        return np.zeros(x.shape[1]), 0.0, middle, splits(x, low, middle), splits(x, middle, high)
    way = np.linalg.eigh(np.cov(x.T, bias=True))[1][:, -1]
    along = x @ way
    at = float(np.quantile(along, (middle - low) / (high - low)))
    return way, at, middle, splits(x[along <= at], low, middle), splits(x[along > at], middle, high)


def place(x: np.ndarray, tree: tuple | None, low: int = 0) -> np.ndarray:
    if tree is None:
        return np.full(len(x), low, np.int32)
    way, at, middle, left, right = tree
    out, on = np.empty(len(x), np.int32), x @ way > at
    out[~on], out[on] = place(x[~on], left, low), place(x[on], right, middle)
    return out


def _placed(tree: tuple, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_flat(batch.column("vector")), size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place(x, tree), pa.int32())], names=[*batch.schema.names, "block"])

    return run


def _own(k: int, size: int):
    """One row a block: its ids in order, their vectors, each one's neighbours within the block and its floor."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        flat = _flat(table.column("vector").combine_chunks()).astype(np.float32)
        x = _unit(flat, size)
        i, j, sims = nearest(x, x, k, True)
        floors, last = np.full(len(x), -9.0), np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
        floors[i[last]] = sims[last]
        # each is in its own list as well: its copies are as similar to it as it is to itself
        alone = np.arange(len(x))
        i, j, sims = np.concatenate([i, alone]), np.concatenate([j, alone]), np.concatenate([sims, _exact(x, x, alone, alone)])
        order = np.argsort(i, kind="stable")
        row = [table.column("block")[0].as_py(), table.column("id").to_pylist(), flat.tobytes(), floors.tobytes(), i[order].astype(np.int32).tobytes(), j[order].astype(np.int32).tobytes(), sims[order].tobytes()]
        kinds = [pa.int32(), pa.list_(pa.string()), *[pa.binary()] * 5]
        return pa.table([pa.array([v], kind) for v, kind in zip(row, kinds)], names=["block", "ids", "vectors", "floors", "i", "j", "sims"])

    return run


def _own_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for n in range(len(batch)):
            ids = batch.column("ids")[n].values.to_numpy(zero_copy_only=False)
            i, j, sims = (np.frombuffer(batch.column(c)[n].as_py(), kind) for c, kind in (("i", np.int32), ("j", np.int32), ("sims", np.float64)))
            yield from _lists(ids, ids, (i, j, sims)).to_batches()


def _tiles(k: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(len(batch)):
                value = lambda c: batch.column(c)[n]  # noqa: B023, E731
                a, b = (value(f"{side}_ids").values.to_numpy(zero_copy_only=False) for side in ("low", "high"))
                x, y = (_unit(np.frombuffer(value(f"{side}_vectors").as_py(), np.float32), size) for side in ("low", "high"))
                of_x, of_y = (np.frombuffer(value(f"{side}_floors").as_py(), np.float64) for side in ("low", "high"))
                mine, theirs = across(x, y, of_x, of_y, k)
                yield from _lists(a, b, mine).to_batches()
                yield from _lists(b, a, theirs).to_batches()

    return run


def _merged(k: int):
    """Rows come sorted by id; of each id a heap keeps the best k of all its lists, and itself at rank 0."""

    def rows(batches):
        for batch in batches:
            ids, sims = batch.column("ids"), batch.column("sims")
            o, names, values = ids.offsets.to_pylist(), ids.values.to_pylist(), sims.values.to_pylist()
            for n, i in enumerate(batch.column("id").to_pylist()):
                yield i, zip((-v for v in values[o[n] : o[n + 1]]), names[o[n] : o[n + 1]])

    def flush(out: list) -> pa.RecordBatch:
        ids, ranks, others, sims = zip(*out)
        return pa.record_batch({"id": pa.array(ids, pa.string()), "rank": pa.array(ranks, pa.int32()), "other": pa.array(others, pa.string()), "similarity": pa.array(sims, pa.float64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for i, lists in groupby(rows(batches), key=lambda r: r[0]):
            pairs = [pair for _, one in lists for pair in one]
            best = [pair for pair in pairs if pair[1] == i] + heapq.nsmallest(k, (pair for pair in pairs if pair[1] != i))
            out += [(i, n, other, -sim) for n, (sim, other) in enumerate(best)]
            if len(out) > 50_000:
                yield flush(out)
                out = []
        if out:
            yield flush(out)

    return run


def _blocks(groups: DataFrame, n: int, k: int, size: int, block: int) -> tuple[DataFrame, int]:
    """The blocks, written, one row each, and their number. groups: id, vector; n of them."""
    # large tables have larger blocks, since each block is read once for each other
    most = max(block, min(LARGEST, n // 16))
    blocks = max(1, -(-n // most))
    if blocks > 1:
        sample = groups.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SPLIT_FROM))) == 0).select("vector").limit(2 * SPLIT_FROM).toArrow()
        tree = splits(_unit(_flat(sample.column("vector").combine_chunks()), size), 0, blocks)
        groups = groups.mapInArrow(_placed(tree, size), "id string, vector array<float>, block int")
        # a block that came out too large, as where vectors differ in length only, falls into several
        parts = {r["block"]: -(-r["count"] // (most + most // 4)) for r in groups.groupBy("block").count().collect()}
        parts = [parts.get(b, 1) for b in range(blocks)]
        first = [sum(parts[:b]) for b in range(blocks)]
        one_of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("block") + 1)
        groups, blocks = groups.withColumn("block", (one_of(first) + F.pmod(F.xxhash64("id"), one_of(parts))).cast("int")), sum(parts)
    else:
        groups = groups.withColumn("block", F.lit(0))
    return written(groups.repartition(blocks, "block").groupBy("block").applyInArrow(_own(k, size), _BLOCK_SCHEMA)), blocks


def _lists_of(groups: DataFrame, n: int, k: int, size: int, block: int) -> DataFrame:
    """id, rank, other, similarity: each group itself at rank 0, then the k most similar others."""
    own, blocks = _blocks(groups, n, k, size, block)
    lists = own.select("ids", "i", "j", "sims").mapInArrow(_own_lists, _TILE_SCHEMA)
    if blocks > 1:
        # a block a partition, so that a task of the join reads just two
        one = own.select("block", "ids", "vectors", "floors").repartitionById(blocks, "block")
        low, high = (one.select(*(F.col(c).alias(f"{side}_{c}") for c in one.columns)) for side in ("low", "high"))
        lists = lists.union(low.join(high, F.col("low_block") < F.col("high_block")).mapInArrow(_tiles(k, size), _TILE_SCHEMA))
    return lists.repartition("id").sortWithinPartitions("id").mapInArrow(_merged(k), "id string, rank int, other string, similarity double")


def neighbours(vectors: DataFrame, id_column: str = "chunk_id", vector: str = "vector", k: int = K, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """id, rank (from 1), other, similarity: the k most similar others of every usable vector."""
    rows = vectors.select(F.col(id_column).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    rows = rows.where(F.col("id").isNotNull() & (F.size("vector") == size) & F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector")).withColumn("hash", F.xxhash64("vector"))
    equal = Window.partitionBy("hash", "vector").orderBy("id")
    rows = rows.select("id", "vector", F.first("id").over(equal).alias("head"), F.row_number().over(equal).alias("place"))
    members = written(rows.withColumn("vector", F.expr("if(place = 1, vector, null)")))
    groups = members.where("place = 1").select("id", "vector")
    n = groups.count()
    lists = _lists_of(groups, n, k, size, block)
    if members.count() == n:
        return lists.where("rank > 0")
    heads = members.where(F.col("place") <= k + 1).select(F.col("id").alias("name"), F.col("head").alias("other"), "place")
    # k members of each other group are enough, k + 1 of the own one, since a member isn't its own neighbour
    best = lists.join(heads, "other").where(F.col("place") <= k + (F.col("rank") == 0).cast("int"))
    best = best.groupBy(F.col("id").alias("head")).agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "name"))), 1, k + 1).alias("best"))
    best = members.select("id", "head").join(best, "head")
    others = F.slice(F.filter("best", lambda one: one["name"] != F.col("id")), 1, k)
    best = best.select("id", F.posexplode(others).alias("at", "one"))
    return best.select("id", (F.col("at") + 1).alias("rank"), F.col("one.name").alias("other"), (-F.col("one.far")).alias("similarity"))


def neighbour_pairs(vectors: DataFrame, id_column: str = "chunk_id", vector: str = "vector", k: int = K) -> DataFrame:
    """Pairs chunk_id_a < chunk_id_b of which at least one is among the k most similar of the other."""
    n = neighbours(vectors, id_column, vector, k)
    return n.select(F.least("id", "other").alias("chunk_id_a"), F.greatest("id", "other").alias("chunk_id_b")).distinct()
