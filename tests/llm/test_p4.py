import numpy as np
import pytest

from folioscope.llm import p4_neighbours as P


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {i: [int(j) for j in np.lexsort((np.arange(len(x)), -s[i]))[:k]] for i in range(len(x))}


@pytest.mark.parametrize("block", [60, 400])
def test_neighbours_are_exact(spark, block):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(250, 16)), r.normal(size=(1, 16)) + r.normal(size=(50, 16)) * 0.01]).astype(np.float32)
    x[5] *= 1e-20
    x[6] *= 1e18
    x[7] = x[8]
    ids = [f"v{i:04}" for i in range(300)]
    rows = [(i, v.tolist(), "x") for i, v in zip(ids, x)]
    rows += [rows[4], ("zero", [0.0] * 16, "x"), ("none", None, "x"), ("short", [1.0], "x"), ("nan", [float("nan")] * 16, "x"), (None, [1.0] * 16, "x"), ("hole", [None] * 16, "x"), ("inf", [float("inf")] + [1.0] * 15, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, vector array<float>, id string")
    got = {}
    for g in P.neighbours(df, k=10, size=16, block=block).collect():
        got.setdefault(g.id, {})[g.rank] = g.other
    expected = brute(x.astype(np.float64) / np.abs(x.astype(np.float64)).max(1)[:, None], 10)
    assert {i: [v[n] for n in range(1, 11)] for i, v in got.items()} == {ids[i]: [ids[j] for j in js] for i, js in expected.items()}


def test_the_bound_holds():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    codes, scale, lost = P.quantised(x)
    near = (codes.astype(np.float64) @ codes.T.astype(np.float64)) * scale[:, None] * scale[None, :]
    assert (np.abs(near - x @ x.T) <= lost[:, None] + (1 + lost[:, None]) * lost[None, :] + 1e-9).all() and codes.dtype == np.int8


def test_few_rows_and_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in "dcba"], "chunk_id string, vector array<float>")
    got = {(x.id, x.rank): x.other for x in P.neighbours(df, k=2, size=2).collect()}
    assert got == {("a", 1): "b", ("a", 2): "c", ("b", 1): "a", ("b", 2): "c", ("c", 1): "a", ("c", 2): "b", ("d", 1): "a", ("d", 2): "b"}
    assert P.neighbours(df.where("chunk_id = 'a'"), k=2, size=2).count() == 0
    assert P.neighbours(df.where("false"), k=2, size=2).count() == 0


def test_a_third_are_copies(spark):
    r = np.random.default_rng(8)
    rows = [(f"c{i:04}", [1.0] * 64) for i in range(1500)] + [(f"v{i:04}", r.normal(size=64).astype(np.float32).tolist()) for i in range(1500)]
    got = {}
    for g in P.neighbours(spark.createDataFrame(rows, "chunk_id string, vector array<float>"), block=1000).collect():
        got.setdefault(g.id, {})[g.rank] = g.other
    first = [f"c{i:04}" for i in range(11)]
    assert all([got[f"c{i:04}"][n] for n in range(1, 11)] == [c for c in first if c != f"c{i:04}"][:10] for i in range(1500))


def exact(x, y, k, same=False):
    s = np.einsum("ia,ja->ij", x, y)
    if same:
        np.fill_diagonal(s, -9)
    return {i: np.lexsort((np.arange(len(y)), -s[i]))[:k].tolist() for i in range(len(x))}


def lists(found):
    got = {}
    for i, j, _ in zip(*found):
        got.setdefault(int(i), []).append(int(j))
    return got


@pytest.mark.parametrize("held", [50, 100_000])
def test_a_tile_serves_both_sides(monkeypatch, held):
    monkeypatch.setattr(P, "SLICE", held)
    r = np.random.default_rng(4)
    for n, m in ((700, 1100), (3, 900), (515, 7), (1, 1), (512, 512)):
        x, y = r.normal(size=(n, 8)), r.normal(size=(m, 8))
        x[: n // 4], y[: m // 3] = y[0] * 3, y[0]
        x, y = x / np.linalg.norm(x, axis=1)[:, None], y / np.linalg.norm(y, axis=1)[:, None]
        low, high = exact(x, y, 5), exact(y, x, 5)
        a, b = P.across(x, y, np.full(n, -9.0), np.full(m, -9.0), 5)
        assert lists(a) == low and lists(b) == high
        # floors that the k-th neighbours just reach leave all of the k
        a, b = P.across(x, y, np.array([x[i] @ y[low[i][-1]] for i in range(n)]) - 1e-12, np.array([y[j] @ x[high[j][-1]] for j in range(m)]) - 1e-12, 5)
        assert lists(a) == low and lists(b) == high


@pytest.mark.parametrize("block", [15, 1000])
def test_copies_are_compared_once(spark, monkeypatch, block):
    whole = P.nearest

    def few(x, y, *rest):
        assert len(x) <= 40 and len(y) <= 40
        return whole(x, y, *rest)

    monkeypatch.setattr(P, "nearest", few)
    r = np.random.default_rng(6)
    kinds = r.normal(size=(40, 16)).astype(np.float32)
    of = np.repeat(np.arange(40), [1] * 20 + [4] * 10 + [10, 11, 12] + [3] * 6 + [900])
    r.shuffle(of)
    ids = [f"v{i:04}" for i in range(len(of))]
    df = spark.createDataFrame([(i, kinds[n].tolist()) for i, n in zip(ids, of)], "chunk_id string, vector array<float>")
    got = {}
    for g in P.neighbours(df, size=16, block=block).collect():
        got.setdefault(g.id, {})[g.rank] = g.other
    u = P._unit(kinds[of].ravel(), 16)
    assert {i: [v[n] for n in range(1, 11)] for i, v in got.items()} == {ids[i]: [ids[j] for j in js] for i, js in exact(u, u, 10, True).items()}


def test_vectors_are_not_sent_for_each_block(spark):
    r = np.random.default_rng(7)
    df = spark.createDataFrame([(f"v{i:03}", r.normal(size=8).tolist()) for i in range(300)], "chunk_id string, vector array<float>")
    found = P.neighbours(df, size=8, block=30)
    assert found.count() == 3000 and "Generate" not in found._jdf.queryExecution().toString()


def test_blocks_stay_small_where_vectors_differ_in_length_only(spark):
    df = spark.createDataFrame([(f"v{i:03}", [1.0 + i, 2.0 + 2 * i]) for i in range(400)], "id string, vector array<float>")
    own, blocks = P._blocks(df, 400, 3, 2, 50)
    sizes = [len(b.ids) for b in own.select("ids").collect()]
    assert sum(sizes) == 400 and max(sizes) < 120 and len(sizes) <= blocks
    got = {}
    for g in P.neighbours(df, "id", k=3, size=2, block=50).collect():
        got.setdefault(g.id, {})[g.rank] = g.other
    u = P._unit(np.array([[1.0 + i, 2.0 + 2 * i] for i in range(400)]).ravel(), 2)
    assert {i: [v[n] for n in range(1, 4)] for i, v in got.items()} == {f"v{i:03}": [f"v{j:03}" for j in js] for i, js in exact(u, u, 3, True).items()}
