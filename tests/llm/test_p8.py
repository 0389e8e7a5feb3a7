import math

import pytest

from folioscope.llm import p8_mixture as P


def test_temperature():
    shares, even = [0.7, 0.2, 0.1], [1 / 3] * 3
    assert P.tempered(shares, even, 1.0) == pytest.approx(shares) and P.tempered(shares, even, 0.0) == pytest.approx(even)
    assert P.tempered(shares, [0.1, 0.1, 0.8], 0.0) == pytest.approx([0.1, 0.1, 0.8]) and P.tempered([1.0, 0.0], [0.5, 0.5], 0.5) == [1.0, 0.0]
    assert P.bisect_exponent(lambda e: False) is None and P.bisect_exponent(lambda e: True) == 0.0
    assert P.bisect_exponent(lambda e: e >= 0.3) == pytest.approx(0.3)
    assert P.own_exponent(0.2, 0.4, 2) == 0.0 and P.own_exponent(0.1, 0.4, 2) == pytest.approx(0.5) and P.own_exponent(0.0, 0.1, 5) == 1.0 and P.own_exponent(0.0, 0.0, 5) == 0.0


def test_shares_keep_limits():
    tokens, weights, repeats = [1000, 100, 0, 500], [0.3, 0.4, 0.1, 0.2], [2, 2, 5, 3]
    s, e = P.target_shares(tokens, weights, repeats)
    total = sum(tokens)
    assert s[1] == pytest.approx(200 / total) and s[2] == 0 and sum(s) == pytest.approx(1) and e[2] == 1 and 0 < e[1] < 1 and e[0] == e[3] == 0
    assert all(x * total <= t * r + 1e-6 for x, t, r in zip(s, tokens, repeats))
    assert P.target_shares([], [], []) == ([], []) and P.target_shares([0, 0], [0.5, 0.5], [1, 1])[0] == [0, 0]


def test_an_exponent_between():
    # what the second can't take would break the third's limit at the weights, so the others go part of the way to their sizes
    tokens, weights, repeats = [800, 50, 150], [0.3, 0.3, 0.4], [2, 2, 3]
    s, e = P.target_shares(tokens, weights, repeats)
    assert sum(s) == pytest.approx(1) and s[1] == pytest.approx(0.1) and s[2] == pytest.approx(0.45) and 0 < e[0] == e[2] < 1
    # an entropy halfway between that of the sizes and the largest
    s, e = P.target_shares([700, 200, 100, 0], [0.25] * 4, [9] * 4, evenness=0.5)
    assert P.entropy(s) == pytest.approx((P.entropy([0.7, 0.2, 0.1]) + math.log(3)) / 2, abs=1e-6) and 0 < e[0] < 1 and s[3] == 0
    s, _ = P.target_shares([700, 200, 100], [0.25] * 3, [1, 1, 1], evenness=0.5)  # nothing may come twice
    assert s == pytest.approx([0.7, 0.2, 0.1])
    s, _ = P.target_shares([700, 200, 100], [0.25] * 3, [9, 9, 9], evenness=1.0)
    assert s == pytest.approx([1 / 3] * 3)


def rows(spark):
    docs = [(i, f"word{i} and {'more ' * (i % 9)}text", ["a", "b", "c", None, "off list"][i % 5] if i % 3 else "a", "x") for i in range(400)]
    docs += [(900, None, "a", "x"), (901, "", "b", "x"), (None, "t", "a", "x"), (3, docs[3][1], docs[3][2], "x")]
    D = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens string")
    T = spark.createDataFrame([("a", 0.3, 2), ("b", 0.4, 2), ("c", 0.2, 3), ("gone", 0.1, None), (None, 0.5, 1)], "source string, weight double, max_repeat int")
    return docs, D, T


def test_mixture(spark):
    docs, D, T = rows(spark)
    sized, plan = P.prepared(D, T)
    encode = P._encoding(P.TOKENIZER).encode_ordinary
    size = {x.doc_id: x.tokens for x in sized.collect()}
    assert size == {d: len(encode(t)) if t else 0 for d, t, s, _ in docs if d is not None and s in ("a", "b", "c")}
    p = {x.source: x for x in plan.collect()}
    total = sum(x.tokens for x in p.values())
    for s, w, r in (("a", 0.3, 2), ("b", 0.4, 2), ("c", 0.2, 3), ("gone", 0.1, 1)):
        assert p[s].reachable == (p[s].tokens * r >= w * total)
    mixed = P.mixture(sized, plan, block=7).collect()
    for s in "abc":
        own = [x for x in mixed if x.source == s]
        used = sum(x.tokens * x.repeats for x in own)
        assert p[s].budget - max(size.values()) < used <= p[s].budget  # full but for less than one document
        assert max(x.repeats for x in own) <= {"a": 2, "b": 2, "c": 3}[s]
    r = {x.source: x for x in P.reached(P.mixture(sized, plan, block=7), plan).collect()}
    assert sum(x.share for x in r.values()) == pytest.approx(1) and r["gone"].tokens_used == 0
    places = P.permuted(P.mixture(sized, plan)).collect()
    assert len({(x.doc_id, x.epoch) for x in places}) == len(places)


def test_nothing(spark):
    _, D, T = rows(spark)
    sized, plan = P.prepared(D.where("false"), T)
    assert plan.count() == 4 and P.mixture(sized, plan).count() == 0
    sized, plan = P.prepared(D, T.where("false"))
    assert plan.count() == 0 and P.reached(P.mixture(sized, plan), plan).count() == 0
