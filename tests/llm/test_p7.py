import random

from folioscope.llm import p7_leaks as P


def test_leaks_against_brute_force(spark):
    r = random.Random(7)
    words = [f"w{i}" for i in range(40)] + ["Ünïcode", "naïve"]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([5, 12, 30, 60])))) for i in range(40)]
    docs = []
    for d in range(120):
        own = [r.choice(words) for _ in range(r.randint(0, 60))]
        if d % 3 == 0:
            w = r.choice(items)[1].split()
            n = r.choice([11, 12, 13, 40])
            s = r.randint(0, max(0, len(w) - n))
            own[len(own) // 2 : len(own) // 2] = w[s : s + n]
        docs.append((d, (" " if d % 2 else "\n").join(own).upper().replace("W1", "Ｗ1") if d % 4 else " - ".join(own)))
    docs += [(500, None), (501, ""), (None, items[3][1]), (1, docs[1][1]), (502, "  ".join(items[2][1].split()))]
    items += [(40, None), (41, ""), (None, "x"), (2, items[2][1])]

    def grams(t):
        w = P.words_of(P.pd.Series([t]))[0] if t else []
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    expected = {(d, i) for d, t in docs for i, u in items if d is not None and i is not None and grams(t) & grams(u)}
    schema = "doc_id long, text string, extra string"
    D = spark.createDataFrame([(d, t, "x") for d, t in docs], schema)
    T = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    assert {(x.doc_id, x.item_id) for x in P.leaks(D, T).collect()} == expected and len(expected) > 10
    assert {(x.doc_id, x.item_id) for x in P.leaks(D, T, shard_words=120, pass_words=400).collect()} == expected  # several shards and passes
    report = {x.item_id: x.documents for x in P.leak_report(D, T).collect()}
    assert len(report) == 42 and sum(report.values()) == len(expected)
    assert P.leaks(D, T.where("false")).count() == 0 and P.leaks(D.where("false"), T).count() == 0


def test_a_long_text(spark):
    item = " ".join(f"q{i}" for i in range(50))
    text = "x " * 200_000 + item + " y" * 200_000
    D = spark.createDataFrame([(1, text)], "doc_id long, text string")
    T = spark.createDataFrame([(9, item), (8, "q0 " * 30)], "item_id long, text string")
    assert [(x.doc_id, x.item_id) for x in P.leaks(D, T).collect()] == [(1, 9)]
