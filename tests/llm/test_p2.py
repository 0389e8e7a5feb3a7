import numpy as np

from folioscope.llm import p2_languages as P

TEXT = {
    "de": "Der Rat hat gestern beschlossen, dass die alte Brücke über den Fluss nicht mehr für den Verkehr geöffnet wird und eine neue gebaut werden soll.",
    "en": "The council decided yesterday that the old bridge across the river will no longer be open to traffic and that a new one should be built soon.",
    "es": "El consejo decidió ayer que el viejo puente sobre el río ya no estará abierto al tráfico y que se debe construir uno nuevo cuanto antes.",
    "fr": "Le conseil a décidé hier que le vieux pont sur la rivière ne serait plus ouvert à la circulation et qu'il fallait en construire un nouveau.",
    "pt": "O conselho decidiu ontem que a velha ponte sobre o rio não estará mais aberta ao trânsito e que uma nova deve ser construída em breve.",
}


def varied(lang, n):
    words, r = TEXT[lang].split(), np.random.default_rng(n)
    return " ".join(words[i] for i in r.permutation(len(words)))


def chunks(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, is_parent boolean, text string, lang string")


def data(spark):
    rows, labels = [], []
    for k, lang in enumerate(P.LANGUAGES):
        for n in range(30):
            key = f"{lang}{n:02}"
            other = P.LANGUAGES[(k + 1) % 5]
            text = varied(lang, n) + ("\n\n" + varied(other, n) if n == 29 else "")
            rows.append((key, False, text, "x"))
            labels.append(("chunk", key, other if n == 0 else ["", lang.upper(), f"{lang}-XX", P.NAMES[lang][0], P.NAMES[lang][2]][n % 5] if n > 1 else None))
    rows += [("null", False, None, "x"), ("empty", False, "", "x"), ("maths", False, "$$ " + "x " * 30, "x"), ("p", True, TEXT["en"], "x"), (rows[5][0], *rows[5][1:])]
    meta = spark.createDataFrame([("s", ["El viejo puente sobre el río", None, ""]), ("t", None)], "slug string, titles array<string>")
    label = spark.createDataFrame(labels, "item_kind string, item_key string, lang string")
    return chunks(spark, rows), meta, label


def test_declared_languages(spark):
    rows = [("en-GB",), (" EN ",), ("español",), ("und",), ("??",), (None,), ("",), ("Deutsch",), ("por",), ("pt_BR",)]
    got = [x.d for x in spark.createDataFrame(rows, "l string").select(P.declared(P.F.col("l")).alias("d")).collect()]
    assert got == ["en", "en", "es", None, None, None, None, "de", "pt", "pt"]


def test_wrong_labels_and_languages(spark):
    c, m, label = data(spark)
    found = {(x.item_kind, x.item_key, x.seg_no): x.lang for x in P.wrong_labels(c, m, label).collect()}
    for k, lang in enumerate(P.LANGUAGES):
        assert found.pop(("chunk", f"{lang}00", 0)) == lang  # a wrong label
        assert found.pop(("chunk", f"{lang}01", 0)) == lang  # none
        assert found.pop(("chunk", f"{lang}29", 1)) == P.LANGUAGES[(k + 1) % 5]  # true of another paragraph only
        for n in range(5, 30, 5):
            assert found.pop(("chunk", f"{lang}{n:02}", 0)) == lang  # an empty label
    assert found.pop(("title", "s", 0)) == "es" and not found
    rows = {(x.item_key, x.seg_no): (x.lang, x.confidence) for x in P.languages(c, m, label).collect()}
    assert rows["de05", -1][0] == "de" and 0.2 < rows["de05", -1][1] <= 1
    assert rows["empty", 0] == (None, 0.0) and ("null", 0) not in rows and rows["s", 2] == (None, 0.0)


def test_held_out_accuracy_with_wrong_labels():
    r = np.random.default_rng(0)
    texts = [varied(lang, n) for n in range(40) for lang in P.LANGUAGES]
    labels = [int(r.integers(5)) if r.random() < 0.15 else k for _ in range(40) for k in range(5)]
    net = P.train(texts, labels)
    test = [varied(lang, n)[:90] for n in range(100, 120) for lang in P.LANGUAGES]
    got = net.log_probabilities(P.as_array([P.windows(t)[0] for t in test])).argmax(1)
    assert (got == np.tile(np.arange(5), 20)).mean() >= 0.97


def test_gradients():
    net, r = P.ByteNetwork(3, 1), np.random.default_rng(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = r.integers(1, 256, (4, P.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 1])
    g = net.gradients(x, y)
    loss = lambda: -net.log_probabilities(x)[np.arange(4), y].mean()
    for name in ("w", "u", "b", "c", "e"):
        at = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        old, step = net.p[name][at], 1e-3
        net.p[name][at] = old + step
        up = loss()
        net.p[name][at] = old - step
        slope = (up - loss()) / (2 * step)
        net.p[name][at] = old
        assert abs(slope - g[name][at]) < 0.05 * abs(slope) + 1e-4


def test_windows_and_no_labels(spark):
    import pytest

    assert P.windows("123 $$ —") == [] and P.windows("") == []
    long = "ä" * 5000
    assert sum(len(w) for w in P.windows(long)) >= 10000 and max(map(len, P.windows(long))) <= P.WINDOW
    c, m, label = data(spark)
    with pytest.raises(ValueError):
        P.wrong_labels(c, m, label.where("false"))
