import random

from pyspark.sql import functions as F

from folioscope.llm import p6_lines as P


def maximal(docs, least):
    """Of each source the blocks in at least `least` documents that are in fewer with a line more on either side."""
    out = {}
    for source in {s for s, _ in docs}:
        texts = [t for s, t in docs if s == source]
        held = {}
        for n, t in enumerate(texts):
            for i in range(len(t)):
                for j in range(i + 1, len(t) + 1):
                    held.setdefault(t[i:j], set()).add(n)
        held = {b: len(n) for b, n in held.items() if len(n) >= least}
        longer = {}
        for b, n in held.items():
            for part in (b[1:], b[:-1]):
                longer[part] = max(longer.get(part, 0), n)
        out |= {(source, b): n for b, n in held.items() if longer.get(b, 0) < n}
    return out


def check_blocks(spark, docs, **settings):
    df = spark.createDataFrame([(s, "\n".join(t)) for s, t in docs], "source string, text string")
    letters = sorted({c for _, t in docs for c in t})
    names = {x.k: x.t for x in spark.createDataFrame([(c,) for c in letters], "t string").select("t", P.line_key(F.col("t")).alias("k")).collect()}
    rows = P.repeated_blocks(df, **settings).collect()
    got = {(x.source, "".join(names[i] for i in x.lines)): x.documents for x in rows}
    wanted = maximal(docs, settings["least"])
    assert len(rows) == len(got) and {(s, b.lower()): n for (s, b), n in got.items()} == {(s, b.lower()): n for (s, b), n in wanted.items()}
    return got


def test_blocks_against_brute_force(spark):
    r = random.Random(6)
    docs = [(s, "".join(r.choice("abcdef") for _ in range(r.randint(0, 9)))) for s in ("s", "t") for _ in range(40)]
    check_blocks(spark, docs, least=6, depth=16, shards=3)


def test_blocks_longer_than_a_batch(spark):
    r = random.Random(8)
    notice, other = "".join(r.choice("abcdefgh") for _ in range(40)), "".join(r.choice("abcd") for _ in range(11))
    docs = []
    for n in range(30):
        own = [r.choice("mnopq") for _ in range(r.randint(0, 6))]
        own.insert(r.randint(0, len(own)), [notice, notice[:25], notice[9:] + notice[:13], "xy" + notice, other + other, other[3:] + "z" + other][n % 6])
        docs.append(("s" if n % 7 else "t", "".join(own)))
    got = check_blocks(spark, docs, least=3, depth=4, shards=2)
    assert ("s", notice) in got and max(len(b) for _, b in got) == 44


def test_places_and_removal(spark):
    schema = "slug string, ord int, type string, text_level int, text string, source string, line long"
    rows = [("s", n, "text", None, f"  Copy   {n} of 6\nown {'abcdefghij'[n]}\n\nSHARE  this" if n < 6 else "share This", "x", 1) for n in range(7)]
    rows += [("t", n, "text", None, "share this", "x", 1) for n in range(5)] + [("s", 50, "text", 1, "share this", "x", 1), ("s", 51, "text", None, None, "x", 1), ("s", 52, "text", None, "", "x", 1), ("s", 53, "text", None, "own a\nown a\n" * 9, "x", 1), (None, 54, "text", None, "share this", "x", 1)]
    rows += [rows[0]]
    block = spark.createDataFrame(rows, schema)
    got = {(x.slug, x.ord, x.line_no) for x in P.repeated_line_places(block).collect()}
    assert got == {("s", n, k) for n in range(6) for k in (0, 3)} | {("s", 6, 0)}
    b = P.plain_blocks(block)
    clean = {(x.source, x.ord): (x.clean, x.removed) for x in P.without_lines(b, P.repeated_lines(b), ["source", "ord"]).collect()}
    assert clean["s", 2] == ("own c\n", 2) and clean["s", 6] == ("", 1) and clean["t", 0] == ("share this", 0) and clean["s", 51][0] is None and clean["s", 52] == ("", 0)
    assert P.repeated_line_places(block.where("false")).count() == 0


def test_long_documents(spark):
    df = spark.createDataFrame([("s", "\n".join(f"line {'x' * (i % 7)} {'y' * (i % 11)}" for i in range(20000)))] * 6, "source string, text string")
    assert P.repeated_lines(df).count() == 77
