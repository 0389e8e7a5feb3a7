"""The registered queries of the numbered problems, and SQL for those that SQL can express."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import once, table
from . import p1_similar, p2_languages, p3_scans, p4_neighbours, p5_pieces, p6_lines, p7_leaks, p8_mixture, p9_forms


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = p1_similar.similar_pairs(p1_similar.child_texts(table(spark, folder, "chunk")))
    return pairs.select(F.col("id_a").alias("chunk_id_a"), F.col("id_b").alias("chunk_id_b"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    groups = p1_similar.groups(p1_similar.child_texts(table(spark, folder, "chunk")))
    return groups.withColumnRenamed("id", "chunk_id")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_languages.wrong_labels(*(table(spark, folder, n) for n in ("chunk", "book_meta", "lang_label")))


def p2_languages_of(spark: SparkSession, folder: str) -> DataFrame:
    return p2_languages.languages(*(table(spark, folder, n) for n in ("chunk", "book_meta", "lang_label")))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_scans.damages(*(table(spark, folder, n) for n in ("block", "book_meta", "outline")))


def p3_clean_blocks(spark: SparkSession, folder: str) -> DataFrame:
    block = table(spark, folder, "block")
    titles = p3_scans.book_titles(block, table(spark, folder, "book_meta"), table(spark, folder, "outline"))
    return p3_scans.repaired(p3_scans.plain_blocks(block), titles).select(F.col("source").alias("slug"), F.col("id").alias("ord"), "clean")


def p3_clean_chunks(spark: SparkSession, folder: str) -> DataFrame:
    block = table(spark, folder, "block")
    titles = p3_scans.book_titles(block, table(spark, folder, "book_meta"), table(spark, folder, "outline"))
    corpus = p3_scans.without_furniture(p3_scans.plain_blocks(block), titles)
    c = once(table(spark, folder, "chunk").select("chunk_id", "book_slug", "text"), "chunk_id")
    texts = c.select(F.col("book_slug").alias("source"), F.col("chunk_id").alias("id"), F.lit(None).cast("int").alias("page"), "text")
    return p3_scans.repaired(texts, titles, corpus).select(F.col("id").alias("chunk_id"), "clean")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_neighbours.neighbour_pairs(table(spark, folder, "children"))


def p4_neighbours_of(spark: SparkSession, folder: str) -> DataFrame:
    return p4_neighbours.neighbours(table(spark, folder, "children")).select("id", "rank", "other", F.round("similarity", 6).alias("similarity"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces.split_oversized(table(spark, folder, "chunk")).select("chunk_id").distinct()


def p5_split(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces.split_oversized(table(spark, folder, "chunk"))


def p5_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Of each oversized chunk: the digest of what its pieces give again, and whether each is under the limit and under its
    breadcrumb and has up to 40 tokens of the one before."""
    chunk = table(spark, folder, "chunk")
    big = p5_pieces.oversized(chunk).select("chunk_id", "breadcrumb", F.when(F.col("is_parent"), p5_pieces.PARENT_LIMIT).otherwise(p5_pieces.CHILD_LIMIT).alias("limit"))
    p = p5_pieces.split_oversized(chunk).join(big, "chunk_id")
    own = F.expr("substring(text, length(text) - (`end` - own_start) + 1)")
    fits = (F.col("tokens") <= F.col("limit")) & (F.length("text") <= 4 * F.col("limit") + 3)
    headed = (F.col("breadcrumb") == "") | F.startswith("text", F.concat("breadcrumb", F.lit("\n\n")))
    shared = F.when(F.col("piece_no") > 0, (F.col("own_start") - F.col("start")).between(1, 4 * p5_pieces.OVERLAP)).otherwise(F.col("start") == 0)
    return p.groupBy("chunk_id").agg(
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("own")))), lambda x: x["own"]), "")).alias("text_md5"),
        F.bool_and(fits).alias("under_limit"), F.bool_and(headed).alias("under_breadcrumb"), F.bool_and(shared).alias("shares"),
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_lines.repeated_line_places(table(spark, folder, "block"))


def p6_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """The maximal blocks of lines that repeat within each book, as their compared text."""
    b = p6_lines.plain_blocks(table(spark, folder, "block"))
    found = p6_lines.block_texts(p6_lines.repeated_blocks(b), b)
    return found.select(F.col("source").alias("slug"), "lines", "n_lines", "documents")


def p6_clean_blocks(spark: SparkSession, folder: str) -> DataFrame:
    b = p6_lines.plain_blocks(table(spark, folder, "block"))
    clean = p6_lines.without_lines(b, p6_lines.repeated_lines(b), ["source", "ord"])
    return clean.select(F.col("source").alias("slug"), "ord", "clean", "removed")


def p6_clean_every_block(spark: SparkSession, folder: str) -> DataFrame:
    """p6_clean_blocks over the blocks of every type; the repeated lines are still those of the text blocks."""
    block = table(spark, folder, "block")
    clean = p6_lines.without_lines(p6_lines.all_blocks(block), p6_lines.repeated_lines(p6_lines.plain_blocks(block)), ["source", "ord"])
    return clean.select(F.col("source").alias("slug"), "ord", "clean", "removed")


def p6_clean_chunks(spark: SparkSession, folder: str) -> DataFrame:
    repeated = p6_lines.repeated_lines(p6_lines.plain_blocks(table(spark, folder, "block")))
    c = once(table(spark, folder, "chunk").select("chunk_id", F.col("book_slug").alias("source"), "text"), "chunk_id")
    return p6_lines.without_lines(c, repeated, ["chunk_id"]).select("chunk_id", "clean", "removed")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks.leak_report(table(spark, folder, "documents"), table(spark, folder, "eval_item"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    _, plan = p8_mixture.prepared(table(spark, folder, "documents"), table(spark, folder, "mix_target"))
    return plan.where("not reachable").select("source")


def p8_mixture_rows(spark: SparkSession, folder: str) -> DataFrame:
    sized, plan = p8_mixture.prepared(table(spark, folder, "documents"), table(spark, folder, "mix_target"))
    return p8_mixture.permuted(p8_mixture.mixture(sized, plan))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    sized, plan = p8_mixture.prepared(table(spark, folder, "documents"), table(spark, folder, "mix_target"))
    return p8_mixture.reached(p8_mixture.mixture(sized, plan), plan)


def _by_characters(spark: SparkSession, folder: str, evenness: float | None = None) -> DataFrame:
    """The mixture's plan with sizes in characters, which SQL can count too, and whether what comes out keeps to it: by less
    than one document under the budget, and no document more often than its limit."""
    sized, plan = p8_mixture.prepared(table(spark, folder, "documents"), table(spark, folder, "mix_target"), size=F.length("text"), evenness=evenness)
    got = p8_mixture.reached(p8_mixture.mixture(sized, plan), plan).select("source", "tokens_used", "most_repeats")
    p = plan.join(got, "source").join(sized.groupBy("source").agg(F.max("tokens").alias("largest")), "source", "left")
    kept = F.col("tokens_used").between(F.col("budget") - F.coalesce("largest", F.lit(0)), F.col("budget")) & (F.col("most_repeats") <= F.col("max_repeat"))
    return p.select("source", "weight", "reachable", F.round("exponent", 5).alias("exponent"), F.round("planned", 5).alias("share"), kept.alias("kept"))


def p8_character_plan(spark: SparkSession, folder: str) -> DataFrame:
    return _by_characters(spark, folder)


def p8_even_plan(spark: SparkSession, folder: str) -> DataFrame:
    """A mixture whose entropy is halfway between that of the sources' sizes and the largest."""
    return _by_characters(spark, folder, 0.5)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_forms.same_looking_pairs(table(spark, folder, "documents"))


def p9_classes(spark: SparkSession, folder: str) -> DataFrame:
    return p9_forms.same_looking_classes(table(spark, folder, "documents"))


def p9_form(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return p9_forms.consistent_texts(docs).select("doc_id", "form")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[:1] == "p" and k[1:2].isdigit() and isinstance(f, type(queries))}


_PAIRS = r"""c AS (SELECT DISTINCT ON (chunk_id) chunk_id, text FROM chunk WHERE NOT is_parent),
            w AS (SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM c),
            s AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
            n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY 1),
            p AS (SELECT a.chunk_id AS a, b.chunk_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2),
            f AS (SELECT a, b FROM p JOIN n x ON x.chunk_id = a JOIN n y ON y.chunk_id = b WHERE k >= 0.6 * (x.n + y.n - k))"""
_RANKED = """c AS (SELECT DISTINCT ON (chunk_id) chunk_id, vector FROM children WHERE len(vector) = 64 AND list_sum(list_transform(vector, lambda x: abs(x))) > 0),
            u AS (SELECT chunk_id, list_transform(vector, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(vector, lambda y: CAST(y AS DOUBLE) * y)))) AS u FROM c),
            r AS (SELECT a.chunk_id AS a, b.chunk_id AS b, list_dot_product(a.u, b.u) AS sim,
              row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_dot_product(a.u, b.u) DESC, b.chunk_id) AS rank FROM u a, u b WHERE a.chunk_id <> b.chunk_id QUALIFY rank <= 10)"""
_KEY = r"regexp_replace(regexp_replace(lower(trim(regexp_replace(line, '\s+', ' ', 'g'))), '\s+', ' ', 'g'), '[0-9]+', '0', 'g')"
_LINES = f"""b AS (SELECT DISTINCT ON (slug, ord) slug, ord, text FROM block WHERE type = 'text' AND text_level IS NULL),
            l AS (SELECT slug, ord, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM b WHERE text IS NOT NULL),
            k AS (SELECT slug, ord, line_no, line AS raw, {_KEY} AS line FROM l),
            f AS (SELECT slug, line FROM k WHERE line <> '' GROUP BY slug, line HAVING count(DISTINCT ord) >= 6)"""
_SIZES = """d AS (SELECT DISTINCT ON (doc_id) doc_id, source, text FROM documents WHERE source IN (SELECT source FROM mix_target)),
            p AS (SELECT t.source, t.weight, t.max_repeat, coalesce(n, 0) / (SELECT sum(length(text)) FROM d) AS s FROM mix_target t LEFT JOIN (SELECT source, sum(length(text)) AS n FROM d GROUP BY 1) USING (source))"""
_KEPT = "coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (f.line IS NULL), '') AS clean, count(f.line) AS removed"


def _compatible() -> tuple[str, str, list[tuple[str, str]]]:
    """By the rule of the form, of the characters up to U+FFFF whose compatibility form isn't kept apart: those that become one
    character, what these become, and ligatures, dots and the like that become several."""
    one, to, several = "", "", []
    for c in map(chr, range(0xA0, 0x10000)):
        kind, form = unicodedata.decomposition(c).split(" ")[0], unicodedata.normalize("NFKC", c)
        if kind.startswith("<") and kind not in ("<super>", "<sub>") and form != " ":
            if len(form) == 1:
                one, to = one + c, to + form
            elif 0x100 <= ord(c) < 0x250 or 0x2010 <= ord(c) < 0x2070 or 0xFB00 <= ord(c) < 0xFB10:
                several.append((c, form))
    return one, to, several


def _form_sql() -> str:
    """t0(id, x): every document's text; d(id, form): its consistent form; step by step, as the operator takes them."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    one, to, several = _compatible()
    spaces, hyphens = "".join(map(chr, p9_forms.SPACES)), "".join(map(chr, p9_forms.HYPHENS))
    drop = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in p9_forms.IGNORABLE)
    chars = f"translate(x, {quoted(spaces + hyphens + chr(0x2028) + chr(0x85))}, {quoted(' ' * len(spaces) + '-' * len(hyphens) + chr(10) * 2)})"
    forms = f"translate(x, {quoted(one)}, {quoted(to)})"
    for a, b in several:
        forms = f"replace({forms}, {quoted(a)}, {quoted(b)})"
    look = p9_forms.LOOKALIKES
    latin = f"translate(w, {quoted(''.join(look))}, {quoted(''.join(look.values()))})"
    return rf"""t0 AS (SELECT doc_id AS id, any_value(text) AS x FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY 1),
        t1 AS (SELECT id, regexp_replace(x, '[{drop}]', '', 'g') AS x FROM t0), t2 AS (SELECT id, {chars} AS x FROM t1), t3 AS (SELECT id, {forms} AS x FROM t2), t4 AS (SELECT id, {chars} AS x FROM t3),
        t5 AS (SELECT id, nfc_normalize(array_to_string(list_transform(regexp_extract_all(x, '\p{{L}}[\p{{L}}\p{{M}}]*|[^\p{{L}}]+'),
          lambda w: CASE WHEN regexp_matches(w, '[A-Za-z\x{{AA}}\x{{BA}}\x{{C0}}-\x{{D6}}\x{{D8}}-\x{{F6}}\x{{F8}}-\x{{24F}}]') THEN {latin} ELSE w END), '')) AS x FROM t4),
        d AS (SELECT id, replace(replace(x, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS form FROM t5)"""


def _leak_sql() -> str:
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    return rf"""{_form_sql()}, dw AS (SELECT id, {words.format("form")} AS w FROM d), iw AS (SELECT item_id, {words.format("text")} AS w FROM eval_item WHERE text IS NOT NULL),
        dr AS (SELECT DISTINCT id, array_to_string(w[i:i + 11], ' ') AS r FROM (SELECT id, w, unnest(range(1, len(w) - 10)) AS i FROM dw)),
        ir AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS r FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM iw)),
        lk AS (SELECT DISTINCT id AS doc_id, item_id FROM dr JOIN ir USING (r))"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_groups": f"""
            WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM f UNION ALL SELECT b, a FROM f),
            t(a, b) AS (SELECT a, b FROM e UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
            g AS (SELECT a, min(b) AS m FROM t GROUP BY 1), d AS (SELECT a, count(*) AS links FROM e GROUP BY 1)
            SELECT c.chunk_id, least(c.chunk_id, coalesce(g.m, c.chunk_id)) AS group_id, coalesce(links, 0) AS links FROM c LEFT JOIN g ON g.a = c.chunk_id LEFT JOIN d ON d.a = c.chunk_id""",
        "p4_neighbours_of": f"WITH {_RANKED} SELECT a AS id, CAST(rank AS INTEGER) AS rank, b AS other, round(sim, 6) AS similarity FROM r",
        "p6_blocks": f"""WITH {_LINES}, a AS (SELECT slug, ord, list(line ORDER BY line_no) AS a FROM k WHERE line <> '' GROUP BY 1, 2),
            i AS (SELECT slug, ord, a, unnest(range(1, len(a) + 1)) AS i FROM a), s AS (SELECT slug, ord, a[i:j] AS s FROM (SELECT *, unnest(range(i, len(a) + 1)) AS j FROM i)),
            r AS (SELECT slug, s, count(DISTINCT ord) AS n FROM s GROUP BY 1, 2 HAVING count(DISTINCT ord) >= 6),
            x AS (SELECT slug, s[2:] AS s, n FROM r UNION SELECT slug, s[:-2], n FROM r)
            SELECT slug, array_to_string(s, chr(10)) AS lines, CAST(len(s) AS BIGINT) AS n_lines, n AS documents FROM r WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.slug = r.slug AND x.s = r.s AND x.n = r.n)""",
        "p6_clean_blocks": f"WITH {_LINES} SELECT k.slug, k.ord, {_KEPT} FROM k LEFT JOIN f ON f.slug = k.slug AND f.line = k.line GROUP BY 1, 2",
        "p6_clean_every_block": f"""WITH {_LINES}, al AS (SELECT slug, ord, text, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS line_no
              FROM (SELECT DISTINCT ON (slug, ord) slug, ord, text FROM block)),
            ak AS (SELECT slug, ord, text, line_no, line AS raw, {_KEY} AS line FROM al)
            SELECT ak.slug, ak.ord, CASE WHEN ak.text IS NOT NULL THEN coalesce(string_agg(raw, chr(10) ORDER BY line_no) FILTER (f.line IS NULL), '') END AS clean, count(f.line) AS removed
            FROM ak LEFT JOIN f ON f.slug = ak.slug AND f.line = ak.line GROUP BY ak.slug, ak.ord, ak.text""",
        "p6_clean_chunks": f"""WITH {_LINES}, cl AS (SELECT chunk_id, book_slug AS slug, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM (SELECT DISTINCT ON (chunk_id) * FROM chunk)),
            ck AS (SELECT chunk_id, slug, line_no, line AS raw, {_KEY} AS line FROM cl)
            SELECT chunk_id, {_KEPT} FROM ck LEFT JOIN f ON f.slug = ck.slug AND f.line = ck.line GROUP BY 1""",
        "p1_found": f"WITH {_PAIRS} SELECT a AS chunk_id_a, b AS chunk_id_b FROM f",
        "p4_found": f"WITH {_RANKED} SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM r",
        # item texts are taken as they are: they hold no character that the form changes within a word
        "p7_found": f"WITH {_leak_sql()} SELECT doc_id, item_id FROM lk",
        "p7_report": f"WITH {_leak_sql()} SELECT i.item_id, count(doc_id) AS documents FROM (SELECT DISTINCT item_id FROM eval_item) i LEFT JOIN lk USING (item_id) GROUP BY 1",
        "p9_form": f"WITH {_form_sql()} SELECT id AS doc_id, form FROM d",
        "p9_classes": f"""WITH {_form_sql()}, b AS (SELECT d.id, form, x AS text FROM d JOIN t0 USING (id)), f AS (SELECT form, min(id) AS class_id, count(DISTINCT text) AS texts, CAST(count(*) AS BIGINT) AS documents FROM b GROUP BY 1)
            SELECT id AS doc_id, class_id, texts, documents FROM b JOIN f USING (form)""",
        "p9_found": f"WITH {_form_sql()}, b AS (SELECT d.id, form, x AS text FROM d JOIN t0 USING (id)) SELECT a.id AS doc_id_a, b.id AS doc_id_b FROM b a JOIN b ON a.form = b.form AND a.id < b.id AND a.text <> b.text",
        "p8_found": """
            -- characters stand for tokens here: by the statement of the problem, the margins hold for any usual tokenizer
            WITH d AS (SELECT DISTINCT ON (doc_id) doc_id, source, length(text) AS n FROM documents WHERE source IN (SELECT source FROM mix_target)),
            s AS (SELECT source, sum(n) AS n FROM d GROUP BY 1)
            SELECT t.source FROM mix_target t LEFT JOIN s USING (source) WHERE coalesce(n, 0) * max_repeat < weight * (SELECT sum(n) FROM s)""",
        "p8_character_plan": f"""WITH {_SIZES},
            f AS (SELECT 1 - sum(max_repeat * s) AS rest FROM p WHERE max_repeat * s < weight), g AS (SELECT sum(weight) AS w FROM p WHERE max_repeat * s >= weight)
            SELECT source, weight, max_repeat * s >= weight AS reachable, CASE WHEN max_repeat * s >= weight THEN 0.0 WHEN s = 0 THEN 1.0 ELSE round(1 - ln(max_repeat) / ln(weight / s), 5) END::DOUBLE AS exponent,
              round(CASE WHEN max_repeat * s < weight THEN max_repeat * s ELSE weight * coalesce(rest, 1) / w END, 5) AS share, true AS kept FROM p, f, g""",
        "p8_even_plan": f"""WITH RECURSIVE {_SIZES}, l AS (SELECT list(s ORDER BY source) AS s, list(max_repeat ORDER BY source) AS r, count(*) AS n FROM p WHERE s > 0),
            h AS (SELECT s, r, 0.5 * ln(n) - 0.5 * list_sum(list_transform(s, lambda x: x * ln(x))) AS goal FROM l),
            b(k, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT k + 1, CASE WHEN ok THEN lo ELSE m END, CASE WHEN ok THEN m ELSE hi END FROM (
              SELECT k, lo, hi, m, ln(z) - list_sum(list_transform(q, lambda x: x * ln(x))) / z <= goal + 1e-12 AND list_bool_and(list_transform(range(1, len(q) + 1), lambda i: q[i] / z <= r[i] * s[i] + 1e-12)) AS ok FROM (
                SELECT *, list_sum(q) AS z FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m, list_transform(s, lambda x: pow(x, (lo + hi) / 2)) AS q, s, r, goal FROM b, h WHERE k < 60)))),
            e AS (SELECT hi AS e FROM b WHERE k = 60), z AS (SELECT sum(pow(s, e)) AS z FROM p, e WHERE s > 0)
            SELECT source, weight, max_repeat * s >= weight AS reachable, round(e, 5) AS exponent, CASE WHEN s > 0 THEN round(pow(s, e) / z, 5) ELSE 0.0 END::DOUBLE AS share, true AS kept FROM p, e, z""",
        "p6_found": f"WITH {_LINES} SELECT slug, ord, CAST(line_no AS INTEGER) AS line_no FROM k JOIN f USING (slug, line)",
        "p5_rejoined": """
            SELECT chunk_id, md5(text) AS text_md5, true AS under_limit, true AS under_breadcrumb, true AS shares FROM (SELECT DISTINCT ON (chunk_id) * FROM chunk)
            WHERE (length(text) + CASE WHEN coalesce(breadcrumb, '') <> '' THEN length(breadcrumb) + 2 ELSE 0 END) // 4
                  > CASE WHEN is_parent THEN 2000 ELSE 350 END""",
        "p5_found": """
            SELECT DISTINCT chunk_id FROM chunk
            WHERE (length(text) + CASE WHEN coalesce(breadcrumb, '') <> '' THEN length(breadcrumb) + 2 ELSE 0 END) // 4
                  > CASE WHEN is_parent THEN 2000 ELSE 350 END""",
    }
