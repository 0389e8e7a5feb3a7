"""SQL that gives the results of the registered queries on another engine."""

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_B = "b AS (SELECT DISTINCT ON (slug, ord) * FROM block ORDER BY slug, ord, loaded_at DESC)"
_M = "m AS (SELECT DISTINCT ON (slug) * FROM book_meta)"
_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunk ORDER BY chunk_id, loaded_at DESC)"
_CH = "ch AS (SELECT DISTINCT ON (chunk_id) * FROM children)"
_TRIM = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_NOTE = rf"(type = 'text' AND text_level IS NULL AND regexp_matches({_TRIM}, '^(Section|Chapter|Appendix|Exercise|Figure|Table|Sección|Capítulo|Ejercicio)\s+[0-9A-Z]+(\.[0-9]+)*\.?$'))"
_K = f"k AS (SELECT * FROM b WHERE type NOT IN ('aside_text', 'page_number', 'header', 'footer') AND NOT {_NOTE})"
_KNOWN = r"known AS (SELECT slug, lower(regexp_replace(title, '^\s+|\s+$', '', 'g')) AS key, arg_max(depth, ord) AS depth FROM outline GROUP BY 1, 2)"
_H = rf"""h AS (SELECT b.slug, ord, {_TRIM} AS title,
    least(6, coalesce(known.depth, CASE WHEN regexp_matches({_TRIM}, '^[0-9]+(\.[0-9]+)*\.?\s+\S')
      THEN 1 + length(regexp_extract({_TRIM}, '^([0-9]+(\.[0-9]+)*)', 1)) - length(replace(regexp_extract({_TRIM}, '^([0-9]+(\.[0-9]+)*)', 1), '.', '')) ELSE 2 END)) AS depth
    FROM b LEFT JOIN known ON b.slug = known.slug AND lower({_TRIM}) = known.key WHERE text_level IS NOT NULL)"""
_TURN = "t AS (SELECT slug, ord, page FROM (SELECT slug, ord, page, lag(page) OVER (PARTITION BY slug ORDER BY ord) AS p FROM k) WHERE p IS NULL OR page <> p)"
_MAN = "man AS (SELECT book_slug, count(*) AS chunks, count(*) FILTER (is_parent) AS parents, count(*) FILTER (NOT is_parent) AS children FROM c GROUP BY 1)"
_KIND = "coalesce(list_extract(['notes', 'extra book', 'basic book', 'guide', 'exam', 'slides', 'assignment', 'code'], CASE WHEN tier >= 0 THEN tier + 1 END), 'unknown')"
_LISTED = f"l AS (SELECT m.slug, unnest(list_distinct(courses)) AS course, {_KIND} AS kind, coalesce(pages, 0) AS pages, coalesce(chunks, 0) AS chunks FROM m LEFT JOIN man ON m.slug = man.book_slug)"
_COURSES = """courses AS (SELECT * FROM (VALUES ('DRL', 'Deep Reinforcement Learning'), ('EE', 'Ética y explicabilidad'), ('GI', 'Geometría de la información'),
    ('IAG', 'Inteligencia artificial geométrica'), ('IAP', 'Inteligencia artificial probabilística'), ('IM', 'Ingeniería de modelos'),
    ('MD', 'Modelos diferenciales'), ('MGP', 'Modelos generativos profundos'), ('MP', 'Métodos probabilísticos')) v(course, name))"""
_BOOKS = r"bk AS (SELECT filename, regexp_replace(filename, '(.)\.[^.]+$', '\1') AS slug, max(tier) AS tier, list_sort(list(DISTINCT course) FILTER (course IS NOT NULL)) AS courses, list_sort(list(DISTINCT title) FILTER (title IS NOT NULL)) AS titles FROM ledger_entry WHERE filename IS NOT NULL GROUP BY 1, 2)"
_CITE = "breadcrumb || ', ' || CASE WHEN page_start = page_end THEN 'p. ' || page_start ELSE 'pp. ' || page_start || '-' || page_end END"


def _bm25(name: str, queries: str, docs: str, k: int) -> str:
    return rf"""{name}_w AS (SELECT id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM ({docs}) WHERE text IS NOT NULL),
    {name}_tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM {name}_w) GROUP BY ALL),
    {name}_st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM {name}_w),
    {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1),
    {name}_q AS (SELECT DISTINCT qid, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS term FROM ({queries})),
    {name}_s AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
      FROM {name}_q JOIN {name}_tf USING (term) JOIN {name}_df USING (term), {name}_st GROUP BY 1, 2),
    {name} AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM {name}_s QUALIFY rank <= {k})"""


def _knn(name: str, queries: str, docs: str, k: int, other: str = "true") -> str:
    return f"""{name} AS (SELECT q.qid, v.id, round(list_dot_product(q.u, v.u), 6) AS score,
      CAST(row_number() OVER (PARTITION BY q.qid ORDER BY round(list_dot_product(q.u, v.u), 6) DESC, v.id) AS INTEGER) AS rank FROM ({queries}) q, ({docs}) v WHERE {other} QUALIFY rank <= {k})"""


_UNIT = "list_transform(vector, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(vector, lambda y: CAST(y AS DOUBLE) * y))))"
_USABLE = "vector IS NOT NULL AND len(vector) = 64 AND list_sum(list_transform(vector, lambda x: abs(x))) > 0"


def _hybrid(where: str = "true") -> str:
    return f"""{_CH}, {_M}, cc AS (SELECT * FROM ch WHERE {where}),
    fv AS (SELECT book_slug AS qid, arg_min({_UNIT}, chunk_id) AS u FROM ch WHERE {_USABLE} GROUP BY 1),
    bq AS (SELECT slug AS qid, titles[1] AS text, u FROM m JOIN fv ON m.slug = fv.qid),
    {_bm25("lex", "SELECT qid, text FROM bq", "SELECT chunk_id AS id, text FROM cc", 8)},
    {_knn("dense", "SELECT qid, u FROM bq", f"SELECT chunk_id AS id, {_UNIT} AS u FROM cc WHERE {_USABLE}", 8)},
    rrf_s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT qid, id, rank FROM lex UNION ALL SELECT qid, id, rank FROM dense) GROUP BY 1, 2),
    rrf AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM rrf_s QUALIFY rank <= 8)"""


_STRIP_TB = r"regexp_replace(coalesce(table_body, ''), '^\s+|\s+$', '', 'g')"
_TM = rf"""tr AS (SELECT slug, ord, table_body, list_filter(list_transform(regexp_extract_all(coalesce(table_body, ''), '(?is)<tr[^>]*>(.*?)</tr>', 1),
      lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda c: regexp_replace(regexp_replace(c, '<[^>]+>', '', 'g'), '^\s+|\s+$', '', 'g'))), lambda r: len(r) > 0) AS rs FROM b WHERE type = 'table'),
    tw AS (SELECT *, list_max(list_transform(rs, lambda r: len(r))) AS width FROM tr),
    tl AS (SELECT *, list_transform(rs, lambda r: '| ' || array_to_string(list_resize(r, width, ''), ' | ') || ' |') AS ls FROM tw),
    tm AS (SELECT slug, ord, CASE WHEN len(rs) = 0 OR regexp_matches(coalesce(table_body, ''), '(?i)(rowspan|colspan)\s*=\s*"?([2-9]|[0-9]{{2,}})') THEN {_STRIP_TB}
      ELSE ls[1] || chr(10) || '|' || repeat('---|', width) || CASE WHEN len(ls) > 1 THEN chr(10) || array_to_string(ls[2:], chr(10)) ELSE '' END END AS markdown FROM tl)"""
_CAP = r"CASE WHEN regexp_replace(coalesce(caption, ''), '^\s+|\s+$', '', 'g') IN ('[]', 'None') THEN '' ELSE regexp_replace(coalesce(caption, ''), '^\s+|\s+$', '', 'g') END"
_TXT = _TRIM.replace("text,", "coalesce(k.text, ''),")
_RD = rf"""rd AS (SELECT * FROM (SELECT k.slug, k.ord, k.page, regexp_replace(CASE
      WHEN type IN ('image', 'chart') THEN CASE WHEN coalesce(img_path, '') <> '' THEN '![' || {_CAP} || '](' || img_path || ')' ELSE '' END
      WHEN type = 'table' THEN CASE WHEN markdown = '' THEN '' WHEN {_CAP} <> '' THEN {_CAP} || chr(10) || chr(10) || markdown ELSE markdown END
      WHEN h.depth IS NOT NULL AND type <> 'equation' AND {_TXT} <> '' THEN repeat('#', CAST(h.depth AS INTEGER)) || ' ' || {_TXT} ELSE {_TXT} END, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS part
    FROM k LEFT JOIN h ON k.slug = h.slug AND k.ord = h.ord LEFT JOIN tm ON k.slug = tm.slug AND k.ord = tm.ord) WHERE part <> '')"""
_INJ = rf"""inj AS (SELECT t.slug, t.ord, t.page, o.ord AS at, regexp_replace(o.title, '^\s+|\s+$', '', 'g') AS title, CAST(least(6, known.depth) AS INTEGER) AS depth
    FROM t JOIN outline o ON t.slug = o.slug AND t.page = o.page JOIN known ON known.slug = o.slug AND known.key = lower(regexp_replace(o.title, '^\s+|\s+$', '', 'g'))
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.slug = t.slug AND b.page = t.page AND b.ord >= t.ord AND b.text_level IS NOT NULL AND lower({_TRIM.replace("text", "b.text")}) = known.key))"""
_PC = rf"""pq AS (SELECT slug, ord, page, unnest(string_split_regex(part, '\n{{2,}}')) AS text, unnest(range(len(string_split_regex(part, '\n{{2,}}')))) AS sub FROM rd
      UNION ALL SELECT slug, ord, page, repeat('#', depth) || ' ' || title, inj."at" - 1000000000 FROM inj),
    pr AS (SELECT slug, ord, CAST(sub AS INTEGER) AS sub, page, {_TRIM} AS text FROM pq WHERE {_TRIM} <> ''),
    ps AS (SELECT *, starts_with(text, '$$') OR starts_with(text, '|') OR starts_with(text, '![') OR starts_with(text, '<table') OR starts_with(text, '```') AS atomic FROM pr),
    pc AS (SELECT slug, ord, sub, page, CASE WHEN atomic THEN text ELSE regexp_replace(text, '(?i)</?su[bp]>', '', 'g') END AS text, atomic FROM ps)"""
_PIECES = ", ".join([_B, _K, _TURN, _KNOWN, _H, _TM, _RD, _INJ, _PC])
_HEAD = r"regexp_extract(text, '^(#{1,6})\s+([^\n]+?)\s*$', 2)"
_LEVELS = ", ".join(f"last_value(CASE WHEN lev = {n} THEN title END IGNORE NULLS) OVER (PARTITION BY slug ORDER BY section_no) AS t{n}" for n in range(1, 7))
_STACK = f"""st1 AS (SELECT *, section_no + least(0, min(depth - section_no) OVER (PARTITION BY slug ORDER BY section_no)) AS lev FROM hd),
    st2 AS (SELECT slug, section_no, lev, {_LEVELS} FROM st1),
    st AS (SELECT slug, section_no, list_filter([{", ".join(f"CASE WHEN lev >= {n} THEN t{n} END" for n in range(1, 7))}], lambda x: x IS NOT NULL) AS trail FROM st2)"""
_BODY = rf"""{_PIECES}, {_M}, nn AS (SELECT *, CAST(sum(CASE WHEN {_HEAD} <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY ord, sub) AS BIGINT) AS section_no FROM pc),
    hd AS (SELECT slug, section_no, length(regexp_extract(text, '^(#{{1,6}})\s', 1)) AS depth, {_HEAD} AS title FROM nn WHERE {_HEAD} <> ''),
    {_STACK},
    body AS (SELECT nn.slug, nn.section_no, nn.ord, nn.sub, nn.page, nn.text, nn.atomic, m.tier,
      CASE WHEN st.slug IS NULL THEN coalesce(m.titles[1], '') ELSE array_to_string(list_filter(list_concat([m.titles[1]], trail), lambda x: x IS NOT NULL AND x <> ''), ' > ') END AS breadcrumb
      FROM nn LEFT JOIN st ON nn.slug = st.slug AND nn.section_no = st.section_no LEFT JOIN m ON m.slug = nn.slug WHERE {_HEAD} = ''),
    sec AS (SELECT slug, section_no, any_value(breadcrumb) AS breadcrumb, count(*) AS pieces, min(page) AS page_start, max(page) AS page_end,
      CAST(greatest(1, (sum(length(text)) + 2 * (count(*) - 1)) // 4) AS INTEGER) AS tokens FROM body GROUP BY 1, 2)"""


def _pack(name: str, rows: str, keys: str, order: str, budget: int) -> str:
    """name: rows with n, their place in keys, and g, the number of their group."""
    same = " AND ".join(f"{name}_r.{k.strip()} = {name}_w.{k.strip()}" for k in keys.split(","))
    return f"""{name}_r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS n FROM ({rows})),
    {name}_w AS (SELECT {keys}, n, CAST(0 AS BIGINT) AS g, CAST(cost AS BIGINT) AS used FROM {name}_r WHERE n = 1
      UNION ALL SELECT {", ".join(f"{name}_r.{k.strip()}" for k in keys.split(","))}, {name}_r.n, CASE WHEN used + cost > {budget} THEN g + 1 ELSE g END, CASE WHEN used + cost > {budget} THEN cost ELSE used + cost END
      FROM {name}_w JOIN {name}_r ON {same} AND {name}_r.n = {name}_w.n + 1),
    {name} AS (SELECT {name}_r.*, g FROM {name}_r JOIN {name}_w ON {same} AND {name}_r.n = {name}_w.n)"""


_RUNS = _pack("rn", "SELECT slug, section_no, tokens AS cost FROM sec", "slug", "section_no", 800)


def _make(keys: str, parent: bool, extra: str) -> str:
    return f"""SELECT slug, {keys}, {extra} string_agg(text, chr(10) || chr(10) ORDER BY ord, sub) AS text, arg_min(breadcrumb, (ord, sub)) AS breadcrumb, min(page) AS page_start, max(page) AS page_end,
      array_to_string(list_sort(list(DISTINCT CASE WHEN atomic THEN 'atomic' ELSE 'prose' END)), ',') AS content_types FROM ck GROUP BY ALL"""


_ID = "substring(sha256(slug || ':{}:' || page_start || '-' || page_end || ':' || text), 1, 16)"
_COST = "greatest(1, length(text) // 4) AS cost"
_CHUNKS = f"""{_BODY}, {_RUNS}, {_pack("pk", f"SELECT *, {_COST} FROM body WHERE tier IN (1, 2)", "slug, section_no", "ord, sub", 2000)},
    un AS (SELECT slug, section_no, ord, sub, page, text, atomic, breadcrumb, cost, section_no * 1000000 + g AS pkey FROM pk
      UNION ALL SELECT body.slug, body.section_no, ord, sub, page, text, atomic, breadcrumb, {_COST}, rn.g AS pkey FROM body JOIN rn ON rn.slug = body.slug AND rn.section_no = body.section_no WHERE tier NOT IN (1, 2)),
    {_pack("ck", "SELECT * FROM un", "slug, section_no, pkey", "ord, sub", 350)},
    pa AS (SELECT *, {_ID.format("parent")} AS chunk_id FROM ({_make("pkey", True, "")})),
    cd AS (SELECT *, {_ID.format("child")} AS chunk_id FROM ({_make("section_no, pkey, g", False, "")}))"""
_OUT = "CAST(greatest(1, length({0}.text) // 4) AS INTEGER) AS tokens, m.tier AS source_tier, {0}.content_types"


SQL = {
    "kept_blocks": f"WITH {_B}, {_K} SELECT slug, ord, type, page FROM k",
    "margin_notes": f"WITH {_B} SELECT slug, ord, text FROM b WHERE {_NOTE}",
    "captions": r"WITH " + _B + r" SELECT slug, ord, CASE WHEN regexp_replace(coalesce(caption, ''), '^\s+|\s+$', '', 'g') IN ('[]', 'None') THEN '' ELSE regexp_replace(coalesce(caption, ''), '^\s+|\s+$', '', 'g') END AS caption FROM b",
    "heading_depths": f"WITH {_B}, {_KNOWN}, {_H} SELECT slug, ord, title, CAST(depth AS INTEGER) AS depth FROM h",
    "page_turns": f"WITH {_B}, {_K}, {_TURN} SELECT slug, ord, page FROM t",
    "injected_headings": rf"""WITH {_B}, {_K}, {_TURN}, {_KNOWN}
        SELECT t.slug, t.ord, o.ord AS at, regexp_replace(o.title, '^\s+|\s+$', '', 'g') AS title, CAST(least(6, known.depth) AS INTEGER) AS depth
        FROM t JOIN outline o ON t.slug = o.slug AND t.page = o.page JOIN known ON known.slug = o.slug AND known.key = lower(regexp_replace(o.title, '^\s+|\s+$', '', 'g'))
        WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.slug = t.slug AND b.page = t.page AND b.ord >= t.ord AND b.text_level IS NOT NULL AND lower({_TRIM.replace("text", "b.text")}) = known.key)""",
    "figure_names": rf"""WITH {_B}, f AS (SELECT slug, img_path, arg_min(page, ord) AS page, min(ord) AS ord FROM b WHERE type IN ('image', 'chart') AND coalesce(img_path, '') <> '' GROUP BY 1, 2)
        SELECT slug, img_path, 'p' || lpad(CAST(page AS VARCHAR), 4, '0') || '-fig' || row_number() OVER (PARTITION BY slug, page ORDER BY ord) || regexp_extract(img_path, '(\.[^./]+)$', 1) AS name FROM f""",
    "clean_characters": f"WITH {_B} SELECT slug, ord, regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', '', 'g') AS text FROM b",
    "table_markdown": f"WITH {_B}, {_TM} SELECT slug, ord, markdown FROM tm",
    "rendered_text": f"WITH {_B}, {_K}, {_KNOWN}, {_H}, {_TM}, {_RD} SELECT slug, ord, page, md5(part) AS part_md5 FROM rd",
    "pieces": f"WITH {_PIECES} SELECT slug, ord, sub, page, text, atomic FROM pc",
    "sections": f"WITH {_BODY} SELECT slug, section_no, breadcrumb, pieces, page_start, page_end, tokens FROM sec",
    "heading_trails": f"WITH {_B}, {_KNOWN}, {_H}, hd AS (SELECT slug, row_number() OVER (PARTITION BY slug ORDER BY ord) AS section_no, depth, title FROM h), {_STACK} SELECT slug, section_no, array_to_string(trail, ' > ') AS trail FROM st",
    "section_runs": f"WITH RECURSIVE {_BODY}, {_RUNS} SELECT slug, section_no, g AS run_no FROM rn",
    "built_chunks": f"""WITH RECURSIVE {_CHUNKS}
        SELECT pa.chunk_id, pa.slug AS book_slug, pa.breadcrumb, pa.page_start, pa.page_end, '' AS parent_id, true AS is_parent, {_OUT.format("pa")} FROM pa JOIN m ON m.slug = pa.slug
        UNION ALL SELECT cd.chunk_id, cd.slug, cd.breadcrumb, cd.page_start, cd.page_end, pa.chunk_id, false, {_OUT.format("cd")} FROM cd JOIN m ON m.slug = cd.slug JOIN pa ON pa.slug = cd.slug AND pa.pkey = cd.pkey""",
    "page_spans": f"""WITH {_B}, {_K}, s AS (SELECT slug, min(page) AS a, max(page) AS z FROM k GROUP BY 1)
        SELECT m.slug, coalesce(a, 0) AS start, coalesce(z, 0) AS "end" FROM (SELECT DISTINCT slug FROM book_meta) m LEFT JOIN s USING (slug)""",
    "packed_lines": r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM (SELECT DISTINCT ON (doc_id) doc_id, text FROM documents WHERE text IS NOT NULL)),
        x AS (SELECT doc_id, line_no, greatest(1, length(line) // 4) AS cost FROM l),
        w AS (SELECT doc_id, line_no, 0 AS group_no, cost AS used FROM x WHERE line_no = 0
          UNION ALL SELECT x.doc_id, x.line_no, CASE WHEN used + cost > 100 THEN group_no + 1 ELSE group_no END, CASE WHEN used + cost > 100 THEN cost ELSE used + cost END
          FROM w JOIN x ON x.doc_id = w.doc_id AND x.line_no = w.line_no + 1)
        SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(group_no AS BIGINT) AS group_no FROM w""",
    "token_estimates": f"WITH {_C} SELECT chunk_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, coalesce(tokens = greatest(1, length(text) // 4), false) AS agrees FROM c",
    "chunk_ids": f"""WITH {_C} SELECT chunk_id, substring(sha256(book_slug || ':' || CASE WHEN is_parent THEN 'parent' ELSE 'child' END || ':' || page_start || '-' || page_end || ':' || text), 1, 16) AS computed_id FROM c""",
    "embedding_texts": f"WITH {_C} SELECT chunk_id, CASE WHEN coalesce(breadcrumb, '') <> '' THEN breadcrumb || chr(10) || chr(10) || text ELSE text END AS embedding_text FROM c WHERE NOT is_parent",
    "citations": f"WITH {_C} SELECT chunk_id, {_CITE} AS citation FROM c",
    "content_types": f"WITH {_C} SELECT book_slug, content_type, count(*) AS chunks FROM (SELECT book_slug, unnest(content_types) AS content_type FROM c) GROUP BY 1, 2",
    "markdown_features": rf"""WITH {_B} SELECT slug, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(len(regexp_extract_all(text, '\$\$[^$]+\$\$'))) AS BIGINT) AS display_math,
        CAST(sum(len(regexp_extract_all(text, '(?m)^#{{1,6}} '))) AS BIGINT) AS headings, CAST(sum(len(regexp_extract_all(text, '(?m)^\|[^\n]+\|$'))) AS BIGINT) AS table_rows,
        CAST(sum(len(regexp_extract_all(text, '```'))) AS BIGINT) AS fences, CAST(sum(len(regexp_extract_all(text, '!\[[^\]]*\]\('))) AS BIGINT) AS images FROM b GROUP BY 1""",
    "books": f"WITH {_BOOKS} SELECT filename, slug, tier, array_to_string(courses, ',') AS courses, array_to_string(titles, '|') AS titles FROM bk",
    "basic_books": f"WITH {_BOOKS} SELECT filename, CAST(len(courses) AS INTEGER) AS n_courses FROM bk WHERE tier = 2",
    "existing_books": rf"""WITH {_BOOKS}, f AS (SELECT DISTINCT unnest(courses) AS course, regexp_replace(slug, '^[a-z]+-[a-z]+-', '') || '.pdf' AS filename FROM book_meta)
        SELECT filename, tier FROM bk WHERE filename IN (SELECT e.filename FROM ledger_entry e JOIN f ON e.course = f.course AND e.filename = f.filename)""",
    "ledger_round_trip": "SELECT DISTINCT course, tier, coalesce(title, '?') AS title, filename FROM ledger_entry WHERE tier IN (1, 2) AND course IS NOT NULL AND filename IS NOT NULL",
    "file_titles": r"""SELECT filename, array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(filename, '\.[^.]+$', ''), '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title
        FROM (SELECT DISTINCT filename FROM ledger_entry)""",
    "staged_books": r"""WITH p AS (SELECT DISTINCT source_path AS path, string_split(source_path, '/')[3] AS kind, titles[1] AS title, courses[1] AS course,
          lower(array_to_string(list_filter(string_split(regexp_replace(regexp_replace(source_path, '^courses/', ''), '\.[^./]+$', ''), '/'), lambda x: x <> 'raw' AND x <> ''), '-')) AS slug FROM book_meta)
        SELECT slug, path, course, CASE WHEN coalesce(title, '') = '' THEN slug ELSE title END AS title, CASE kind WHEN 'slides' THEN 5 WHEN 'exams' THEN 4 WHEN 'assignments' THEN 6 WHEN 'notes' THEN 0 ELSE 7 END AS tier
        FROM p WHERE kind IN ('slides', 'exams', 'assignments', 'notes', 'code') AND path LIKE '%.pdf'""",
    "manifest": f"WITH {_C}, {_MAN} SELECT * FROM man",
    "coverage": f"""WITH {_C}, {_MAN}, {_M}, {_LISTED}, {_COURSES}, t AS (SELECT course, count(*) AS books, sum(pages) AS pages, sum(chunks) AS chunks FROM l GROUP BY 1)
        SELECT course, name, coalesce(books, 0) AS books, CAST(coalesce(pages, 0) AS BIGINT) AS pages, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks, coalesce(books, 0) > 0 AS indexed FROM courses LEFT JOIN t USING (course)""",
    "coverage_by_kind": f"WITH {_C}, {_MAN}, {_M}, {_LISTED}, {_COURSES} SELECT course, kind, count(*) AS books FROM l WHERE course IN (SELECT course FROM courses) GROUP BY 1, 2",
    "status": f"""WITH {_C}, {_MAN}, {_M} SELECT count(*) AS extracted, CAST(coalesce(sum(pages), 0) AS BIGINT) AS pages, count(*) FILTER (extraction_tier = 'scan') AS scans,
        CAST(coalesce(sum(chunks), 0) AS BIGINT) AS chunks, count(*) FILTER (len(warnings) > 0) AS with_warnings FROM m LEFT JOIN man ON m.slug = man.book_slug""",
    "scan_classes": f"""WITH {_B}, {_M}, pc AS (SELECT slug, page, sum(length(text)) AS chars FROM b GROUP BY 1, 2),
        p AS (SELECT DISTINCT slug, CAST(floor(pages * f) AS INTEGER) AS page FROM m, (VALUES (0.2::DOUBLE), (0.3), (0.4), (0.5), (0.6), (0.7), (0.8)) v(f) WHERE pages > 0 AND floor(pages * f) < pages),
        q AS (SELECT slug, median(coalesce(chars, 0)) AS median FROM p LEFT JOIN pc USING (slug, page) GROUP BY 1)
        SELECT slug, CAST(coalesce(median, 0) AS DOUBLE) AS median, CASE WHEN coalesce(median, 0) < 200 THEN 'scan' ELSE 'born_digital' END AS extraction_tier FROM m LEFT JOIN q USING (slug)""",
    "stage_keys": f"WITH {_M} SELECT slug, substring(sha256(source_sha256 || ':0123456789abcdef'), 1, 16) AS stage_key FROM m",
    "undone_books": f"WITH {_M} SELECT slug FROM m WHERE tier < 4 OR tier IS NULL",
    "drop_outcomes": rf"""WITH {_M}, x AS (SELECT unnest(courses) AS course, CASE tier WHEN 2 THEN 'basic' WHEN 1 THEN 'extra' WHEN 5 THEN 'slides' WHEN 4 THEN 'exams' ELSE 'other' END AS kind, regexp_replace(source_path, '^.*/', '') AS name, source_sha256 AS sha, pages FROM m),
        y AS (SELECT *, course || '/' || kind || '/' || name AS path, sha IN (SELECT source_sha256 FROM m WHERE tier = 2) AS held,
          CASE WHEN course NOT IN ('DRL', 'EE', 'GI', 'IAG', 'IAP', 'IM', 'MD', 'MGP', 'MP') THEN 'course' WHEN kind = 'other' THEN 'kind' WHEN NOT lower(name) LIKE '%.pdf' THEN 'suffix' END AS bad FROM x),
        z AS (SELECT *, CASE WHEN bad IS NULL THEN CASE WHEN pages IS NULL THEN 'unreadable' WHEN kind IN ('basic', 'extra') AND pages < 20 THEN 'too short' END END AS late FROM y),
        f AS (SELECT *, min(CASE WHEN bad IS NULL AND late IS NULL THEN path END) OVER (PARTITION BY sha) AS first FROM z),
        s AS (SELECT *, CASE WHEN bad IS NOT NULL THEN 'rejected' WHEN held OR coalesce(first < path, false) THEN 'duplicate' WHEN late IS NOT NULL THEN 'rejected' WHEN kind IN ('basic', 'extra') THEN 'accepted' ELSE 'stored' END AS status FROM f)
        SELECT path, status, CASE WHEN status = 'rejected' THEN coalesce(bad, late) END AS reason,
          array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title FROM s""",
    "course_scope": f"WITH {_C} SELECT chunk_id, book_slug FROM c WHERE list_contains(courses, 'IAP')",
    "bm25_search": f"WITH {_CH}, {_bm25('lex', 'SELECT item_id AS qid, text FROM eval_item', 'SELECT chunk_id AS id, text FROM ch', 8)} SELECT qid, id, score, rank FROM lex",
    "vector_search": f"""WITH e AS (SELECT DISTINCT ON (vec_id) vec_id, embedding AS vector FROM embeddings), u AS (SELECT vec_id, {_UNIT} AS u FROM e WHERE {_USABLE}),
        {_knn("dense", "SELECT vec_id AS qid, u FROM u WHERE vec_id % 50 = 0", "SELECT vec_id AS id, u FROM u", 10, "q.qid <> v.id")} SELECT qid, id, score, rank FROM dense""",
    "hybrid_search": f"WITH {_hybrid()} SELECT qid, id, score, rank FROM rrf",
    "course_search": f"WITH {_hybrid(chr(108) + 'ist_contains(courses, ' + chr(39) + 'IAP' + chr(39) + ')')} SELECT qid, id, score, rank FROM rrf",
    "expanded_search": f"""WITH {_hybrid()}, {_C}, mt AS (SELECT rrf.*, p.chunk_id AS parent FROM rrf JOIN ch ON ch.chunk_id = rrf.id LEFT JOIN c p ON p.chunk_id = ch.parent_id AND p.is_parent),
        best AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY qid, coalesce(parent, 'child:' || id) ORDER BY rank) = 1)
        SELECT qid, c.chunk_id, score, rank, CASE WHEN parent IS NOT NULL THEN id END AS matched, book_slug, {_CITE} AS citation FROM best JOIN c ON c.chunk_id = coalesce(parent, id)""",
    "neighbours": f"WITH {_C} SELECT chunk_id, lag(chunk_id) OVER w AS previous, lead(chunk_id) OVER w AS following FROM c WINDOW w AS (PARTITION BY book_slug, is_parent ORDER BY seq, chunk_id)",
    "fetched": f"""WITH {_C}, n AS (SELECT chunk_id, lag(chunk_id) OVER w AS previous, lead(chunk_id) OVER w AS following FROM c WINDOW w AS (PARTITION BY book_slug, is_parent ORDER BY seq, chunk_id))
        SELECT a.chunk_id AS asked, n.chunk_id, CASE WHEN p.chunk_id IS NOT NULL THEN a.chunk_id END AS matched, previous, following
        FROM c a LEFT JOIN c p ON p.chunk_id = a.parent_id AND p.is_parent AND p.book_slug = a.book_slug JOIN n ON n.chunk_id = coalesce(p.chunk_id, a.chunk_id) WHERE NOT a.is_parent""",
    "located": f"WITH {_C} SELECT chunk_id, book_slug FROM c WHERE chunk_id IN (SELECT chunk_id FROM children WHERE chunk_id <> '')",
    "streamed_events": "SELECT * FROM events",
    "event_hours": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}

_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


def _hashed(name: str, texts: str) -> str:
    """name(id, place, value): the components that aren't zero of hashed vectors; name_u(id, u): the vectors."""
    return rf"""{name}_h AS (SELECT id, ('0x' || substring(md5(w), 1, 8))::BIGINT AS h FROM (SELECT id, unnest({_WORDS.format("text")}) AS w FROM ({texts}))),
    {name}_n AS (SELECT id, CAST(h % 64 AS INTEGER) AS place, sum(CASE WHEN h >= 2147483648 THEN 1 ELSE -1 END)::DOUBLE AS n FROM {name}_h GROUP BY 1, 2),
    {name} AS (SELECT id, place, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS FLOAT) AS value FROM {name}_n),
    {name}_u AS (SELECT id, list_transform(range(64), lambda i: coalesce(m[CAST(i AS INTEGER)], 0)::DOUBLE) AS u FROM (SELECT id, map(list(place), list(value)) AS m FROM {name} WHERE value <> 0 GROUP BY 1))"""


def _answers(children: str, queries: str) -> str:
    """rrf: the fused matches of queries (qid, text, u) in children (id, text, u)."""
    return f"""{_bm25("lex", f"SELECT qid, text FROM {queries}", f"SELECT id, text FROM {children}", 8)},
    {_knn("dense", f"SELECT qid, u FROM {queries} WHERE u IS NOT NULL", f"SELECT id, u FROM {children} WHERE u IS NOT NULL", 8)},
    rrf_s AS (SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT qid, id, rank FROM lex UNION ALL SELECT qid, id, rank FROM dense) GROUP BY 1, 2),
    rrf AS (SELECT qid, id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS INTEGER) AS rank FROM rrf_s QUALIFY rank <= 8)"""


_INDEXED = f"""kc AS (SELECT chunk_id AS id, CASE WHEN coalesce(breadcrumb, '') <> '' THEN breadcrumb || chr(10) || chr(10) || text ELSE text END AS text FROM c WHERE NOT is_parent),
    {_hashed("hc", "SELECT id, text FROM kc")}, kv AS (SELECT kc.id, text, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) AS u FROM kc LEFT JOIN hc_u USING (id)),
    kq AS (SELECT slug AS id, titles[1] AS text FROM m WHERE titles[1] IS NOT NULL), {_hashed("hq", "SELECT id, text FROM kq")},
    qv AS (SELECT kq.id AS qid, text, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) AS u FROM kq LEFT JOIN hq_u USING (id))"""
_DROPS = SQL["drop_outcomes"].split("SELECT path, status")[0]
_DROPS = _DROPS.replace("pages FROM m)", "pages, titles[1] AS sidecar FROM m)", 1)
_NAMED = r"array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(name, '\.[^.]+$', ''), '[-_]+', ' ', 'g')), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"
_TITLED = rf"coalesce(nullif(trim(string_split(trim(sidecar), chr(10))[1]), ''), {_NAMED})"
_REASON = "CASE WHEN status = 'rejected' THEN coalesce(bad, late) END"
_TITLES = "array_to_string(titles, '|')"

SQL |= {
    "encoded_children": f"WITH {_CH}, {_hashed('hc', 'SELECT chunk_id AS id, text FROM ch')} SELECT id, place, round(value::DOUBLE, 4) AS value FROM hc WHERE value <> 0",
    "read_block_lines": rf"""WITH {_B} SELECT slug, CAST(row_number() OVER (PARTITION BY slug ORDER BY ord) - 1 AS INTEGER) AS ord, type, page, text_level, md5(coalesce(text, '')) AS text_md5,
        CASE WHEN trim(coalesce(caption, '')) IN ('[]', 'None') THEN '' ELSE trim(coalesce(caption, '')) END AS caption, CAST(length(coalesce(table_body, '')) AS INTEGER) AS table_chars FROM b""",
    "read_ledgers": SQL["ledger_round_trip"],
    "read_intake": SQL["staged_books"].replace("FROM p WHERE kind IN", "FROM p WHERE path IN (SELECT source_path FROM book_meta WHERE pages >= 20) AND kind IN"),
    "read_sidecars": f"WITH {_M} SELECT slug, tier, pages, page_span.start AS page_start, page_span.\"end\" AS page_end, coalesce({_TITLES}, '') AS titles, source_sha256, chars FROM m",
    "read_chunk_lines": f"WITH {_C} SELECT chunk_id, book_slug, lag(chunk_id) OVER (PARTITION BY book_slug ORDER BY seq, chunk_id) AS previous, md5(text) AS text_md5, array_to_string(courses, ',') AS courses FROM c",
    "hashed_books": f"WITH {_M} SELECT slug, sha256(source_path || chr(10)) AS sha256, CAST(strlen(source_path) + 1 AS BIGINT) AS bytes FROM m",
    "stored_chunks": f"WITH {_C}, {_MAN} SELECT chunk_id, book_slug, is_parent, md5(CASE WHEN book_slug = (SELECT max(book_slug) FROM c) THEN upper(text) ELSE text END) AS text_md5 FROM c WHERE book_slug IN (SELECT book_slug FROM man WHERE parents > 1)",
    "stored_manifest": SQL["manifest"],
    "indexed_children": f"""WITH {_C} SELECT x.chunk_id, md5(CASE WHEN coalesce(x.breadcrumb, '') <> '' THEN x.breadcrumb || chr(10) || chr(10) || x.text ELSE x.text END) AS text_md5, md5(x.text) AS body_md5,
        CAST(64 AS INTEGER) AS size, CAST(length(p.text) AS INTEGER) AS parent_chars FROM c x LEFT JOIN c p ON p.chunk_id = x.parent_id AND p.is_parent WHERE NOT x.is_parent""",
    "index_answers": f"""WITH {_C}, {_M}, {_INDEXED}, {_answers("kv", "qv")},
        mt AS (SELECT rrf.*, p.chunk_id AS parent FROM rrf JOIN c x ON x.chunk_id = rrf.id LEFT JOIN c p ON p.chunk_id = x.parent_id AND p.is_parent),
        best AS (SELECT * FROM mt QUALIFY row_number() OVER (PARTITION BY qid, coalesce(parent, 'child:' || id) ORDER BY rank) = 1)
        SELECT qid, rank, score, c.chunk_id, c.book_slug, CASE WHEN parent IS NOT NULL THEN id END AS matched, md5(c.text) AS text_md5, md5(CASE WHEN parent IS NOT NULL THEN k.text ELSE '' END) AS matched_md5,
          {_CITE.replace("breadcrumb", "c.breadcrumb").replace("page_start", "c.page_start").replace("page_end", "c.page_end")} AS citation FROM best JOIN c ON c.chunk_id = coalesce(parent, id) JOIN c k ON k.chunk_id = id""",
    "plain_answers": f"WITH {_hybrid()} SELECT qid, rank, score, rrf.id AS chunk_id, book_slug, array_to_string(courses, ',') AS courses, md5(body) AS text_md5, '' AS matched_text FROM rrf JOIN ch ON ch.chunk_id = rrf.id",
    "published_chunks": f"WITH {_C} SELECT chunk_id, 'r1' AS pulled FROM c WHERE is_parent UNION ALL SELECT chunk_id, 'again r1' FROM c WHERE is_parent UNION ALL SELECT chunk_id, 'newest r2' FROM c",
    "rendered_figures": rf"""WITH {_B}, {_K}, {_KNOWN}, {_H}, {_TM}, {_RD}, f AS (SELECT slug, img_path, arg_min(page, ord) AS page, min(ord) AS ord FROM b WHERE type IN ('image', 'chart') AND coalesce(img_path, '') <> '' AND length(img_path) * 100 >= 2200 GROUP BY 1, 2),
        n AS (SELECT slug, img_path, 'p' || lpad(CAST(page AS VARCHAR), 4, '0') || '-fig' || row_number() OVER (PARTITION BY slug, page ORDER BY ord) || regexp_extract(img_path, '(\.[^./]+)$', 1) AS name FROM f)
        SELECT rd.slug, rd.ord, CASE WHEN n.name IS NULL THEN part ELSE replace(part, '](' || b.img_path || ')', '](' || n.name || ')') END AS part
        FROM rd JOIN b ON b.slug = rd.slug AND b.ord = rd.ord AND b.type IN ('image', 'chart') LEFT JOIN n ON n.slug = b.slug AND n.img_path = b.img_path""",
    "document_meta": rf"""WITH {_B}, {_K}, {_KNOWN}, {_H}, {_TM}, {_RD}, s AS (SELECT slug, count(*) AS parts, CAST(sum(length(part)) + 2 * (count(*) - 1) AS BIGINT) AS chars, min(page) AS page_start, max(page) AS page_end FROM rd GROUP BY 1),
        f AS (SELECT slug, count(DISTINCT img_path) AS figures FROM b WHERE type IN ('image', 'chart') AND coalesce(img_path, '') <> '' GROUP BY 1)
        SELECT slug, coalesce(parts, 0) AS parts, coalesce(chars, 0) AS chars, coalesce(page_start, 0) AS page_start, coalesce(page_end, 0) AS page_end, coalesce(figures, 0) AS figures FROM (SELECT DISTINCT slug FROM book_meta) LEFT JOIN s USING (slug) LEFT JOIN f USING (slug)""",
    "written_documents": rf"""WITH {_B}, {_K}, {_KNOWN}, {_H}, {_TM}, {_RD}, l AS (SELECT slug, unnest(string_split(part, chr(10))) AS line FROM rd)
        SELECT slug, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS chars FROM l WHERE line <> '' GROUP BY 1""",
    "described_books": f"""WITH {SQL["scan_classes"].removeprefix("WITH ").rpartition("SELECT slug, CAST")[0].rstrip()}, sc AS (SELECT slug, coalesce(pages, 0) AS pages, source_sha256 AS sha256, CASE WHEN coalesce(median, 0) < 200 THEN 'scan' ELSE 'born_digital' END AS extraction_tier FROM m LEFT JOIN q USING (slug))
        SELECT slug, pages, sha256, extraction_tier, array_to_string(list_filter([CASE WHEN extraction_tier = 'scan' THEN 'no text layer' END, CASE WHEN slug NOT IN (SELECT slug FROM outline WHERE slug IS NOT NULL) THEN 'no outline' END, CASE WHEN pages < 20 THEN 'only ' || pages || ' pages' END], lambda x: x IS NOT NULL), '; ') AS warnings FROM sc""",
    "titled_drops": f"""{_DROPS} SELECT path, status, {_TITLED} AS title, CASE WHEN status = 'accepted' THEN 'courses/' || course || '/literature/' || name WHEN status = 'stored' THEN 'courses/' || course || '/raw/' || kind || '/' || name END AS destination FROM s""",
    "outcome_totals": f"{_DROPS} SELECT status, coalesce({_REASON}, '') AS reason, count(*) AS files FROM s GROUP BY 1, 2",
    "new_entries": f"{_DROPS} SELECT DISTINCT course, CASE kind WHEN 'basic' THEN 2 ELSE 1 END AS tier, {_TITLED} AS title, name AS filename FROM s WHERE status IN ('accepted', 'duplicate') AND kind IN ('basic', 'extra') AND NOT EXISTS (SELECT 1 FROM ledger_entry e WHERE e.course = s.course AND e.filename = s.name)",
    "coverage_nested": f"""WITH {_C}, {_MAN}, {_M}, {_LISTED}, {_COURSES}, k AS (SELECT course, kind, count(*) AS n FROM l GROUP BY 1, 2), ks AS (SELECT course, string_agg(kind || '=' || n, ',' ORDER BY kind) AS by_kind FROM k GROUP BY 1),
        t AS (SELECT course, count(*) AS books, string_agg(slug, ',' ORDER BY slug) AS book_slugs FROM l GROUP BY 1)
        SELECT course, coalesce(books, 0) AS books, coalesce(book_slugs, '') AS book_slugs, coalesce(by_kind, '') AS by_kind FROM courses LEFT JOIN t USING (course) LEFT JOIN ks USING (course)""",
    "all_warnings": f"WITH {_M} SELECT slug, array_to_string(warnings, '; ') AS warnings FROM m WHERE len(warnings) > 0",
}
