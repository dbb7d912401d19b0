"""SQL: boilerplate, hyphens, paragraphs, headings, chunks, spans."""

from .s_layout import BLOCK_LINES
from .s_layout import SQL as LAYOUT

_EDGES = r"""
    SELECT *, line_no = 0 OR line_no = n_lines - 1 AS edge,
           trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '#', 'g'), '\s+', ' ', 'g')) AS key FROM v_lines"""
_KEPT = f"""
    SELECT e.* FROM ({_EDGES}) e JOIN (SELECT source, count(DISTINCT doc_id) AS s FROM documents GROUP BY 1) t USING (source)
    LEFT JOIN (SELECT source, key, count(DISTINCT doc_id) AS n FROM ({_EDGES}) WHERE edge AND key <> '' GROUP BY 1, 2) k USING (source, key)
    WHERE NOT (edge AND key <> '' AND s >= 2 AND coalesce(n, 0) >= CASE WHEN s >= 4 THEN 3 ELSE s END)"""

_COMPOUNDS = r"""
    SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '\p{L}{2,}-\p{L}{2,}'))) AS compound FROM v_wrapped"""


def bridged(source: str, part: str, order: str) -> str:
    """Every row of ``source`` with ``joined``: the text once the next row of its part follows."""
    return rf"""
    SELECT b.*, CASE WHEN nxt IS NULL OR text = '' THEN text
           WHEN head <> '' AND tail <> '' THEN CASE WHEN regexp_matches(tail, '^\p{{Lu}}') OR c.compound IS NOT NULL THEN text ELSE text[1:(length(text) - 1)] END
           WHEN regexp_matches(text, '\s$') THEN text ELSE text || ' ' END AS joined
    FROM (SELECT *, lower(head || '-' || tail) AS word FROM (
            SELECT *, regexp_extract(text, '(\p{{L}}[\p{{L}}''\x{{2019}}]*)-$', 1) AS head, regexp_extract(ltrim(nxt), '^(\p{{L}}[\p{{L}}''\x{{2019}}]*)', 1) AS tail
            FROM (SELECT *, lead(text) OVER (PARTITION BY {part} ORDER BY {order}) AS nxt FROM ({source})))) b
    LEFT JOIN ({_COMPOUNDS}) c ON b.doc_id = c.doc_id AND b.word = c.compound"""


_ITEMS = """SELECT doc_id, vline AS seq, vline // 3 + 1 AS page, CASE WHEN length(text) <= 12 THEN 'h1' ELSE 'p' END AS tag, text FROM v_wrapped"""
_STITCHED = rf"""
    SELECT *, count(*) FILTER (NOT merges) OVER (PARTITION BY doc_id ORDER BY seq) AS item FROM (
      SELECT *, coalesce(tag = 'p' AND ptag = 'p' AND page = ppage + 1 AND NOT regexp_matches(ptext, '[.!?:;\x{{bb}}\x{{201d}}"'')\]]\s*$')
             AND (ptext LIKE '%-' OR regexp_matches(text, '^[\p{{Ll}}\p{{Nd}}]')), false) AS merges
      FROM (SELECT *, lag(tag) OVER o AS ptag, lag(page) OVER o AS ppage, lag(text) OVER o AS ptext FROM ({_ITEMS}) WINDOW o AS (PARTITION BY doc_id ORDER BY seq)))"""

_LINE_ITEMS = """
    SELECT l.doc_id, line_no AS item, CASE WHEN length(line) <= 60 THEN 'h1' ELSE 'p' END AS tag, line AS text, n_pages AS sheets,
           row_number() OVER (PARTITION BY l.doc_id ORDER BY line_no) AS rn
    FROM v_lines l JOIN v_pages p ON l.doc_id = p.doc_id WHERE line <> ''"""


def chunked(limit: int) -> str:
    """CTEs ending in ``chunks``: the resetting size is carried row by row."""
    return f"""WITH RECURSIVE items AS MATERIALIZED ({_LINE_ITEMS}),
      docs AS (SELECT doc_id, count(*) FILTER (tag = 'h1') <= any_value(sheets) AS by_heading FROM items GROUP BY 1),
      walk AS (
        SELECT doc_id, rn, 1 AS chunk, length(text)::BIGINT AS size FROM items WHERE rn = 1
        UNION ALL
        SELECT i.doc_id, i.rn, CASE WHEN cut THEN w.chunk + 1 ELSE w.chunk END, CASE WHEN cut THEN 0 ELSE w.size END + length(i.text)
        FROM walk w JOIN items i ON i.doc_id = w.doc_id AND i.rn = w.rn + 1 JOIN docs d ON d.doc_id = w.doc_id,
             LATERAL (SELECT (by_heading AND i.tag = 'h1') OR w.size > {limit} AS cut)),
      chunks AS (SELECT i.*, w.chunk::BIGINT AS chunk FROM items i JOIN walk w ON i.doc_id = w.doc_id AND i.rn = w.rn)"""


SQL: dict[str, str] = {
    "a7_furniture_keys": f"SELECT source, key, count(DISTINCT doc_id) AS n FROM ({_EDGES}) WHERE edge AND key <> '' GROUP BY 1, 2",
    "c1_drop_furniture": f"SELECT doc_id, source, n_lines, line_no, line FROM ({_KEPT})",
    "c1_removed_per_source": f"""
        SELECT source, n_lines, n_lines - coalesce(n_kept, 0) AS n_removed FROM (SELECT source, count(*) AS n_lines FROM v_lines GROUP BY 1)
        LEFT JOIN (SELECT source, count(*) AS n_kept FROM ({_KEPT}) GROUP BY 1) USING (source)""",
    "a13_compounds": _COMPOUNDS,
    "w5_paragraphs": f"""
        SELECT doc_id, page_no, block, row_no, seg, count(*) FILTER (rn > 1 AND align NOT IN ('center', 'right') AND
               ((ind AND NOT coalesce(next_ind, false)) OR (align = 'justify' AND px1 < xr - size * 3))) OVER (PARTITION BY doc_id, page_no, block ORDER BY row_no) AS para
        FROM (SELECT *, lead(ind) OVER o AS next_ind, lag(x1) OVER o AS px1, row_number() OVER o AS rn, max(x1) OVER (PARTITION BY doc_id, page_no, block) AS xr
          FROM (SELECT t.*, align, x0 - min(x0) OVER (PARTITION BY doc_id, page_no, block) > size * 0.5 AS ind
                FROM ({BLOCK_LINES}) t JOIN ({LAYOUT['a4_align_of']}) USING (doc_id, page_no, block))
          WINDOW o AS (PARTITION BY doc_id, page_no, block ORDER BY row_no))""",
    "w6_stitch": f"""
        SELECT doc_id, item, string_agg(joined, '' ORDER BY seq) AS text, arg_min(tag, seq) AS tag, max(page) AS page
        FROM ({bridged(_STITCHED, 'doc_id, item', 'seq')}) GROUP BY 1, 2""",
    "w7_bridge": f"""
        SELECT doc_id, string_agg(joined, '' ORDER BY vline) AS text, count(*) AS n_lines
        FROM ({bridged('SELECT * FROM v_wrapped', 'doc_id', 'vline')}) GROUP BY 1""",
    "w8_classify": f"""
        SELECT doc_id, row_no, seg, size, CASE WHEN length(text) > 140 THEN 'p' WHEN size >= body * 1.45 THEN 'h1' WHEN size >= body * 1.15 THEN 'h2' ELSE 'p' END AS tag
        FROM v_tlines JOIN ({LAYOUT['a1_body_size']}) USING (doc_id)""",
    "w9_chunk": f"{chunked(40000)} SELECT doc_id, item, tag, chunk FROM chunks",
    "w9_chunk_small": f"{chunked(2000)} SELECT doc_id, item, tag, chunk FROM chunks",
    "w10_toc": f"""{chunked(2000)}, marked AS (
          SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY item) AS pos,
                 count(*) FILTER (tag = 'h1') OVER (PARTITION BY doc_id ORDER BY item) AS h FROM chunks)
        SELECT doc_id, h AS entry, 'c' || lpad(chunk::VARCHAR, greatest(3, length(chunk::VARCHAR))::INT, '0') || '.xhtml' || CASE WHEN pos = 1 THEN '' ELSE '#h' || h END AS href, text AS label
        FROM marked WHERE tag = 'h1'
        UNION ALL SELECT doc_id, 1, 'c001.xhtml', 'Document ' || doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunks WHERE tag = 'h1')""",
    "w11_merge_runs": """
        SELECT doc_id, row_no, span, bold, italic, string_agg(text || ' ', '' ORDER BY run_no) AS text FROM (
          SELECT *, count(*) FILTER (n) OVER (PARTITION BY doc_id, row_no ORDER BY run_no) AS span FROM (
            SELECT doc_id, row_no, run_no, text, nullif(bold, false) AS bold, italic,
                   row_number() OVER o = 1 OR bold IS DISTINCT FROM lag(bold) OVER o OR italic IS DISTINCT FROM lag(italic) OVER o AS n
            FROM v_runs WINDOW o AS (PARTITION BY doc_id, row_no ORDER BY run_no))) GROUP BY ALL""",
    "w12_absorb_spaces": """
        SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY i) AS piece, p AS text FROM (
          SELECT doc_id, line_no, unnest(range(0, len(a))) AS i, unnest(a) AS p
          FROM (SELECT doc_id, line_no, CASE WHEN line LIKE ' %' THEN list_prepend(regexp_extract(line, '^ +'), regexp_extract_all(ltrim(line), '[^ ]+ *'))
                       ELSE regexp_extract_all(line, '[^ ]+ *') END AS a FROM v_lines))""",
    "w13_squeeze_blanks": r"""
        SELECT doc_id, line_no, t AS line FROM (
          SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY line_no) AS p, max(line_no) FILTER (t <> '') OVER (PARTITION BY doc_id) AS z
          FROM (SELECT doc_id, line_no, rtrim(regexp_replace(replace(line, chr(9), ' '), '[\x01-\x1f\x7f]', '', 'g')) AS t FROM v_gappy))
        WHERE (t <> '' OR coalesce(p, '') <> '') AND line_no <= z""",
    # names are counted per base, but where a suffixed name is also spelled out they are given out line by line
    "w23_unique_names": """
        WITH RECURSIVE named AS (
          SELECT *, row_number() OVER (PARTITION BY doc_id, base ORDER BY line_no) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM (
            SELECT *, coalesce(nullif(trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'field') AS base FROM v_field_labels)),
        met AS (SELECT DISTINCT a.doc_id FROM named a JOIN named b ON a.doc_id = b.doc_id AND a.n > 1 AND starts_with(b.base, a.base || '_')
                WHERE regexp_matches(substr(b.base, length(a.base) + 1), '^(_[0-9]+)+$')),
        walk AS (
          SELECT doc_id, 0::BIGINT AS k, 0::BIGINT AS line_no, ''::VARCHAR AS label, ''::VARCHAR AS name, []::VARCHAR[] AS used FROM met
          UNION ALL
          SELECT doc_id, k, line_no, label, name, list_append(used, name) FROM (
            SELECT n.doc_id, n.k, n.line_no, n.label, w.used, CASE WHEN NOT list_contains(w.used, n.base) THEN n.base
                     ELSE n.base || '_' || list_filter(range(2, n.k + 2), lambda i: NOT list_contains(w.used, n.base || '_' || i))[1] END AS name
            FROM walk w JOIN named n ON n.doc_id = w.doc_id AND n.k = w.k + 1))
        SELECT doc_id, line_no, label, base || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS name FROM named WHERE doc_id NOT IN (SELECT doc_id FROM met)
        UNION ALL SELECT doc_id, line_no, label, name FROM walk WHERE k > 0""",
    "w25_eol_lines": "SELECT doc_id, line_no AS line, replace(line, ' ', '_') || '_' AS text FROM v_lines",
    "w27_strip_instructions": """
        SELECT doc_id, line_no, word_no, token FROM (
          SELECT *, last_value(CASE WHEN token IN ('[', '~') THEN token END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no, word_no) AS st FROM v_tokens)
        WHERE token NOT IN ('[', '~', ']') AND coalesce(st, '~') <> '['""",
}
