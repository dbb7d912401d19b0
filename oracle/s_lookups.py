"""SQL: ordered, inherited, nested and interval lookups; search."""

_Q = "(VALUES ('the'), ('und'), ('de la'), ('aa'), ('the'), ('e')) t(q)"


def _hits(runs: str) -> str:
    """Occurrences by splitting on the query: each piece but the last is followed by a hit."""
    return f"""
        SELECT *, (lens - length(q))::BIGINT AS pos, x + (w / greatest(1, length(text))) * (lens - length(q)) AS hx, greatest((w / greatest(1, length(text))) * length(q), 20)::DOUBLE AS hw FROM (
          SELECT *, sum(length(p) + length(q)) OVER (PARTITION BY doc_id, row_no, run_no, qi ORDER BY i) AS lens FROM (
            SELECT r.*, q, qi, unnest(range(0, len(ps))) AS i, unnest(ps) AS p, len(ps) AS n FROM (
              SELECT r.*, q, qi, string_split(lower(text), q) AS ps FROM ({runs}) r, (SELECT q, row_number() OVER () AS qi FROM {_Q}) WHERE contains(lower(text), q)) r)
          QUALIFY i < n - 1)"""


_LINE_RUNS = "SELECT doc_id, 1 AS page_no, line_no AS row_no, 0 AS run_no, line AS text, 0 AS x, length(line) * 60 AS w FROM v_lines"

SQL: dict[str, str] = {
    "j9_resolve_order": """
        SELECT conv_id AS doc, 'slides/slide' || turn || '.xml' AS target, CASE WHEN role <> 'user' THEN 0 ELSE 1 END::BIGINT AS tier,
               CASE WHEN role <> 'user' THEN -turn ELSE turn END AS n FROM conversations""",
    "o2_natural_order": "SELECT 'slides/slide' || event_id || '.xml' AS part, event_id AS n FROM events WHERE event_type <> 'error'",
    "o3_title_first": """
        SELECT conv_id, turn, role = 'assistant' AS is_title, CASE WHEN role = 'assistant' THEN 0 ELSE 1 END::BIGINT AS sort_key FROM conversations""",
    "j13_resolve_styles": """
        WITH RECURSIVE chain AS (
          SELECT id AS start, id, parent, size, bold, 0 AS depth FROM v_styles
          UNION ALL SELECT c.start, s.id, s.parent, s.size, s.bold, c.depth + 1 FROM chain c JOIN v_styles s ON s.id = c.parent WHERE c.depth < 40)
        SELECT start AS id, coalesce(arg_min(size, depth) FILTER (size IS NOT NULL), 11) AS size, coalesce(arg_min(bold, depth) FILTER (bold IS NOT NULL), false) AS bold
        FROM chain GROUP BY 1""",
    "j14_expand_blocks": """
        WITH RECURSIVE walk AS (
          SELECT 0::BIGINT AS block, 1::BIGINT AS n, [0::BIGINT] AS path, 0::BIGINT AS depth
          UNION ALL SELECT i.child, w.n * i.cols * i.n_rows, list_append(w.path, i.child), w.depth + 1
          FROM walk w JOIN v_inserts i ON i.block = w.block WHERE NOT list_contains(w.path, i.child))
        SELECT block, 'ok' AS status, sum(n)::BIGINT AS copies, min(depth) AS depth, false AS saturated FROM walk GROUP BY 1""",
    "j15_props_at": """
        SELECT p.doc, p.pos, arg_min(prop, seq) AS prop FROM (
          SELECT DISTINCT doc, pos FROM (SELECT doc, unnest(range(lo, hi + 1, 50)) AS pos FROM v_turn_ranges UNION ALL SELECT doc, hi + 7 FROM v_turn_ranges)) p
        LEFT JOIN v_turn_ranges r ON p.doc = r.doc AND p.pos >= r.lo AND p.pos < r.hi GROUP BY 1, 2""",
    "j16_cell_props": """
        SELECT o_custkey AS tbl, o_orderkey AS cell, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority WHEN c_acctbal > 0 THEN c_mktsegment END AS border
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "x1_find": f"""
        SELECT doc_id, row_no, q, count(*) AS n, sum(pos)::BIGINT AS pos, sum(hx) AS x, sum(hw) AS w FROM ({_hits('SELECT * FROM v_runs')}) GROUP BY 1, 2, 3""",
    "x1_find_lines": f"""
        SELECT doc_id, row_no, q, count(*) AS n, sum(pos)::BIGINT AS pos, max(hx) AS last_x, max(hw) AS w FROM ({_hits(_LINE_RUNS)}) GROUP BY 1, 2, 3""",
    "x2_hit_pages": f"""
        SELECT doc_id, page_no, q, count(*) AS n, min(row_no) AS first_row, arg_min(hx, row_no * 1000000000 + run_no * 10000000 + pos) AS first_x FROM ({_hits('SELECT * FROM v_runs')}) GROUP BY 1, 2, 3""",
}
