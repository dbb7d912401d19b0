"""SQL: overlap, hit tests, redaction, merging."""

_SHAPES = "SELECT {keys}, x, y, w, h, min(rect_id) AS id, count(*) AS copies FROM {rects} GROUP BY ALL"


def _pairs(keys: str, rects: str = "v_rects") -> str:
    s = _SHAPES.format(keys=keys, rects=rects)
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    cols = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
        SELECT {cols}, a.id AS a, b.id AS b, a.copies AS a_copies, b.copies AS b_copies, a.w * a.h AS aa, b.w * b.h AS ba,
               (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS shared
        FROM ({s}) a JOIN ({s}) b ON {on} AND (a.id < b.id OR (a.id = b.id AND a.copies > 1))
             AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h"""


_SEL = """
    SELECT strftime(e.ts, '%Y-%m-%d %H') AS action, page, x, y, CASE WHEN variant = 'view' THEN w - mark_id % 30 ELSE w END AS w, h
    FROM v_marks m JOIN events e ON m.mark_id = e.event_id WHERE variant = 'signup' OR (variant = 'view' AND mark_id % 50 = 0)"""
_SHARED = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_HITS = f"""
    SELECT action, page, mark_id FROM (
      SELECT a.action, a.page, b.mark_id, sum({_SHARED}) AS shared FROM ({_SEL}) a JOIN v_marks b ON b.variant = 'view' AND a.page = b.page GROUP BY ALL)
    JOIN (SELECT action, page, sum(w * h) AS sa FROM ({_SEL}) GROUP BY ALL) USING (action, page)
    JOIN (SELECT mark_id, sum(w * h) AS ma FROM v_marks GROUP BY ALL) USING (mark_id) WHERE shared / sa >= 0.6 OR shared / ma >= 0.6"""
_MARK_PAIRS = f"""
    SELECT page, variant, am, bm FROM (
      SELECT a.page, a.variant, a.mark_id AS am, b.mark_id AS bm, sum({_SHARED}) AS shared FROM v_marks a JOIN v_marks b
      ON a.page = b.page AND a.variant = b.variant AND a.mark_id <> b.mark_id GROUP BY ALL)
    JOIN (SELECT mark_id AS am, sum(w * h) AS aa FROM v_marks GROUP BY ALL) USING (am) JOIN (SELECT mark_id AS bm, sum(w * h) AS ba FROM v_marks GROUP BY ALL) USING (bm)
    WHERE shared / aa >= 0.6 OR shared / ba >= 0.6"""

SQL: dict[str, str] = {
    "j1_text_in": """
        WITH b AS (SELECT doc_id * 3000 + page_no * 3 + k AS box_id, doc_id, page_no, CASE WHEN k = 2 THEN x - 50000 ELSE x END AS x, y, CASE WHEN k = 1 THEN 2 * w ELSE w END AS w, h
                   FROM v_boxes, (SELECT unnest([0, 1, 2]) AS k))
        SELECT b.box_id, any_value(b.doc_id) AS doc_id, any_value(b.page_no) AS page_no,
               coalesce(trim(regexp_replace(string_agg(text, ' ' ORDER BY (baseline - size) // 30, r.x, run_no), '\\s+', ' ', 'g')), '') AS text,
               (arg_min(size, place) + 5) // 10 AS size, arg_min(face IN (1, 2, 4), place) AS bold, arg_min(face IN (1, 4), place) AS serif, arg_min(face = 2, place) AS mono, count(text) AS n_runs
        FROM b LEFT JOIN (SELECT *, ((baseline - size) // 30) * 100000 + x AS place, (doc_id + row_no + run_no) % 5 AS face FROM v_runs) r
             ON r.doc_id = b.doc_id AND r.page_no = b.page_no AND trim(text) <> ''
             AND r.x + r.w >= b.x AND r.x <= b.x + b.w AND baseline >= b.y AND baseline - size <= b.y + b.h GROUP BY 1""",
    "j2_match_marks": f"""
        WITH shape AS (SELECT page, variant, mark_id, min(mark_id) OVER (PARTITION BY page, variant, boxes) AS rep, count(*) OVER (PARTITION BY page, variant, boxes) AS copies
                       FROM (SELECT page, variant, mark_id, list_sort(list([x, y, w, h])) AS boxes FROM v_marks GROUP BY ALL))
        SELECT p.page, p.variant, am AS mark, any_value(a.copies) AS copies, count(*) AS n_matches, min(b.rep) FILTER (b.rep <> am) AS match
        FROM ({_MARK_PAIRS}) p JOIN shape a ON p.am = a.mark_id JOIN shape b ON p.bm = b.mark_id WHERE a.rep = am GROUP BY 1, 2, 3""",
    "j3_toggle_marks": f"""
        SELECT action, page, mark_id, 'remove' AS op FROM ({_HITS})
        UNION ALL SELECT DISTINCT action, page, NULL, 'insert' FROM ({_SEL}) WHERE action NOT IN (SELECT action FROM ({_HITS}))""",
    "j4_hit_test": """
        SELECT point_id, max(rect_id) AS hit FROM v_points p LEFT JOIN v_rects r ON p.page = r.page AND px BETWEEN x AND x + w AND py BETWEEN y AND y + h GROUP BY 1""",
    "j5_overlapping_pairs": f"SELECT page, a, b, a_copies, b_copies FROM ({_pairs('page')})",
    "j5_overlap_summary": f"""
        SELECT page, a AS shape, a_copies AS copies, sum(n)::BIGINT AS n_others, sum(shared * n)::BIGINT AS shared, arg_max(b, shared * 1000000000 - b) AS best
        FROM (SELECT page, a, b, a_copies, b_copies - (a = b)::INT AS n, shared FROM ({_pairs('page')})
              UNION ALL SELECT page, b, a, b_copies, a_copies, shared FROM ({_pairs('page')}) WHERE a <> b) GROUP BY 1, 2, 3""",
    "j6_redact": """
        SELECT doc_id, page_no, flattened, count(*) AS n, sum(w)::BIGINT AS w, sum(x * 31 + run_no)::BIGINT AS digest FROM (
          SELECT r.*, b.doc_id IS NOT NULL AS flattened,
                 b.doc_id IS NOT NULL AND r.x < b.x + b.w AND r.x + r.w > b.x AND baseline - size < b.y + b.h AND baseline > b.y AS gone
          FROM v_runs r LEFT JOIN v_boxes b ON r.doc_id = b.doc_id AND r.page_no = b.page_no) WHERE NOT gone GROUP BY 1, 2, 3""",
    "w17_merge_rects": """
        SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y) - 1 AS line, x, y, w, h FROM (
          SELECT doc_id, page_no, min(x) AS x, min(baseline - size) AS y, max(x + w) - min(x) AS w, min(size) AS h FROM v_runs GROUP BY doc_id, page_no, row_no)""",
    "a3_extent": """
        SELECT page, x, y, x1 - x AS w, y1 - y AS h FROM (
          SELECT page, min(x - p) AS x, min(y - p) AS y, max(x + w + p) AS x1, max(y + h + p) AS y1
          FROM (SELECT *, CASE WHEN variant = 'click' THEN 3 ELSE 0 END AS p FROM v_rects) GROUP BY 1)""",
    "p14_drop_trivial": """
        SELECT * FROM (SELECT rect_id, CASE WHEN variant = 'click' THEN 'ink' ELSE 'shape' END AS kind, rect_id % 4 AS n_points, w % 7 AS w, h % 9 AS h FROM v_rects)
        WHERE CASE WHEN kind = 'ink' THEN n_points >= 2 ELSE w >= 4 OR h >= 4 END""",
}
