"""SQL: ordered logs, strokes, tables, colours."""


def _simplified(points: str, key: str, order: str) -> str:
    return f"""
        SELECT {key}, n - CASE WHEN shut THEN 1 ELSE 0 END AS n_points,
               CASE WHEN n - CASE WHEN shut THEN 1 ELSE 0 END < 2 THEN 'none' WHEN n - CASE WHEN shut THEN 1 ELSE 0 END = 2 THEN 'line' ELSE 'polyline' END AS kind
        FROM (SELECT {key}, count(*) AS n, bool_or(closed) AND count(*) > 1 AND arg_min(x, rn) = arg_max(x, rn) AND arg_min(y, rn) = arg_max(y, rn) AS shut
              FROM (SELECT *, row_number() OVER o AS rn, lag(x) OVER o AS px, lag(y) OVER o AS py FROM ({points}) WINDOW o AS (PARTITION BY {key} ORDER BY {order}))
              WHERE px IS NULL OR x <> px OR y <> py GROUP BY 1)"""


def _q(c: str) -> str:
    return f"floor(floor({c} * alpha + 255 * (1 - alpha) + 0.5) * 3 / 255 + 0.5)::BIGINT * 85"


SQL: dict[str, str] = {
    "w14_number_items": """
        SELECT list, level, seq, CASE WHEN v IS NULL THEN rn ELSE v + rn - vn END AS number FROM (
          SELECT *, last_value(value IGNORE NULLS) OVER o AS v, last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER o AS vn
          FROM (SELECT *, row_number() OVER (PARTITION BY list, level ORDER BY ts, seq) AS rn FROM v_list_items) WINDOW o AS (PARTITION BY list, level ORDER BY ts, seq))""",
    "w15_remap_pages": """
        SELECT doc, rect_id, CASE WHEN p2 = mv_at THEN mv_to ELSE l + CASE WHEN l >= mv_to THEN 1 ELSE 0 END END AS page FROM (
          SELECT *, p2 - CASE WHEN p2 > mv_at THEN 1 ELSE 0 END AS l FROM (
            SELECT *, p1 + CASE WHEN p1 > ins_at THEN 1 ELSE 0 END AS p2 FROM (
              SELECT m.*, e.*, page - CASE WHEN page > del_at THEN 1 ELSE 0 END AS p1 FROM v_page_marks m JOIN v_page_edits e USING (doc) WHERE page <> del_at)))""",
    "w16_erase": """
        SELECT stroke, island, n_points, x_first, x_last FROM (
          SELECT stroke, island, count(*) AS n_points, arg_min(x, rn) AS x_first, arg_max(x, rn) AS x_last, any_value(touched) AS touched FROM (
            SELECT *, count(*) FILTER (erased) OVER (PARTITION BY stroke ORDER BY ts, event_id) AS island, bool_or(erased) OVER (PARTITION BY stroke) AS touched,
                   row_number() OVER (PARTITION BY stroke ORDER BY ts, event_id) AS rn FROM v_strokes) WHERE NOT erased GROUP BY 1, 2)
        WHERE NOT touched OR n_points > 1""",
    "w16_surviving_points": """
        SELECT stroke, island, event_id, x, y FROM (
          SELECT *, count(*) OVER (PARTITION BY stroke, island) AS n, bool_or(cut) OVER (PARTITION BY stroke) AS touched FROM (
            SELECT stroke, event_id, x, y, false AS cut, count(*) FILTER (erased) OVER (PARTITION BY stroke ORDER BY ts, event_id) AS island, erased FROM v_strokes) WHERE NOT erased)
        WHERE n > 1 OR stroke NOT IN (SELECT stroke FROM v_strokes WHERE erased)""",
    "w26_kept_points": """
        WITH k AS (SELECT *, row_number() OVER (PARTITION BY stroke ORDER BY ts) AS i, count(*) OVER (PARTITION BY stroke) AS n, first_value(x) OVER (PARTITION BY stroke ORDER BY ts) AS fx,
                          first_value(y) OVER (PARTITION BY stroke ORDER BY ts) AS fy
                   FROM (SELECT stroke, ts, event_id, x // 5 AS x, y, x // 5 IS DISTINCT FROM lag(x // 5) OVER o OR y IS DISTINCT FROM lag(y) OVER o AS moved FROM v_strokes WINDOW o AS (PARTITION BY stroke ORDER BY ts, event_id)) WHERE moved)
        SELECT stroke, event_id, x, y FROM k WHERE NOT (stroke % 2 = 0 AND n > 1 AND i = n AND x = fx AND y = fy)""",
    "w16_flag_erased": """
        SELECT rect_id, EXISTS (SELECT 1 FROM v_rects n WHERE n.variant = 'error' AND n.page = p.page
               AND (p.x - n.x - 3) * (p.x - n.x - 3) + (p.y - n.y - 4) * (p.y - n.y - 4) <= 400) AS erased FROM v_rects p""",
    "w24_to_records": """
        SELECT * FROM (SELECT conv_id, turn, count(*) FILTER (is_marker) OVER (PARTITION BY conv_id ORDER BY turn) AS record FROM v_turns) WHERE record > 0""",
    "w26_simplify_paths": _simplified("SELECT stroke, ts, event_id, x // 5 AS x, y, stroke % 2 = 0 AS closed FROM v_strokes", "stroke", "ts, event_id"),
    "w26_short_paths": _simplified("""SELECT l_orderkey AS path, l_linenumber AS n, min(l_quantity::BIGINT % 2) AS x, min(l_linenumber % 2) AS y,
        bool_or(l_orderkey % 2 = 0) AS closed FROM lineitem GROUP BY 1, 2""", "path", "n"),
    "a9_column_stops": """
        SELECT tbl, col, width, round(upto * CASE WHEN total > 2400 THEN 2400 / total ELSE 1 END, 6) AS stop FROM (
          SELECT *, sum(width) OVER (PARTITION BY tbl)::BIGINT AS total, sum(width) OVER (PARTITION BY tbl ORDER BY col)::BIGINT AS upto
          FROM (SELECT tbl, col, max(60 * length(text) + 140) AS width FROM v_cells GROUP BY 1, 2)) WHERE col < 3""",
    "a10_palette": f"""
        SELECT '#' || lpad(lower(to_hex(key)), 6, '0') AS colour, n FROM (
          SELECT {_q('r')} * 65536 + {_q('g')} * 256 + {_q('b')} AS key, count(*) AS n
          FROM (SELECT event_id * 37 % 256 AS r, fv * 5 % 256 AS g, event_id * 11 % 256 AS b, CASE WHEN event_type = 'view' THEN 0.5 ELSE 1.0 END AS alpha FROM v_events)
          GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 48)""",
    "a17_endpoints": """
        SELECT stroke, arg_min(x, rn) AS ax, arg_min(y, rn) AS ay, arg_max(x, rn) AS bx, arg_max(y, rn) AS by
        FROM (SELECT *, row_number() OVER (PARTITION BY stroke ORDER BY ts, event_id) AS rn FROM v_strokes) GROUP BY 1""",
    "a18_consensus": """
        SELECT box, CASE WHEN max(greatest(abs(r - mr), abs(g - mg), abs(b - mb))) > 24 THEN '#ffffff'
               ELSE '#' || lpad(lower(to_hex(any_value(mr))), 2, '0') || lpad(lower(to_hex(any_value(mg))), 2, '0') || lpad(lower(to_hex(any_value(mb))), 2, '0') END AS colour
        FROM (SELECT *, quantile_disc(r, 0.5) OVER (PARTITION BY box) AS mr, quantile_disc(g, 0.5) OVER (PARTITION BY box) AS mg, quantile_disc(b, 0.5) OVER (PARTITION BY box) AS mb
              FROM (SELECT l_orderkey AS box, floor(200 + l_quantity / 2)::BIGINT AS r, floor(l_tax * 300 + 0.5)::BIGINT AS g, floor(l_discount * 300 + 0.5)::BIGINT AS b FROM lineitem))
        GROUP BY 1""",
}
