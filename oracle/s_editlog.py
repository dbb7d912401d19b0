"""SQL: state folded from edit logs."""

STATE = """
    SELECT doc, name, kind, value, is_on, event_id, false AS seeded FROM (
      SELECT *, row_number() OVER (PARTITION BY doc, name ORDER BY ts DESC, event_id DESC) AS rn FROM v_field_log WHERE NOT seed)
    WHERE rn = 1 AND NOT (kind = 'text' AND value = '')
    UNION ALL
    SELECT doc, name, kind, value, CASE WHEN kind IN ('text', 'choice') THEN is_on ELSE true END, event_id, true FROM (
      SELECT s.*, row_number() OVER (PARTITION BY s.doc, s.name ORDER BY s.ts, s.event_id) AS rn FROM v_field_log s
      LEFT JOIN (SELECT * FROM v_field_log WHERE NOT seed QUALIFY row_number() OVER (PARTITION BY doc, name ORDER BY ts DESC, event_id DESC) = 1) e
        ON s.doc = e.doc AND s.name = e.name
      WHERE s.seed AND s.value <> '' AND (e.doc IS NULL OR (e.kind = 'text' AND e.value = '' AND (s.ts, s.event_id) > (e.ts, e.event_id)))) WHERE rn = 1"""

BOXES = """
    SELECT doc, name, widget_id, least(x0, x1) AS x, least(y0, y1) AS y FROM v_widgets
    WHERE NOT hidden AND NOT push_button AND abs(x1 - x0) >= 3 AND abs(y1 - y0) >= 3 AND NOT (read_only AND field_value = '')"""



def _replay(limit: int | None, edits: str) -> str:
    """The history carried row by row."""
    return f"""
        WITH RECURSIVE steps AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS rn FROM ({edits})),
        walk AS (
          SELECT session, 0::BIGINT AS rn, []::VARCHAR[] AS past, 0::BIGINT AS redo FROM (SELECT DISTINCT session FROM steps)
          UNION ALL
          SELECT w.session, s.rn,
                 CASE s.op WHEN 'push' THEN {f'CASE WHEN len(past) = {limit} THEN list_append(past[2:], s.label) ELSE list_append(past, s.label) END' if limit else 'list_append(past, s.label)'}
                      WHEN 'undo' THEN past[1:(len(past) - 1)] WHEN 'redo' THEN CASE WHEN redo > 0 THEN list_append(past, '') ELSE past END ELSE [] END,
                 CASE s.op WHEN 'undo' THEN redo + CASE WHEN len(past) > 0 THEN 1 ELSE 0 END WHEN 'redo' THEN greatest(redo - 1, 0) ELSE 0 END
          FROM walk w JOIN steps s ON s.session = w.session AND s.rn = w.rn + 1)
        SELECT session, len(past)::BIGINT AS depth, redo, coalesce(past[len(past)], '') AS label FROM walk
        WHERE (session, rn) IN (SELECT (session, max(rn)) FROM steps GROUP BY session)"""


SQL: dict[str, str] = {
    "t1_replay": _replay(None, "SELECT * FROM v_edits"),
    "t1_replay_shallow": _replay(3, "SELECT * FROM v_edits"),
    "t2_field_state": STATE,
    "t3_live_annots": """
        SELECT l.doc, id, page, event_id FROM (
          SELECT * FROM v_annot_steps WHERE op IN ('add', 'remove') QUALIFY row_number() OVER (PARTITION BY doc, id ORDER BY ts DESC, sub DESC) = 1) l
        LEFT JOIN (SELECT doc, max(ts) AS cleared FROM v_annot_steps WHERE op = 'clear' GROUP BY 1) c ON l.doc = c.doc
        WHERE op = 'add' AND (cleared IS NULL OR (ts, sub) > (cleared, 0))""",
    "t4_changed_pages": """
        SELECT DISTINCT doc, strftime(t, '%Y-%m-%d %H') AS "commit", page FROM (
          SELECT doc, ts AS t, page FROM v_annot_steps WHERE op = 'add'
          UNION ALL
          SELECT a.doc, e.ts, a.page FROM v_annot_steps a, LATERAL (
            SELECT n.ts, n.op FROM v_annot_steps n WHERE n.doc = a.doc AND (n.ts, n.sub) > (a.ts, a.sub) AND (n.op = 'clear' OR (n.id = a.id AND n.op IN ('add', 'remove')))
            ORDER BY n.ts, n.sub LIMIT 1) e WHERE a.op = 'add' AND e.op <> 'add'
          UNION ALL
          SELECT t.doc, t.ts, m.page FROM v_annot_steps t, LATERAL (
            SELECT n.op, n.page FROM v_annot_steps n WHERE n.doc = t.doc AND n.ts < t.ts AND (n.op = 'clear' OR (n.id = t.id AND n.op IN ('add', 'remove')))
            ORDER BY n.ts DESC, n.sub DESC LIMIT 1) m WHERE t.op = 'touch' AND m.op = 'add')""",
    "t5_coalesce_bursts": """
        SELECT doc, strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M') AS tick, count(*) AS n, arg_max(event_id, ts) AS last_id
        FROM v_field_log GROUP BY 1, 2""",
    "t6_handoff": """
        SELECT doc, event_id, CASE WHEN p IN ('click', 'view') THEN 'file' || pid END AS value FROM (
          SELECT user_id AS doc, event_id, event_type, lag(event_type) OVER o AS p, lag(event_id) OVER o AS pid FROM events WHERE event_type <> 'signup'
          WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE event_type IN ('purchase', 'error')""",
    "t7_dedupe_payload": "SELECT doc, stamp, arg_min(event_id, ts) AS payload_id, count(*) AS n_snapshots FROM v_revisions GROUP BY 1, 2",
    "t8_restore_cost": """
        SELECT doc, event_id, p = stamp AS cheap FROM (SELECT *, lag(stamp) OVER (PARTITION BY doc ORDER BY ts, event_id) AS p FROM v_revisions) WHERE p IS NOT NULL""",
    "a5_completion": f"""
        SELECT doc, count(*) AS touched, count(*) FILTER (CASE WHEN kind IN ('check', 'radio') THEN is_on ELSE value <> '' END) AS filled FROM ({STATE}) GROUP BY 1""",
    "p10_mirror_values": f"SELECT b.*, s.value, s.is_on FROM ({BOXES}) b JOIN ({STATE}) s ON b.doc = s.doc AND b.name = s.name",
}
