"""SQL text of the derived inputs; queries name them and ``compose`` adds the CTEs."""

from __future__ import annotations

import re

from corpusloom.plans.views import SAMPLE_HEADS

_HEX = ", ".join(f"'{h}'" for _, h in SAMPLE_HEADS)
_KIND = ", ".join(f"'{k}'" for k, _ in SAMPLE_HEADS)
_N = len(SAMPLE_HEADS)

VIEWS: dict[str, str] = {
    "v_lines": """
        SELECT doc_id, source, len(a)::BIGINT AS n_lines, unnest(range(0, len(a)))::BIGINT AS line_no, unnest(a) AS line
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS a FROM documents)""",
    "v_words": """
        SELECT doc_id, line_no, line_len, unnest(range(0, len(a)))::BIGINT AS word_no, unnest(a) AS word
        FROM (SELECT doc_id, line_no, length(line)::BIGINT AS line_len,
                     list_filter(string_split(line, ' '), lambda w: w <> '') AS a FROM v_lines)""",
    "v_rows": """
        SELECT doc_id, line_no, part, (row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1)::BIGINT AS row_no,
               n_words, line_len
        FROM (SELECT doc_id, line_no, word_no // 10 AS part, count(*) AS n_words, any_value(line_len) AS line_len
              FROM v_words GROUP BY ALL)""",
    "v_runs": """
        SELECT w.doc_id, (r.row_no // 40 + 1)::BIGINT AS page_no, r.row_no, (w.word_no % 10)::BIGINT AS run_no, w.word AS text,
               (560 + CASE WHEN r.part = 0 AND r.row_no > 0 THEN 120 ELSE 0 END
                + CASE WHEN w.word_no % 10 >= 5 AND r.row_no % 9 = 4 THEN 300 ELSE 0 END
                + 60 * coalesce(sum(length(w.word) + 1) OVER (PARTITION BY w.doc_id, r.row_no ORDER BY w.word_no
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS x,
               (60 * length(w.word))::BIGINT AS w, (600 + 154 * (r.row_no % 40))::BIGINT AS baseline,
               CASE WHEN r.row_no = 0 AND r.line_len <= 140 THEN 240 ELSE 110 END::BIGINT AS size,
               (w.doc_id + w.word_no) % 7 = 0 AS bold, w.word_no % 11 = 0 AS italic,
               CASE WHEN (w.doc_id + r.row_no) % 97 = 0 AND r.n_words = 1 THEN 90 ELSE 0 END::BIGINT AS angle
        FROM v_words w JOIN v_rows r ON w.doc_id = r.doc_id AND w.line_no = r.line_no AND w.word_no // 10 = r.part""",
    "v_pages": """SELECT doc_id, max(page_no) AS n_pages FROM v_runs GROUP BY doc_id""",
    "v_titles_raw": """
        SELECT page_id, url, regexp_extract(html, '<title>(.*?)</title>', 1, 's') AS title FROM pages""",
    "v_titles": """
        SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'Microsoft Word - ' || title || '.docx'
                             WHEN page_id % 7 = 0 THEN 'untitled' ELSE title END AS title, 'page-' || page_id AS name
        FROM v_titles_raw""",
    "v_tracked": """
        SELECT page_id AS doc_id, i::BIGINT AS run_no, c AS text, (560 + 90 * i)::BIGINT AS x, 60::BIGINT AS w, 110::BIGINT AS size
        FROM (SELECT page_id, unnest(range(0, length(title))) AS i, unnest(string_split(title, '')) AS c FROM v_titles_raw)
        WHERE c <> ' '""",
    "v_flow": """
        SELECT doc_id, i, w, len(a) AS n FROM (
          SELECT doc_id, a, unnest(range(0, len(a))) AS i, unnest(a) AS w FROM (
            SELECT doc_id, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS a FROM documents))""",
    "v_wrapped": """
        SELECT doc_id, vline::BIGINT AS vline, string_agg(piece, ' ' ORDER BY ord) AS text FROM (
          SELECT doc_id, i // 8 AS vline, (CASE WHEN i % 8 = 3 AND (i // 8) % 4 = 1 THEN i - 1 ELSE i END) * 2 AS ord,
                 string_agg(CASE WHEN cut THEN w[1:(length(w) // 2)] || '-' ELSE w END, '-' ORDER BY i) AS piece
          FROM (SELECT *, i % 8 = 7 AND (i // 8) % 5 = 0 AND n > i + 1 AND regexp_matches(w, '^\\p{L}{6,}$') AS cut FROM v_flow)
          GROUP BY ALL
          UNION ALL
          SELECT doc_id, i // 8 + 1, -1, w[(length(w) // 2 + 1):] FROM v_flow
          WHERE i % 8 = 7 AND (i // 8) % 5 = 0 AND n > i + 1 AND regexp_matches(w, '^\\p{L}{6,}$'))
        GROUP BY ALL""",
    "v_noisy": """
        SELECT doc_id, text[1:20] || repeat(chr((doc_id % 8 + 1)::INT), doc_id % 400) || text[21:] AS text FROM documents""",
    "v_scripted": """
        SELECT doc_id, source, text || repeat(chr(12354), (length(text) * (doc_id % 10)) // 100) AS text FROM documents""",
    "v_gappy": """
        SELECT doc_id, unnest(range(0, len(a)))::BIGINT AS line_no, unnest(a) AS line FROM (
          SELECT doc_id, string_split(chr(10) || ' ' || chr(10) || replace(text, '. ', '.' || chr(10) || chr(10) || chr(9) || chr(10))
                 || chr(10) || chr(10), chr(10)) AS a FROM documents)""",
    "v_routes": """
        SELECT DISTINCT route FROM (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS route FROM pages)
        WHERE route <> ''""",
    "v_events": """SELECT *, json_extract_string(props, '$.k')::BIGINT AS k, floor(value)::BIGINT AS fv FROM events""",
    "v_heads": f"""
        SELECT event_id AS file_id, 'f' || event_id || '.' || claimed AS name, claimed, hexed, bytes, event_type FROM (
          SELECT event_id, ([{_KIND}])[((event_id + fv) % {_N} + 1)::INT] AS claimed, ([{_HEX}])[(event_id % {_N} + 1)::INT] AS hexed,
                 event_id * 37 % 3000 AS bytes, event_type FROM v_events)""",
    "v_rects": """
        SELECT event_id AS rect_id, user_id AS page, event_id * 37 % 540 AS x, fv % 800 AS y, 20 + event_id % 60 AS w,
               10 + (event_id // 7) % 30 AS h, event_type AS variant FROM v_events""",
    "v_marks": """
        SELECT page, variant, mark_id, x - 9 * i AS x, y + i * h AS y, w + 5 * i AS w, h FROM (
          SELECT page, variant, rect_id AS mark_id, x, y, w, h, unnest(range(0, rect_id % 3 + 1))::BIGINT AS i FROM v_rects
          UNION ALL SELECT page, variant, rect_id + 1000000000, x + rect_id % 3 * 8, y, w, h, unnest(range(0, rect_id % 3 + 1)) FROM v_rects WHERE rect_id % 4 = 0)""",
    "v_points": """
        SELECT event_id AS point_id, user_id AS page, event_id * 53 % 560 AS px, fv * 2 % 820 AS py FROM v_events""",
    "v_strokes": """
        SELECT user_id AS stroke, ts, event_id, k % 6 AS x, fv % 3 AS y, event_type = 'error' AS erased FROM v_events""",
    "v_edits": """
        SELECT user_id AS session, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'push'
               WHEN event_type = 'purchase' THEN 'undo' WHEN event_type = 'error' THEN 'redo' ELSE 'clear' END AS op,
               'e' || event_id AS label FROM events""",
    "v_widgets": """
        SELECT user_id AS doc, event_id AS widget_id, 'f' || (k % 20) AS name,
               CASE k % 4 WHEN 0 THEN 'Tx' WHEN 1 THEN 'Ch' ELSE 'Btn' END AS field_type, k % 4 = 2 AS radio_button,
               k % 4 = 3 AND k % 8 = 7 AS push_button, event_type = 'error' AS hidden, event_type = 'purchase' AS read_only,
               event_id * 41 % 500 AS x0, event_id * 29 % 700 AS y0, event_id * 41 % 500 + fv - 2 AS x1,
               event_id * 29 % 700 - k % 12 AS y1,
               CASE WHEN event_id % 9 = 0 THEN '' WHEN event_id % 5 = 0 THEN 'Off' ELSE 'v' || event_id END AS field_value
        FROM v_events""",
    "v_field_log": """
        SELECT user_id AS doc, 'f' || (k % 20) AS name,
               CASE k % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'choice' WHEN 2 THEN 'radio' ELSE 'check' END AS kind,
               CASE WHEN event_id % 9 = 0 THEN '' ELSE 'v' || event_id END AS value,
               event_type IN ('click', 'purchase') AS is_on, ts, event_id, event_type = 'signup' AS seed FROM v_events""",
    "v_annot_log": """
        SELECT user_id AS doc, event_id % 25 AS id, CASE WHEN event_type IN ('click', 'view') THEN 'add' WHEN event_type = 'error' THEN 'remove'
               WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'load' WHEN event_type = 'signup' THEN 'clear' ELSE 'touch' END AS op,
               fv % 9 + 1 AS page, ts, event_id, fv FROM v_events""",
    # a load is a clear, then an add of each of its items
    "v_annot_steps": """
        SELECT doc, CASE WHEN op <> 'load' THEN id END AS id, CASE WHEN op = 'load' THEN 'clear' ELSE op END AS op, page, ts, event_id, 0::BIGINT AS sub FROM v_annot_log
        UNION ALL
        SELECT doc, (event_id + j * (event_id % 2)) % 25, 'add', (fv + j) % 9 + 1, ts, event_id, j + 1
        FROM (SELECT *, unnest(range(0, event_id % 5)) AS j FROM v_annot_log WHERE op = 'load')""",
    "v_revisions": """
        SELECT user_id AS doc, ts, event_id, event_type,
               count(*) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stamp FROM events""",
    "v_list_items": """
        SELECT user_id AS list, event_id % 2 AS level, ts, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN k END AS value FROM v_events""",
    "v_page_marks": """SELECT page AS doc, rect_id, x % 9 + 1 AS page FROM v_rects""",
    "v_page_edits": """
        SELECT doc, doc % 9 + 1 AS del_at, k % 8 + 1 AS ins_at, doc % 7 + 1 AS mv_at, k % 6 + 1 AS mv_to
        FROM (SELECT user_id AS doc, max(k) AS k FROM v_events GROUP BY 1)""",
    "v_catalogue": """
        SELECT replace(p_name, ' ', '-') || '-' || p_partkey AS slug, 'P' || p_partkey AS code, p_name AS name, p_type AS category,
               p_brand AS tag1, p_partkey AS seq, (p_size % 7)::BIGINT AS pages, p_size::BIGINT AS fields FROM part""",
    "v_popular": """
        SELECT seq, qty, row_number() OVER (ORDER BY qty DESC, seq) - 1 AS rank FROM (
          SELECT l_partkey AS seq, sum(l_quantity) AS qty FROM lineitem GROUP BY 1)""",
    "v_notes": """
        SELECT replace(p_name, ' ', '-') || '-' || p_partkey AS slug, 'About ' || p_name AS about,
               CASE WHEN p_size > 8 THEN 'Buyers of ' || p_brand END AS who FROM part WHERE p_size <= 17""",
    "v_edges": """
        SELECT src, dst, (['from', 'to', 'img', 'other'])[(length(src || dst) % 4 + 1)::INT] AS cat, n > 12 AS pop, top > 45 AS live, seq
        FROM (SELECT lower(replace(p_brand, '#', '')) AS src, lower(p_type) AS dst, max(p_size) AS top, min(p_partkey) AS seq,
                     count(*) AS n FROM part GROUP BY 1, 2)""",
    "v_manifest_prev": """
        SELECT o_orderkey AS slug, strftime(o_orderdate, '%Y-%m-%d') AS fetched FROM orders WHERE o_totalprice > 200000""",
    "v_manifest_new": """
        SELECT o_orderkey AS slug, o_orderstatus = 'F' AS cached, floor(o_totalprice)::BIGINT AS bytes, o_orderkey % 9 + 1 AS pages,
               o_orderkey % 6 AS fields, o_orderpriority <> '5-LOW' AS writable,
               CASE WHEN o_totalprice < 5000 THEN 'too small' END AS skip_reason FROM orders""",
    "v_defs": """
        SELECT source AS owner, key, source[4:]::BIGINT % 2 AS grp FROM (
          SELECT source, lower(trim(regexp_replace(line, '[0-9]+', '#', 'g'))) AS key FROM v_lines) WHERE key <> ''""",
    "v_cells": """
        SELECT o_custkey AS tbl, o_orderkey AS row, unnest([0, 1, 2, 3])::BIGINT AS col,
               CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE unnest([o_orderkey::VARCHAR, o_orderstatus,
                    strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority]) END AS text FROM orders""",
    "v_styles": """
        SELECT p_partkey AS id, CASE WHEN p_partkey > 0 THEN p_partkey // 3 END AS parent,
               CASE WHEN p_size % 4 = 0 THEN p_size::BIGINT END AS size, CASE WHEN p_size > 40 THEN true END AS bold FROM part
        UNION ALL SELECT -1, -2, count(*), NULL FROM part
        UNION ALL SELECT -2, -1, NULL, NULL""",
    "v_inserts": """
        SELECT p_partkey // 2 AS block, p_partkey AS child, (1 + p_size % 3)::BIGINT AS cols, (1 + p_size % 2)::BIGINT AS n_rows
        FROM part WHERE p_partkey > 0
        UNION ALL SELECT p_partkey, p_partkey, 1 + p_size % 3, 1 + p_size % 2 FROM part WHERE p_partkey > 0 AND p_size = 1""",
    "v_turns": """SELECT conv_id, turn, role, role = 'user' AS is_marker, text FROM conversations""",
    "v_turn_ranges": """
        SELECT conv_id AS doc, turn AS seq, (t - n)::BIGINT AS lo, t::BIGINT AS hi, role AS prop FROM (
          SELECT *, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS t FROM conversations)""",
    "v_tokens": """
        SELECT doc_id, line_no, word_no, CASE word_no % 20 WHEN 5 THEN '[' WHEN 7 THEN '~' WHEN 9 THEN ']' ELSE word END AS token
        FROM v_words""",
    "v_boxes": """
        SELECT doc_id, unnest(range(1, n_pages + 1))::BIGINT AS page_no, 1000::BIGINT AS x, 1270::BIGINT AS y, 2000::BIGINT AS w,
               462::BIGINT AS h FROM v_pages WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)""",
    "v_field_labels": """
        SELECT doc_id, line_no, line || CASE WHEN line_no % 3 = 1 THEN ' 2' ELSE '' END AS label FROM v_lines WHERE trim(line) <> ''""",
    # text lines rebuilt from runs: a gap wider than 1.6 em breaks, any other gap over the row's threshold is a space
    "v_gaps": """
        SELECT *, x - lag(x + w) OVER r AS gap, greatest(size, lag(size) OVER r) AS em FROM v_runs
        WINDOW r AS (PARTITION BY doc_id, page_no, row_no ORDER BY x, run_no)""",
    "v_segs": """
        SELECT *, count(*) FILTER (gap > 1.6 * em) OVER (PARTITION BY doc_id, page_no, row_no ORDER BY x, run_no) AS seg FROM v_gaps""",
    "v_spaces": """
        SELECT doc_id, page_no, row_no, n, singles,
               CASE WHEN n >= 5 AND singles / n >= 0.6 AND m > 0.18 THEN least(m * 1.45::DOUBLE, 1.6::DOUBLE * 0.9) ELSE 0.18::DOUBLE END AS threshold
        FROM (SELECT doc_id, page_no, row_no, count(*) AS n, count(*) FILTER (length(text) = 1) AS singles,
                     coalesce(quantile_disc(CASE WHEN gap > 0 AND gap / em < 1.6 THEN gap / em END, 0.5), 0) AS m FROM v_gaps GROUP BY 1, 2, 3)""",
    "v_tlines": """
        SELECT doc_id, page_no, row_no, seg,
               string_agg(CASE WHEN gap > threshold * em AND gap <= 1.6 * em THEN ' ' ELSE '' END || text, '' ORDER BY x, run_no) AS text,
               min(x) AS x0, max(x + w) AS x1, min(baseline) AS baseline, min(size) AS size, count(*) AS n_runs
        FROM v_segs JOIN v_spaces USING (doc_id, page_no, row_no) GROUP BY 1, 2, 3, 4""",
}


def compose(sql: str) -> str:
    """Prefix ``sql`` with the views it uses, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in needed]
    body = sql.strip()
    recursive = ""
    head = re.match(r"(?is)WITH\s+(RECURSIVE\s+)?", body)
    if head:
        recursive = "RECURSIVE " if head.group(1) else ""
        body = body[head.end():]
        return f"WITH {recursive}{', '.join([*ctes, body])}" if ctes else f"WITH {recursive}{body}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
