"""SQL: sources, sinks and guards."""

from corpusloom.functions.guards import SCRIPT_BANDS
from corpusloom.operators.routing import ACCEPTS, SUGGESTIONS
from corpusloom.sources.tables import TABLES

_BANDS = "".join(rf"\x{{{lo:x}}}-\x{{{hi:x}}}" for lo, hi, _ in SCRIPT_BANDS)
_BAND_NAME = " ".join(f"WHEN unicode(f) BETWEEN {lo} AND {hi} THEN '{n}'" for lo, hi, n in SCRIPT_BANDS)
_WANTED = ", ".join(f"('{s}', [{', '.join(repr(k) for k in ks)}])" for s, ks in ACCEPTS.items())
_HINTS = ", ".join(f"('{k}', '{h}')" for k, h in SUGGESTIONS.items())

KIND = """CASE WHEN hexed LIKE 'FFD8FF%' THEN 'jpg' WHEN hexed LIKE '89504E47%' THEN 'png' WHEN hexed LIKE '47494638%' THEN 'gif'
  WHEN hexed LIKE '424D%' THEN 'bmp' WHEN hexed LIKE '00000100%' THEN 'ico' WHEN hexed LIKE '2521%' THEN 'eps'
  WHEN hexed LIKE '49492A00%' OR hexed LIKE '4D4D002A%' THEN 'tiff' WHEN hexed LIKE '%3C737667%' THEN 'svg'
  WHEN hexed LIKE '52494646%57454250' THEN 'webp' WHEN hexed LIKE '%6674797061766966' THEN 'avif'
  WHEN hexed LIKE '%6674797068656963' THEN 'heic' WHEN hexed LIKE '25504446%' THEN 'pdf' END"""

SQL: dict[str, str] = {
    "s1_table_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES),
    "s3_read_manifest": """
        SELECT event_id, unnest(json_keys(props)) AS key, json_extract_string(props, '$.' || unnest(json_keys(props)))::BIGINT AS value
        FROM events""",
    "s4_to_lines": """
        SELECT doc_id, line_no, line FROM (
          SELECT *, max(CASE WHEN trim(line) <> '' THEN line_no END) OVER (PARTITION BY doc_id) AS last_full FROM v_lines)
        WHERE line_no <= last_full""",
    "s6_layout_runs": "SELECT * FROM v_runs",
    "s7_scan_fields": """
        SELECT doc, widget_id, name, kind, x, y, w, h, read_only, initial,
               initial <> '' AND (kind IN ('text', 'choice') OR initial <> 'Off') AS seeds FROM (
          SELECT doc, widget_id, name, CASE WHEN field_type = 'Tx' THEN 'text' WHEN field_type = 'Ch' THEN 'choice'
                 WHEN radio_button THEN 'radio' ELSE 'check' END AS kind,
                 least(x0, x1) AS x, least(y0, y1) AS y, abs(x1 - x0) AS w, abs(y1 - y0) AS h, read_only, field_value AS initial
          FROM v_widgets WHERE NOT hidden AND NOT push_button)
        WHERE w >= 3 AND h >= 3 AND NOT (read_only AND initial = '')""",
    "k1_write_chunks": """
        SELECT lang AS bucket, count(*) AS n, sum(length(line))::BIGINT AS chars FROM v_lines JOIN documents USING (doc_id) GROUP BY 1""",
    "k1_bundle": """
        SELECT source, doc_id // 500 AS chunk, count(*) AS n_rows, sum(length(text))::BIGINT AS chars, count(*) AS n, sum(length(text))::BIGINT AS n_chars FROM documents GROUP BY 1, 2""",
    "k2_sitemap": """
        SELECT 'https://example.org/' || route AS loc, '2024-01-01' AS lastmod, coalesce(f, 'monthly') AS changefreq, coalesce(p, '0.8') AS priority
        FROM (SELECT route, f, p FROM (VALUES ('', NULL, '1.0'), ('editor.html', NULL, '0.9'), ('converter.html', 'weekly', '0.9'),
                ('forms.html', 'weekly', '0.9'), ('privacy.html', 'yearly', '0.3'), ('terms.html', 'yearly', '0.3')) t(route, f, p)
              UNION ALL SELECT route, NULL, NULL FROM v_routes)""",
    "k3_qa_jsonld": r"""
        SELECT page_id, CASE WHEN n > 0 THEN 'ok' ELSE 'error' END AS status, n AS n_pairs,
               CASE WHEN n > 0 THEN '{"@context":"https://schema.org","@type":"FAQPage","mainEntity":[' || array_to_string(list_transform(answers,
                 lambda a: '{"@type":"Question","name":' || to_json(q)::VARCHAR || ',"acceptedAnswer":{"@type":"Answer","text":' || to_json(a)::VARCHAR || '}}'), ',') || ']}' END AS jsonld
        FROM (SELECT page_id, len(answers)::BIGINT AS n, answers, trim(regexp_replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1, 's'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS q
          FROM (SELECT page_id, html, list_transform(regexp_extract_all(html, '(?s)<p>(.*?)</p>', 1),
                 lambda a: trim(regexp_replace(regexp_replace(a, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))) AS answers FROM pages))""",
    "k4_refresh_manifest": """
        SELECT n.slug, n.cached, CASE WHEN n.cached AND p.fetched IS NOT NULL THEN p.fetched ELSE '2024-01-01' END AS fetched
        FROM v_manifest_new n LEFT JOIN v_manifest_prev p ON n.slug = p.slug""",
    "k5_rows_to_text": """
        SELECT tbl, row, string_agg(text, chr(9) ORDER BY col) AS text FROM v_cells GROUP BY tbl, row HAVING bool_or(text <> '')""",
    "k6_pending": """
        SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (
          SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1 HAVING count(DISTINCT o_orderpriority) = 5)""",
    "a8_manifest_report": """
        SELECT section, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (
          SELECT 'kept' AS section, bytes FROM v_manifest_new WHERE skip_reason IS NULL
          UNION ALL SELECT 'flatten only', bytes FROM v_manifest_new WHERE skip_reason IS NULL AND NOT writable
          UNION ALL SELECT 'no fields', bytes FROM v_manifest_new WHERE skip_reason IS NULL AND fields = 0
          UNION ALL SELECT 'skipped: ' || skip_reason, bytes FROM v_manifest_new WHERE skip_reason IS NOT NULL) GROUP BY 1""",
    "a8_manifest_sections": """
        SELECT 'kept' AS section, slug FROM v_manifest_new WHERE skip_reason IS NULL
        UNION ALL SELECT 'flatten only', slug FROM v_manifest_new WHERE skip_reason IS NULL AND NOT writable
        UNION ALL SELECT 'no fields', slug FROM v_manifest_new WHERE skip_reason IS NULL AND fields = 0
        UNION ALL SELECT 'skipped: ' || skip_reason, slug FROM v_manifest_new WHERE skip_reason IS NOT NULL""",
    "p1_sniff": f"""
        SELECT file_id, {KIND} AS kind, hexed LIKE '504B0304%' AS zip, hexed LIKE 'D0CF11E0A1B11AE1%' AS ole,
               CASE WHEN hexed LIKE '89504E470D0A1A0A%' THEN 'png' WHEN hexed LIKE 'FFD8FF%' THEN 'jpeg' END AS embeddable FROM v_heads""",
    "p2_route": f"""
        SELECT file_id, src, kind, reason, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'refused' END AS status,
               CASE WHEN kind IS NOT NULL AND reason IS NOT NULL THEN hint END AS suggestion FROM (
          SELECT file_id, src, kind, hint, CASE WHEN kind IS NULL THEN 'unrecognised' WHEN NOT list_contains(w, kind) THEN
                 'wanted ' || CASE WHEN len(w) > 1 THEN upper(array_to_string(w[:-2], ', ')) || ' or ' ELSE '' END || upper(w[-1]) || ', found ' || upper(kind) END AS reason
          FROM (SELECT file_id, claimed AS src, k AS kind, hint, coalesce(wanted, [claimed]) AS w
                FROM (SELECT *, {KIND} AS k FROM v_heads) h
                LEFT JOIN (VALUES {_WANTED}) r(rs, wanted) ON claimed = rs LEFT JOIN (VALUES {_HINTS}) s(hk, hint) ON k = hk))""",
    "p3_looks_binary": r"""
        SELECT doc_id, len(regexp_extract_all(text, '[\x01-\x08\x0b\x0c\x0e-\x1f\x{fffd}]')) > length(text) * 0.05::DOUBLE AS is_binary FROM v_noisy""",
    "p4_script_share": rf"""
        SELECT doc_id, solid AS n_solid, missing AS n_missing, CASE WHEN solid > 0 AND missing * 20 > solid THEN CASE {_BAND_NAME} END END AS script
        FROM (SELECT doc_id, length(regexp_replace(text, '[\x01-\x20]', '', 'g')) AS solid,
                     len(regexp_extract_all(text, '[{_BANDS}]'))::BIGINT AS missing, regexp_extract(text, '[{_BANDS}]') AS f FROM v_scripted)""",
    "p8_require_text": """
        SELECT event_id, value AS text, CASE WHEN trim(value) = '' THEN 'refused' ELSE 'accepted' END AS status,
               CASE WHEN trim(value) = '' THEN 'no text' END AS reason FROM v_field_log""",
    "p9_validate": f"""
        SELECT file_id, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN event_type = 'view' THEN 'flatten' ELSE 'kept' END AS status, reason FROM (
          SELECT *, CASE WHEN event_type = 'signup' THEN 'missing' WHEN kind IS NULL OR kind <> claimed THEN 'not ' || claimed
                 WHEN event_type = 'error' THEN 'neither writable nor readable' WHEN bytes < 1000 THEN 'only ' || bytes || ' bytes' END AS reason
          FROM (SELECT *, {KIND} AS kind FROM v_heads))""",
    "p11_visible": """
        SELECT l_suppkey::VARCHAR AS layer, count(*) AS n, sum(l_quantity) AS qty FROM lineitem
        WHERE l_suppkey = 0 OR l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 2000) GROUP BY 1""",
    "p13_strip_revisions": """
        SELECT event_id, CASE WHEN event_type = 'view' THEN 'h' ELSE 'p' END AS kind FROM events WHERE event_type NOT IN ('error', 'signup')""",
}
