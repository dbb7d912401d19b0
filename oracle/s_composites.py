"""SQL: the multi-step pipelines that can be said in SQL."""

from .s_catalogue import _RANKED
from .s_catalogue import SQL as CATALOGUE
from .s_sources import SQL as SOURCES
from .s_editlog import BOXES, STATE

SQL: dict[str, str] = {
    "c3_ingest": f"""
        SELECT status, coalesce(reason, '') AS reason, CASE WHEN event_type = 'click' AND p.fetched IS NOT NULL THEN p.fetched ELSE '2024-01-01' END AS fetched,
               count(*) AS n, sum(bytes)::BIGINT AS bytes
        FROM ({SOURCES['p9_validate'].replace('SELECT file_id, CASE', 'SELECT file_id, bytes, event_type, CASE')}) f
        LEFT JOIN v_manifest_prev p ON p.slug = file_id GROUP BY 1, 2, 3""",
    "c3_report": f"""
        SELECT section, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (
          SELECT bytes, unnest(list_filter([CASE WHEN reason IS NULL THEN 'kept' ELSE 'skipped: ' || reason END,
                                            CASE WHEN reason IS NULL AND event_type IN ('view', 'error') THEN 'flatten only' END,
                                            CASE WHEN reason IS NULL AND file_id % 6 = 0 THEN 'no fields' END], lambda x: x IS NOT NULL)) AS section
          FROM ({SOURCES['p9_validate'].replace('SELECT file_id, CASE', 'SELECT file_id, bytes, event_type, CASE')})) GROUP BY 1""",
    "c4_publish": f"""
        SELECT r.seq, r.slug, r.category, rank, description, about, who, related FROM ({_RANKED}) r
        JOIN ({CATALOGUE['p12_describe']}) d USING (slug) JOIN ({CATALOGUE['j7_enrich']}) e USING (slug)
        LEFT JOIN (SELECT seq, string_agg(related::VARCHAR, ',' ORDER BY position) AS related FROM ({CATALOGUE['w19_related']}) GROUP BY 1) n ON n.seq = r.seq""",
    "c4_routes": """
        SELECT 'https://example.org/' || route AS loc, '2024-01-01' AS lastmod, coalesce(f, 'monthly') AS changefreq, coalesce(p, '0.8') AS priority
        FROM (SELECT route, f, p FROM (VALUES ('', NULL, '1.0'), ('editor.html', NULL, '0.9'), ('converter.html', 'weekly', '0.9'),
                ('forms.html', 'weekly', '0.9'), ('privacy.html', 'yearly', '0.3'), ('terms.html', 'yearly', '0.3')) t(route, f, p)
              UNION ALL SELECT 'forms/' || slug || '.html', NULL, NULL FROM v_catalogue)""",
    "c6_redacted_release": f"""
        WITH drawn AS (
          SELECT doc_id, page_no, x, w, baseline, size FROM v_runs
          UNION ALL
          SELECT f.doc, 1, x * 10, 60 * length(value), y * 10 + 110, 110 FROM ({BOXES}) f JOIN ({STATE}) s ON f.doc = s.doc AND f.name = s.name
          WHERE value <> '' AND f.doc IN (SELECT doc_id FROM documents)),
        kept AS (SELECT * FROM (
          SELECT r.*, b.doc_id IS NOT NULL AS flattened,
                 b.doc_id IS NOT NULL AND r.x < b.x + b.w AND r.x + r.w > b.x AND baseline - size < b.y + b.h AND baseline > b.y AS gone
          FROM drawn r LEFT JOIN v_boxes b ON r.doc_id = b.doc_id AND r.page_no = b.page_no) WHERE NOT gone),
        leaked AS (SELECT k.doc_id, count(*) AS n FROM kept k JOIN v_boxes b ON k.doc_id = b.doc_id AND k.page_no = b.page_no
          WHERE least(k.x + k.w, b.x + b.w) > greatest(k.x, b.x) AND least(k.baseline, b.y + b.h) > greatest(k.baseline - k.size, b.y) GROUP BY 1)
        SELECT doc_id, count(*) AS n_runs, count(DISTINCT CASE WHEN flattened THEN page_no END) AS n_flattened, coalesce(any_value(n), 0) AS n_leaks, '' AS title
        FROM kept LEFT JOIN leaked USING (doc_id) GROUP BY 1""",
}
