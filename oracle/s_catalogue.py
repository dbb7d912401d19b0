"""SQL: catalogue, facets, audits, set operations."""

_RANKED = "SELECT c.*, coalesce(p.rank, (SELECT count(*) FROM v_popular)) AS rank FROM v_catalogue c LEFT JOIN v_popular p USING (seq)"
_DEFS = "SELECT DISTINCT owner, key, CASE WHEN grp = 0 THEN 1 END AS grp FROM v_defs"

SQL: dict[str, str] = {
    "p5_search_catalogue": """
        SELECT slug, code FROM v_catalogue WHERE category = 'SMALL' AND (contains(lower(code || ' ' || name), 'brand#1') OR contains(lower(tag1 || ' ' || name), 'brand#1'))""",
    "p5_search_count": """
        SELECT n, n || CASE WHEN n = 1 THEN ' form' ELSE ' forms' END AS label, n = 0 AS empty, term FROM (
          SELECT count(*) AS n, 'ring' AS term FROM v_catalogue WHERE contains(lower(code || ' ' || name || ' ' || tag1), 'ring')
          UNION ALL SELECT count(*), 'none' FROM v_catalogue WHERE contains(lower(name), 'no such thing'))""",
    "p6_search_edges": """
        SELECT src, dst, 'brand2 to' AS term, 'img' AS tab FROM v_edges WHERE contains(src || ' to ' || dst, 'brand2 to')
        UNION ALL SELECT src, dst, '', 'pop' FROM v_edges WHERE pop UNION ALL SELECT src, dst, '', 'from' FROM v_edges WHERE cat = 'from'""",
    "p12_describe": """
        SELECT slug, name || ' (' || code || ')' || CASE WHEN pages > 0 THEN ' ' || chr(183) || ' ' || pages || ' page' || CASE WHEN pages = 1 THEN '' ELSE 's' END ELSE '' END
               || CASE WHEN fields > 0 THEN ' ' || chr(183) || ' ' || fields || ' fillable field' || CASE WHEN fields = 1 THEN '' ELSE 's' END ELSE '' END AS description FROM v_catalogue""",
    "j7_enrich": """
        SELECT c.slug, c.category, coalesce(n.about, what) AS about, coalesce(n.who, guide_who) AS who FROM v_catalogue c LEFT JOIN v_notes n USING (slug)
        LEFT JOIN (SELECT p_type AS category, 'General ' || lower(p_type) AS what, 'Anyone, ' || max(p_brand) AS guide_who FROM part GROUP BY p_type) g ON c.category = g.category""",
    "j8_coverage": "SELECT src, dst, cat, CASE WHEN live THEN 'live' ELSE 'not built' END AS status FROM v_edges",
    "a12_status_by_category": "SELECT live, cat, count(*) AS n, count(*) FILTER (pop) AS n_popular FROM v_edges GROUP BY 1, 2",
    "a12_category_members": "SELECT live, cat, src || '-to-' || dst AS member FROM v_edges",
    "a6_skipped_report": """
        SELECT p_brand AS type, count(*) AS n FROM part WHERE p_brand NOT IN ('Brand#1', 'Brand#5', 'Brand#9') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""",
    "u1_all_items": """
        SELECT slug, code, name, category, seq, 0::BIGINT AS source_no FROM v_catalogue
        UNION ALL SELECT replace(lower(s_name), '#', '-'), 'S' || s_suppkey, s_name, 'N' || s_nationkey, s_suppkey, 1 FROM supplier""",
    "u2_missing": "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49",
    "u3_shared_keys": "SELECT key FROM v_defs WHERE grp = 0 INTERSECT SELECT key FROM v_defs WHERE grp = 1",
    "u4_upsert_registry": """
        SELECT face, 'c' || event_id AS css_key, CASE WHEN event_type = 'click' THEN event_id END AS bytes FROM (
          SELECT *, 'face' || (k % 40) AS face, row_number() OVER (PARTITION BY k % 40 ORDER BY (event_type = 'click') DESC, ts DESC, event_id DESC) AS rn FROM v_events) WHERE rn = 1""",
    "o4_top_k": """
        SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) WHERE position <= 3""",
    "o5_faces": "SELECT DISTINCT replace(p_brand, '#', '-') || '-' || p_type AS face FROM part",
    "w18_ranked": f"SELECT slug, seq, rank FROM ({_RANKED})",
    "w18_featured": f"SELECT slug, rank FROM ({_RANKED}) ORDER BY rank, seq LIMIT 3",
    "w19_related": f"""
        SELECT seq, related, position FROM (
          SELECT a.seq, b.seq AS related, row_number() OVER (PARTITION BY a.seq ORDER BY b.rank, b.seq) AS position
          FROM ({_RANKED}) a JOIN ({_RANKED}) b ON a.category = b.category AND a.seq <> b.seq) WHERE position <= 6""",
    "w20_related_edges": """
        SELECT seq, related, position FROM (
          SELECT a.seq, b.seq AS related, row_number() OVER (PARTITION BY a.seq ORDER BY a.cat <> b.cat, b.seq) AS position
          FROM v_edges a JOIN v_edges b ON a.seq <> b.seq AND (a.cat = b.cat OR b.pop)) WHERE position <= 11""",
    "j11_collisions": f"""
        SELECT key, count(DISTINCT o) AS n_owners, max(n_clashes)::BIGINT AS n_clashes, min(o) AS first_owner, max(o) AS last_owner FROM (
          SELECT key, unnest([a_owner, b_owner]) AS o, count(*) OVER (PARTITION BY key) AS n_clashes FROM (
            SELECT a.key, a.owner AS a_owner, b.owner AS b_owner FROM ({_DEFS}) a JOIN ({_DEFS}) b ON a.key = b.key AND a.owner < b.owner
            WHERE NOT (a.grp IS NOT NULL AND b.grp IS NOT NULL AND a.grp = b.grp))) GROUP BY 1""",
    "j11_bare_keys": f"SELECT DISTINCT owner, key FROM ({_DEFS}) WHERE grp IS NULL AND NOT regexp_matches(key, '^[a-m#]')",
}
SQL["j11_collisions"] = f"""
    SELECT k.key, n_owners, n_clashes, first_owner, last_owner FROM (
      SELECT a.key, count(*) AS n_clashes FROM ({_DEFS}) a JOIN ({_DEFS}) b ON a.key = b.key AND a.owner < b.owner
      WHERE NOT coalesce(a.grp = b.grp, false) GROUP BY 1) k
    JOIN (SELECT key, count(DISTINCT owner) AS n_owners, min(owner) AS first_owner, max(owner) AS last_owner FROM v_defs GROUP BY 1) USING (key)"""
