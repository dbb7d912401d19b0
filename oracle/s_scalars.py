"""SQL: column functions."""

from corpusloom.functions.faces import MONO_NAMES, SERIF_NAMES
from corpusloom.functions.text import EXTENSIONS, WS_CHARS

WS = f"[{WS_CHARS}]"
HWS = "[" + WS_CHARS.replace(r"\n", "") + "]"
_ROMAN = "[1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1]"
_SIGNS = "['M', 'CM', 'D', 'CD', 'C', 'XC', 'L', 'XL', 'X', 'IX', 'V', 'IV', 'I']"
_DIGIT = {1000: ["", "M", "MM", "MMM"], 100: ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
          10: ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
          1: ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"]}


def roman(n: str) -> str:
    return " || ".join(f"({d!r})[({n} // {p} % 10 + 1)::INT]" for p, d in _DIGIT.items())


def letters(n: str) -> str:
    two = f"CASE WHEN {n} > 26 AND {n} <= 702 THEN chr((97 + ({n} - 27) // 26)::INT) ELSE '' END"
    three = (f"CASE WHEN {n} > 702 THEN chr((97 + ({n} - 703) // 676)::INT) || chr((97 + ({n} - 703) // 26 % 26)::INT) ELSE '' END")
    return f"{three} || {two} || chr((97 + ({n} - 1) % 26)::INT)"


def trim(s: str) -> str:
    return f"regexp_replace({s}, '^{WS}+|{WS}+$', '', 'g')"


def one_line(s: str) -> str:
    return f"({trim(f"regexp_replace({s}, '{WS}+', ' ', 'g')")})[1:200]"


_KB = "CASE WHEN n < 1048576 THEN {kb} || ' KB' ELSE (floor(n / 1048576.0 * 10 + 0.5)::BIGINT // 10) || '.' || (floor(n / 1048576.0 * 10 + 0.5)::BIGINT % 10) || ' MB' END"
_EXT = ", ".join(f"'{k}': '{e}'" for k, e in EXTENSIONS.items())

SQL: dict[str, str] = {
    "f1_clean_html_text": r"SELECT doc_id, regexp_replace(text, '[\x01-\x08\x0b-\x1f\x7f-\x{9f}\x{a0}]', ' ', 'g') AS out FROM v_noisy",
    "f2_collapse_ws": rf"""
        SELECT doc_id, {trim(rf"regexp_replace(regexp_replace(regexp_replace(t, '{HWS}*\n{HWS}*', chr(10), 'g'), '{HWS}+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")} AS out
        FROM (SELECT doc_id, replace(replace(text, ', ', ', ' || chr(9) || '  '), '. ', '. ' || chr(10) || ' ' || chr(10) || chr(10) || '  ' || chr(10)) AS t FROM documents)""",
    "f3_printable": rf"""
        SELECT doc_id, regexp_replace(text, '[\x01-\x08\x0b-\x1f\x7f-\x{{9f}}]', '', 'g') AS dropped,
               {trim(r"regexp_replace(regexp_replace(regexp_replace(g, '[\x01-\x08\x0b-\x1f\x7f-\x{9f}]', '', 'g'), '[\t ]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS tidied
        FROM (SELECT doc_id, text, ' ' || chr(10) || replace(text, '.', '. ' || chr(9) || repeat(chr(10), 4)) AS g FROM v_noisy)""",
    "f4_tidy_line": rf"""
        SELECT doc_id, regexp_replace(regexp_replace(translate(text, ',' || chr(9), '  ') || '   ', '[\x01-\x08\x0a-\x1f\x7f\x{{fffe}}\x{{ffff}}]', '', 'g'), '{WS}+$', '') AS out FROM v_noisy""",
    "f5_xml_safe": r"""
        SELECT page_id, replace(replace(replace(replace(regexp_replace(html, '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}\x{fffe}\x{ffff}]', '', 'g'),
               '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS out FROM pages""",
    "f6_unescape_entities": """
        SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS out FROM pages""",
    "f6_unescape_numeric": "SELECT page_id, title AS out FROM v_titles_raw",
    "f7_strip_soft_hyphen_ws": """
        SELECT doc_id, line_no, len(w)::BIGINT AS n, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = 1 THEN ltrim(y(x, i, len(w))) ELSE y(x, i, len(w)) END), '|') AS out
        FROM (SELECT 1)""",
    "f8_one_line": f"SELECT doc_id, {one_line('text')} AS out FROM documents",
    "f9_clean_title": rf"""
        SELECT page_id, CASE WHEN t <> '' AND NOT regexp_matches(lower(t), '^(untitled|document[0-9]*|no title|slide [0-9]+)$') THEN t
               WHEN {one_line('name')} <> '' THEN {one_line('name')} ELSE 'Untitled' END AS out
        FROM (SELECT page_id, name, {trim(rf"regexp_replace(regexp_replace({one_line('title')}, '^Microsoft (Word|PowerPoint) - ', '', 'i'), '\.(docx?|pptx?|pages|indd|pdf|tex|rtf|odt)$', '', 'i')")} AS t FROM v_titles)""",
    "f10_bcp47": """
        SELECT doc_id, CASE WHEN regexp_full_match(t, '[A-Za-z]{2,3}(-[A-Za-z0-9]{2,8})*') THEN t ELSE 'und' END AS out
        FROM (SELECT doc_id, trim(lang || CASE doc_id % 3 WHEN 0 THEN '-x1' WHEN 1 THEN '_bad' ELSE ' ' END) AS t FROM documents)""",
    "f11_stable_uuid": """
        SELECT doc_id, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-8' || h[14:16] || '-' ||
               (['8','9','a','b','8','9','a','b','8','9','a','b','8','9','a','b'])[instr('0123456789abcdef', h[17])] || h[18:20] || '-' || h[21:32] AS out
        FROM (SELECT doc_id, md5(text) AS h FROM documents)""",
    "f12_slug": """
        SELECT p_partkey, trim(regexp_replace(lower(p_brand || ' / ' || p_name || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS slug,
               lower(p_type) || '-to-' || p_name AS conv, upper(p_type) || ' to ' || upper(p_name) AS title FROM part""",
    "f13_out_name": f"""
        SELECT file_id, regexp_replace(name, '\\.[^.]+$', '') || '.' || coalesce(map_extract(MAP {{{_EXT}}}, d)[1], d) AS out
        FROM (SELECT *, CASE file_id % 3 WHEN 0 THEN 'word' WHEN 1 THEN 'dxf' ELSE 'excel' END AS d FROM v_heads)""",
    "f15_numerals": f"""
        SELECT p_partkey, {roman('n')} AS upper_roman, lower({roman('n')}) AS lower_roman, {letters('n')} AS letters
        FROM (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)""",
    "f16_marker_text": f"""
        SELECT p_partkey, p_brand || ' ' || p_size || '.' AS templated, '(' || {roman('p_size')} || ')' AS affixed FROM part""",
    "f17_resolve_path": """
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'site/' || p WHEN 1 THEN p ELSE raw END AS out
        FROM (SELECT page_id, raw, array_to_string(list_filter(string_split(raw, '/'), lambda s: s <> ''), '/') AS p FROM (
              SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS raw FROM pages))""",
    "f18_human_bytes": f"""
        SELECT o_orderkey, {_KB.format(kb='floor(n / 1024.0 + 0.5)::BIGINT')} AS a, {_KB.format(kb='greatest(1, floor(n / 1024.0 + 0.5)::BIGINT)')} AS b
        FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT * (o_orderkey % 50) AS n FROM orders)""",
    "f19_faces": rf"""
        SELECT p_partkey, face, regexp_matches(face, '(?i)bold|black|heavy|semib|demi|[-_,](6|7|8|9)00\b') AS bold,
               regexp_matches(face, '(?i)italic|oblique') AS italic,
               CASE WHEN face = '' THEN NULL WHEN regexp_matches(lower(face), '{"|".join(MONO_NAMES)}') THEN 'mono'
                    WHEN regexp_matches(lower(face), '{"|".join(SERIF_NAMES)}') THEN 'serif' ELSE 'sans' END AS family,
               regexp_matches(lower(face), 'bold|[-,]bd|black|blk|heavy|demi|semib|medi') AS sel_bold,
               regexp_matches(lower(face), 'times|serif|georgia|garamond|roman|book|minion|cambria|caslon') AND NOT contains(lower(face), 'sans') AS sel_serif,
               regexp_matches(lower(face), 'mono|courier|consol') AS sel_mono
        FROM (SELECT p_partkey, (['Courier New', 'Times-Roman', 'Arial', 'Noto Serif', 'Menlo', 'Segoe UI', ''])[(p_partkey % 7 + 1)::INT]
                     || (['-Bold', '-Italic', '', '-SemiBold', '-700', 'Black', '-Oblique', '-Medium', ',Bd'])[(p_size % 9 + 1)::INT] AS face FROM part)""",
    "f20_rect_of": """
        SELECT rect_id, least(x - 50, 270) AS span_x, least(y, h * 9) AS span_y, abs(320 - x) AS span_w, abs(h * 9 - y) AS span_h,
               greatest(0, least(x - 50, 540)) AS crop_x, greatest(0, least(y - 20, 800)) AS crop_y,
               greatest(20, least(w * 9, 540 - greatest(0, least(x - 50, 540)))) AS crop_w,
               greatest(20, least(h * 20, 800 - greatest(0, least(y - 20, 800)))) AS crop_h FROM v_rects""",
    "f21_units": """
        SELECT p_partkey, p_size / 20 AS twips, CASE WHEN p_size % 5 <> 0 THEN p_size / 2 END AS half, p_partkey * 9525 AS emu,
               floor(p_size * 12 * 0.352778::DOUBLE + 0.5)::BIGINT AS mm FROM part""",
    "f22_affine": """
        SELECT rect_id, w * x - h * 7 + x AS px, h * x + w * 7 + y AS py, w * 2 AS m0, h * 2 AS m1, w - h * 3 AS m2, h + w * 3 AS m3,
               -h * 5 + x AS m4, w * 5 + y AS m5, round(atan2(h, w), 6) AS turn, round(sqrt(abs(w * w + h * h)), 6) AS grow
        FROM (SELECT rect_id, x::DOUBLE AS x, y::DOUBLE AS y, w::DOUBLE AS w, h::DOUBLE AS h FROM v_rects)""",
    "f23_pick_charset": r"""
        SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'utf-8' WHEN 1 THEN CASE WHEN regexp_matches(bare, '[\x{80}-\x{ff}]') THEN 'windows-1252' ELSE 'utf-8' END ELSE 'utf-16le' END AS charset,
               md5(CASE WHEN page_id % 3 = 1 THEN regexp_replace(bare, '[^\x00-\x{ff}]', '?', 'g') ELSE html END) AS digest
        FROM (SELECT page_id, html, replace(html, '<meta charset="utf-8">', '') AS bare FROM pages)""",
    "f24_strip_metadata": "SELECT page_id, '' AS title, '' AS author, '' AS subject, '' AS keywords, '' AS producer, '' AS creator FROM pages",
    "f26_replace_between": """
        SELECT page_id, html[1:(instr(html, '<title') - 1)] || '<title>x</title>' || html[(instr(html, '</title>') + 8):] AS titled,
               CASE WHEN ok THEN html[1:(instr(html, '<footer') - 1)] || 'END' || html[(instr(html, '</html>') + 7):] END AS footed,
               CASE WHEN ok THEN 'ok' ELSE 'error' END AS status
        FROM (SELECT *, instr(html, '<footer') > 0 AND instr(html, '</html>') > 0 AS ok FROM pages)""",
}

_SOFT = "regexp_replace(replace(' ' || replace(x, 'e', 'e' || chr(173)) || '  ', chr(173), ''), '\\s+', ' ', 'g')"
SQL["f7_strip_soft_hyphen_ws"] = f"""
    SELECT doc_id, line_no, len(b)::BIGINT AS n, array_to_string(b, '|') AS out FROM (
      SELECT doc_id, line_no, list_filter(list_transform(a, lambda x, i: CASE WHEN i = 1 AND i = len(a) THEN trim(x) WHEN i = 1 THEN ltrim(x)
             WHEN i = len(a) THEN rtrim(x) ELSE x END), lambda x: x <> '') AS b
      FROM (SELECT doc_id, line_no, list_transform(string_split(line, ' '), lambda x: {_SOFT}) AS a FROM v_lines))"""
