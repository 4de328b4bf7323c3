"""The registered queries as SQL for the checking engine, over the given tables."""

from __future__ import annotations

import re

from filingdelta.plans.registry import EXPECTED_SECTIONS, NOW, THRESHOLD, UPLOAD_LIMIT_MB, WARNING_LEVELS
from filingdelta.plans.tables import GIVEN, LANGUAGE_KEYWORDS, PAGE_LINES, SHARED

_WORDS = ", ".join(
    f"('{kind}', {i}, '{word}')"
    for kind, words in LANGUAGE_KEYWORDS.items()
    for i, word in enumerate(words)
)
_LABEL = "CASE {0} WHEN 'de' THEN 'German' WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'unknown' THEN '未判定' ELSE {0} END"
_NUMBER = "-?[0-9]+(\\.[0-9]+)?"
_TYPED = "COALESCE(NULLIF(COALESCE(NULLIF(manual_type, ''), detected_type), '') <> 'unknown', FALSE)"

# Named steps; a statement pulls in the ones it mentions.
STEPS = {
    name: sql.format(
        first_line="split_part(text, chr(10), 1)", **{g: g for g in GIVEN}
    )
    for name, sql in SHARED.items()
}
STEPS |= {
    "lexicon": f"SELECT * FROM (VALUES {_WORDS}) v(kind, ordinal, word)",
    "totals": "SELECT kind, count(*) AS total FROM lexicon GROUP BY kind",
    "doc_lines": "SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents",
    "doc_pages": f"""
SELECT doc_id AS document_id, CAST(i + 1 AS INTEGER) AS page_number,
  array_to_string(ls[i * {PAGE_LINES} + 1 : i * {PAGE_LINES} + {PAGE_LINES}], chr(10)) AS text
FROM (SELECT doc_id, ls, unnest(range(CAST((len(ls) + {PAGE_LINES - 1}) // {PAGE_LINES} AS BIGINT))) AS i FROM doc_lines)""",
    "page_totals": "SELECT document_id, CAST(max(page_number) AS INTEGER) AS n FROM doc_pages GROUP BY document_id",
    "windows": """
SELECT document_id, CAST(k AS INTEGER) AS batch_index, CAST(1 + 9 * k AS INTEGER) AS batch_start,
  CAST(least(10 + 9 * k, n) AS INTEGER) AS batch_end
FROM (SELECT document_id, n, unnest(range(CAST(greatest(1, (n + 7) // 9) AS BIGINT))) AS k FROM page_totals)""",
    "page_windows": """
SELECT p.document_id, p.page_number, w.batch_index, w.batch_start, w.batch_end
FROM doc_pages p JOIN windows w ON p.document_id = w.document_id AND p.page_number BETWEEN w.batch_start AND w.batch_end""",
    "candidates": """
SELECT document_id, batch_index, CAST(floor((page_number - 1) / 2) AS INT) AS ordinal,
  'S' || CAST(CAST(floor((page_number - 1) / 8) AS INT) AS STRING)
    || ' - T' || CAST(CAST(floor((page_number - 1) / 4) AS INT) AS STRING)
    || ' - U' || CAST(CAST(floor((page_number - 1) / 2) AS INT) AS STRING) AS section_name,
  min(page_number) AS start_page, max(page_number) AS end_page,
  CAST(10 - (max(document_id) + max(batch_index)) % 5 AS DOUBLE) / 10 AS confidence,
  max(page_number) = max(batch_end) AS is_continuing
FROM page_windows
GROUP BY document_id, batch_index, floor((page_number - 1) / 8), floor((page_number - 1) / 4),
  floor((page_number - 1) / 2)
UNION ALL
SELECT document_id, batch_index, -1 AS ordinal,
  'S' || CAST(CAST(floor((batch_start - 1) / 8) AS INT) AS STRING) AS section_name,
  batch_start AS start_page, CAST(batch_start + 2 AS INT) AS end_page,
  CAST(0.5 AS DOUBLE) AS confidence, FALSE AS is_continuing
FROM page_windows WHERE page_number = batch_start
UNION ALL
SELECT document_id, batch_index, -2 AS ordinal, 'Appendix' AS section_name,
  batch_end AS start_page, batch_end AS end_page, CAST(NULL AS DOUBLE) AS confidence, TRUE AS is_continuing
FROM page_windows WHERE page_number = batch_end""",
    "merged": """
SELECT document_id, section_name, min(start_page) AS start_page, max(end_page) AS end_page,
  arg_min(COALESCE(confidence, 0.0), batch_index * 100000 + ordinal) AS confidence,
  arg_max(is_continuing, batch_index * 100000 + ordinal) AS is_continuing
FROM candidates GROUP BY document_id, section_name""",
    "merged_pages": """
SELECT document_id, section_name, CAST(unnest(range(start_page, end_page + 1)) AS INTEGER) AS page_number FROM merged""",
    "char_counts": """
SELECT m.document_id, m.section_name, CAST(COALESCE(sum(length(p.text)), 0) AS BIGINT) AS char_count
FROM merged_pages m LEFT JOIN doc_pages p ON m.document_id = p.document_id AND m.page_number = p.page_number
GROUP BY m.document_id, m.section_name""",
    "content_sections": "SELECT m.*, char_count, char_count >= 300 AS has_content FROM merged m JOIN char_counts USING (document_id, section_name)",
    "above": """
SELECT document_id, section_name AS child, confidence, array_to_string(parts[1:i], ' - ') AS section_name
FROM (SELECT *, unnest(range(1, len(parts))) AS i
      FROM (SELECT *, string_split(section_name, ' - ') AS parts FROM merged))""",
    "below_pages": """
SELECT DISTINCT a.document_id, a.section_name, p.page_number FROM above a
JOIN merged_pages p ON a.document_id = p.document_id AND a.child = p.section_name""",
    "exclusive": """
SELECT m.document_id, m.section_name, m.page_number FROM merged_pages m
ANTI JOIN below_pages b ON m.document_id = b.document_id AND m.section_name = b.section_name AND m.page_number = b.page_number""",
    "page_grids": "SELECT document_id, page_number, page_number % 3 AS table_index, string_split(text, chr(10)) AS ls FROM doc_pages",
    "section_grids": """
SELECT m.document_id, m.section_name, g.page_number, g.table_index, g.ls FROM merged_pages m
JOIN page_grids g ON m.document_id = g.document_id AND m.page_number = g.page_number""",
    "upload_sizes": "SELECT *, CAST(strlen(body) AS BIGINT) AS size_bytes, COALESCE(contains(NULLIF(lower(content_type), ''), 'pdf'), TRUE) AND starts_with(body, '%PDF') AS is_pdf FROM uploads",
    "upload_checks": f"""
SELECT *, array_to_string(list_filter([
    CASE WHEN size_bytes = 0 THEN 'The file is empty.' END,
    CASE WHEN size_bytes > {UPLOAD_LIMIT_MB} * 1048576
         THEN 'File size ' || printf('%.2f', size_bytes / CAST(1048576 AS DOUBLE)) || 'MB exceeds the limit of {UPLOAD_LIMIT_MB}MB.' END,
    CASE WHEN NOT is_pdf THEN 'Only valid PDF documents can be uploaded.' END], lambda e: e IS NOT NULL), '|') AS errors
FROM upload_sizes""",
    "catalogue": """
SELECT detected_type AS document_type, max(detected_type_label) AS display_name FROM metadata
WHERE detected_type NOT IN ('', 'unknown') GROUP BY detected_type""",
    "samples": """
SELECT d.doc_id AS document_id, d.source || '.pdf' AS filename, s.text_sample
FROM documents d LEFT JOIN (
  SELECT document_id, substr(string_agg(text, chr(10) ORDER BY page_number), 1, 64000) AS text_sample
  FROM doc_pages WHERE page_number <= 5 AND text <> '' GROUP BY document_id) s ON d.doc_id = s.document_id""",
    "grids": """
SELECT l_orderkey AS document_id, count(*) AS n,
  string_agg('item ' || CAST(l_linenumber AS VARCHAR) || '|' || l_returnflag || '|' ||
    CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END || '|' || l_linestatus, chr(10)
    ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) AS body,
  arg_min(CASE WHEN l_linestatus = 'F' THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) ELSE '' END,
    row(l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus)) AS first_quantity,
  arg_min(l_linestatus, row(l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus)) AS first_status,
  count(*) FILTER (l_linestatus = 'F') AS n_numbers
FROM lineitem GROUP BY l_orderkey""",
    "paths": """
SELECT document_type, node_id, name AS path, 1 AS depth, required FROM nodes WHERE parent_id IS NULL
UNION ALL SELECT n.document_type, n.node_id, r.name || ' - ' || n.name, 2, n.required
FROM nodes n JOIN nodes r ON n.parent_id = r.node_id WHERE r.parent_id IS NULL AND n.name IS NOT NULL
UNION ALL SELECT c.document_type, c.node_id, r.name || ' - ' || n.name || ' - ' || c.name, 3, c.required
FROM nodes c JOIN nodes n ON c.parent_id = n.node_id JOIN nodes r ON n.parent_id = r.node_id WHERE n.name IS NOT NULL""",
    "replies": """
SELECT document_id, section_name, CASE WHEN json_valid(reply_json) THEN reply_json END AS reply_json,
  length(reply_json) AS n FROM content_replies""",
    "folded": """
SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(company_name, '\\([^)]*\\)', '', 'g'),
  'Corporation|Corp\\.|Inc\\.|Ltd\\.|Limited|Holdings|holding', '', 'gi'), '[\\s\\-\\.,]', '', 'g'))) AS norm
FROM filings""",
    "company_folds": """
SELECT *, lower(trim(regexp_replace(regexp_replace(regexp_replace(name, '\\([^)]*\\)', '', 'g'),
  'Corporation|Corp\\.|Inc\\.|Ltd\\.|Limited|Holdings|holding', '', 'gi'), '[\\s\\-\\.,]', '', 'g'))) AS company
FROM company_names""",
    "company_sizes": "SELECT company, count(*) AS n FROM company_folds GROUP BY company",
    "company_links": """
SELECT s.company AS short, l.company AS long, s.n AS n_short, l.n AS n_long FROM company_sizes s
JOIN company_sizes l ON length(s.company) < length(l.company) AND contains(l.company, s.company)""",
    "catalogue_keywords": """
SELECT item_id, ordinal - 1 AS ordinal, lower(word) AS word FROM (
  SELECT item_id, unnest(words) AS word, generate_subscripts(words, 1) AS ordinal
  FROM (SELECT item_id, regexp_split_to_array(text, '\\.\\s*') AS words FROM catalogue_words))""",
    "catalogue_totals": "SELECT item_id, count(*) AS total FROM catalogue_keywords GROUP BY item_id",
    "catalogue_best": """
SELECT doc_id, item_id, m FROM (
  SELECT d.doc_id, k.item_id, count(*) AS m, row_number() OVER (PARTITION BY d.doc_id ORDER BY count(*) DESC, k.item_id) AS rn
  FROM documents d JOIN catalogue_keywords k ON k.word <> '' AND contains(lower(d.source || ' ' || d.text), k.word) GROUP BY d.doc_id, k.item_id)
WHERE rn = 1""",
    "family_sections": """
SELECT * EXCLUDE (n) FROM (
  SELECT CAST(d.doc_id // 4 AS BIGINT) AS comparison_id, CAST(d.doc_id % 4 AS INTEGER) AS position, d.doc_id AS document_id, d.lang, s.section_name,
    count(*) OVER (PARTITION BY d.doc_id // 4, d.lang, s.section_name) AS n
  FROM documents d JOIN content_sections s ON s.document_id = d.doc_id AND s.has_content) WHERE n > 1""",
    "mode_groups": """
SELECT comparison_id, count(*) AS n, arg_min(f, position) AS a, arg_max(f, position) AS b
FROM requests r JOIN folded f ON r.document_id = f.document_id GROUP BY comparison_id""",
    "modes": """
SELECT comparison_id, n,
  COALESCE(trim(a.company_name) = trim(b.company_name), FALSE)
    OR COALESCE(length(a.norm) >= 3 AND length(b.norm) >= 3 AND (contains(a.norm, b.norm) OR contains(b.norm, a.norm)), FALSE) AS company,
  COALESCE(a.document_type = b.document_type, FALSE) AS kind, COALESCE(a.fiscal_year = b.fiscal_year, FALSE) AS same_year
FROM mode_groups""",
    "common": """
SELECT p.pair_id, a.section_name, a.has_content AND b.has_content AS has_both,
  CAST(a.start_page AS VARCHAR) || '-' || CAST(a.end_page AS VARCHAR) AS r1,
  CAST(b.start_page AS VARCHAR) || '-' || CAST(b.end_page AS VARCHAR) AS r2
FROM copy_pairs p JOIN content_sections a ON p.doc1_id = a.document_id
JOIN content_sections b ON p.doc2_id = b.document_id AND a.section_name = b.section_name""",
    "exact_mappings": "SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY section_name) AS mapping_index FROM common WHERE has_both",
    "vectors": "SELECT CAST(label AS BIGINT) AS document_id, vec_id AS ordinal, 'sec-' || CAST(vec_id AS VARCHAR) AS section_name, CAST(embedding AS DOUBLE[]) AS v FROM embeddings",
    "nearest": f"""
SELECT pair_id, doc1_section, doc2_section, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY doc1_section ORDER BY sim DESC, o2) AS rn FROM (
    SELECT CAST(a.document_id AS VARCHAR) AS pair_id, a.document_id AS doc1_id, a.section_name AS doc1_section, b.section_name AS doc2_section,
      b.ordinal AS o2, list_cosine_similarity(a.v, b.v) AS sim
    FROM vectors a JOIN vectors b ON b.document_id = a.document_id + 1)
  WHERE sim > {THRESHOLD}) WHERE rn = 1""",
    "cell_text": "SELECT *, trim(replace(text, ',', '')) AS clean FROM cells",
    "cell_number": f"SELECT *, NULLIF(regexp_extract(clean, '{_NUMBER}', 0), '') AS num FROM cell_text",
    "cell_value": """
SELECT *, TRY_CAST(num AS DOUBLE) AS value,
  NULLIF(trim(substr(clean, CAST(instr(clean, num) + length(num) AS BIGINT))), '') AS unit FROM cell_number""",
    "cell_base": """
SELECT *, CASE WHEN contains(unit, '千') THEN value * 1000 WHEN contains(unit, '百万') THEN value * 1000000
    WHEN contains(unit, '十億') THEN value * 1000000000 ELSE value END AS base,
  CASE WHEN unit IS NULL OR contains(unit, '千') OR contains(unit, '百万') OR contains(unit, '十億') THEN '円' ELSE unit END AS base_unit
FROM cell_value""",
    "cell_diffs": """
SELECT p.pair_id, a.table_id, b.table_id AS table2, a."row", a."col", a.item_name, a.value AS value1, b.value AS value2,
  a.base - b.base AS difference, CASE WHEN a.base <> 0 THEN (a.base - b.base) / abs(a.base) * 100 END AS difference_pct,
  a.unit AS unit1, b.unit AS unit2, a.base_unit AS normalized_unit
FROM month_pairs p JOIN cell_base a ON p.doc1_id = a.document_id AND a."col" >= 1
JOIN cell_base b ON p.doc2_id = b.document_id AND a."row" = b."row" AND a."col" = b."col"
WHERE a.value IS NOT NULL AND b.value IS NOT NULL
  AND NOT CASE WHEN a.base = 0 AND b.base = 0 THEN TRUE WHEN a.base = 0 OR b.base = 0 THEN FALSE
    ELSE abs(a.base - b.base) / greatest(abs(a.base), abs(b.base)) * 100 <= 0.01 END""",
    "text_pairs": """
SELECT pair_id, a.text AS text1, b.text AS text2 FROM copy_pairs p
JOIN documents a ON p.doc1_id = a.doc_id JOIN documents b ON p.doc2_id = b.doc_id
UNION ALL SELECT pair_id, text1, text2 FROM turn_pairs""",
    "line_counts": """
SELECT pair_id, line, sum(one) AS n1, sum(two) AS n2 FROM (
  SELECT pair_id, unnest(string_split(text1, chr(10))) AS line, 1 AS one, 0 AS two FROM text_pairs WHERE text1 <> '' AND text2 <> ''
  UNION ALL
  SELECT pair_id, unnest(string_split(text2, chr(10))), 0, 1 FROM text_pairs WHERE text1 <> '' AND text2 <> ''
) GROUP BY pair_id, line""",
    "first_kpis": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, indicator ORDER BY pos) AS rn FROM kpis) WHERE rn = 1""",
    "keyed_relations": """
SELECT *, CASE WHEN relationship_type IN ('causality', 'condition_consequence', 'problem_solution', 'premise_conclusion')
    THEN relationship_type || ':' || COALESCE(a, '') || ':' || COALESCE(b, '')
    ELSE COALESCE(relationship_type, '') || ':' || substr(original_text, 1, 100) END AS relation_key
FROM relations""",
    "last_relations": """
SELECT document_id, section_name, relation_key, original_text FROM (
  SELECT *, row_number() OVER (PARTITION BY document_id, section_name, relation_key
    ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, cents DESC) AS rn FROM keyed_relations) WHERE rn = 1""",
    "read_replies": """
SELECT comparison_id, mapping_index, mode, reply_json AS raw,
  CASE WHEN json_valid(reply_json) AND reply_json <> 'null' THEN reply_json END AS j FROM review_replies""",
    "read_reviews": """
SELECT *, CASE WHEN j IS NULL THEN 0 WHEN mode = 'consistency_check' THEN COALESCE(json_array_length(j, '$.contradictions'), 0)
    ELSE COALESCE(json_array_length(j, '$.text_changes.contradictions'), 0) END AS n_contra,
  COALESCE(json_extract_string(j, '$.importance'), 'medium') AS imp,
  COALESCE(json_extract_string(j, '$.importance_reason'), '') AS why,
  CASE WHEN j IS NULL THEN 0 WHEN mode = 'consistency_check' THEN 5
    ELSE len(json_keys(j, '$.text_changes')) END AS n_text_changes,
  COALESCE(json_extract_string(j, '$.additional_search.needed') = 'true', FALSE) AS search_needed,
  COALESCE(json_array_length(j, '$.additional_search.search_phrases'), 0) AS n_phrases
FROM read_replies""",
    "related_pairs": """
SELECT a.section_name AS query_id, b.section_name, b.ordinal, a.v[1] AS head, list_cosine_similarity(a.v, b.v) AS sim,
  list_cosine_similarity(list_transform(a.v, lambda x: -x), b.v) AS opposite
FROM vectors a JOIN vectors b ON a.document_id = b.document_id AND a.section_name <> b.section_name""",
    "related_hits": """
SELECT query_id, 1 AS iteration, rank, section_name, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, ordinal) AS rank FROM related_pairs) WHERE rank <= 3""",
    "second_hits": """
SELECT query_id, 2 AS iteration, rank, section_name, opposite AS sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY opposite DESC, ordinal) AS rank FROM (
    SELECT * FROM related_pairs p ANTI JOIN related_hits h ON p.query_id = h.query_id AND p.section_name = h.section_name)
  WHERE head > 0) WHERE rank <= 3""",
    "ordered_reviews": """
SELECT *, COALESCE(TRY_CAST(NULLIF(regexp_extract(doc1_page_range, '^([0-9]+)', 1), '') AS INTEGER), 0) AS doc1_start,
  COALESCE(TRY_CAST(NULLIF(regexp_extract(doc2_page_range, '^([0-9]+)', 1), '') AS INTEGER), 0) AS doc2_start,
  COALESCE(NULLIF(doc1_section_name, ''), section_name) AS doc1_key FROM reviews""",
    "outcomes": f"""
SELECT document_id, CASE WHEN NOT {_TYPED} THEN 'skipped' WHEN size_bytes > 1000 THEN 'completed' ELSE 'failed' END AS outcome,
  CASE WHEN NOT {_TYPED} THEN 'unknown_type' END AS reason FROM metadata""",
    "times": "SELECT *, CAST(replace(replace(created_at, 'Z', ''), '+00:00', '') AS TIMESTAMP) AS created FROM metadata",
}


def _review(search: bool) -> str:
    forced = "n_contra > 0"
    note = "'矛盾が' || CAST(n_contra AS VARCHAR) || '件検出されました'"
    imp = "imp" if search else f"CASE WHEN {forced} THEN 'high' ELSE imp END"
    why = "why" if search else f"CASE WHEN {forced} AND why = '' THEN {note} WHEN {forced} THEN {note} || '。' || why ELSE why END"
    bad_why, bad_sum = "'分析失敗'", "'分析に失敗しました'"
    if search:
        bad_why = "CASE raw WHEN '' THEN 'LLMレスポンスが空' WHEN 'null' THEN 'LLMレスポンスがnull' ELSE '分析失敗' END"
        bad_sum = ("CASE raw WHEN '' THEN '分析結果が取得できませんでした（空のレスポンス）' "
                   "WHEN 'null' THEN '分析結果が取得できませんでした' ELSE '分析に失敗しました' END")
    return f"""
SELECT comparison_id, mapping_index, CASE WHEN j IS NULL THEN 'low' ELSE {imp} END AS importance,
  CASE WHEN j IS NULL THEN {bad_why} ELSE {why} END AS importance_reason,
  CASE WHEN j IS NULL THEN {bad_sum} ELSE COALESCE(json_extract_string(j, '$.summary'), '') END AS summary,
  CAST(n_contra AS INTEGER) AS contradiction_count, CAST(n_text_changes AS INTEGER) AS n_text_changes,
  CAST(COALESCE(json_array_length(j, '$.numerical_changes'), 0) AS INTEGER) AS n_numerical,
  json_extract_string(j, '$.tone_analysis.tone1') AS tone1, search_needed, CAST(n_phrases AS INTEGER) AS n_phrases
FROM read_reviews"""


def _classified(source: str, key: str) -> str:
    """Winner per row of ``source`` (key, hay)."""
    return f"""
SELECT {key}, kind, least(1.0, CAST(m AS DOUBLE) / total) AS share, words FROM (
  SELECT s.{key}, l.kind, count(*) AS m, string_agg(word, ',' ORDER BY ordinal) AS words,
    row_number() OVER (PARTITION BY s.{key} ORDER BY count(*) DESC, l.kind) AS rn
  FROM {source} s JOIN lexicon l ON contains(s.hay, l.word) GROUP BY s.{key}, l.kind) w
JOIN totals USING (kind) WHERE rn = 1"""


STEPS |= {
    "sample_text": "SELECT document_id, lower(filename || ' ' || COALESCE(text_sample, '')) AS hay FROM samples",
    "sample_best": _classified("sample_text", "document_id"),
    "reply_text": "SELECT doc_id, lower(filename || ' ' || text_sample) AS hay FROM type_replies",
    "reply_best": _classified("reply_text", "doc_id"),
    "reply_parts": """
SELECT doc_id, CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.document_type') = 'VARCHAR'
      AND json_extract_string(j, '$.document_type') IN ('de', 'en', 'es', 'fr', 'none', 'unknown')
    THEN json_extract_string(j, '$.document_type') END AS reply_type,
  CASE json_type(j, '$.confidence') WHEN 'DOUBLE' THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE)
    WHEN 'UBIGINT' THEN CAST(json_extract_string(j, '$.confidence') AS DOUBLE)
    WHEN 'BOOLEAN' THEN CASE json_extract_string(j, '$.confidence') WHEN 'true' THEN 1.0 ELSE 0.0 END
    ELSE 0.5 END AS confidence,
  CASE WHEN json_type(j, '$.reason') = 'VARCHAR' THEN json_extract_string(j, '$.reason') END AS reason
FROM (SELECT doc_id, CASE WHEN json_valid(reply_json) THEN reply_json END AS j FROM type_replies)""",
    "reply_words": """
SELECT t.doc_id, string_agg(word, ',' ORDER BY ordinal) AS words FROM reply_text t JOIN reply_parts p USING (doc_id)
JOIN lexicon l ON l.kind = p.reply_type AND contains(t.hay, l.word) GROUP BY t.doc_id""",
    "typed_replies": """
SELECT p.doc_id, reply_type, CASE WHEN reply_type IS NOT NULL THEN round(greatest(0.0, least(confidence, 1.0)), 2) END AS reply_confidence,
  CASE WHEN reply_type IS NOT NULL THEN reason END AS reply_reason,
  CASE WHEN reply_type IS NOT NULL THEN COALESCE(words, '') END AS reply_keywords
FROM reply_parts p LEFT JOIN reply_words w ON p.doc_id = w.doc_id""",
    "upload_text": "SELECT batch_id || '/' || filename AS id, lower(filename || ' ' || body) AS hay FROM upload_checks WHERE errors = ''",
    "upload_best": _classified("upload_text", "id"),
}



def _lacking(own: int, other: int) -> str:
    """Numbers of one side of the month pairs that the other side's table has nowhere."""
    return f"""
SELECT p.pair_id, a.table_id, a."row", a."col", a.item_name, a.value, a.base_unit AS unit, {other} AS missing_in
FROM month_pairs p JOIN cell_base a ON p.doc{own}_id = a.document_id AND a."col" >= 1 AND a.value IS NOT NULL
WHERE NOT EXISTS (SELECT 1 FROM cell_base b WHERE b.document_id = p.doc{other}_id AND b.table_id = a.table_id AND b."col" >= 1 AND b.value IS NOT NULL
  AND b.base_unit = a.base_unit AND CASE WHEN a.base = 0 AND b.base = 0 THEN TRUE WHEN a.base = 0 OR b.base = 0 THEN FALSE
    ELSE abs(a.base - b.base) / greatest(abs(a.base), abs(b.base)) * 100 <= 0.01 END)"""


_PRICE2 = "l_extendedprice * (1 - l_discount / CAST(500 AS DOUBLE))"

ORACLE = {
    "a1_template_catalog": """
SELECT document_type, kind, CAST(ordinal AS INTEGER) AS ordinal, node_id, parent_id, name, required FROM (
  SELECT 'part' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS document_type, unnest([
    {'kind': 'type', 'ordinal': NULL, 'node_id': NULL, 'parent_id': NULL, 'name': p_name, 'required': NULL},
    {'kind': 'keyword', 'ordinal': 0, 'node_id': NULL, 'parent_id': NULL, 'name': lower(split_part(p_name, ' ', 1)), 'required': NULL},
    {'kind': 'keyword', 'ordinal': 1, 'node_id': NULL, 'parent_id': NULL, 'name': lower(split_part(p_name, ' ', 2)), 'required': NULL},
    {'kind': 'node', 'ordinal': 0, 'node_id': '0000', 'parent_id': NULL, 'name': p_brand, 'required': TRUE},
    {'kind': 'node', 'ordinal': 1, 'node_id': '0000.0001', 'parent_id': '0000', 'name': 'size ' || CAST(p_size AS VARCHAR), 'required': FALSE}
  ], recursive := true) FROM part)""",
    "a3_read_metadata": "SELECT document_id, filename, size_bytes, created_at, detected_type FROM metadata WHERE NOT ends_with(created_at, '+00:00')",
    "a4_save_structured": f"""
SELECT m.document_id, CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || CAST(l.quality AS VARCHAR) END AS structured_data,
  CASE WHEN l.toxic = 1 THEN 'vision' WHEN l.toxic = 0 THEN 'text' END AS extraction_method,
  CASE WHEN l.quality = 1 THEN 1 WHEN l.doc_id IS NOT NULL THEN 0 END AS n_metadata,
  CASE WHEN l.doc_id IS NOT NULL THEN '{NOW}Z' ELSE m.created_at END AS updated_at
FROM metadata m LEFT JOIN labels l ON m.document_id = CAST(l.doc_id AS VARCHAR)""",
    "a4_structured_store": f"""
SELECT m.document_id, m.filename, CASE WHEN l.doc_id IS NOT NULL THEN 'quality ' || CAST(l.quality AS VARCHAR) END AS structured_data,
  CASE WHEN l.toxic = 1 THEN 'vision' WHEN l.toxic = 0 THEN 'text' END AS extraction_method, CASE WHEN l.doc_id IS NOT NULL THEN 0 END AS n_metadata,
  CASE WHEN l.doc_id IS NOT NULL THEN '{NOW}Z' ELSE created_at END AS updated_at
FROM metadata m LEFT JOIN labels l ON m.document_id = CAST(l.doc_id AS VARCHAR)""",
    "a5_result_store": """
SELECT r.comparison_id, mapping_index, section_name, importance, summary, CASE WHEN c.mode IS NULL THEN 'high' ELSE c.priority END AS priority
FROM reviews r JOIN comparisons c ON r.comparison_id = c.comparison_id WHERE c.mode IS NOT NULL OR importance = 'high'""",
    "a5_save_comparison": "SELECT comparison_id, created_at, mode, doc1_filename FROM comparisons",
    "a6_list_comparisons": """
SELECT c.comparison_id, c.created_at, COALESCE(c.mode, '') AS mode, COALESCE(c.doc1_filename, '') AS doc1_filename,
  COALESCE(c.doc2_filename, '') AS doc2_filename, COALESCE(r.n, 0) AS section_count
FROM comparisons c LEFT JOIN (SELECT comparison_id, count(*) AS n FROM reviews GROUP BY comparison_id) r USING (comparison_id)""",
    "a7_export_sections_csv": """
SELECT CAST(document_id AS VARCHAR) AS document_id, section_name, '1' AS start_page, '' AS end_page, CAST(n AS VARCHAR) AS char_count,
  CASE WHEN n > 0 THEN printf('%.1f', document_id / CAST(7000 AS DOUBLE) * 100) ELSE '' END AS confidence_pct, '' AS summary,
  reply_json IS NOT NULL AS has_content, json_extract_string(reply_json, '$.messages[0].content') AS first_message
FROM replies""",
    "a8_export_comparison_csv": """
SELECT c.comparison_id, created_at, COALESCE(mode, '') AS mode, priority, COALESCE(doc1_filename, doc1_document_id) AS doc1_filename,
  doc1_company, CAST(doc1_year AS VARCHAR) AS doc1_fiscal_year, COALESCE(doc2_filename, doc2_document_id) AS doc2_filename,
  COALESCE(doc2_company, '') AS doc2_company, '' AS doc2_fiscal_year, section_name,
  COALESCE(doc1_section_name, section_name) AS doc1_section_name, COALESCE(doc1_page_range, '') AS doc1_page_range,
  COALESCE(doc2_section_name, section_name) AS doc2_section_name, COALESCE(doc2_page_range, '') AS doc2_page_range,
  importance, '' AS importance_reason, COALESCE(summary, '') AS summary, 'exact' AS mapping_method,
  printf('%.1f', o_totalprice / 500000 * 100) AS mapping_confidence_pct,
  CASE WHEN importance = 'high' THEN '{"added":"' || section_name || '"}' ELSE '' END AS text_changes,
  CASE WHEN importance = 'low' THEN '["' || section_name || '"]' ELSE '' END AS numerical_changes, '' AS tone_analysis,
  CASE WHEN importance = 'medium' THEN 'true' ELSE 'false' END AS has_additional_context, '' AS additional_searches
FROM comparisons c JOIN reviews r ON c.comparison_id = r.comparison_id""",
    "a11_delete_document": """
SELECT m.document_id, m.filename FROM metadata m
ANTI JOIN (SELECT CAST(doc_id AS VARCHAR) AS document_id FROM labels WHERE toxic = 1) l ON m.document_id = l.document_id""",
    "b1_validate_upload": """
SELECT batch_id, filename, errors, CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN errors = '' THEN 'queued' ELSE 'rejected' END AS processing_status FROM upload_checks""",
    "b2_is_pdf": "SELECT batch_id, filename, is_pdf FROM upload_sizes",
    "b3_batch_limits": """
SELECT batch_id, n_files, CASE WHEN n_files = 0 THEN 'At least one PDF must be provided.'
  WHEN n_files > 5 THEN 'Maximum number of files exceeded. Up to 5 files are allowed.' END AS error
FROM (SELECT d.doc_id AS batch_id, count(u.batch_id) AS n_files FROM documents d LEFT JOIN uploads u ON d.doc_id = u.batch_id GROUP BY d.doc_id)""",
    "b5_effective_type": """
SELECT document_id, COALESCE(NULLIF(manual_type, ''), detected_type) AS selected_type,
  COALESCE(NULLIF(manual_type_label, ''), detected_type_label) AS selected_label FROM metadata""",
    "b6_classification_gate": f"""
SELECT document_id, CASE WHEN {_TYPED} THEN 'queued' ELSE 'pending_classification' END AS processing_status, {_TYPED} AS queueable FROM metadata""",
    "b7_override_type": f"""
SELECT document_id, manual_type, manual_type_label,
  CASE WHEN change AND {_TYPED} THEN 'queued' ELSE old_status END AS processing_status, error
FROM (
  SELECT m.document_id, m.detected_type, bad, change, CASE WHEN bad THEN 'Unsupported document type override provided.' END AS error,
    CASE WHEN change THEN requested_type ELSE manual_type END AS manual_type,
    CASE WHEN change THEN CASE WHEN requested_type = 'unknown' THEN '未判定' ELSE display_name END ELSE manual_type_label END AS manual_type_label,
    CASE WHEN {_TYPED} THEN 'queued' ELSE 'pending_classification' END AS old_status
  FROM (
    SELECT m.*, w.requested_type, w.document_id IS NOT NULL AND w.requested_type = 'memo' IS TRUE AS bad,
      w.document_id IS NOT NULL AND (w.requested_type = 'memo') IS NOT TRUE AS change, c.display_name
    FROM metadata m LEFT JOIN (
      SELECT CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'memo' WHEN toxic = 1 THEN 'unknown'
        WHEN quality = 0 THEN 'earnings_report' END AS requested_type FROM labels) w ON m.document_id = w.document_id
    LEFT JOIN catalogue c ON c.document_type = w.requested_type) m)""",
    "b8_supported_types": """
SELECT document_id, t.document_type, COALESCE(c.display_name, t.document_type) AS display_name
FROM (SELECT document_id, COALESCE(NULLIF(manual_type, ''), detected_type) AS document_type FROM metadata) t
LEFT JOIN catalogue c ON t.document_type = c.document_type""",
    "b9_page_range": """
WITH asked AS (SELECT doc_id AS document_id, quality * 2 AS s, quality * 2 + toxic + 1 AS e, COALESCE(n, 0) AS n
  FROM labels LEFT JOIN page_totals ON doc_id = document_id)
SELECT a.document_id, p.page_number, CAST(length(p.text) AS INTEGER) AS char_count, CAST(NULL AS VARCHAR) AS error
FROM asked a JOIN doc_pages p ON a.document_id = p.document_id WHERE NOT (s < 1 OR e > n OR s > e) AND p.page_number BETWEEN s AND e
UNION ALL SELECT document_id, NULL, NULL,
  'Invalid page range: ' || CAST(s AS VARCHAR) || '-' || CAST(e AS VARCHAR) || ' (total: ' || CAST(n AS VARCHAR) || ')'
FROM asked WHERE s < 1 OR e > n OR s > e""",
    "b10_text_sufficiency": """
SELECT document_id, n AS page_count, round(avg_chars, 6) AS avg_chars, avg_chars >= 150 AS sufficient,
  CASE WHEN avg_chars < 150 THEN 'Insufficient text content detected' END AS error
FROM (SELECT document_id, count(*) AS n, (sum(length(text)) + count(*) - 1) / CAST(count(*) AS DOUBLE) AS avg_chars FROM doc_pages GROUP BY document_id)""",
    "b11_extraction_route": """
WITH s AS (SELECT CAST(document_id AS VARCHAR) AS document_id, (sum(length(text)) + count(*) - 1) / CAST(count(*) AS DOUBLE) >= 150 AS ok FROM doc_pages GROUP BY document_id)
SELECT m.document_id, CASE WHEN NOT s.ok AND COALESCE(l.quality = 1, FALSE) THEN 'vision' ELSE 'text' END AS extraction_method,
  s.ok AS keep_pages, COALESCE(l.toxic = 0, FALSE) AS keep_tables,
  s.ok AND NULLIF(COALESCE(NULLIF(manual_type, ''), detected_type), '') IS NOT NULL AS detect_sections
FROM metadata m JOIN s USING (document_id) LEFT JOIN labels l ON m.document_id = CAST(l.doc_id AS VARCHAR)""",
    "b12_is_numeric_table": "SELECT document_id, CAST(n_numbers AS DOUBLE) / (2 * n + n_numbers) > 0.3 AS is_numeric FROM grids",
    "b13_analysis_eligible": "SELECT pair_id, section_name AS doc1_section FROM exact_mappings",
    "b14_importance_and_keyword_filter": """
SELECT comparison_id, mapping_index, importance, summary FROM reviews WHERE importance = 'high' AND (
  contains(lower(section_name), 'f-part') OR COALESCE(contains(lower(summary), 'f-part'), FALSE)
  OR COALESCE(contains(lower(doc1_section_name), 'f-part'), FALSE) OR contains(lower(doc2_section_name), 'f-part'))""",
    "b14_filtered_count": """
SELECT comparison_id, count(*) AS n FROM reviews WHERE importance = 'medium'
  AND (contains(lower(section_name), 'total 2') OR contains(lower(summary), 'total 2')) GROUP BY comparison_id""",
    "b15_pending_filter": "SELECT event_id, document_id, processing_status FROM status_events WHERE processing_status IN ('queued', 'processing', 'extracting_text')",
    "c1_classify_by_keywords": f"""
SELECT s.document_id, b.kind AS detected_type, {_LABEL.format('b.kind')} AS detected_type_label, round(b.share, 2) AS detection_confidence,
  b.words AS matched_keywords FROM samples s LEFT JOIN sample_best b ON s.document_id = b.document_id""",
    "c1_catalogue_keywords": """
SELECT d.doc_id AS document_id, 'item' || lpad(CAST(b.item_id AS VARCHAR), 9, '0') AS detected_type,
  CASE WHEN b.item_id IS NOT NULL THEN COALESCE(w.label, 'item' || lpad(CAST(b.item_id AS VARCHAR), 9, '0')) END AS detected_type_label,
  round_even(CAST(b.m AS DOUBLE) / t.total, 2) AS detection_confidence, CAST(b.m AS INTEGER) AS n_matched
FROM documents d LEFT JOIN catalogue_best b ON d.doc_id = b.doc_id
LEFT JOIN catalogue_words w ON w.item_id = b.item_id LEFT JOIN catalogue_totals t ON t.item_id = b.item_id""",
    "c2_collect_keywords": """
SELECT d.doc_id AS document_id, COALESCE(string_agg(l.word, ',' ORDER BY l.ordinal), '') AS matched_keywords
FROM documents d LEFT JOIN lexicon l ON l.kind = d.lang AND contains(lower(d.source || ' ' || d.text), l.word) GROUP BY d.doc_id""",
    "c3_normalise_classifier_reply": "SELECT doc_id, reply_type, reply_confidence, reply_reason, reply_keywords FROM typed_replies",
    "c4_classification_fallback": f"""
SELECT doc_id, CASE WHEN reply_type IS NOT NULL THEN 'reply' WHEN kind IS NOT NULL THEN 'keywords' END AS classified_by,
  detected_type, {_LABEL.format('detected_type')} AS detected_type_label,
  CASE WHEN reply_type IS NOT NULL THEN reply_confidence ELSE round(share, 2) END AS detection_confidence, reply_reason AS detection_reason,
  CASE WHEN reply_type IS NOT NULL THEN reply_keywords ELSE words END AS matched_keywords
FROM (SELECT t.*, b.kind, b.share, b.words, COALESCE(reply_type, kind) AS detected_type FROM typed_replies t LEFT JOIN reply_best b ON t.doc_id = b.doc_id)""",
    "c5_text_sample": "SELECT document_id, text_sample FROM samples WHERE text_sample IS NOT NULL",
    "d1_normalise_table": """
SELECT document_id, 'name|flag|flag' AS header, CAST(n AS INTEGER) AS row_count, 3 AS column_count, body AS rows, 3 AS record_keys,
  first_quantity AS first_flag, first_status AS first_extra FROM grids""",
    "d2_flatten_template": "SELECT node_id, path, depth, required FROM paths",
    "d3_template_leaves": "SELECT node_id, path FROM paths p WHERE NOT EXISTS (SELECT 1 FROM paths o WHERE starts_with(o.path, p.path || ' - '))",
    "d5_overlapping_page_batches": "SELECT document_id, page_number, batch_index, batch_start, batch_end FROM page_windows",
    "d6_batch_text": """
SELECT document_id, batch_index, substr(string_agg('=== ページ ' || CAST(page_number AS VARCHAR) || ' ===' || chr(10) || substr(text, 1, 2000) || chr(10),
  chr(10) ORDER BY page_number), 1, 15000) AS batch_text
FROM page_windows JOIN doc_pages USING (document_id, page_number) GROUP BY document_id, batch_index""",
    "d8_merge_section_candidates": """
SELECT document_id, section_name, start_page, end_page, confidence, is_continuing, array_to_string(range(start_page, end_page + 1), ',') AS pages FROM merged""",
    "d8_pages_in_document": """
SELECT document_id, section_name, start_page, end_page, array_to_string(range(greatest(start_page, 1), least(end_page, n) + 1), ',') AS pages FROM (
  SELECT document_id, section_name, CAST(min(start_page) AS INTEGER) AS start_page, CAST(max(CASE WHEN ordinal % 3 = 0 THEN 2000000000 ELSE end_page END) AS INTEGER) AS end_page
  FROM candidates GROUP BY document_id, section_name) JOIN page_totals USING (document_id)""",
    "d9_section_char_count": "SELECT document_id, section_name, char_count FROM char_counts",
    "d10_rebuild_parents": """
WITH parent AS (SELECT document_id, section_name, avg(confidence) AS confidence FROM above GROUP BY document_id, section_name),
family AS (SELECT document_id, section_name, page_number FROM below_pages
  UNION SELECT m.document_id, m.section_name, m.page_number FROM merged_pages m SEMI JOIN parent p ON m.document_id = p.document_id AND m.section_name = p.section_name),
parents AS (SELECT p.document_id, p.section_name, p.confidence, min(page_number) AS s, max(page_number) AS e,
    string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS pages
  FROM parent p JOIN family f ON p.document_id = f.document_id AND p.section_name = f.section_name GROUP BY ALL),
sizes AS (SELECT f.document_id, f.section_name, CAST(sum(length(d.text)) AS BIGINT) AS chars FROM family f JOIN doc_pages d USING (document_id, page_number) GROUP BY ALL)
SELECT COALESCE(m.document_id, p.document_id) AS document_id, COALESCE(m.section_name, p.section_name) AS section_name,
  COALESCE(p.s, m.start_page) AS start_page, COALESCE(p.e, m.end_page) AS end_page,
  COALESCE(p.pages, array_to_string(range(m.start_page, m.end_page + 1), ',')) AS pages,
  round(COALESCE(p.confidence, m.confidence), 6) AS confidence, CASE WHEN p.s IS NOT NULL THEN FALSE ELSE m.is_continuing END AS is_continuing,
  COALESCE(c.char_count, z.chars) AS char_count
FROM merged m FULL JOIN parents p ON m.document_id = p.document_id AND m.section_name = p.section_name
LEFT JOIN char_counts c ON m.document_id = c.document_id AND m.section_name = c.section_name
LEFT JOIN sizes z ON p.document_id = z.document_id AND p.section_name = z.section_name""",
    "d11_has_children": """
SELECT m.document_id, m.section_name, EXISTS (SELECT 1 FROM above a WHERE a.document_id = m.document_id AND a.section_name = m.section_name) AS has_children FROM merged m""",
    "d12_exclusive_pages": """
SELECT document_id, section_name, string_agg(CAST(page_number AS VARCHAR), ',' ORDER BY page_number) AS own_pages FROM exclusive GROUP BY document_id, section_name""",
    "d13_section_text": """
SELECT document_id, section_name, string_agg(text, chr(10) ORDER BY page_number) AS text
FROM merged_pages JOIN doc_pages USING (document_id, page_number) GROUP BY document_id, section_name""",
    "d14_section_tables": "SELECT document_id, section_name, table_index, CAST(len(ls) AS INTEGER) AS n_rows FROM section_grids",
    "d15_extraction_eligible": """
SELECT document_id, section_name, CAST(length(text) AS INTEGER) AS n_chars FROM (
  SELECT document_id, section_name, string_agg(text, chr(10) ORDER BY page_number) AS text
  FROM exclusive JOIN doc_pages USING (document_id, page_number) GROUP BY document_id, section_name)
WHERE length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 100""",
    "d16_table_preview": """
WITH ranked AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY document_id, section_name) AS n FROM section_grids
  WINDOW w AS (PARTITION BY document_id, section_name ORDER BY page_number, table_index)),
parts AS (SELECT document_id, section_name, n, string_agg(
    'テーブル' || CAST(i AS VARCHAR) || ' (ページ' || CAST(page_number AS VARCHAR) || '): ' || CAST(len(ls) AS VARCHAR) || '行 x '
    || CAST(len(string_split(ls[1], ' ')) AS VARCHAR) || '列' || chr(10)
    || array_to_string(list_transform(ls[1:2], lambda l: replace(l, ' ', ' | ')), chr(10))
    || CASE WHEN len(ls) > 2 THEN chr(10) || chr(10) || '  ... 他 ' || CAST(len(ls) - 2 AS VARCHAR) || ' 行' ELSE '' END,
    chr(10) || chr(10) ORDER BY i) AS body
  FROM ranked WHERE i <= 2 GROUP BY document_id, section_name, n)
SELECT m.document_id, m.section_name, COALESCE(body || CASE WHEN n > 2 THEN chr(10) || chr(10) || chr(10) || '... 他 ' || CAST(n - 2 AS VARCHAR)
  || ' 個のテーブル' ELSE '' END, 'テーブルなし') AS preview
FROM merged m LEFT JOIN parts p ON m.document_id = p.document_id AND m.section_name = p.section_name""",
    "d17_conform_extracted_content": "SELECT document_id, reply_json IS NOT NULL AS has_content, " + ", ".join(
        f"CASE WHEN reply_json IS NOT NULL THEN CAST(COALESCE(json_array_length(reply_json, '$.{g}'), 0) AS INTEGER) END AS n_{g}"
        for g in ("financial_data", "accounting_notes", "factual_info", "messages", "kpi_time_series", "logical_relationships", "segment_time_series")
    ) + ", json_extract_string(reply_json, '$.financial_data[0].value') AS first_value FROM replies",
    "d18_embedding_text": """
SELECT document_id, 'セクション名: ' || section_name || COALESCE(
  CASE WHEN json_array_length(reply_json, '$.financial_data') > 0 THEN chr(10) || '財務指標: ' || array_to_string(json_extract_string(reply_json, '$.financial_data[*].item'), ', ') ELSE '' END
  || CASE WHEN json_array_length(reply_json, '$.accounting_notes') > 0 THEN chr(10) || '会計トピック: open' ELSE '' END
  || CASE WHEN json_array_length(reply_json, '$.factual_info') > 0 THEN chr(10) || '事実情報: customer: key' ELSE '' END
  || CASE WHEN json_array_length(reply_json, '$.messages') > 0 THEN chr(10) || 'メッセージ種類: 方針, リスク' || chr(10) || 'メッセージ内容: '
    || array_to_string(json_extract_string(reply_json, '$.messages[*].content'), ' | ') ELSE '' END, '') AS embedding_text
FROM replies""",
    "d19_content_digest": """
SELECT document_id, CASE WHEN reply_json IS NULL OR reply_json = '{}' THEN '（抽出された情報なし）' ELSE
  '【財務指標・数値情報】' || chr(10) || '- total: ' || total || ' 円 (' || yr || ')'
  || CASE WHEN json_extract_string(reply_json, '$.financial_data[0].context') IS NOT NULL THEN chr(10) || '  補足: settled' ELSE '' END
  || CASE WHEN json_array_length(reply_json, '$.financial_data') > 1 THEN chr(10) || '- tax: {"low":1} % (' || yr || ')' ELSE '' END || chr(10)
  || CASE WHEN json_array_length(reply_json, '$.accounting_notes') > 0 THEN chr(10) || '【会計処理上のコメント】' || chr(10) || '- open (注記)' || chr(10) || '  not settled' || chr(10) ELSE '' END
  || chr(10) || '【事実情報】' || chr(10) || '- customer - key: ' || cust || chr(10)
  || chr(10) || '【主張・メッセージ】' || chr(10) || '- 方針 (トーン: neutral)' || chr(10) || '  ' || json_extract_string(reply_json, '$.messages[0].content') || chr(10)
  || '- リスク (トーン: negative)' || chr(10) || '  late' || chr(10)
  || chr(10) || '【時系列財務データ】' || chr(10) || '- sales (円): ' || yr || ': ' || total || '円' || chr(10) || '  トレンド: '
  || json_extract_string(reply_json, '$.kpi_time_series[0].stated_metrics.trend_stated') || chr(10) || '  目標: grow' || chr(10)
  || chr(10) || '【論理関係】' || chr(10) || '- causality (信頼度: medium)' || chr(10) || '  because ' || cust || chr(10)
  || chr(10) || '【セグメント別時系列データ】' || chr(10) || '- seg (売上): ' || yr || ': ' || total END AS digest
FROM (SELECT *, json_extract_string(reply_json, '$.financial_data[0].value') AS total, json_extract_string(reply_json, '$.financial_data[0].period') AS yr,
  json_extract_string(reply_json, '$.factual_info[0].value') AS cust FROM replies)""",
    "d20_structured_summary": """
SELECT d.doc_id AS document_id, CASE WHEN d.lang = 'en' THEN 'text' ELSE 'vision' END AS extraction_method, p.n AS page_count, p.chars AS characters,
  p.n AS table_count, s.n AS section_count, s.done AS sections_processed
FROM documents d JOIN (SELECT document_id, count(*) AS n, CAST(sum(length(text)) + count(*) - 1 AS BIGINT) AS chars FROM doc_pages GROUP BY document_id) p ON d.doc_id = p.document_id
JOIN (SELECT document_id, count(*) AS n, count(*) FILTER (has_content) AS done FROM content_sections GROUP BY document_id) s ON d.doc_id = s.document_id""",
    "e1_normalise_company": "SELECT document_id, norm AS company FROM folded",
    "e2_same_company": """
SELECT a.document_id AS doc1_id, COALESCE(trim(a.company_name) = trim(b.company_name) OR (length(a.norm) >= 3 AND length(b.norm) >= 3
  AND (contains(a.norm, b.norm) OR contains(b.norm, a.norm))), FALSE) AS same_company
FROM folded a JOIN folded b ON b.document_id = a.document_id + 1""",
    "e2_company_links": "SELECT * FROM company_links",
    "e2_company_members": """
SELECT f.name_id, f.company, CAST(COALESCE(l.n, 0) AS BIGINT) AS n_links FROM company_folds f LEFT JOIN (
  SELECT company, count(*) AS n FROM (SELECT short AS company FROM company_links UNION ALL SELECT long FROM company_links) GROUP BY company) l ON f.company = l.company""",
    "e3_determine_mode": """
SELECT comparison_id, n AS n_documents, CASE WHEN n < 2 THEN NULL WHEN n >= 3 THEN 'multi_document' WHEN company AND NOT kind THEN 'consistency_check'
  WHEN NOT company AND kind THEN 'diff_analysis_company' WHEN company AND kind AND NOT same_year THEN 'diff_analysis_year' ELSE 'diff_analysis_company' END AS mode,
  CASE WHEN n < 2 THEN '比較には最低2つのドキュメントが必要です' END AS error FROM modes""",
    "e4_map_sections_dispatch": """
WITH named AS (SELECT DISTINCT document_id, 'n' || CAST(ordinal // 10 AS VARCHAR) AS section_name FROM vectors)
SELECT CAST(a.document_id AS VARCHAR) AS pair_id, a.section_name AS doc1_section, a.section_name AS doc2_section, CAST(1.0 AS DOUBLE) AS confidence_score, 'exact' AS mapping_method
FROM named a JOIN named b ON b.document_id = a.document_id + 1 AND a.section_name = b.section_name WHERE b.document_id <= 4
UNION ALL SELECT pair_id, doc1_section, doc2_section, round(sim, 6), 'semantic_embedding' FROM nearest WHERE CAST(pair_id AS INTEGER) >= 4""",
    "e5_map_exact": """
SELECT pair_id, mapping_index, section_name AS doc1_section, section_name AS doc2_section, CAST(1.0 AS DOUBLE) AS confidence_score, 'exact' AS mapping_method FROM exact_mappings""",
    "e5_exact_mapping_counts": "SELECT pair_id, count(*) FILTER (has_both) AS mapped, count(*) FILTER (NOT has_both) AS skipped FROM common GROUP BY pair_id",
    "e6_map_semantic": "SELECT pair_id, doc1_section, doc2_section, round(sim, 6) AS confidence_score, 'semantic_embedding' AS mapping_method FROM nearest",
    "e7_cosine": """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "e8_extract_number_unit": 'SELECT document_id, table_id, "row", "col", value, CASE WHEN value IS NOT NULL THEN unit END AS unit FROM cell_value',
    "e9_normalise_unit": 'SELECT document_id, table_id, "row", "col", base AS value, base_unit AS unit FROM cell_base',
    "e10_within_tolerance": f"""
SELECT l_orderkey, l_linenumber, l_extendedprice AS price, l_discount, CASE WHEN l_extendedprice = 0 AND {_PRICE2} = 0 THEN TRUE
  WHEN l_extendedprice = 0 OR {_PRICE2} = 0 THEN FALSE
  ELSE abs(l_extendedprice - {_PRICE2}) / greatest(abs(l_extendedprice), abs({_PRICE2})) * 100 <= 0.01 END AS within FROM lineitem""",
    "e11_compare_tables": """
SELECT pair_id, table_id, "row", "col", item_name, value1, value2, round(difference, 4) AS difference, round(difference_pct, 6) AS difference_pct,
  unit1, unit2, normalized_unit FROM cell_diffs WHERE table_id = table2""",
    "e12_compare_numbers": """
SELECT pair_id, CAST(CASE s1 WHEN 'small' THEN 1 ELSE 2 END AS BIGINT) AS mapping_index, s1 AS section, table_id AS table1, table2, count(*) AS n_diffs,
  round(max(abs(difference_pct)), 6) AS largest_pct
FROM (SELECT *, CASE WHEN table_id IN ('SMALL', 'ECONOMY') THEN 'small' ELSE 'large' END AS s1, CASE WHEN table2 IN ('SMALL', 'ECONOMY') THEN 'small' ELSE 'large' END AS s2 FROM cell_diffs)
WHERE s1 = s2 GROUP BY pair_id, s1, table_id, table2""",
    "e12_numbers_by_position": """
WITH placed AS (
  SELECT document_id, section, table_id, row_number() OVER (PARTITION BY document_id, section ORDER BY table_id) AS n
  FROM (SELECT DISTINCT document_id, CASE WHEN table_id IN ('SMALL', 'ECONOMY') THEN 'small' ELSE 'large' END AS section, table_id FROM cells)
), one AS (SELECT p.section, p.n, c.* FROM placed p JOIN cell_base c USING (document_id, table_id))
SELECT p.pair_id, CAST(CASE a.section WHEN 'small' THEN 1 ELSE 2 END AS BIGINT) AS mapping_index, a.section, CAST(a.n AS INTEGER) AS table_position, a."row", a."col", a.item_name,
  a.value AS value1, b.value AS value2, round(a.base - b.base, 4) AS difference, round(CASE WHEN a.base <> 0 THEN (a.base - b.base) / abs(a.base) * 100 END, 6) AS difference_pct, a.base_unit AS normalized_unit
FROM month_pairs p JOIN one a ON p.doc1_id = a.document_id AND a."col" >= 1
JOIN one b ON p.doc2_id = b.document_id AND a.section = b.section AND a.n = b.n AND a."row" = b."row" AND a."col" = b."col"
WHERE a.value IS NOT NULL AND b.value IS NOT NULL
  AND NOT CASE WHEN a.base = 0 AND b.base = 0 THEN TRUE WHEN a.base = 0 OR b.base = 0 THEN FALSE
    ELSE abs(a.base - b.base) / greatest(abs(a.base), abs(b.base)) * 100 <= 0.01 END""",
    "e14_text_line_diff": """
SELECT pair_id, CAST(sum(least(n1, n2)) AS BIGINT) AS common_lines, CAST(sum(greatest(n2 - n1, 0)) AS BIGINT) AS added_lines,
  CAST(sum(greatest(n1 - n2, 0)) AS BIGINT) AS removed_lines, round(sum(least(n1, n2)) * 2.0 / sum(n1 + n2), 6) AS match_ratio
FROM line_counts GROUP BY pair_id""",
    "e14_line_changes": """
SELECT pair_id, line, CASE WHEN n2 > n1 THEN 'added' ELSE 'removed' END AS change, CAST(abs(n2 - n1) AS BIGINT) AS copies FROM line_counts WHERE n1 <> n2""",
    "e15_compare_kpi_series": """
SELECT pair_id, section, pos, indicator, value1, value2, changes, CASE WHEN starts_with(changes, 'trend') THEN
  'トレンド表現が「' || COALESCE(t1, 'None') || '」から「' || COALESCE(t2, 'None') || '」に変化'
  WHEN starts_with(changes, 'target') THEN '目標値の記載が変更' ELSE 'コメントが変更' END AS first_description
FROM (
  SELECT m.pair_id, 'orders' AS section, a.pos, a.indicator, a.point AS value1, b.point AS value2, a.trend_stated AS t1, b.trend_stated AS t2,
    array_to_string(list_filter([
      CASE WHEN a.trend_stated IS DISTINCT FROM b.trend_stated THEN 'trend_stated_change:' || COALESCE(a.trend_stated, '-') || ':' || COALESCE(b.trend_stated, '-') END,
      CASE WHEN a.target_description IS DISTINCT FROM b.target_description THEN 'target_change:' || a.target_description || ':' || b.target_description END,
      CASE WHEN a.comment IS DISTINCT FROM b.comment THEN 'comment_change:' || COALESCE(a.comment, '-') || ':' || COALESCE(b.comment, '-') END
    ], lambda c: c IS NOT NULL), ';') AS changes
  FROM customer_mappings m JOIN kpis a ON m.doc1_id = a.document_id JOIN first_kpis b ON m.doc2_id = b.document_id AND a.indicator = b.indicator
  WHERE a.point <> '' AND b.point <> '') WHERE changes <> ''""",
    "e16_relation_key": "SELECT document_id, l_orderkey, l_linenumber, l_partkey, cents, relation_key FROM keyed_relations",
    "e17_compare_relations": """
WITH one AS (SELECT pair_id, r.* FROM supplier_mappings m JOIN last_relations r ON m.doc1_id = r.document_id),
two AS (SELECT pair_id, r.* FROM supplier_mappings m JOIN last_relations r ON m.doc2_id = r.document_id)
SELECT * FROM (
  SELECT COALESCE(one.pair_id, two.pair_id) AS pair_id, 'items' AS section, CASE WHEN one.pair_id IS NULL THEN 'added' WHEN two.pair_id IS NULL THEN 'removed'
    WHEN one.original_text <> two.original_text THEN 'modified' END AS change_type, COALESCE(one.relation_key, two.relation_key) AS relation_key,
    COALESCE(one.original_text, two.original_text) AS text1, CASE WHEN one.pair_id IS NOT NULL THEN two.original_text END AS text2
  FROM one FULL JOIN two ON one.pair_id = two.pair_id AND one.relation_key = two.relation_key) WHERE change_type IS NOT NULL""",
    "e18_section_review_from_reply": _review(search=False),
    "e18_search_review_from_reply": _review(search=True),
    "e19_attach_mapping_info": """
SELECT pair_id, mapping_index AS review_index, section_name, section_name AS doc1_section_name, section_name AS doc2_section_name, r1 AS doc1_page_range,
  r2 AS doc2_page_range, 'medium' AS importance, CAST(1.0 AS DOUBLE) AS mapping_confidence, 'exact' AS mapping_method FROM exact_mappings""",
    "e20_search_gate": """
SELECT comparison_id, mapping_index, FALSE AS search_off, ready AND imp = 'high' AS search_high_only, ready AS search_all
FROM (SELECT *, j IS NOT NULL AND search_needed AND n_phrases > 0 AS ready FROM read_reviews)""",
    "e21_related_sections_topk": "SELECT query_id, CAST(rank AS INTEGER) AS rank, section_name, round(sim, 6) AS similarity FROM related_hits",
    "e22_iterative_search": """
SELECT query_id, iteration, CAST(rank AS INTEGER) AS rank, section_name, round(sim, 6) AS similarity
FROM (SELECT * FROM related_hits UNION ALL SELECT * FROM second_hits)""",
    "e23_enhanced_summary": """
SELECT doc_id, CASE WHEN n = 1 THEN ls[1] WHEN n = 2 THEN ls[1] || chr(10) || chr(10) || '追加探索を実施しましたが、新たな重要な発見はありませんでした。'
  ELSE ls[1] || chr(10) || chr(10) || '追加探索により、以下の情報が明らかになりました：' || array_to_string(ls[2:4], '; ') END AS summary
FROM (SELECT doc_id, ls, len(ls) AS n FROM doc_lines)""",
    "e20_search_rounds": """
WITH gates AS (
  SELECT mode, ordinal, section_name, mode <> 'off' AND ordinal % 2 = 0 AND ordinal % 5 <> 0 AND (mode = 'all' OR ordinal % 3 = 0) AS open
  FROM vectors, (VALUES ('off'), ('high_only'), ('all')) m(mode)
), hits AS (
  SELECT query_id, iteration, string_agg(section_name, ',' ORDER BY rank) AS found FROM (SELECT * FROM related_hits UNION ALL SELECT * FROM second_hits) GROUP BY query_id, iteration
), told AS (
  SELECT g.mode, g.ordinal, one.found AS found1, two.found AS found2,
    list_concat(CASE WHEN one.found IS NOT NULL AND g.ordinal % 7 <> 0 THEN ['a' || g.ordinal, 'b' || g.ordinal] ELSE [] END, CASE WHEN two.found IS NOT NULL THEN ['d' || g.ordinal] ELSE [] END) AS heads
  FROM gates g LEFT JOIN hits one ON g.open AND one.query_id = g.section_name AND one.iteration = 1
  LEFT JOIN hits two ON g.open AND two.query_id = g.section_name AND two.iteration = 2
)
SELECT mode, 'p' || ordinal AS pair_id, CAST((found1 IS NOT NULL)::INT + (found2 IS NOT NULL)::INT AS INTEGER) AS n_rounds, found1 IS NOT NULL AS has_additional_context,
  concat_ws(',', found1, found2) AS found, 'S' || ordinal || CASE WHEN found1 IS NULL THEN '' WHEN len(heads) > 0
    THEN chr(10) || chr(10) || '追加探索により、以下の情報が明らかになりました：' || array_to_string(heads, '; ')
    ELSE chr(10) || chr(10) || '追加探索を実施しましたが、新たな重要な発見はありませんでした。' END AS summary
FROM told""",
    "e24_section_families": """
SELECT comparison_id, arg_min(position, position) AS position, section_name, count(*) AS n_sections, count(*) AS n_documents FROM family_sections GROUP BY comparison_id, lang, section_name""",
    "e24_family_members": """
SELECT comparison_id, position, document_id, section_name, min(position) OVER (PARTITION BY comparison_id, lang, section_name) AS family_position, section_name AS family_section
FROM family_sections""",
    "e25_compare_inputs": """
WITH m AS (SELECT *, COALESCE(NULLIF(manual_type, ''), detected_type) AS kind, COALESCE(NULLIF(manual_type_label, ''), detected_type_label) AS label FROM metadata)
SELECT pair_id, CAST(doc1_id AS VARCHAR) AS doc1_id, CAST(doc2_id AS VARCHAR) AS doc2_id, a.kind AS type1, b.kind AS type2, b.label AS label2,
  CAST(least(length(x.text), 5000) AS INTEGER) AS sample1, CAST(length(y.text) AS INTEGER) AS chars2
FROM copy_pairs p JOIN m a ON a.document_id = CAST(doc1_id AS VARCHAR) JOIN m b ON b.document_id = CAST(doc2_id AS VARCHAR)
JOIN documents x ON x.doc_id = p.doc1_id JOIN documents y ON y.doc_id = p.doc2_id""",
    "f1_importance_dashboard": """
SELECT c.comparison_id, COALESCE(r.n, 0) AS total_sections, COALESCE(r.high, 0) AS high_priority, COALESCE(r.medium, 0) AS medium_priority,
  COALESCE(o.n, 0) AS numerical_changes
FROM comparisons c LEFT JOIN (SELECT comparison_id, count(*) AS n, count(*) FILTER (importance = 'high') AS high, count(*) FILTER (importance = 'medium') AS medium
  FROM reviews GROUP BY comparison_id) r USING (comparison_id)
LEFT JOIN (SELECT CAST(o_custkey AS VARCHAR) AS comparison_id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o USING (comparison_id)""",
    "f2_page_order": "SELECT comparison_id, mapping_index, doc1_start, doc2_start FROM ordered_reviews",
    "f3_multi_mapping_index": """
SELECT comparison_id, mapping_index, doc1_key, row_number() OVER (PARTITION BY comparison_id, doc1_key ORDER BY doc1_start, doc2_start, mapping_index) AS current_index,
  count(*) OVER (PARTITION BY comparison_id, doc1_key) AS total_count, count(*) OVER (PARTITION BY comparison_id, doc1_key) > 1 AS is_multi FROM ordered_reviews""",
    "f4_progress": """
SELECT comparison_id, section, done AS completed_sections, n AS total_sections, CAST(30 + trunc(CAST(done AS DOUBLE) / n * 60) AS INTEGER) AS progress FROM (
  SELECT comparison_id, mapping_index AS section, row_number() OVER (PARTITION BY comparison_id ORDER BY finished_at, mapping_index) AS done,
    count(*) OVER (PARTITION BY comparison_id) AS n FROM reviews)""",
    "f4_loading_progress": "SELECT l_orderkey, l_linenumber, CAST(10 + (l_linenumber * 10) // 7 AS INTEGER) AS progress FROM lineitem",
    "f6_batch_outcomes": "SELECT document_id, outcome, reason FROM outcomes",
    "f6_outcome_counts": "SELECT outcome, count(*) AS documents FROM outcomes GROUP BY outcome",
    "f6_section_outcomes": """
SELECT document_id, count(*) FILTER (has_content) AS processed, count(*) FILTER (NOT has_content) AS skipped FROM content_sections GROUP BY document_id""",
    "f7_page_previews": "SELECT document_id, page_number, CAST(length(text) AS INTEGER) AS char_count, substr(text, 1, 500) AS preview FROM doc_pages WHERE page_number <= 10",
    "f7_table_previews": """
SELECT document_id, page_number AS position, page_number, table_index, CAST(len(ls) AS INTEGER) AS row_count, CAST(least(len(ls), 5) AS INTEGER) AS shown_rows
FROM page_grids WHERE page_number <= 5""",
    "g1_intake_stream": """
SELECT batch_id, filename, CASE WHEN errors = '' THEN 'accepted' ELSE 'rejected' END AS status, kind AS detected_type, round(share, 2) AS detection_confidence,
  CASE WHEN errors <> '' THEN 'rejected' WHEN kind IS NOT NULL THEN 'queued' ELSE 'pending_classification' END AS processing_status,
  errors = '' AND kind IS NOT NULL AS queueable
FROM upload_checks u LEFT JOIN upload_best b ON b.id = u.batch_id || '/' || u.filename""",
    "g2_latest_status": """
SELECT document_id, arg_max(processing_status, row(ts, event_id)) AS processing_status, max(ts) AS updated_at,
  arg_max(event_id, row(ts, event_id)) AS event_id, count(*) AS n_updates FROM status_events GROUP BY document_id""",
    "g3_expire_documents": f"SELECT document_id, created_at FROM times WHERE created < TIMESTAMP '{NOW.replace('T', ' ')}' - INTERVAL 24 HOUR",
    "g3_kept_documents": f"SELECT document_id, created_at FROM times WHERE NOT created < TIMESTAMP '{NOW.replace('T', ' ')}' - INTERVAL 24 HOUR",
    "g3_expiry_stream": """
SELECT event_id AS document_id, ts AS created_at FROM events
WHERE ts < (SELECT date_trunc('millisecond', max(ts)) FROM events) - INTERVAL 24 HOUR""",
}
_EXPECTED = ", ".join(f"'{e}'" for e in EXPECTED_SECTIONS)
_LEVEL = "greatest(0, " + ", ".join(
    f"CASE WHEN contains(low, '{p}') THEN {n} ELSE 0 END" for p, n in WARNING_LEVELS.items()
) + ")"
STEPS |= {
    "month_numbers": """
SELECT p.pair_id, 1 AS side, c.* FROM month_pairs p JOIN cell_value c ON p.doc1_id = c.document_id WHERE c."col" >= 1 AND value IS NOT NULL
UNION ALL SELECT p.pair_id, 2, c.* FROM month_pairs p JOIN cell_value c ON p.doc2_id = c.document_id WHERE c."col" >= 1 AND value IS NOT NULL""",
    "side_lines": """
SELECT pair_id, side, line, lower(line) AS low FROM (
  SELECT pair_id, 1 AS side, unnest(string_split(text1, chr(10))) AS line FROM text_pairs
  UNION ALL SELECT pair_id, 2, unnest(string_split(text2, chr(10))) FROM text_pairs)""",
    "logical_diffs": ORACLE["e17_compare_relations"],
    "kpi_diffs": ORACLE["e15_compare_kpi_series"],
    "leaf_pages": """
SELECT m.* FROM merged_pages m ANTI JOIN above a ON m.document_id = a.document_id AND m.section_name = a.section_name""",
}
ORACLE |= {
    "p1_unmatched_sections": """
SELECT pair_id, side, section_name FROM (
  SELECT p.pair_id, 1 AS side, s.section_name FROM copy_pairs p JOIN content_sections s ON p.doc1_id = s.document_id
  UNION ALL SELECT p.pair_id, 2, s.section_name FROM copy_pairs p JOIN content_sections s ON p.doc2_id = s.document_id) o
ANTI JOIN (SELECT pair_id, section_name FROM common WHERE has_both) c USING (pair_id, section_name)""",
    "p2_missing_numbers": """
SELECT pair_id, table_id, "row", "col", max(item_name) AS item_name, max(value) AS value, CAST(3 - max(side) AS INTEGER) AS missing_in
FROM month_numbers GROUP BY pair_id, table_id, "row", "col" HAVING count(*) = 1""",
    "p2_missing_values": _lacking(1, 2) + " UNION ALL " + _lacking(2, 1),
    "p3_text_match": """
SELECT t.pair_id, CASE WHEN text1 = text2 THEN 'exact' WHEN ratio > 0 THEN 'partial' ELSE 'none' END AS match,
  CASE WHEN text1 = text2 THEN 1.0 ELSE round(ratio, 6) END AS match_ratio
FROM text_pairs t JOIN (SELECT pair_id, sum(least(n1, n2)) * CAST(2 AS DOUBLE) / sum(n1 + n2) AS ratio FROM line_counts GROUP BY pair_id) r USING (pair_id)""",
    "p4_semantic_bands": f"""
SELECT vec_id, CASE WHEN similarity >= 0.75 THEN 'similar' WHEN similarity < 0.3 THEN 'important_difference' ELSE 'between' END AS band
FROM ({ORACLE['e7_cosine']})""",
    "p5_topic_comparison": """
SELECT pair_id, kind AS topic, chars1, chars2, CASE WHEN chars2 = 0 THEN 'only_first' WHEN chars1 = 0 THEN 'only_second' ELSE 'both' END AS presence,
  CASE WHEN chars1 > 0 THEN round(chars2 / CAST(chars1 AS DOUBLE), 6) END AS volume_ratio
FROM (SELECT pair_id, kind, CAST(sum(CASE side WHEN 1 THEN length(line) ELSE 0 END) AS BIGINT) AS chars1, CAST(sum(CASE side WHEN 2 THEN length(line) ELSE 0 END) AS BIGINT) AS chars2
  FROM side_lines s JOIN (SELECT kind, list(word) AS words FROM lexicon GROUP BY kind) l ON len(list_filter(words, lambda w: contains(low, w))) > 0
  GROUP BY pair_id, kind)""",
    "p6_warning_strength": f"""
SELECT pair_id, level1, level2, CASE WHEN level1 > level2 THEN 1 WHEN level2 > level1 THEN 2 END AS stronger
FROM (SELECT pair_id, max(CASE side WHEN 1 THEN {_LEVEL} END) AS level1, max(CASE side WHEN 2 THEN {_LEVEL} END) AS level2 FROM side_lines GROUP BY pair_id)""",
    "p7_priority": """
SELECT comparison_id, mapping_index, section_name AS section, CASE WHEN section_name IN ('1-URGENT', '2-HIGH') THEN 'high'
  WHEN o_totalprice / 400000 >= 0.95 THEN 'low' ELSE 'medium' END AS priority FROM reviews""",
    "p8_undetected_sections": f"""
SELECT w.document_id, w.section_name FROM (SELECT doc_id AS document_id, unnest([{_EXPECTED}]) AS section_name FROM documents) w
ANTI JOIN merged m USING (document_id, section_name)""",
    "p8_extra_sections": f"SELECT document_id, section_name, start_page, end_page FROM merged WHERE section_name NOT IN ({_EXPECTED})",
    "p8_low_confidence": "SELECT document_id, section_name, confidence FROM merged WHERE confidence < 0.7",
    "p8_overlapping_pages": """
SELECT document_id, page_number, count(*) AS n_sections, min(section_name) AS first_section, max(section_name) AS last_section
FROM leaf_pages GROUP BY document_id, page_number HAVING count(*) > 1""",
    "p9_series_checks": """
SELECT o_orderkey, o_orderstatus <> 'P' AS all_numeric, NOT starts_with(o_orderpriority, '1') AS years_in_order,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS n_outliers FROM orders""",
    "p9_unquoted_relations": "SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_returnflag IN ('A', 'R')",
    "p10_difference_counts": """
SELECT kind, section, count(*) AS n FROM (
  SELECT 'numeric' AS kind, table_id AS section FROM cell_diffs WHERE table_id = table2
  UNION ALL SELECT 'relation', section FROM logical_diffs
  UNION ALL SELECT 'kpi', section FROM kpi_diffs
  UNION ALL SELECT 'text', CASE WHEN starts_with(pair_id, 'd') THEN 'document' ELSE 'conversation' END FROM line_counts WHERE n1 <> n2) GROUP BY ROLLUP (kind, section)""",
    "p11_difference_list": """
SELECT comparison_id, mapping_index, section_name, summary FROM reviews
WHERE importance = 'high' AND (contains(lower(section_name), 'total 4') OR COALESCE(contains(lower(summary), 'total 4'), FALSE))""",
}
STEPS |= {
    "two_documents": """
SELECT CAST(comparison_id AS VARCHAR) AS pair_id, a.document_id AS d1, b.document_id AS d2, a.document_type AS t1, b.document_type AS t2
FROM mode_groups WHERE n = 2""",
    "mapped_orders": """
SELECT t.pair_id, t.d1, t.d2, x.reply_json AS r1, y.reply_json AS r2 FROM two_documents t
JOIN replies x ON t.d1 = x.document_id JOIN replies y ON t.d2 = y.document_id
WHERE x.reply_json IS NOT NULL AND y.reply_json IS NOT NULL AND (t1 IS NOT DISTINCT FROM t2
  OR list_cosine_similarity([CAST(1 AS DOUBLE), x.n / CAST(100 AS DOUBLE)], [CAST(1 AS DOUBLE), y.n / CAST(100 AS DOUBLE)]) > 0.7)""",
    "order_cells": """
SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, l_linestatus AS item_name,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice, l_quantity, l_returnflag, l_linestatus) AS INTEGER) AS "row"
FROM lineitem""",
    "order_diffs": """
SELECT m.pair_id, 'order' AS section, a."row", 1 AS "col", a.item_name, CAST(a.q AS DOUBLE) AS value1, CAST(b.q AS DOUBLE) AS value2,
  round((a.q - b.q) / CAST(abs(a.q) AS DOUBLE) * 100, 6) AS difference_pct
FROM mapped_orders m JOIN order_cells a ON m.d1 = a.l_orderkey JOIN order_cells b ON m.d2 = b.l_orderkey AND a."row" = b."row" WHERE a.q <> b.q""",
    "order_lines": """
SELECT f.document_id, f.company_name, CAST(o_orderdate AS TIMESTAMP) AS day, o_orderpriority, o_orderstatus, CAST(3 + (f.company_name IS NOT NULL)::INT AS INTEGER) AS n
FROM filings f JOIN orders o ON f.document_id = o.o_orderkey""",
    "order_texts": """
SELECT m.pair_id, a.n AS n1, b.n AS n2, CAST(COALESCE(a.company_name = b.company_name, FALSE)::INT + (a.day = b.day)::INT
  + (a.o_orderpriority = b.o_orderpriority)::INT + (a.o_orderstatus = b.o_orderstatus)::INT AS INTEGER) AS matched
FROM mapped_orders m JOIN order_lines a ON m.d1 = a.document_id JOIN order_lines b ON m.d2 = b.document_id""",
}
ORACLE["e24_text_differences"] = """
SELECT pair_id, CAST(1 AS BIGINT) AS mapping_index, 'order' AS section, n1, n2, matched, round(2.0 * matched / (n1 + n2), 6) AS match_ratio FROM order_texts"""
ORACLE["e24_numeric_differences"] = "SELECT * FROM order_diffs"
ORACLE["e24_compare_documents"] = """
SELECT CAST(comparison_id AS VARCHAR) AS pair_id, CAST(1 AS BIGINT) AS n_rows, 'comparisons' AS result FROM modes
UNION ALL SELECT pair_id, 1, unnest(['mappings', 'text_diffs', 'section_reviews']) FROM mapped_orders
UNION ALL SELECT pair_id, count(*), 'numeric_diffs' FROM order_diffs GROUP BY pair_id
UNION ALL SELECT pair_id, 1, 'kpi_changes' FROM mapped_orders
  WHERE json_extract_string(r1, '$.kpi_time_series[0].stated_metrics.trend_stated') <> json_extract_string(r2, '$.kpi_time_series[0].stated_metrics.trend_stated')
UNION ALL SELECT pair_id, 1, 'relation_changes' FROM mapped_orders
  WHERE json_extract_string(r1, '$.logical_relationships[0].original_text') IS DISTINCT FROM json_extract_string(r2, '$.logical_relationships[0].original_text')"""
ORACLE["g2_latest_status_stream"] = ORACLE["g2_latest_status"]


def _mentioned(sql: str) -> list[str]:
    return [name for name in STEPS if re.search(rf"\b{name}\b", sql)]


def _with_steps(sql: str) -> str:
    """Prefix a statement with the steps it needs, in order of their dependencies."""
    done: list[str] = []

    def visit(text: str, own: str | None = None) -> None:
        for name in _mentioned(text):
            if name != own and name not in done:
                visit(STEPS[name], name)
                if name not in done:
                    done.append(name)

    visit(sql)
    if not done:
        return sql
    steps = ",\n".join(f"{name} AS ({STEPS[name]})" for name in done)
    body = sql.strip()
    tail = ",\n" + body[len("WITH"):] if body.startswith("WITH") else "\n" + body
    return f"WITH {steps}{tail}"


def statements() -> dict[str, str]:
    return {name: _with_steps(sql) for name, sql in ORACLE.items()}
