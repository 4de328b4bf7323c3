"""SQL twins of the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

# Blanks, word bytes and the case folding of the contracts, as patterns of the checking engine.
FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

QUALITY = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), listed AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS full_lines FROM texts
), placed AS (
  SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM listed WHERE len(words) > 3
), counted AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, words[i], words[i + 1], words[i + 2]) AS n FROM placed
), covered AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM counted, (VALUES (0), (1), (2)) AS steps(d) WHERE n > 1 GROUP BY rid
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(full_lines)::BIGINT AS n_lines, (len(full_lines) - len(list_distinct(full_lines)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM listed LEFT JOIN covered USING (rid)
), failed AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.3::DOUBLE * n_words OR n_dup_lines > 0.5::DOUBLE * n_lines
            OR word_chars < 2.0::DOUBLE * n_words OR word_chars > 15.0::DOUBLE * n_words) AS kept
FROM failed
"""

CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, (length(text) + 3) // 4 + 4 AS tokens,
         length('<s>[INST]  [/INST]</s>') + length(regexp_replace(role, '([<\[\\])', '\1\\', 'g')) + length(regexp_replace(text, '([<\[\\])', '\1\\', 'g')) AS chars
  FROM said
), turns AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - tokens AS before,
         greatest((2048 - 256 - greatest(least(coalesce(sum(tokens) FILTER (WHERE role = 'system') OVER (PARTITION BY conv_id), 0), 1024), coalesce(first_tokens, 0))) // 2, 224) AS stride
  FROM sized LEFT JOIN (
    SELECT conv_id AS s_conv, arg_min(tokens, row(coalesce(turn, -4611686018427387904), text)) AS first_tokens FROM sized WHERE role = 'system' GROUP BY conv_id
  ) s ON conv_id IS NOT DISTINCT FROM s_conv
), windows AS (
  SELECT conv_id, before // stride AS stretch, tokens > stride AS large, min(before) AS begins FROM turns GROUP BY ALL
), instructions AS (
  SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY before) AS reached, row_number() OVER (PARTITION BY conv_id ORDER BY before) AS nth FROM turns WHERE role = 'system'
), repeated AS (
  SELECT w.conv_id, t.chars FROM windows w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id
  WHERE t.role <> 'system' AND t.tokens <= 256 AND t.before + t.tokens <= w.begins AND t.before >= w.begins - 256
  UNION ALL
  SELECT w.conv_id, l.chars FROM windows w JOIN instructions l ON w.conv_id IS NOT DISTINCT FROM l.conv_id WHERE (l.reached <= 1024 OR l.nth = 1) AND l.before < w.begins
), extra AS (
  SELECT conv_id, sum(chars) AS chars FROM repeated GROUP BY conv_id
), told AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY before) AS turns,
         coalesce(string_agg(text, '' ORDER BY before) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars
  FROM turns GROUP BY conv_id
)
SELECT t.conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
       (t.chars + coalesce(e.chars, 0))::BIGINT AS formatted_chars
FROM told t LEFT JOIN extra e ON t.conv_id IS NOT DISTINCT FROM e.conv_id
"""

DECONTAMINATION = rf"""
WITH doc_words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({FOLDED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM documents
), item_words AS (
  SELECT item_id::VARCHAR AS item_id, regexp_extract_all({FOLDED}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS words FROM benchmark WHERE item_id IS NOT NULL
), items AS (
  SELECT item_id, words, least(len(words), 13) AS width FROM item_words WHERE len(words) > 0
), item_places AS (
  SELECT item_id, words, width, unnest(range(1, len(words) - width + 2)) AS i FROM items
), wanted AS (
  SELECT DISTINCT item_id, width, array_to_string(words[i:i + width - 1], ' ') AS win FROM item_places
), widths AS (
  SELECT DISTINCT width FROM items
), doc_places AS (
  SELECT rid, words, width, unnest(range(1, len(words) - width + 2)) AS i FROM doc_words, widths WHERE len(words) >= width
), met AS (
  SELECT rid, i, p.width, item_id FROM (SELECT *, array_to_string(words[i:i + width - 1], ' ') AS win FROM doc_places) p
  JOIN wanted w ON p.width = w.width AND p.win = w.win
), hits AS (
  SELECT rid, count(DISTINCT place) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + width)) AS place FROM met) GROUP BY rid
), found AS (
  SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM met) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(h.n, 0)::BIGINT AS n_hit, coalesce(f.n, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AND 20 * coalesce(h.n, 0) >= len(words) AS contaminated
FROM doc_words LEFT JOIN hits h USING (rid) LEFT JOIN found f USING (rid)
"""

# The rules as the query has them, longest first: host, path, rule, verdict.
URL_CASES = (
    ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("example.com", "/en/", "example.com/en/", "block"),
    ("net", "/es/", "net/es/", "block"),
    ("net", "/fr/", "net/fr/", "block"),
    ("com", "/", "com/", "allow"),
)


def _rule_case(column: int) -> str:
    """CASE over the rules that gives this column of the first that fits, else null."""
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    return "CASE " + " ".join(f"WHEN {fits.format(*c)} THEN '{c[column]}'" for c in URL_CASES) + " END"


URL_HEAD = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), rows AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), split AS (
  SELECT *, string_split(ltrim(path, '/'), '/') AS segments FROM rows
), shaped AS (
  SELECT page_id, host, path, list_concat(list_transform(segments[1:4], lambda s: CASE
           WHEN regexp_matches(s, '^[0-9]+$') THEN '{n}'
           WHEN regexp_matches(s, '^[0-9]+(\.[A-Za-z]{2,5})$') THEN '{n}.ext'
           WHEN regexp_matches(s, '^[0-9a-fA-F]{8,}$|^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$') THEN '{hex}'
           WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$') THEN '{date}' ELSE s END),
         CASE WHEN len(segments) > 4 THEN ['**'] ELSE [] END) AS shape FROM split
), known AS (
  SELECT doc_id AS page_id, max(1 - quality)::BIGINT AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id
), tree0 AS (
  SELECT host, shape, count(*) AS n, count(bad) AS labelled, coalesce(sum(bad), 0)::BIGINT AS bad, '' AS template
  FROM shaped LEFT JOIN known USING (page_id) GROUP BY host, shape
)"""
# One level of the tree; {0} is the level, {1} the next one.
URL_LEVEL = """, child{0} AS (
  SELECT host, template, shape[{1}] AS segment, sum(n) AS n, sum(labelled) AS labelled, sum(bad) AS bad
  FROM tree{0} WHERE len(shape) > {0} GROUP BY ALL
), parent{0} AS (
  SELECT host, template, count(*) AS children, sum(n) AS all_n, sum(labelled) AS all_labelled, sum(bad) AS all_bad FROM child{0} GROUP BY ALL
), compared{0} AS (
  SELECT *, (all_bad + 1) / (all_labelled + 2) AS pooled, all_labelled - labelled AS others,
         abs((bad + 1) / (labelled + 2) - (all_bad - bad + 1) / (all_labelled - labelled + 2)) AS gap FROM child{0} JOIN parent{0} USING (host, template)
), named{0} AS (
  SELECT host, template, segment, CASE WHEN (children > 20 AND children > 0.5::DOUBLE * all_n)
         OR (gap < 2.0::DOUBLE * sqrt(pooled * (1 - pooled) * (1 / (labelled + 2) + 1 / (others + 2))) AND children > 1) THEN '*' ELSE segment END AS name
  FROM compared{0}
), tree{1} AS (
  SELECT t.host, t.shape, t.n, t.labelled, t.bad, t.template || coalesce('/' || d.name, '') AS template
  FROM tree{0} t LEFT JOIN named{0} d ON t.host = d.host AND t.template = d.template AND t.shape[{1}] = d.segment
)"""
URL_TAIL = f""", leaves AS (
  SELECT host, shape, labelled, bad, template || CASE WHEN len(shape) > 4 THEN '/**' ELSE '' END AS template FROM tree4
), prior AS (
  SELECT coalesce((sum(bad) + 1) / (count(*) + 2), 0.5::DOUBLE) AS share FROM known
), purity AS (
  SELECT host, template, (sum(bad) + 10.0::DOUBLE * (SELECT share FROM prior)) / (sum(labelled) + 10.0::DOUBLE) AS bad_share FROM leaves GROUP BY ALL
)
SELECT page_id, host, path, {_rule_case(2)} AS rule,
       coalesce({_rule_case(3)}, CASE WHEN bad_share > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM shaped JOIN leaves USING (host, shape) JOIN purity USING (host, template)
"""
URLS = URL_HEAD + "".join(URL_LEVEL.format(level, level + 1) for level in range(4)) + URL_TAIL

LINES = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS held FROM documents
), lines AS (
  SELECT rid, doc_id, unnest(held) AS line, generate_subscripts(held, 1) AS place FROM texts
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM (SELECT DISTINCT key, doc_id FROM keyed WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3
), judged AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""

MANIFEST = r"""
WITH RECURSIVE sealed AS (
  SELECT row_number() OVER () AS rid, coalesce('=' || lang, '') AS grp, *,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR END,
           CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END, CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
    CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail,
    list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
      list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS flipped
  FROM documents
), leaves AS (
  SELECT rid, grp, doc_id, sha256(concat(head, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END, tail)) AS leaf,
    CASE WHEN xor(flipped, 4294967295) % 7 = 0 AND n_chars IS NOT NULL THEN sha256(concat(head, strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), tail)) END AS changed
  FROM sealed
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM leaves
), trees(grp, depth, i, n, node) AS (
  SELECT grp, 0, i, n, leaf FROM numbered
  UNION ALL
  SELECT grp, depth + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM trees WHERE n > 1 GROUP BY grp, depth, i // 2, n
), subroots AS (
  SELECT grp, depth AS height, node, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS n FROM trees WHERE n = 1
), tops(depth, i, n, node) AS (
  SELECT 0, i, n, node FROM subroots
  UNION ALL
  SELECT depth + 1, i // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY depth, i // 2, n
), root AS (
  SELECT node, depth AS height FROM tops WHERE n = 1
), steps AS (
  SELECT l.rid, d.depth AS step, ((l.i >> d.depth) & 1)::INT AS side, t.node
  FROM numbered l JOIN subroots s ON l.grp = s.grp JOIN (SELECT DISTINCT grp, depth FROM trees) d ON d.grp = l.grp AND d.depth < s.height
  LEFT JOIN trees t ON t.grp = l.grp AND t.depth = d.depth AND t.i = xor(l.i >> d.depth, 1)
  UNION ALL
  SELECT l.rid, 1000 + d.depth, ((s.i >> d.depth) & 1)::INT, t.node
  FROM numbered l JOIN subroots s ON l.grp = s.grp JOIN (SELECT DISTINCT depth FROM tops) d ON d.depth < (SELECT height FROM root)
  LEFT JOIN tops t ON t.depth = d.depth AND t.i = xor(s.i >> d.depth, 1)
), paths AS (
  SELECT rid, sha256(coalesce(string_agg(node, '' ORDER BY step), '')) AS proof_sha256, list(CASE WHEN node IS NULL THEN '' WHEN side = 1 THEN node || '<' ELSE '>' || node END ORDER BY step) AS path
  FROM steps GROUP BY rid
), told AS (
  SELECT l.doc_id, l.leaf, s.node AS subroot, r.node AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(l.changed, l.leaf), coalesce(p.path, []::VARCHAR[])), lambda node, step:
      CASE WHEN step = '' THEN sha256(node) WHEN step[1] = '>' THEN sha256(node || step[2:]) ELSE sha256(step[:-2] || node) END) AS folded_root
  FROM numbered l JOIN subroots s ON l.grp = s.grp CROSS JOIN root r LEFT JOIN paths p ON p.rid = l.rid
)
SELECT *, folded_root = root AS verified FROM told
"""

ORACLE: dict[str, str] = {
    "op2_url_filters": URLS,
    "op4_quality_rules": QUALITY,
    "op7_chat_windows": CHAT,
    "op9_decontamination": DECONTAMINATION,
    "op11_merkle_manifest": MANIFEST,
    "op12_line_dedup": LINES,
}
