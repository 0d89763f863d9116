"""DuckDB statements equivalent to the queries that SQL can express.

The others are trained models, encoders or approximate searches, or their rows depend on
hashes; tests compare them with brute-force versions.
"""

from __future__ import annotations

_URLS = r"""
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), rules(rule_host, rule_path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
         ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), fits AS (
  SELECT n, rule_host || rule_path AS rule, verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC) AS place
  FROM split JOIN rules
    ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN (SELECT * FROM fits WHERE place = 1) USING (n)
"""


def _escaped(text: str) -> str:
    """SQL that puts a backslash before itself and before the control strings of the template.

    None of these strings starts or ends within another one, so the order does not matter.
    """
    marks = ["[/INST]", "[INST]", "<</SYS>>", "<<SYS>>", "</ROLE>", "<ROLE:", "</s>", "<s>", "|>"]
    out = f"replace({text}, '\\', '\\\\')"
    for mark in marks:
        out = f"replace({out}, '{mark}', '\\{mark}')"
    return out


_CHAT = f"""
WITH turns AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL
  VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), formatted AS (
  SELECT *, {_escaped("text")} AS escaped,
    CASE role WHEN 'system' THEN length('<<SYS>><</SYS>>') WHEN 'user' THEN length('[INST][/INST]')
      WHEN 'assistant' THEN length('<s></s>')
      ELSE length('<ROLE:|></ROLE>') + length({_escaped("role")}) END AS markers,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS after
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + markers)::BIGINT AS formatted_chars,
  bool_and(CASE role
    WHEN 'system' THEN before IS NULL
    WHEN 'user' THEN before IS NULL OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN coalesce(before = 'user', false)
    ELSE false END AND (after IS NOT NULL OR role = 'assistant')) AS valid
FROM formatted GROUP BY conv_id
"""

_NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(
    CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words
), sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT u, v FROM common JOIN sizes p ON p.doc_id = u JOIN sizes q ON q.doc_id = v
  WHERE 100 * k >= 85 * (p.n + q.n - k)
), both_ways AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(doc_id, other) AS (
  SELECT DISTINCT u, u FROM both_ways
  UNION
  SELECT doc_id, v FROM reach JOIN both_ways ON other = u
), roots AS (SELECT doc_id, min(other) AS root FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id,
  coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""


# Pages whose article is marked as one: its blocks, without tags, decoded.
_HTML = r"""
WITH articles AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS article FROM pages
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(
    string_split(regexp_replace(article, '</?(p|h1)>', chr(1), 'g'), chr(1)),
    lambda block: trim(regexp_replace(
      regexp_replace(replace(replace(replace(
        regexp_replace(replace(block, '<br>', ' '), '<[^>]*>', '', 'g'),
        '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g'),
      '[\x20\x09-\x0D]+', ' ', 'g'), ' ')), lambda block: block <> '') AS found
  FROM articles
)
SELECT page_id, url, array_to_string(found, chr(10) || chr(10)) AS text,
  length(array_to_string(found, chr(10) || chr(10)))::BIGINT AS n_chars
FROM blocks
"""

# CRC-32 of the UTF-8 bytes of ``name``: a table of 256 entries by rule, then a fold over the bytes.
_CRC = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, i:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) AS entries
  FROM range(256) AS t(n)
), crcs AS MATERIALIZED (
  SELECT name, xor(list_reduce(
    list_transform(range(1, length(hex(encode(name))), 2), lambda i:
      16 * (instr('0123456789ABCDEF', substr(hex(encode(name)), i, 1)) - 1)
      + instr('0123456789ABCDEF', substr(hex(encode(name)), i + 1, 1)) - 1),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS crc
  FROM (SELECT DISTINCT name FROM names), crc_table
)"""

# Cheapest edits forwards, row by row: the least (cost, edits) of each state, with up to two insertions.
_REPAIR = rf"""
WITH RECURSIVE names AS (
  SELECT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), {_CRC},
damaged AS MATERIALIZED (
  SELECT conv_id, turn, CASE WHEN crc % 20 = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
    CASE crc % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g')
      ELSE coalesce(text, ' ') END AS text
  FROM conversations JOIN crcs ON name = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '),
    range(CASE WHEN crc % 20 = 3 THEN 2 ELSE 1 END)
  WHERE crc % 20 <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), judged AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' 
      WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'none' END AS fault,
    left(role, 1) AS initial
  FROM placed
), inserts(state, k, after, edits, said) AS (
  VALUES (0, 0, 0, '', ''), (0, 1, 2, 'I', 'user:'), (0, 2, 3, 'II', 'user:' || chr(10) || 'assistant:'),
    (1, 0, 1, '', ''), (1, 1, 2, 'I', 'user:'), (1, 2, 3, 'II', 'user:' || chr(10) || 'assistant:'),
    (2, 0, 2, '', ''), (2, 1, 3, 'I', 'assistant:'), (3, 0, 3, '', ''), (3, 1, 2, 'I', 'user:')
), edits(state, edit, initial, after, role) AS (
  VALUES (0, 'D', NULL, 0, NULL), (1, 'D', NULL, 1, NULL), (2, 'D', NULL, 2, NULL), (3, 'D', NULL, 3, NULL),
    (0, 'K', 's', 1, NULL), (0, 'K', 'u', 2, NULL), (1, 'K', 'u', 2, NULL), (2, 'K', 'a', 3, NULL), (3, 'K', 'u', 2, NULL),
    (0, 'R', NULL, 2, 'user'), (1, 'R', NULL, 2, 'user'), (2, 'R', NULL, 3, 'assistant'), (3, 'R', NULL, 2, 'user')
), path AS (
  SELECT conv_id, 0 AS i, after AS state, {{'cost': 2 * k, 'edits': edits, 'said': said}} AS best
  FROM (SELECT DISTINCT conv_id FROM conversations), inserts WHERE state = 0
  UNION ALL
  SELECT conv_id, i, n.after,
    min({{'cost': cost + 2 * k, 'edits': so_far || n.edits,
         'said': so_far_said || CASE WHEN so_far_said <> '' AND n.said <> '' THEN chr(10) ELSE '' END || n.said}})
  FROM (
    SELECT p.conv_id, r.i, e.after AS state, best.edits || edit AS so_far,
      best.cost + CASE edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
        + CASE WHEN edit <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost,
      best.said || CASE WHEN edit = 'D' THEN ''
        ELSE CASE WHEN best.said = '' THEN '' ELSE chr(10) END || coalesce(e.role, r.role) || ':' || text END AS so_far_said
    FROM path p JOIN judged r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1
    JOIN edits e ON e.state = p.state AND (e.initial IS NULL OR e.initial = r.initial)
      AND (edit = 'D' OR fault NOT IN ('blank', 'duplicate'))
  ) JOIN inserts n USING (state)
  GROUP BY conv_id, i, n.after
), last_row AS (
  SELECT conv_id, max(i) AS n, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated
  FROM judged GROUP BY conv_id
), pairs AS (
  SELECT conv_id, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT conv_id, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM judged)
  GROUP BY conv_id
), repaired AS (
  SELECT conv_id, i, min(best) AS best FROM path WHERE state IN (0, 3) GROUP BY conv_id, i
)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
  coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.edits AS audit, sha256(best.said) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN last_row l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN pairs q ON q.conv_id IS NOT DISTINCT FROM c.conv_id
JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM c.conv_id AND r.i = coalesce(l.n, 0)
"""

_RESAMPLE = rf"""
WITH texts AS (
  SELECT 0 AS target, row_number() OVER () AS n, doc_id, text FROM documents
  UNION ALL SELECT 1, -1 - row_number() OVER (), NULL, text FROM benchmark
), words AS MATERIALIZED (
  SELECT target, n, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS MATERIALIZED (SELECT target, n, unnest(w) AS name FROM words),
names AS (SELECT name FROM features), {_CRC},
hits AS MATERIALIZED (
  SELECT target, n, crc % 10000 AS bucket, count(*) AS k
  FROM features JOIN crcs USING (name) GROUP BY ALL
), counts AS (
  SELECT bucket, coalesce(sum(k) FILTER (target = 0), 0)::DOUBLE AS s,
    coalesce(sum(k) FILTER (target = 1), 0)::DOUBLE AS t
  FROM hits GROUP BY bucket
), gains AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain
  FROM counts
), weights AS (
  SELECT n, floor(sum(k * gain) / sum(k)::DOUBLE)::BIGINT AS weight
  FROM hits JOIN gains USING (bucket) WHERE target = 0 GROUP BY n
), scored AS (
  SELECT n, doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((
      ('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weights USING (n) WHERE target = 0
), placed AS (
  SELECT n, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS open_rows
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score,
  CASE WHEN place <= 10 * open_rows // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (n)
"""


def statements() -> dict[str, str]:
    return {
        "op5_url_rules": _URLS,
        "op8_chat_format": _CHAT,
        "op9_near_duplicates": _NEAR,
        "op11_html_text": _HTML,
        "op12_conversation_repair": _REPAIR,
        "op13_importance_resampling": _RESAMPLE,
    }
