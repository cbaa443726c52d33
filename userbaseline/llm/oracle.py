"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

from userbaseline.llm.line_dedup import FOLDED, UPPER

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FOLD = f"'{UPPER}', '{FOLDED}'"

LINES = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), {_FOLD}) AS key FROM e),
f AS (SELECT key AS dropped FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(dropped) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN dropped IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM k LEFT JOIN f ON key = dropped GROUP BY doc_id
"""

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
e AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS i
  FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM p WHERE 100 * i >= 75 * (na + nb - i)
  UNION SELECT b, a FROM p WHERE 100 * i >= 75 * (na + nb - i)),
r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a)
SELECT s.doc_id, len(g) AS n_shingles, c.component_id
FROM s JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1) c USING (doc_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS newest FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> newest THEN newest END AS refers_to
FROM m
"""

CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<turn >' || '</turn>')
    + length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))
    + length(replace(replace(text, '&', '&amp;'), '<', '&lt;'))) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""

# doc_ids are unique here; levels below 0 are those of the upper tree
_HELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_LEAF = " || ".join(_HELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_CRC_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"

MERKLE = f"""
WITH RECURSIVE bits(c, b, k) AS (
  SELECT CAST(i AS BIGINT), i, 0 FROM range(256) t(i) UNION ALL SELECT {_CRC_STEP}, b, k + 1 FROM bits WHERE k < 8),
crcs AS (SELECT list(c ORDER BY b) AS crc_table FROM bits WHERE k = 8),
d AS (
  SELECT doc_id, coalesce('s' || source, '') AS grp, sha256({_LEAF} || {_HELD.format("text")}) AS leaf,
    sha256({_LEAF} || {_HELD.format(f"translate(text, {_FOLD})")}) AS changed,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda a, x: xor(crc_table[(xor(a, x) & 255) + 1], a >> 8)), 4294967295) AS crc
  FROM documents, crcs),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n FROM d),
lo(grp, level, pos, h, n) AS (
  SELECT grp, 0, pos, leaf, n FROM placed
  UNION ALL SELECT grp, level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16
  FROM lo WHERE n > 1 GROUP BY grp, level, pos // 16, n),
subroots AS (
  SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM lo WHERE n = 1),
up(level, pos, h, n) AS (
  SELECT 0, place, subroot, n FROM subroots
  UNION ALL SELECT level + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16
  FROM up WHERE n > 1 GROUP BY level, pos // 16, n),
nodes AS MATERIALIZED (
  SELECT grp, level, pos, h, n FROM lo WHERE n > 1
  UNION ALL SELECT NULL, level + 1000, pos, h, n FROM up WHERE n > 1),
ways AS MATERIALIZED (
  SELECT p.doc_id, p.grp, p.leaf, subroot, CASE WHEN crc % 5 = 0 THEN changed ELSE leaf END AS found, pos, place
  FROM placed p JOIN subroots USING (grp)),
steps(doc_id, grp, level, pos, h, above, ended, said) AS (
  SELECT doc_id, grp, 0, pos, found, place, false, '' FROM ways
  UNION ALL SELECT s.doc_id, any_value(s.grp), any_value(CASE WHEN r.h IS NULL THEN 1000 ELSE s.level + 1 END),
    any_value(CASE WHEN r.h IS NULL THEN s.above ELSE s.pos // 16 END),
    coalesce(sha256(string_agg(CASE WHEN r.pos = s.pos THEN s.h ELSE r.h END, '' ORDER BY r.pos)), any_value(s.h)),
    any_value(s.above), any_value(r.h IS NULL AND s.level >= 1000),
    any_value(s.said) || coalesce(string_agg(CASE WHEN r.pos <> s.pos THEN r.h END, '' ORDER BY r.pos), '')
  FROM steps s LEFT JOIN nodes r ON r.level = s.level AND (r.grp = s.grp OR s.level >= 1000) AND r.pos // 16 = s.pos // 16
  WHERE NOT s.ended GROUP BY s.doc_id)
SELECT w.doc_id, leaf, subroot, u.h AS root, sha256(s.said) AS proof_sha256, s.h AS folded_root, s.h = u.h AS verified
FROM ways w JOIN steps s ON s.doc_id = w.doc_id AND s.ended CROSS JOIN (SELECT h FROM up WHERE n = 1) u
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_jaccard_join": JACCARD, "op7_line_dedup": LINES, "op8_warc": WARC, "op10_chat_tree": CHAT, "op11_merkle_manifest": MERKLE}
