"""The queries as plain SQL for DuckDB, without the operators' methods: whole strings, full sorts, all pairs."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LINES = f"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos, len(string_split(text, chr(10))) AS n
  FROM documents WHERE text <> ''
), w AS (
  SELECT *, regexp_extract_all(line, '[^.!?]*[.!?]+[ \\t\\r\\x0b\\x0c]*|[^.!?]+') AS p FROM l
), u AS (
  SELECT doc_id, pos, 0 AS sub, line AS piece FROM w
  UNION ALL
  SELECT doc_id, pos, generate_subscripts(p, 1) AS sub, unnest(p) AS piece FROM w WHERE len(p) > 1
), v AS (
  SELECT *, trim(regexp_replace(translate(piece, '{UPPER}', '{LOWER}'), '[ \\t\\r\\x0b\\x0c]+', ' ', 'g')) AS norm FROM u
), c AS (
  SELECT *, norm <> '' AND (sub = 0 OR len(string_split(norm, ' ')) >= 5) AS unit FROM v
), r AS (
  SELECT *, unit AND row_number() OVER (PARTITION BY norm, unit ORDER BY doc_id, pos, sub) > 1 AS again FROM c
), x AS (
  SELECT r.doc_id, r.pos, r.sub, r.again AS gone,
         r.piece || CASE WHEN w.pos < w.n AND r.sub IN (0, len(w.p)) THEN chr(10) ELSE '' END AS whole
  FROM r JOIN w USING (doc_id, pos) JOIN (SELECT doc_id, pos, again AS line_gone FROM r WHERE sub = 0) g USING (doc_id, pos)
  WHERE (r.sub = 0) = (line_gone OR len(w.p) <= 1)
), s AS (
  SELECT doc_id, count(DISTINCT pos) AS n_lines, count(*) FILTER (gone) AS n_removed,
         coalesce(sum(strlen(whole)) FILTER (gone), 0) AS bytes_removed,
         coalesce(string_agg(whole, '' ORDER BY pos, sub) FILTER (NOT gone), '') AS kept
  FROM x GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(bytes_removed, 0)::BIGINT AS bytes_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""

_REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (
  SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS s
  FROM d, LATERAL (SELECT unnest(range(1, length(h) // 2 - 48)) AS i)
), f AS (
  SELECT s, min(doc_id) AS first FROM p GROUP BY s HAVING min(doc_id) < max(doc_id)
), m AS (
  SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM p JOIN f USING (s) WHERE first < doc_id
), r AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM m GROUP BY doc_id, run
), n AS (
  SELECT *, coalesce(a > lag(b) OVER (PARTITION BY doc_id ORDER BY a), true) AS head FROM r
), o AS (
  SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY a) AS span FROM n
), c AS (
  SELECT doc_id, min(a) AS a, max(b) AS b FROM o GROUP BY doc_id, span
), k AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 1) AS before,
         lead(a) OVER (PARTITION BY doc_id ORDER BY a) IS NULL AS last
  FROM c
), e AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans,
         string_agg(substr(h, 2 * before - 1, 2 * (a - before)) || CASE WHEN last THEN substr(h, 2 * b - 1) ELSE '' END, '' ORDER BY a) AS kept
  FROM k JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed,
       coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id)
"""

_SCORES = """
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents WHERE text IS NOT NULL
), t AS (
  SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d
), x AS (
  SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM t
), one AS (SELECT w, count(*) AS n FROM t GROUP BY w),
two AS (SELECT v, w, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY v, w HAVING count(*) >= 2),
total AS (SELECT sum(n) AS n FROM one),
s AS (
  SELECT doc_id, CASE
      WHEN x.v IS NULL THEN round(log10(b.n / total.n) * 1e9)
      WHEN two.n IS NULL THEN round((log10(0.4) + log10(b.n / total.n)) * 1e9)
      ELSE round(log10(two.n / a.n) * 1e9) END::BIGINT AS value,
    (x.v IS NOT NULL AND two.n IS NULL)::BIGINT AS off
  FROM x JOIN one b ON b.w = x.w LEFT JOIN one a ON a.w = x.v
  LEFT JOIN two ON two.v = x.v AND two.w = x.w CROSS JOIN total
), g AS (SELECT doc_id, count(*) AS n, sum(value)::BIGINT AS value, sum(off) AS off FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(g.n, 0)::BIGINT AS n_words, coalesce(off, 0)::BIGINT AS n_backed_off,
       coalesce(value, 0) / 1000000000 AS log10_score, value / 1000000000 / g.n AS log10_per_word
FROM documents LEFT JOIN g USING (doc_id)
"""

_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(x, y) AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, least(x, min(y)) AS component FROM r GROUP BY x),
n AS (SELECT x, count(*) AS n FROM l GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component, vec_id) AS component_id,
       vec_id = coalesce(component, vec_id) AS kept
FROM embeddings LEFT JOIN c ON c.x = vec_id LEFT JOIN n ON n.x = vec_id
"""

_RECORD = """'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
    || 'WARC-Record-ID: <urn:md5:' || md5(concat_ws('|', page_id, uri)) || '>' || chr(13) || chr(10)
    || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || uri || chr(13) || chr(10)
    || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body)
    || chr(13) || chr(10) || chr(13) || chr(10) || body"""
_FIXITY = f"""
WITH p AS (
  SELECT page_id, coalesce(page_id // 1000, -1) AS file, coalesce(html, '') AS body,
         regexp_replace(coalesce(url, ''), '[\\x00-\\x20]', '%20', 'g') AS uri
  FROM pages
), r AS (SELECT page_id, file, {_RECORD} AS rec FROM p),
o AS (
  SELECT *, coalesce(sum(strlen(rec) + 4) OVER (PARTITION BY file ORDER BY page_id, rec
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM r
)
SELECT file, "offset", CASE WHEN page_id % 89 = 0 THEN 'missing' ELSE 'changed' END AS status,
       sha256(rec) AS primary_digest, CASE WHEN page_id % 89 <> 0 THEN sha256('!' || substr(rec, 2)) END AS replica_digest
FROM o WHERE page_id % 89 = 0 OR page_id % 97 = 0
"""

_CHATS = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS spot
  FROM t
), h AS (
  SELECT *, md5(string_agg(coalesce('=' || role, '') || chr(1) || coalesce('=' || text, ''), chr(2))
           OVER (PARTITION BY conv_id ORDER BY spot)) AS p, count(*) OVER (PARTITION BY conv_id) AS n
  FROM o
), f AS (SELECT spot, p, min(conv_id) AS conv_id, count(*) AS n_logged FROM h WHERE spot = n GROUP BY spot, p),
k AS (
  SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.spot < h.n AND h.spot = f.spot AND h.p = f.p)
)
SELECT k.conv_id, (o.spot - 1) // 256 AS part, k.spot AS n_turns, n_logged,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || replace(coalesce(text, ''), '<|', '< |')
                  || '<|im_end|>' || chr(10), '' ORDER BY o.spot) AS rendered
FROM k JOIN o USING (conv_id) GROUP BY ALL
"""

_MIX = """
WITH s AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), b AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
k AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS rank FROM b),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][rank % 3 + 1] AS weight, [1.5::DOUBLE, 1.0, 0.5][rank % 3 + 1] AS a,
         [0.5::DOUBLE, 1.0, 1.5][rank % 3 + 1] AS z, source_size::DOUBLE * 3 AS cap
  FROM k
), l AS (
  SELECT *, row_number() OVER q AS place, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER p, 0))
         / (sum(weight) OVER () - coalesce(sum(weight) OVER p, 0)) AS own
  FROM w WINDOW q AS (ORDER BY cap / weight, rank),
         p AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT *, least(cap, weight * coalesce((SELECT arg_min(own, place) FROM l WHERE cap > weight * own), 0)) AS target FROM l
), c AS (
  SELECT s.*, source_size, target, a, z, coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source
), x AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS q,
         least(before::DOUBLE / nullif(target, 0), 1.0) AS share
  FROM c
), y AS (
  SELECT *, q * size + least(greatest(floor(target)::BIGINT - q * source_size - before, 0), size) AS taken FROM x
)
SELECT doc_id, size, source_size, target, taken, source, CASE WHEN taken > 0 THEN
    (a + z) / 2 * share * 2 / (a + sqrt(greatest(a * a + (z - a) * ((a + z) / 2) * share * 2, 0.0))) END AS position
FROM y
"""

_HITS = f"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+'), []) AS w
  FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM benchmark
), n AS (
  SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0
), g AS (
  SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM n, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)
), p AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS gram
  FROM d, (SELECT DISTINCT size FROM g), LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS i)
), h AS (SELECT doc_id, item_id, i, p.size FROM p JOIN g USING (size, gram)),
c AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS spot FROM h) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike,
         list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT anchor_id, positive_id, positive_score, other AS negative_id, score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT alike AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

# CRC-32 (reflected, polynomial 0xEDB88320) of an ASCII string, bit by bit; then rows after damage; then one step a
# row over all states of the pattern, with up to two insertions before each row and at the end.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT FOR c IN string_split(key, '')]),
  lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
    lambda x, i: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""

_REPAIR = f"""
WITH RECURSIVE k AS (
  SELECT *, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC} % 20 AS kind FROM k
), d AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c WHERE kind <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
         left(role, 1) AS r, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM d
), f AS (
  SELECT *, t = '' AS blank, t <> '' AND again AS duplicate,
         t <> '' AND NOT again AND right(t, 1) NOT IN ('.', '!', '?') AS truncated,
         coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM o
), g AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal, count(*) AS n
  FROM f GROUP BY conv_id
), e(st, edit, sys, usr, ast, cost, nxt) AS (
  VALUES (0, 'K', true, false, false, 0, 1), (0, 'K', false, true, false, 0, 2), (1, 'K', false, true, false, 0, 2),
         (3, 'K', false, true, false, 0, 2), (2, 'K', false, false, true, 0, 3), (0, 'R', true, true, true, 3, 2),
         (1, 'R', true, true, true, 3, 2), (3, 'R', true, true, true, 3, 2), (2, 'R', true, true, true, 3, 3)
), ins(st, n, nxt) AS (
  VALUES (0, 0, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (0, 1, 2), (1, 1, 2), (2, 1, 3), (3, 1, 2),
         (0, 2, 3), (1, 2, 3), (2, 2, 2), (3, 2, 3)
), w AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS st, 0 AS cost, '' AS audit, '' AS made FROM g
  UNION ALL
  (WITH step AS (
    SELECT w.conv_id, f.i, x.st, w.cost + ins.n * 3 + x.cost AS cost, w.audit || repeat('I', ins.n) || x.edit AS audit,
           w.made || CASE ins.n WHEN 0 THEN '' WHEN 1 THEN CASE ins.nxt WHEN 2 THEN 'user:' ELSE 'assistant:' END || chr(10)
             ELSE CASE ins.nxt WHEN 3 THEN 'user:' || chr(10) || 'assistant:' ELSE 'assistant:' || chr(10) || 'user:' END || chr(10) END
           || CASE x.edit WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
              ELSE CASE x.st WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) END AS made
    FROM w JOIN ins ON ins.st = w.st JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1,
    LATERAL (
      SELECT ins.nxt AS st, 'D' AS edit, 4 AS cost
      UNION ALL
      SELECT e.nxt, e.edit, e.cost + CASE WHEN f.truncated THEN 3 ELSE 0 END FROM e
      WHERE e.st = ins.nxt AND NOT f.blank AND NOT f.duplicate
        AND (e.edit = 'R' OR e.sys AND f.r = 's' OR e.usr AND f.r = 'u' OR e.ast AND f.r = 'a')
    ) x
  )
  SELECT conv_id, i, st, cost, audit, made FROM step
  QUALIFY row_number() OVER (PARTITION BY conv_id, st ORDER BY cost, audit) = 1)
), y AS (
  SELECT w.conv_id, w.cost + ins.n * 3 AS total, w.audit || repeat('I', ins.n) AS edits,
         w.made || CASE ins.n WHEN 0 THEN '' WHEN 1 THEN 'assistant:' || chr(10)
           ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END AS made
  FROM w JOIN g ON g.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = g.n JOIN ins ON ins.st = w.st AND ins.nxt IN (0, 3)
), z AS (
  SELECT conv_id, total AS cost, edits AS audit, made FROM y
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY total, edits) = 1
)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(left(made, length(made) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM a.conv_id
"""

ORACLE_SQL: dict[str, str] = {
    "op1_line_dedup": _LINES,
    "op2_suffix_array_dedup": _REPEATS,
    "op3_lm_scoring": _SCORES,
    "op5_lattice_near_dedup": _LINKS,
    "op7_merkle_fixity": _FIXITY,
    "op8_chat_collapse": _CHATS,
    "op9_source_mixing": _MIX,
    "op10_wu_manber_decontamination": _HITS,
    "op12_bidirectional_repair": _REPAIR,
    "op13_four_russians_negatives": _NEGATIVES,
}
