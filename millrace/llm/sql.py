"""SQL of the operators that DuckDB can state, over the same tables."""

COPIES = r"""
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
WINDOW w AS (PARTITION BY t)
"""

#: crc32 from its table of 256 entries; then the levels of all trees, in which a node knows the digests beside it.
MANIFEST = r"""
WITH RECURSIVE crc(b, step, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT b, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE step < 8),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM crc WHERE step = 8),
chosen AS (
  SELECT d.*, coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 3 = 0, false) AS changed
  FROM documents d, crc_table),
fields AS (
  SELECT doc_id, lang, text, CASE WHEN changed THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS given,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM chosen),
leaves AS (
  SELECT doc_id, lang, leaf, given, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i
  FROM (SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(given) || ':' || given, '-')) AS given FROM fields)),
nodes(lang, level, i, h, n) AS (
  SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8, n),
subroots AS (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops(level, i, h, n) AS (
  SELECT 0, i, h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (n + 7) // 8 FROM tops WHERE n > 1 GROUP BY level, i // 8, n),
steps AS (
  SELECT lang, level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM nodes WHERE n > 1 WINDOW w AS (PARTITION BY lang, level, i // 8 ORDER BY i)),
top_steps AS (
  SELECT level, i, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
    coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM tops WHERE n > 1 WINDOW w AS (PARTITION BY level, i // 8 ORDER BY i)),
depths AS (SELECT lang, max(level) AS depth FROM nodes GROUP BY lang),
every_step AS (
  SELECT lang, level AS step, false AS upper, i, l, r FROM steps
  UNION ALL SELECT s.lang, depth + level, true, t.i, l, r
  FROM subroots s JOIN depths ON depths.lang IS NOT DISTINCT FROM s.lang JOIN top_steps t ON t.i = s.i // (8 ** t.level)::BIGINT),
path(doc_id, leaf, lang, i, step, h, proof) AS (
  SELECT doc_id, leaf, lang, i, 0, given, '' FROM leaves
  UNION ALL
  SELECT p.doc_id, p.leaf, p.lang, p.i, p.step + 1, sha256(s.l || p.h || s.r), p.proof || s.l || s.r
  FROM path p JOIN every_step s ON s.lang IS NOT DISTINCT FROM p.lang AND s.step = p.step AND (s.upper OR s.i = p.i // (8 ** p.step)::BIGINT))
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, sha256(p.proof) AS proof_sha256, p.h AS folded_root, p.h = t.h AS verified
FROM path p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.lang JOIN depths d ON d.lang IS NOT DISTINCT FROM p.lang JOIN tops t ON t.n = 1
WHERE p.step = d.depth + t.level
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, d, generate_subscripts(ps, 1) AS p, unnest(ps) AS piece
  FROM (SELECT lang, row_number() OVER () AS d,
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps FROM documents)),
words AS (SELECT lang, d, p, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (SELECT lang, d, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
grams AS (SELECT lang, [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] AS ws FROM words WINDOW o AS (PARTITION BY lang, d, p ORDER BY i)),
f AS (
  SELECT lang, size, array_to_string(ws[1:size], ' ') AS phrase, count(*) AS f
  FROM grams, (SELECT unnest([1, 2, 3, 4, 5]) AS size) WHERE ws[size] IS NOT NULL GROUP BY ALL),
totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
candidates AS (SELECT * FROM f WHERE size > 1 AND f >= 100),
kept AS (
  SELECT * FROM candidates c WHERE NOT EXISTS (
    SELECT 1 FROM candidates x WHERE x.lang = c.lang AND x.size > c.size AND 100 * x.f >= 100 * c.f AND contains(' ' || x.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, f AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS lp, array_to_string(string_split(phrase, ' ')[k + 1:size], ' ') AS rp
  FROM kept, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k < size),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, (1000 * c.a::HUGEINT * n) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM lowest QUALIFY rank <= 2000
"""
