"""DuckDB SQL of the queries that SQL can express, on the same tables.

The others (tokenizers, hashing, suffix arrays, models, packing) are tested
against plain Python versions.
"""

WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LINE_DEDUP = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM split),
keyed AS (SELECT *, translate(trim(line, {WHITE}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
held AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
marked AS (SELECT k.doc_id, k.line, k.i, h.owner IS NOT NULL AND h.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN held h USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUALITY_RULES = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, {WORDS} AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (SELECT doc_id, unnest(words) AS a, unnest(range(len(words))) AS i FROM d),
t AS (SELECT doc_id, i, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM t WHERE c IS NOT NULL),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS o FROM r WHERE n > 1) GROUP BY doc_id),
top AS (SELECT doc_id, max(n) AS n FROM (SELECT doc_id, a, count(*) AS n FROM w GROUP BY doc_id, a) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
         len(lines) AS n_lines, coalesce(top.n, 0) AS top_word,
         length(text) - length(replace(text, '!', '')) AS shouts,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS upper_letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS letters,
         len(list_filter(lines, lambda x: regexp_matches(rtrim(x, {WHITE}), '(\.\.\.|…)$'))) AS ellipses,
         len(list_filter(lines, lambda x: regexp_matches(ltrim(x, {WHITE}), '^(- |\* |•)'))) AS bullets
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN top USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR 5 * shouts > n_words OR 2 * upper_letters > letters OR 10 * n_dup_lines > 4 * n_lines
            OR 4 * top_word > n_words OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words)
            OR 10 * ellipses > 3 * n_lines OR 10 * bullets > 9 * n_lines) AS kept
FROM b
"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, len({WORDS}) AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((('0x' || substr(md5('0|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(text)), 1, 13))::BIGINT + 1) / 4503599627370496.0)
         / CASE WHEN size >= 50 AND length(text) BETWEEN 4 * size AND 10 * size THEN 1.0 ELSE 0.5 END AS key
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::BIGINT AS cap,
         [5.0::DOUBLE, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM k GROUP BY source),
f AS (
  SELECT *, 1.5 * sum(source_size) OVER () AS budget,
         (1.5 * sum(source_size) OVER () - (sum(cap) OVER fill - cap)) / (sum(weight) OVER () - sum(weight) OVER fill + weight) * weight >= cap AS capped
  FROM s WINDOW fill AS (ORDER BY cap / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
g AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap::DOUBLE
              ELSE weight * (budget - sum(CASE WHEN capped THEN cap ELSE 0 END) OVER ()) / sum(CASE WHEN capped THEN 0.0 ELSE weight END) OVER () END::DOUBLE AS target
  FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM g),
p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
         sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
c AS (
  SELECT source, max(key) AS cut FROM p
  WHERE upto <= rest OR (upto - size <= rest AND upto - rest < rest - (upto - size)) GROUP BY source)
SELECT p.doc_id, p.size, p.source_size, p.target,
       (p.size * (p.epochs + CASE WHEN p.key <= c.cut AND p.rest > 0 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM p LEFT JOIN c ON p.source IS NOT DISTINCT FROM c.source
"""

FIELD = "coalesce(CAST(octet_length(encode({0})) AS VARCHAR) || ':' || {0}, '-')"
HALF = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
BYTE = f"list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, k: {HALF})"
CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda s: ascii(s)::BIGINT)), lambda c, b: {BYTE}), 4294967295)"
LEAF = "sha256(" + " || ".join(FIELD.format(f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars")) + " || " + FIELD.format("{0}") + ")"

MERKLE = f"""
WITH RECURSIVE
d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered, {CRC} % 3 = 0 AS hit FROM documents),
l AS (
  SELECT doc_id, {LEAF.format("text")} AS leaf, CASE WHEN hit THEN {LEAF.format("lowered")} END AS changed,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g,
         count(*) OVER (PARTITION BY lang) AS n
  FROM d),
nodes AS (
  SELECT g, 0 AS level, place, n, leaf AS hash FROM l
  UNION ALL
  SELECT g, level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY place)) FROM nodes WHERE n > 1 GROUP BY g, level, place // 8),
subroots AS (SELECT g, hash FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, g AS place, count(*) OVER () AS n, hash FROM subroots
  UNION ALL
  SELECT level + 1, place // 8, (any_value(n) + 7) // 8, sha256(string_agg(hash, '' ORDER BY place)) FROM tops WHERE n > 1 GROUP BY level, place // 8),
beside AS (
  SELECT g, level, place, coalesce(string_agg(hash, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(hash, '') OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM nodes WHERE n > 1 WINDOW o AS (PARTITION BY g, level, place // 8 ORDER BY place)),
beside_top AS (
  SELECT level, place, coalesce(string_agg(hash, '') OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
         coalesce(string_agg(hash, '') OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt
  FROM tops WHERE n > 1 WINDOW o AS (PARTITION BY level, place // 8 ORDER BY place)),
walk AS (
  SELECT doc_id, leaf, g, 0 AS level, place, n, '' AS proof, coalesce(changed, leaf) AS node FROM l
  UNION ALL
  SELECT w.doc_id, w.leaf, w.g, w.level + 1, w.place // 8, (w.n + 7) // 8, w.proof || b.lft || b.rgt, sha256(b.lft || w.node || b.rgt)
  FROM walk w JOIN beside b ON b.g = w.g AND b.level = w.level AND b.place = w.place WHERE w.n > 1),
high AS (
  SELECT doc_id, leaf, g, 0 AS level, g AS place, (SELECT count(*) FROM subroots) AS n, proof, node FROM walk WHERE n = 1
  UNION ALL
  SELECT w.doc_id, w.leaf, w.g, w.level + 1, w.place // 8, (w.n + 7) // 8, w.proof || b.lft || b.rgt, sha256(b.lft || w.node || b.rgt)
  FROM high w JOIN beside_top b ON b.level = w.level AND b.place = w.place WHERE w.n > 1)
SELECT h.doc_id, h.leaf, s.hash AS subroot, t.hash AS root, sha256(h.proof) AS proof_sha256, h.node AS folded_root, h.node = t.hash AS verified
FROM high h JOIN subroots s USING (g) CROSS JOIN (SELECT hash FROM tops WHERE n = 1) t WHERE h.n = 1
"""

ITEM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM (SELECT item_id, {ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM b),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
hits AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM places) p JOIN win USING (n, gram)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
