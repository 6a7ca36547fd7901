"""SQL twins in DuckDB of the queries that SQL can express."""

ORACLE: dict[str, str] = {}

ORACLE["op1_url_filters"] = r"""
WITH located AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
judged AS (
  SELECT *, '.' || host AS h,
         (host LIKE '%spam%' OR host LIKE '%casino%' OR host LIKE '%viagra%') AS spam
  FROM located)
SELECT page_id, host, path,
       CASE WHEN h LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
            WHEN h LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
            WHEN h LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
            WHEN h LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
            WHEN h LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
       CASE WHEN h LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'allow'
            WHEN h LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'block'
            WHEN h LIKE '%.net' AND starts_with(path, '/es/') THEN 'block'
            WHEN h LIKE '%.net' AND starts_with(path, '/fr/') THEN 'block'
            WHEN h LIKE '%.com' AND starts_with(path, '/') THEN 'allow'
            WHEN spam THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

ORACLE["op6_decontamination"] = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
win AS (
  SELECT DISTINCT item, least(10, len(ws)) AS n,
         array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS w
  FROM item, range(1, greatest(1, len(ws) - 9) + 1) r(i) WHERE len(ws) > 0),
doc AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
size AS (SELECT DISTINCT n FROM win),
cut AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS pos,
         unnest(list_transform(range(1, len(ws) - n + 2), lambda i: array_to_string(ws[i : i + n - 1], ' '))) AS w
  FROM doc, size WHERE len(ws) >= n),
hit AS (SELECT doc_id, pos, n, item FROM cut JOIN win USING (n, w)),
spot AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS pos FROM hit),
hits AS (SELECT doc_id, count(*) AS n_hit FROM spot GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS names FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(names), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(names, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE["op9_near_dedup"] = r"""
WITH RECURSIVE doc AS (
  SELECT doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS s
  FROM doc, range(1, greatest(1, len(ws) - 3) + 1) r(i) WHERE len(ws) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
overlap AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM overlap JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * overlap.n >= 80 * (x.n + y.n - overlap.n)),
reach AS (
  SELECT doc_id AS v, doc_id AS r FROM documents
  UNION SELECT link.b, reach.r FROM reach JOIN link ON link.a = reach.v),
least_ AS (SELECT v AS doc_id, min(r) AS component_id FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN size USING (doc_id) JOIN least_ USING (doc_id)
"""

ORACLE["op12_manifest"] = r"""
WITH RECURSIVE field AS (
  SELECT doc_id, lang, crc32_fold, text,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
         || coalesce(strlen(source) || ':' || source, '-')
         || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM (SELECT *, xor(4294967295, list_reduce(
          list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda c: CAST(ascii(c) AS BIGINT)),
          lambda crc, byte: list_reduce(range(0, 8),
            lambda a, _: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, byte)),
          4294967295)) % 3 AS crc32_fold FROM documents)),
leaf AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN crc32_fold = 0 THEN sha256(head || coalesce(strlen(low) || ':' || low, '-')) END AS changed
  FROM field),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos FROM leaf),
tree AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
  UNION ALL
  SELECT lang, level + 1,
         list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], '')))
  FROM tree WHERE len(nodes) > 1),
sub AS (
  SELECT lang, nodes[1] AS subroot, level AS height,
         row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM tree WHERE len(nodes) = 1),
upper AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM sub
  UNION ALL
  SELECT level + 1,
         list_transform(range(0, len(nodes), 8), lambda i: sha256(array_to_string(nodes[i + 1 : i + 8], '')))
  FROM upper WHERE len(nodes) > 1),
step AS (
  SELECT doc_id, placed.pos AS id_pos, placed.lang, tree.level, nodes, pos // CAST(power(8, tree.level) AS BIGINT) AS i
  FROM placed JOIN tree ON tree.lang IS NOT DISTINCT FROM placed.lang WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, placed.pos, placed.lang, height + upper.level, upper.nodes, place // CAST(power(8, upper.level) AS BIGINT)
  FROM placed JOIN sub ON sub.lang IS NOT DISTINCT FROM placed.lang, upper WHERE len(upper.nodes) > 1),
side AS (
  SELECT id_pos, lang, level,
         array_to_string(nodes[i // 8 * 8 + 1 : i], '') AS lower,
         array_to_string(nodes[i + 2 : i // 8 * 8 + 8], '') AS higher
  FROM step),
proof AS (
  SELECT id_pos, lang, sha256(string_agg(lower || higher, '' ORDER BY level)) AS proof_sha256
  FROM side GROUP BY id_pos, lang),
fold AS (
  SELECT pos AS id_pos, lang, 0 AS level, coalesce(changed, leaf) AS node FROM placed
  UNION ALL
  SELECT fold.id_pos, fold.lang, fold.level + 1, sha256(lower || node || higher)
  FROM fold JOIN side ON side.id_pos = fold.id_pos AND side.lang IS NOT DISTINCT FROM fold.lang AND side.level = fold.level),
folded AS (SELECT id_pos, lang, arg_max(node, level) AS folded_root FROM fold GROUP BY id_pos, lang)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
       folded_root = root AS verified
FROM placed
JOIN sub ON sub.lang IS NOT DISTINCT FROM placed.lang
JOIN folded ON folded.id_pos = placed.pos AND folded.lang IS NOT DISTINCT FROM placed.lang
LEFT JOIN proof ON proof.id_pos = placed.pos AND proof.lang IS NOT DISTINCT FROM placed.lang,
(SELECT nodes[1] AS root FROM upper WHERE len(nodes) = 1)
"""

ORACLE["op13_repeats"] = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS pos,
         unnest(list_transform(range(1, len(ws) - 48), lambda i: sha256(array_to_string(ws[i : i + 49], ' ')))) AS w
  FROM doc WHERE len(ws) >= 50),
owner AS (SELECT w, min(doc_id) AS least FROM win GROUP BY w),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos
  FROM win JOIN owner USING (w) WHERE doc_id > least),
cut AS (SELECT doc_id, list(pos) AS places, count(*) AS n_removed FROM gone GROUP BY doc_id),
word AS (
  SELECT doc_id, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM doc),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text
  FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM doc LEFT JOIN cut USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
