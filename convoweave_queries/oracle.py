"""SQL twins of the queries, for DuckDB over the same tables."""

from __future__ import annotations

# Text pieces by turn; chr(10) is the newline.
PIECE = """
pieces AS (
  SELECT conv_id, turn, role, content,
         CASE role
           WHEN 'system' THEN '<|system|>' || chr(10) || content || chr(10)
           WHEN 'user' THEN '<|user|>' || chr(10) || content || chr(10)
           WHEN 'assistant' THEN '<|assistant|>' || chr(10) || content || '</s>'
             || CASE WHEN turn = max(turn) OVER (PARTITION BY conv_id) THEN '' ELSE chr(10) END
           ELSE ''
         END AS piece
  FROM {source}
)"""
RENDERED = f"""
turns AS (SELECT conv_id, turn, role, text AS content FROM conversations),
{PIECE.format(source="turns")},
rendered AS (
  SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text FROM pieces GROUP BY conv_id
)"""
DAMAGED = f"""
turns AS (
  SELECT conv_id, turn,
         CASE WHEN role = 'system' AND length(text) % 2 = 0 THEN 'tool' ELSE role END AS role,
         CASE WHEN length(text) % 5 <> 0 THEN text END AS content
  FROM conversations
),
bad AS (
  SELECT DISTINCT conv_id FROM turns
  WHERE content IS NULL AND role IN ('system', 'user', 'assistant')
),
good_turns AS (SELECT * FROM turns WHERE conv_id NOT IN (SELECT conv_id FROM bad)),
{PIECE.format(source="good_turns")},
rendered AS (
  SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text FROM pieces GROUP BY conv_id
)"""
SPANS = """
placed AS (
  SELECT conv_id, turn, role, content,
         coalesce(sum(length(piece)) OVER (
           PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
         ), 0) AS piece_start
  FROM pieces
),
spans AS (
  SELECT conv_id, turn,
         CAST(piece_start + length('<|assistant|>') + 1 AS INTEGER) AS span_start,
         CAST(piece_start + length('<|assistant|>') + 1 + length(content) + length('</s>')
              AS INTEGER) AS span_end
  FROM placed WHERE role = 'assistant'
)"""
PAIRS = f"""
ended AS (
  SELECT conv_id, max(turn) AS last_turn FROM conversations WHERE role = 'assistant' GROUP BY conv_id
),
chosen_turns AS (
  SELECT c.conv_id, c.turn, c.role, c.text AS content
  FROM conversations c JOIN ended e ON c.conv_id = e.conv_id AND c.turn <= e.last_turn
),
rejected_turns AS (
  SELECT c.conv_id, c.turn, c.role,
         CASE WHEN c.turn = e.last_turn THEN c.content || chr(10) || c.content
              ELSE c.content END AS content
  FROM chosen_turns c JOIN ended e ON c.conv_id = e.conv_id
),
{PIECE.format(source="chosen_turns").replace("pieces AS", "chosen_pieces AS")},
{PIECE.format(source="rejected_turns").replace("pieces AS", "rejected_pieces AS")},
pairs AS (
  SELECT a.conv_id, a.text AS chosen_text, b.text AS rejected_text
  FROM (SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text
        FROM chosen_pieces GROUP BY conv_id) a
  JOIN (SELECT conv_id, string_agg(piece, '' ORDER BY turn) AS text
        FROM rejected_pieces GROUP BY conv_id) b ON a.conv_id = b.conv_id
)"""
TOKENS = r"'<\|assistant\|>|<\|system\|>|<\|user\|>|</s>|[^\s<]+|<'"
# Tokens piece by piece; of an answer all but the marker are trained on.
MASKED = f"""
flagged AS (
  SELECT conv_id, turn, place, token,
         CASE WHEN role = 'assistant' AND place > 1 THEN '1' ELSE '0' END AS flag
  FROM (SELECT conv_id, turn, role, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place
        FROM (SELECT conv_id, turn, role, regexp_extract_all(piece, {TOKENS}) AS tokens FROM pieces))
)"""
MIXTURE = f"""
{RENDERED},
members AS (
  SELECT 'conv' AS member, CAST(conv_id AS VARCHAR) AS row_key, text,
         CAST(0.5 AS DOUBLE) AS weight FROM rendered
  UNION ALL
  SELECT 'doc', CAST(doc_id AS VARCHAR), '<|user|>' || chr(10) || text || chr(10),
         CAST(0.66 AS DOUBLE) FROM documents
  UNION ALL
  SELECT 'bench', CAST(item_id AS VARCHAR), '<|user|>' || chr(10) || text || chr(10),
         CAST(0.10 AS DOUBLE) FROM benchmark
),
sampled AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
             PARTITION BY member ORDER BY md5('42:sample:' || member || ':' || row_key), row_key
           ) AS place,
           count(*) OVER (PARTITION BY member) AS n
    FROM members
  ) ranked WHERE place <= floor(n * weight)
),
mixture AS (
  SELECT member, row_key, text, md5('42:shuffle:' || member || ':' || row_key) AS order_key,
         CASE WHEN row_number() OVER (
                ORDER BY md5('42:split:' || member || ':' || row_key), member || ':' || row_key
              ) <= ceil(count(*) OVER () * CAST(0.1 AS DOUBLE))
              THEN 'test' ELSE 'train' END AS split
  FROM sampled
)"""
LISTING = """
named AS (
  SELECT event_id, event_type, user_id,
         CASE WHEN user_id % 3 = 0 THEN 'dpo' ELSE 'sft' END AS kind,
         'run-' || user_id AS run
  FROM events
),
based AS (SELECT *, 'results/' || kind || '/' || run AS base FROM named),
listing AS (
  SELECT base || '/checkpoint-' || event_id AS path, true AS is_dir FROM based
  UNION ALL SELECT base || '/checkpoint-' || event_id || '/model.safetensors', false FROM based
  UNION ALL SELECT base || '/checkpoint-' || event_id || '/optimizer.pt', false FROM based
  UNION ALL SELECT base || '/checkpoint-' || event_id || '/latest', false FROM based
    WHERE event_type = 'error'
  UNION ALL SELECT base || '/train_results.json', false FROM based WHERE event_id % 100 = 0
  UNION ALL SELECT base || '/weights-' || event_id || '.bin', false FROM based
    WHERE event_type = 'signup'
  UNION ALL SELECT base || '/checkpoint-x' || event_id, true FROM based
    WHERE event_type = 'click'
  UNION ALL SELECT base || '/checkpoint-9' || event_id, false FROM based
    WHERE event_type = 'view'
  UNION ALL SELECT base || '/slurm/job-' || event_id || '.sh', false FROM based
    WHERE event_type = 'purchase' AND event_id % 20 = 7
  UNION ALL SELECT 'recipes/dpo/' || run || '.sh', false FROM based WHERE event_id % 50 = 0
  UNION ALL SELECT 'results/' || kind || '/.tmp-' || user_id || '/a.bin', false FROM based
    WHERE event_type = 'view'
  UNION ALL SELECT 'logs/' || event_id || '.txt', false FROM based
),
configs AS (
  SELECT 'results/' || CASE WHEN user_id % 3 = 0 THEN 'dpo' ELSE 'sft' END || '/run-' || user_id
           AS run,
         CASE WHEN user_id % 10 <= 4 THEN '{"hub_model_id": " org/run-' || user_id || ' "}'
              WHEN user_id % 10 = 5 THEN '{"hub_model_id": 12}'
              WHEN user_id % 10 = 6 THEN '{"hub_model_id": '
              WHEN user_id % 10 = 7 THEN '{"hub_model_id": "   "}'
              ELSE '[1, 2]' END AS config_json
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 10 <> 9
),
published AS (
  SELECT 'org/run-' || user_id AS repo_id
  FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 4 = 0
),
hub AS (
  SELECT run, CASE WHEN json_type(config, '$.hub_model_id') = 'VARCHAR'
                   THEN nullif(trim(config ->> '$.hub_model_id'), '') END AS hub_model_id
  FROM (SELECT run, CASE WHEN json_valid(config_json) THEN config_json END AS config FROM configs)
)"""
RUNS = f"""
{LISTING},
entries AS (
  SELECT split_part(path, '/', 2) AS kind, split_part(path, '/', 3) AS run,
         nullif(regexp_replace(path, '^[^/]*/[^/]*/[^/]*/?', ''), '') AS rest, path, is_dir
  FROM listing
  WHERE path LIKE 'results/%' AND split_part(path, '/', 3) NOT LIKE '.%'
),
summary AS (
  SELECT kind, run, 'results/' || kind || '/' || run AS path,
         bool_or(rest = 'train_results.json' AND NOT is_dir) AS finished,
         max(CASE WHEN is_dir AND regexp_full_match(rest, 'checkpoint-[0-9]+')
                  THEN CAST(substr(rest, 12) AS BIGINT) END) AS latest_checkpoint_step,
         min(CASE WHEN regexp_full_match(rest, 'slurm/[^/]*\\.sh') THEN path END) AS slurm,
         count(CASE WHEN regexp_full_match(rest, 'slurm/[^/]*\\.sh') THEN path END) AS n_scripts
  FROM entries GROUP BY kind, run
),
overrides AS (
  SELECT DISTINCT 'dpo' AS kind, regexp_extract(path, '^recipes/dpo/([^/]*)\\.sh$', 1) AS run,
         path AS override
  FROM listing WHERE path LIKE 'recipes/dpo/%'
),
runs AS (
  SELECT s.kind, s.run, s.path, h.hub_model_id, s.finished,
         CASE WHEN s.finished THEN 'found train_results.json'
              ELSE 'missing train_results.json (training not finished or failed)' END
           AS finish_reason,
         s.latest_checkpoint_step, coalesce(o.override, s.slurm) AS slurm_script,
         o.override IS NULL AND s.n_scripts > 1 AS many_scripts,
         CASE WHEN h.hub_model_id IS NOT NULL
              THEN h.hub_model_id IN (SELECT repo_id FROM published) END AS published,
         CASE WHEN s.finished THEN 'finished'
              WHEN s.latest_checkpoint_step IS NOT NULL THEN 'in progress'
              ELSE 'none' END AS submit_status,
         CASE WHEN s.finished AND h.hub_model_id IS NOT NULL THEN 'ready'
              WHEN s.finished THEN 'finished, no id'
              ELSE 'not finished' END AS publish_status,
         CASE WHEN h.hub_model_id IS NULL THEN 'n/a'
              WHEN h.hub_model_id IN (SELECT repo_id FROM published) THEN 'yes'
              ELSE 'no' END AS published_status
  FROM summary s
  LEFT JOIN overrides o ON o.kind = s.kind AND o.run = s.run
  LEFT JOIN hub h ON h.run = s.path
)""".replace("\\\\", "\\")


def _pack(rows: str, length: str, shard: str, order: str) -> str:
    return f"""
    SELECT doc_id, {length}, shard, CAST(start AS BIGINT) AS start,
           CAST(floor(start / 4096) AS BIGINT) AS block, CAST(start % 4096 AS INTEGER) AS "offset"
    FROM (
      SELECT *, coalesce(sum({length}) OVER (
               PARTITION BY shard ORDER BY {order}
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
      FROM (SELECT *, CAST({shard} AS INTEGER) AS shard FROM {rows})
    )"""


_HASH = "md5('42:pack::' || CAST({key} AS VARCHAR))"
_PLACE = "CAST('0x' || substr(" + _HASH + ", 1, 15) AS BIGINT)"

def _permute_once(source: str) -> str:
    """Six rounds on ``x`` of a derived table, one subquery each: ``(number, x, y)``."""
    key = "CAST('0x' || substr(md5('42:permute:{r}'), 1, 7) AS BIGINT)"
    p = "2147483647"
    inner = f"SELECT number, x, x // b AS l, x % b AS r, a, b FROM ({source}), size"
    for r in range(6):
        digit, k = ("r", key.format(r=r)) if r % 2 == 0 else ("l", key.format(r=r))
        mixed = f"SELECT *, ({digit} + {k}) % {p} AS m FROM ({inner})"
        mixed = f"SELECT * EXCLUDE (m), (m * m + {k}) % {p} AS m FROM ({mixed})"
        left, right = ("(l + m * m % {p}) % a", "r") if r % 2 == 0 else ("l", "(r + m * m % {p}) % b")
        inner = f"SELECT number, x, {left.format(p=p)} AS l, {right.format(p=p)} AS r, a, b FROM ({mixed})"
    return f"SELECT number, x, l * b + r AS y FROM ({inner})"


PLACES = f"""
numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM documents),
n AS (SELECT count(*) AS n FROM documents),
size AS (
  SELECT n, a, (n + a - 1) // a AS b FROM (SELECT n, CAST(ceil(sqrt(n)) AS BIGINT) AS a FROM n)
),
walk AS (
  SELECT number, y, 0 AS step FROM ({_permute_once("SELECT number, number AS x FROM numbered")})
  UNION ALL
  SELECT number, y, 0 FROM ({_permute_once("SELECT number, y AS x FROM walk, n WHERE y >= n")})
),
places AS (SELECT number, y AS place FROM walk, n WHERE y < n)"""

ORACLE: dict[str, str] = {
    "render_chat": f"WITH {RENDERED} SELECT conv_id, text FROM rendered",
    "render_generation_prompt": f"""
        WITH {RENDERED}
        SELECT conv_id, text || '<|assistant|>' || chr(10) AS text FROM rendered""",
    "render_guard": f"""
        WITH {DAMAGED}
        SELECT conv_id, false AS rejected, text FROM rendered
        UNION ALL SELECT conv_id, true, NULL FROM bad""",
    "render_pairs": f"WITH {PAIRS} SELECT conv_id, chosen_text, rejected_text FROM pairs",
    "assistant_spans": f"""
        WITH {RENDERED}, {SPANS}
        SELECT conv_id,
               CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER)
                 AS span_no,
               span_start, span_end
        FROM spans""",
    "render_turns": f"""
        WITH {RENDERED}, {SPANS}
        SELECT p.conv_id, p.turn, p.piece, CAST(piece_start AS BIGINT) AS piece_start
        FROM pieces p JOIN placed s ON s.conv_id = p.conv_id AND s.turn = p.turn""",
    "turn_spans": f"""
        WITH {RENDERED}, {SPANS}
        SELECT conv_id, turn, CAST(span_start AS BIGINT) AS span_start,
               CAST(span_end AS BIGINT) AS span_end
        FROM spans""",
    "scan_dataset": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "scan_splits": "SELECT lang AS split, doc_id FROM documents",
    "scan_member_split": """
        SELECT doc_id, text, source, n_chars FROM documents WHERE lang = 'fr'""",
    "select_rename": "SELECT doc_id, text AS body FROM documents",
    "sft_columns": """
        SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages FROM conversations GROUP BY conv_id""",
    "preference_columns": """
        SELECT conv_id, CAST(count(*) AS INTEGER) AS chosen_messages,
               CAST(count(*) AS INTEGER) AS rejected_messages
        FROM conversations c
        WHERE turn <= (SELECT max(turn) FROM conversations a
                       WHERE a.conv_id = c.conv_id AND a.role = 'assistant')
        GROUP BY conv_id""",
    "drop_empty_conversations": """
        SELECT conv_id, CAST(count(*) AS INTEGER) AS n_messages FROM conversations
        WHERE role = 'assistant' GROUP BY conv_id""",
    "concat_members": """
        SELECT 'doc' AS src, doc_id AS id, text, lang FROM documents
        UNION ALL SELECT 'bench', item_id, text, NULL FROM benchmark""",
    "concat_nested": """
        SELECT 'conv' AS src, CAST(conv_id AS VARCHAR) AS id, role, text AS content,
               CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS BIGINT) AS n_chars, NULL AS item
        FROM conversations
        UNION ALL SELECT 'doc', CAST(doc_id AS VARCHAR), 'user', text, lang, n_chars, NULL FROM documents
        UNION ALL SELECT 'bench', NULL, NULL, text, NULL, NULL, item_id FROM benchmark""",
    "transform_expressions": r"""
        SELECT doc_id, upper(lang) AS lang,
               CAST(len(regexp_extract_all(text, '[^ \n]+')) AS INTEGER) AS n_words
        FROM documents""",
    "transform_batches": """
        SELECT doc_id, lang, source, n_chars + 1 AS n_chars, lang || ':' || source AS labelled,
               CASE WHEN doc_id % 3 <> 0 THEN 9007199254740993 + doc_id END AS large
        FROM documents""",
    "transform_columns": """
        SELECT doc_id, lang || ':' || source AS labelled, n_chars + 1 AS n_chars
        FROM documents WHERE doc_id >= 10 AND lang <> 'de'""",
    "replaced_split": """
        SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split
        FROM documents WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0""",
    "transform_rows": """
        SELECT doc_id, length(text) + len(regexp_extract_all(text, '[áàâäéèêëíìîïóòôöúùûüñçÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÑÇ]')) AS n_letters
        FROM documents""",
    "sample_by_weight": """
        SELECT doc_id, lang, n_chars FROM (
          SELECT *, row_number() OVER (
                   ORDER BY md5('42:sample:doc:' || doc_id), CAST(doc_id AS VARCHAR)) AS place,
                 count(*) OVER () AS n
          FROM documents)
        WHERE place <= floor(n * CAST(0.66 AS DOUBLE))""",
    "sample_by_row_weight": """
        WITH weighted AS (
          SELECT doc_id, lang, quality,
                 CASE WHEN doc_id % 11 = 7 AND quality = 0 THEN 0.0
                      ELSE coalesce(1.0 + 3.0 * quality, 2.0) END::DOUBLE AS weight
          FROM documents LEFT JOIN labels USING (doc_id)
        ),
        keyed AS (
          SELECT *, md5('42:weigh:doc:' || doc_id) AS digest FROM weighted WHERE weight > 0
        ),
        ranked AS (
          SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY
                   -ln(((CAST('0x' || substr(digest, 1, 15) AS BIGINT) >> 8) + 1) / 4503599627370496.0::DOUBLE) / weight,
                   digest) AS place
          FROM keyed
        )
        SELECT doc_id, lang, quality, weight FROM ranked WHERE place <= floor(n * CAST(0.2 AS DOUBLE))""",
    "sample_composite_key": """
        SELECT l_orderkey, l_linenumber, l_quantity FROM (
          SELECT *, row_number() OVER (ORDER BY md5('42:sample:line:' || key), key) AS place,
                 count(*) OVER () AS n
          FROM (SELECT *, l_orderkey || chr(31) || l_linenumber AS key FROM lineitem))
        WHERE place <= floor(n * CAST(0.29 AS DOUBLE))""",
    "sample_without_key": """
        SELECT content_key, n_chars FROM (
          SELECT *, row_number() OVER (
                   ORDER BY md5('42:sample:doc:' || content_key), content_key) AS place,
                 count(*) OVER () AS n
          FROM (SELECT md5(content) || ':' || row_number() OVER (PARTITION BY content) AS content_key,
                       n_chars
                FROM (SELECT replace(replace(text, chr(92), chr(92) || chr(92)), chr(31), chr(92) || 's')
                             || chr(31) || coalesce(nullif(source, 'src0'), chr(92) || 'N') AS content,
                             CAST(length(text) AS INTEGER) AS n_chars
                      FROM documents)))
        WHERE place <= floor(n * CAST(0.5 AS DOUBLE))""",
    "shuffle_order": """
        SELECT doc_id, md5('42:shuffle:doc:' || doc_id) AS order_key FROM documents""",
    "permuted_order": f"""
        WITH RECURSIVE {PLACES}
        SELECT doc_id, number, place, number AS back FROM numbered JOIN places USING (number)""",
    "sample_by_place": f"""
        WITH RECURSIVE {PLACES}
        SELECT doc_id, lang FROM numbered JOIN places USING (number) JOIN documents USING (doc_id), n
        WHERE place < CAST(floor(n * CAST(0.3 AS DOUBLE)) AS BIGINT)""",
    "train_test_split": """
        SELECT doc_id, lang,
               CASE WHEN row_number() OVER (
                      ORDER BY md5('42:split:doc:' || doc_id), CAST(doc_id AS VARCHAR)
                    ) <= ceil(count(*) OVER () * CAST(0.07 AS DOUBLE))
                    THEN 'test' ELSE 'train' END AS split
        FROM documents""",
    "mixture": f"WITH {MIXTURE} SELECT member, row_key, order_key, split, text FROM mixture",
    "mixture_without_keys": """
        SELECT member, row_key,
               md5('42:shuffle:' || member || ':' || row_key) AS order_key, n_chars
        FROM (
          SELECT *, row_number() OVER (
                   PARTITION BY member
                   ORDER BY md5('42:sample:' || member || ':' || row_key), row_key) AS place,
                 count(*) OVER (PARTITION BY member) AS n
          FROM (
            SELECT member, CAST(length(text) AS INTEGER) AS n_chars, weight,
                   md5(text) || ':' || row_number() OVER (PARTITION BY member, text) AS row_key
            FROM (
              SELECT 'documents.parquet' AS member, text, CAST(0.5 AS DOUBLE) AS weight
              FROM documents
              UNION ALL SELECT 'benchmark.parquet', text, 1.0 FROM benchmark
              UNION ALL SELECT 'conversations.parquet', text, 1.0 FROM conversations
            )
          )
        )
        WHERE place <= floor(n * weight)""",
    "mixture_counts": f"""
        WITH {MIXTURE} SELECT member, split, count(*) AS rows FROM mixture
        GROUP BY member, split""",
    "split_counts": f"""
        WITH {MIXTURE} SELECT split, count(*) AS rows FROM mixture GROUP BY split""",
    "split_metrics": f"""
        WITH {MIXTURE}
        SELECT count(*) FILTER (WHERE split = 'train') AS train_samples,
               count(*) FILTER (WHERE split = 'test') AS eval_samples FROM mixture""",
    "written_metrics": f"""
        WITH {MIXTURE}
        SELECT count(*) FILTER (WHERE split = 'train') AS train_samples,
               count(*) FILTER (WHERE split = 'test') AS eval_samples FROM mixture""",
    "write_splits": f"WITH {MIXTURE} SELECT member, row_key, order_key, split FROM mixture",
    "token_counts": f"""
        SELECT doc_id, CAST(len(regexp_extract_all(text, {TOKENS})) AS INTEGER) AS n_tokens
        FROM documents""",
    "chat_token_counts": f"""
        WITH {RENDERED}
        SELECT conv_id, CAST(len(regexp_extract_all(text, {TOKENS})) AS INTEGER) AS n_tokens
        FROM rendered""",
    "truncate_tokens": f"""
        SELECT doc_id, CAST(len(tokens) AS INTEGER) AS n_tokens, len(tokens) > 4096 AS truncated,
               array_to_string(tokens[1:4096], ' ') AS kept
        FROM (SELECT doc_id, regexp_extract_all(text, {TOKENS}) AS tokens FROM documents)""",
    "pack_in_key_order": _pack("documents", "n_chars", "doc_id % 8", "doc_id"),
    "pack_segments": f"""
        SELECT doc_id, shard, block, CAST(greatest(start - block * 4096, 0) AS INTEGER) AS "offset",
               CAST(greatest(block * 4096 - start, 0) AS INTEGER) AS from_char,
               CAST(least((block + 1) * 4096 - start, n_chars) AS INTEGER) AS to_char
        FROM (SELECT doc_id, shard, start, n_chars,
                     unnest(range(block, (start + n_chars - 1) // 4096 + 1)) AS block
              FROM ({_pack("documents", "n_chars", "doc_id % 8", "doc_id")})
              WHERE n_chars > 0)""",
    "pack_in_hash_order": _pack(
        f"""(SELECT doc_id, CAST(len(regexp_extract_all(text, {TOKENS})) AS INTEGER) AS n_tokens
             FROM documents)""",
        "n_tokens",
        _PLACE.format(key="doc_id") + " % 8",
        _HASH.format(key="doc_id"),
    ),
    "packed_text": f"""
        WITH {RENDERED},
        tokenised AS (
          SELECT conv_id, regexp_extract_all(text, {TOKENS}) AS tokens,
                 {_HASH.format(key="conv_id")} AS hash,
                 CAST({_PLACE.format(key="conv_id")} % 4 AS INTEGER) AS shard
          FROM rendered
        ),
        numbered AS (
          SELECT shard, token,
                 row_number() OVER (PARTITION BY shard ORDER BY hash, place) - 1 AS idx
          FROM (SELECT shard, hash, unnest(tokens) AS token,
                       generate_subscripts(tokens, 1) AS place FROM tokenised)
        )
        SELECT shard, CAST(floor(idx / 512) AS BIGINT) AS block,
               CAST(count(*) AS INTEGER) AS n_tokens, string_agg(token, ' ' ORDER BY idx) AS text
        FROM numbered GROUP BY shard, CAST(floor(idx / 512) AS BIGINT)""",
    "pack_whole_rows": f"""
        SELECT doc_id, n_tokens, CAST(ceil(n_tokens / 4096.0) AS BIGINT) AS n_pieces,
               CAST(n_tokens AS BIGINT) AS n_placed, least(n_tokens, 4096) AS longest, true AS apart
        FROM (SELECT doc_id, CAST(len(regexp_extract_all(text, {TOKENS})) AS INTEGER) AS n_tokens FROM documents)
        WHERE n_tokens > 0""",
    "packed_whole_text": f"""
        WITH {RENDERED},
        pieces_of AS (
          SELECT tokens, unnest(range(0, len(tokens), 512)) AS cut
          FROM (SELECT regexp_extract_all(text, {TOKENS}) AS tokens FROM rendered)
        )
        SELECT CAST(least(512, len(tokens) - cut) AS INTEGER) AS n_tokens,
               array_to_string(tokens[cut + 1 : cut + 512], ' ') AS text
        FROM pieces_of""",
    "packed_masked_text": f"""
        WITH {RENDERED}, {MASKED},
        numbered AS (
          SELECT shard, token, flag,
                 row_number() OVER (PARTITION BY shard ORDER BY hash, turn, place) - 1 AS idx
          FROM (SELECT *, {_HASH.format(key="conv_id")} AS hash,
                       CAST({_PLACE.format(key="conv_id")} % 4 AS INTEGER) AS shard
                FROM flagged)
        )
        SELECT shard, CAST(floor(idx / 512) AS BIGINT) AS block,
               string_agg(token, ' ' ORDER BY idx) AS text, string_agg(flag, '' ORDER BY idx) AS mask
        FROM numbered GROUP BY shard, CAST(floor(idx / 512) AS BIGINT)""",
    "token_mask": f"""
        WITH {RENDERED}, {MASKED}
        SELECT conv_id, left(string_agg(flag, '' ORDER BY turn, place), 256) AS mask
        FROM flagged GROUP BY conv_id""",
    "masked_token_ids": f"""
        WITH {RENDERED},
        answers AS (
          SELECT conv_id, string_agg(content || '</s>', '' ORDER BY turn) AS trained
          FROM turns WHERE role = 'assistant' GROUP BY conv_id
        )
        SELECT conv_id, true AS complete, md5(text) AS text_md5, md5(coalesce(trained, '')) AS trained_md5
        FROM rendered LEFT JOIN answers USING (conv_id)""",
    "sft_text": f"""
        WITH {DAMAGED}, {SPANS},
        tokenised AS (
          SELECT conv_id, text, regexp_extract_all(text, {TOKENS}) AS tokens FROM rendered
        )
        SELECT t.conv_id, text, CAST(len(tokens) AS INTEGER) AS n_tokens,
               len(tokens) > 256 AS truncated, array_to_string(tokens[1:256], ' ') AS kept,
               CAST(coalesce(n, 0) AS INTEGER) AS n_spans,
               CAST(coalesce(chars, 0) AS INTEGER) AS trainable_chars
        FROM tokenised t
        LEFT JOIN (SELECT conv_id, count(*) AS n, sum(span_end - span_start) AS chars
                   FROM spans GROUP BY conv_id) s ON s.conv_id = t.conv_id""",
    "preference_text": f"""
        WITH {PAIRS},
        counted AS (
          SELECT *, CAST(len(regexp_extract_all(chosen_text, {TOKENS})) AS INTEGER)
                      AS chosen_n_tokens,
                 CAST(len(regexp_extract_all(rejected_text, {TOKENS})) AS INTEGER)
                      AS rejected_n_tokens
          FROM pairs
        )
        SELECT *, chosen_n_tokens > 512 AS chosen_truncated,
               rejected_n_tokens > 512 AS rejected_truncated
        FROM counted""",
    "run_status": f"WITH {RUNS} SELECT * FROM runs",
    "run_status_unchecked": f"WITH {RUNS} SELECT path, 'skipped' AS published_status FROM runs",
    "listing_entries": f"WITH {RUNS} SELECT kind, run, path, is_dir FROM entries",
    "config_hub_ids": f"WITH {LISTING} SELECT run, hub_model_id FROM hub",
    "latest_checkpoint": f"WITH {RUNS} SELECT path, latest_checkpoint_step FROM summary",
    "run_scripts": f"WITH {RUNS} SELECT path, slurm_script, many_scripts FROM runs",
    "finished_runs": f"WITH {RUNS} SELECT path, kind FROM summary WHERE finished",
    "publishable_runs": f"""
        WITH {RUNS} SELECT path, hub_model_id FROM runs
        WHERE finished AND hub_model_id IS NOT NULL""",
    "resubmittable_runs": f"""
        WITH {RUNS} SELECT path, slurm_script FROM runs
        WHERE slurm_script IS NOT NULL AND NOT finished""",
    "exclude_finished": f"""
        WITH {RUNS} SELECT path, submit_status FROM runs WHERE NOT finished""",
    "exclude_published": f"""
        WITH {RUNS} SELECT path, hub_model_id FROM runs WHERE published IS NOT TRUE""",
    "catalogue_counts": f"""
        WITH {RUNS}
        SELECT count(*) AS runs, count(*) FILTER (WHERE finished) AS finished,
               count(*) FILTER (WHERE finished AND hub_model_id IS NOT NULL) AS publishable,
               count(*) FILTER (WHERE slurm_script IS NOT NULL AND NOT finished)
                 AS resubmittable,
               count(*) FILTER (WHERE finished AND slurm_script IS NOT NULL)
                 AS skipped_finished,
               count(*) FILTER (WHERE published) AS published
        FROM runs""",
    "listing_order": f"""
        WITH {RUNS} SELECT kind, run, submit_status FROM runs
        ORDER BY CASE kind WHEN 'sft' THEN 0 ELSE 1 END, lower(run), run""",
    "artifact_manifest": f"""
        WITH {RUNS}
        SELECT path AS src,
               'results/' || kind || '/' || run || '/artifacts/'
                 || regexp_extract(rest, '^checkpoint-([0-9]+)/([^/]+)$', 1) || '/'
                 || regexp_extract(rest, '^checkpoint-([0-9]+)/([^/]+)$', 2) AS dst
        FROM entries
        WHERE NOT is_dir AND regexp_full_match(rest, 'checkpoint-[0-9]+/[^/]+')
          AND (path LIKE '%.safetensors' OR path LIKE '%.bin' OR path LIKE '%.json'
               OR path LIKE '%.model' OR path LIKE '%.jinja' OR path LIKE '%latest')""",
    "upload_manifest": f"""
        WITH {RUNS}
        SELECT r.hub_model_id AS repo_id, e.path AS src, e.rest AS dst
        FROM entries e JOIN runs r ON r.kind = e.kind AND r.run = e.run
        WHERE NOT e.is_dir AND e.rest NOT LIKE 'checkpoint-%' AND e.rest NOT LIKE 'slurm/%'
          AND r.finished AND r.hub_model_id IS NOT NULL""",
    "bucketed_catalogue": f"WITH {RUNS} SELECT path, finished, latest_checkpoint_step, hub_model_id FROM runs",
    "upload_by_patterns": f"""
        WITH {RUNS}
        SELECT r.hub_model_id AS repo_id, e.path AS src, e.rest AS dst
        FROM entries e JOIN runs r ON r.kind = e.kind AND r.run = e.run
        WHERE NOT e.is_dir AND r.finished AND r.hub_model_id IS NOT NULL
          AND NOT (e.rest GLOB 'checkpoint-*[!05]/*' OR e.rest GLOB 'slurm/job-?.sh'
                   OR e.rest GLOB '*/[k-o]*.pt' OR e.rest GLOB 'weights-*1*.bin')
          AND (e.rest GLOB '*.bin' OR e.rest GLOB '*.pt' OR e.rest GLOB 'checkpoint-*/[a-m]*'
               OR e.rest GLOB 'slurm/**')""",
    "stream_run_status": f"""
        WITH {RUNS}
        SELECT r.kind, r.run, r.path, r.finished, r.latest_checkpoint_step, r.slurm_script, r.many_scripts, n_files
        FROM runs r JOIN (SELECT kind, run, CAST(count(DISTINCT path) AS BIGINT) AS n_files
                          FROM entries WHERE NOT is_dir GROUP BY kind, run) f
          ON f.kind = r.kind AND f.run = r.run""",
    "stream_documents": """
        SELECT doc_id, '<|user|>' || chr(10) || text || chr(10) AS text FROM documents""",
}
