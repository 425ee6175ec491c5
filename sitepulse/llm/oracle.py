"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

ORACLE = {
    "op1_exact_dedup": """
SELECT doc_id,
       max(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op3_warc": """
WITH page AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
FROM page
""",
    "op8_line_dedup": f"""
WITH line AS (
  SELECT r, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM (SELECT *, row_number() OVER () AS r FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM line
), common AS (
  SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key
GROUP BY r, doc_id
""",
    "op6_decontamination": f"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
         array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (
    SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
    FROM doc, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
  )
), hits AS (
  SELECT doc_id, grams.n, i, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.win = windows.win
), words AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids
  FROM hits GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words ON doc.doc_id = words.doc_id LEFT JOIN items ON doc.doc_id = items.doc_id
""",
    "op12_lexical_search": f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w
  FROM documents
), item AS (
  SELECT row_number() OVER () AS i, item_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS w
  FROM benchmark
), asked AS (
  SELECT i, item_id, t, count(*) AS times FROM (SELECT i, item_id, unnest(w) AS t FROM item) GROUP BY i, item_id, t
), posting AS (
  SELECT r, doc_id, n, t, count(*) AS tf
  FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM doc) GROUP BY r, doc_id, n, t
), total AS (
  SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS words FROM doc WHERE len(w) > 0
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS v
  FROM posting, total GROUP BY t, docs
), scored AS (
  SELECT i, item_id, r, doc_id,
         CAST(sum(times * v * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // words)))) AS BIGINT) AS score
  FROM asked JOIN posting USING (t) JOIN weight USING (t), total
  GROUP BY i, item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank,
       doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 20
""",
    "op13_prefix_trie": """
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT c, c - c % 20 AS base,
         xor(list_reduce(
           list_transform(range(1, len(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT)),
           lambda a, b: list_reduce(range(8), lambda v, i: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(a, b)),
           4294967295), 4294967295) & 3 AS h
  FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT c, coalesce(list(struct_pack(role, text) ORDER BY own, p) FILTER (p IS NOT NULL), []) AS s
  FROM (
    SELECT conv.c, own, p, role, text
    FROM conv LEFT JOIN (
      SELECT conv.c, 0 AS own, p, role, text FROM conv JOIN turns ON turns.c = base AND p <= h
      UNION ALL
      SELECT conv.c, 1, p, role, text FROM conv JOIN turns ON turns.c = conv.c AND p > h
    ) AS t ON t.c = conv.c
  ) GROUP BY c
), prefix AS (
  SELECT c, d, s[1:d] AS k, len(s) = d AS ends,
         CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].text, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM prefix GROUP BY d, k
), child AS (
  SELECT d - 1 AS d, k[1:d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1, 2
), subtree AS (
  SELECT e AS d, k[1:e] AS k, count(*) FILTER (leaf) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens
  FROM (
    SELECT node.d, node.k, n_convs, words, n_children IS NULL AS leaf, unnest(range(0, node.d + 1)) AS e
    FROM node LEFT JOIN child ON child.d = node.d AND child.k = node.k
  ) GROUP BY 1, 2
)
SELECT node.conv_id, node.d AS depth, parent.conv_id AS parent_conv_id, node.n_convs,
       coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, node.ends_sha256
FROM node
JOIN subtree ON subtree.d = node.d AND subtree.k = node.k
LEFT JOIN child ON child.d = node.d AND child.k = node.k
LEFT JOIN node AS parent ON parent.d = node.d - 1 AND parent.k = node.k[1:node.d - 1]
""",
}
