"""DuckDB's counterparts of the queries for manifests, shards and tries; they share no code with the operators."""

from __future__ import annotations

#: The 256 remainders of the CRC-32 polynomial.
CRC = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""


def crc(text: str) -> str:
    """DuckDB's unsigned crc32 of an ASCII text, with crc_table in the FROM clause."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


OP11_SQL = f"""
WITH RECURSIVE {CRC},
  d AS (SELECT row_number() OVER () AS r, doc_id, source, text, concat_ws('', {', '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))}) AS head, CASE WHEN doc_id IS NULL THEN 1 ELSE {crc("CAST(doc_id AS VARCHAR)")} % 2 END AS odd FROM documents, crc_table),
  hashed AS (SELECT *, sha256(head || {_field('text')}) AS leaf, sha256(head || {_field('replace(text, chr(10), ' + chr(39) * 2 + ')')}) AS changed FROM d),
  leaves AS (SELECT *, coalesce('=' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank,
    CASE WHEN odd = 0 THEN changed ELSE leaf END AS claimed FROM hashed),
  up AS (SELECT tree, rank, leaf AS digest, 0 AS level, count(*) OVER (PARTITION BY tree) AS n FROM leaves
    UNION ALL SELECT tree, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), level + 1, (n + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, rank // 3, level, n),
  subroots AS (SELECT tree, digest, level AS height FROM up WHERE n = 1),
  forest AS (SELECT row_number() OVER (ORDER BY tree) - 1 AS rank, digest, 0 AS level, count(*) OVER () AS n FROM subroots
    UNION ALL SELECT rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), level + 1, (n + 2) // 3 FROM forest WHERE n > 1 GROUP BY rank // 3, level, n),
  top AS (SELECT digest AS root FROM forest WHERE n = 1),
  numbered AS (SELECT *, row_number() OVER (ORDER BY tree) - 1 AS number FROM subroots),
  runs AS (SELECT tree, level, rank // 3 AS run, list(digest ORDER BY rank) AS ds FROM up WHERE n > 1 GROUP BY ALL
    UNION ALL SELECT '/' AS tree, level, rank // 3, list(digest ORDER BY rank) FROM forest WHERE n > 1 GROUP BY ALL),
  fold AS (SELECT r, tree, height, number, rank AS pos, 0 AS step, claimed AS folded, '' AS proof FROM leaves JOIN numbered USING (tree)
    UNION ALL SELECT r, fold.tree, height, number, (CASE WHEN step = height THEN number ELSE pos END) // 3, step + 1,
      sha256(array_to_string(ds[:k], '') || folded || array_to_string(ds[k + 2:], '')), proof || array_to_string(ds[:k], '') || array_to_string(ds[k + 2:], '')
    FROM (SELECT *, (CASE WHEN step = height THEN number ELSE pos END) % 3 AS k FROM fold) AS fold JOIN runs ON runs.tree = CASE WHEN step < height THEN fold.tree ELSE '/' END
      AND runs.level = step - CASE WHEN step < height THEN 0 ELSE height END AND runs.run = (CASE WHEN step = height THEN number ELSE pos END) // 3),
  last AS (SELECT r, arg_max(folded, step) AS folded_root, arg_max(proof, step) AS proof FROM fold GROUP BY r)
SELECT doc_id, leaf, digest AS subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN numbered USING (tree) JOIN last USING (r), top
"""


#: Labels and weights are those of the registered trees; the draws are made again from md5.
OP12_SQL = f"""
WITH {CRC},
  text_bytes AS (SELECT row_number() OVER () AS r, doc_id, text, encode(coalesce(text, '')) AS raw FROM documents),
  crcs AS (SELECT r, doc_id, octet_length(raw) + 8 AS size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, octet_length(raw) + 1),
      lambda i: CAST('0x' || hex(raw[i:i]) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM text_bytes, crc_table),
  units AS (SELECT '0/r' || i // 12 AS region, '/k' || i % 12 // 4 AS rack, i AS shard, 0 AS grown FROM (SELECT unnest(range(24)) AS i) UNION ALL SELECT '1/r0', '/k0', 24, 1),
  trees AS (SELECT tree, u.* FROM (VALUES (0), (1)) AS v(tree) JOIN units AS u ON u.grown <= tree),
  nodes AS (SELECT tree, '' AS up, region AS label, count(*) AS weight FROM trees GROUP BY ALL UNION ALL SELECT tree, region, region || rack, count(*) FROM trees GROUP BY ALL
    UNION ALL SELECT tree, region || rack, region || rack || '/' || shard, 1 FROM trees),
  draws AS (SELECT doc_id, tree, up, label, -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || label), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / weight AS x
    FROM (SELECT DISTINCT doc_id FROM documents), nodes),
  best AS (SELECT doc_id, tree, up, arg_min(label, x) AS label FROM draws GROUP BY ALL),
  picked AS (SELECT doc_id, tree, CAST(string_split(c.label, '/')[4] AS INTEGER) AS shard FROM best AS a JOIN best AS b USING (doc_id, tree) JOIN best AS c USING (doc_id, tree)
    WHERE a.up = '' AND b.up = a.label AND c.up = b.label)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, p.shard, row_number() OVER (PARTITION BY p.shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, g.shard AS grown_shard
FROM crcs JOIN picked AS p USING (doc_id) JOIN picked AS g USING (doc_id) WHERE p.tree = 0 AND g.tree = 1
"""

OP13_SQL = f"""
WITH {CRC},
  o AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
  h AS (SELECT conv_id, turns, {crc("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM o, crc_table),
  p AS (SELECT h.conv_id, list_concat(coalesce(b.turns[:h.h], []), h.turns[h.h + 1:]) AS path FROM h LEFT JOIN o AS b ON b.conv_id = h.conv_id - h.conv_id % 100),
  n AS (SELECT path[:d] AS node, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN len(path) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
    FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM p) GROUP BY ALL),
  k AS (SELECT node[:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
  w AS (SELECT n.node, n.depth, CAST(n_children IS NULL AS BIGINT) AS leaf, (n_convs - 1) * CASE WHEN n.depth > 0 THEN length(n.node[n.depth].text) ELSE 0 END AS saved FROM n LEFT JOIN k USING (node)),
  s AS (SELECT node[:d] AS node, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM w) GROUP BY ALL)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN s USING (node) LEFT JOIN k USING (node) LEFT JOIN n AS up ON n.depth > 0 AND up.node = n.node[:n.depth - 1]
"""
