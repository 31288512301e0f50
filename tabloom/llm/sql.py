"""DuckDB SQL of the corpus queries that SQL can express."""

MIX_SOURCES = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
  FROM docs GROUP BY source),
filled AS (
  SELECT cap / weight AS ratio, row_number() OVER w AS n,
         coalesce(sum(cap) OVER w, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS open_weight
  FROM sources
  WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((1.5 * (SELECT sum(size) FROM docs) - capped) / open_weight, n) AS level
  FROM filled WHERE (1.5 * (SELECT sum(size) FROM docs) - capped) / open_weight <= ratio),
targets AS (
  SELECT source, source_size, least(cap, weight * (SELECT level FROM level)) AS target FROM sources),
placed AS (
  SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS goal,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, CAST(doc_id AS VARCHAR)
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(greatest(0, least(size, goal - place)) + greatest(0, least(size, goal - source_size - place)) AS BIGINT) AS taken
FROM placed
"""

DECONTAMINATE = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
pattern AS (
  SELECT DISTINCT item_id, least(len(words), 13) AS size, array_to_string(words[i:i + 12], ' ') AS pattern
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS i FROM item WHERE len(words) > 0)),
place AS (
  SELECT rid, p, list(word) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS ahead
  FROM (SELECT rid, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM doc)),
found AS (
  SELECT rid, p, s.size, item_id
  FROM place, (SELECT DISTINCT size FROM pattern) s
  JOIN pattern ON pattern.size = s.size
  WHERE len(ahead) >= s.size AND pattern = array_to_string(ahead[1:s.size], ' ')),
hit AS (
  SELECT rid, count(DISTINCT spot) AS n_hit FROM (SELECT rid, unnest(range(p, p + size)) AS spot FROM found) GROUP BY rid),
ids AS (
  SELECT rid, count(DISTINCT item_id) AS n_items,
         sha256(array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',')) AS items_sha256
  FROM found GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN ids USING (rid)
"""

ARCHIVE_PAGES = r"""
WITH page AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS place,
         first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id
  FROM pages)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((CAST('0x' || substr(sha1(payload), 1 + 5 * (i // 4), 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
       CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN first_id END AS refers_to
FROM page
"""

# The unsigned crc32 of a text of ASCII characters, bit by bit.
_CRC32 = """xor(list_reduce(list_transform(string_split({text}, ''), lambda s: CAST(ascii(s) AS BIGINT)),
      lambda crc, byte: list_reduce(range(8), lambda r, bit: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(crc, byte)),
      4294967295), 4294967295)"""

PREFIX_TRIE = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
           PARTITION BY conv_id
           ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
conv AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head, {_CRC32.format(text='CAST(conv_id AS VARCHAR)')} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
sequence AS (
  SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY own, i) AS turns
  FROM (SELECT c.conv_id, 0 AS own, i, role, text FROM conv c JOIN turns t ON t.conv_id = c.head AND t.i <= c.h
        UNION ALL SELECT c.conv_id, 1, i, role, text FROM conv c JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h)
  GROUP BY conv_id),
rebuilt AS (SELECT conv_id, coalesce(turns, []) AS turns FROM conv LEFT JOIN sequence USING (conv_id)),
member AS (
  SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS ends
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM rebuilt)),
node AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * coalesce(length(prefix[d].text), 0) AS saved,
         sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM member GROUP BY d, prefix),
child AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT m.d, m.prefix, sum(n.saved) AS saved_tokens, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves
  FROM node n JOIN member m ON m.conv_id = n.conv_id AND m.d <= n.d
  LEFT JOIN child c ON c.d = n.d AND c.prefix = n.prefix
  GROUP BY m.d, m.prefix)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.n_leaves,
       CAST(b.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM node n JOIN below b ON b.d = n.d AND b.prefix = n.prefix
LEFT JOIN child c ON c.d = n.d AND c.prefix = n.prefix
LEFT JOIN node p ON p.d = n.d - 1 AND p.prefix = n.prefix[1:n.d - 1]
"""
