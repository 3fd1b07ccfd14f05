"""DuckDB SQL for the queries that SQL can express, formulated independently of the operators."""

from rasterweave.llm.lm import ALONE

#: CRC-32 (polynomial EDB88320) by its table, folded over the bytes of a text.
_CRC = """
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i))
),
"""

ORACLES: dict[str, str] = {
    "op1_cross_entropy_difference": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lower(coalesce(text, '')) AS body,
    coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1), FALSE) AS own FROM documents
),
words AS (
  SELECT r, own, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT r, own, regexp_extract_all(body, '[ALONE]|[^\x20\x09-\x0DALONE]+') AS ws FROM docs)
),
tokens AS (SELECT *, ('0x' || substr(md5(w), 1, 4))::INTEGER % 512 AS c FROM words),
grams AS (SELECT *, coalesce(lag(c) OVER (PARTITION BY r ORDER BY i), 512) AS d FROM tokens),
totals AS (SELECT count(*) AS n_all, count(*) FILTER (WHERE own) AS n_own FROM grams),
n2 AS (
  SELECT d, c, CASE WHEN n_own > 0 THEN count(*) FILTER (WHERE own) ELSE count(*) END AS t, count(*) * CASE WHEN n_own > 0 THEN n_own / n_all ELSE 1 END AS g
  FROM grams, totals GROUP BY d, c, n_own, n_all
),
n1 AS (SELECT c, sum(t) AS t, sum(g) AS g FROM n2 GROUP BY c),
h1 AS (SELECT d, sum(t) AS t, sum(g) AS g FROM n2 GROUP BY d),
sums AS (SELECT sum(t) AS t, sum(g) AS g FROM n1),
steps AS (
  SELECT d, c, -ln((n2.t + 10 * (n1.t + 1) / (sums.t + 512)) / (h1.t + 10)) AS lt, -ln((n2.g + 10 * (n1.g + 1) / (sums.g + 512)) / (h1.g + 10)) AS lb
  FROM n2 JOIN n1 USING (c) JOIN h1 USING (d), sums
),
counts AS (SELECT w, c, count(*) AS n, count(*) FILTER (WHERE own) AS t FROM tokens GROUP BY w, c),
of_class AS (SELECT c, sum(n) AS n, sum(t) AS t FROM counts GROUP BY c),
spelled AS (SELECT w, -ln((k.t + 10 * (k.n / o.n)) / (o.t + 10)) AS lt, -ln(k.n / o.n) AS lb FROM counts k JOIN of_class o USING (c)),
scored AS (
  SELECT r, count(*) AS n, avg(steps.lt + spelled.lt) AS ct, avg(steps.lb + spelled.lb) AS cb FROM grams JOIN steps USING (d, c) JOIN spelled USING (w) GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_tokens, round(ct, 6) AS ce_target, round(cb, 6) AS ce_background, round(ct - cb, 6) AS score
FROM docs LEFT JOIN scored USING (r)
""".replace("ALONE", ALONE),
    # lines, their sums over three and the stretches from surge to dive; the markup that these tables have is cut by patterns
    "op4_line_block_extraction": r"""
WITH cut AS (
  SELECT page_id, url, reduce([html,
    '(?s)<head>.*?</head>', '(?s)<script>.*?</script>', '(?s)<nav>.*?</nav>', '(?s)<footer>.*?(</footer>|$)', '(?s)<div class="ad">.*?</div>'],
    lambda page, pattern: regexp_replace(page, pattern, '<hr>', 'g')) AS body FROM pages
),
parts AS (
  SELECT page_id, url, unnest(string_split_regex(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '</?(?:p|h1|article|body|html)(?: [^>]*)?>|<!DOCTYPE html>')) AS part,
    generate_subscripts(string_split_regex(regexp_replace(body, '(?s)<!--.*?-->', '', 'g'), '</?(?:p|h1|article|body|html)(?: [^>]*)?>|<!DOCTYPE html>'), 1) AS p
  FROM cut
),
pieces AS (
  SELECT page_id, url, p, unnest(string_split(replace(part, '<hr>', chr(1) || '<hr>' || chr(1)), chr(1))) AS piece, generate_subscripts(string_split(replace(part, '<hr>', chr(1) || '<hr>' || chr(1)), chr(1)), 1) AS q FROM parts
),
plain AS (
  SELECT page_id, url, row_number() OVER (PARTITION BY page_id, url ORDER BY p, q) AS i, CASE WHEN piece = '<hr>' THEN '' ELSE regexp_replace(trim(regexp_replace(
    replace(replace(replace(replace(replace(piece, '<b>', ''), '</b>', ''), '<br>', ' '), '&quot;', '"'), '&#x27;', chr(39)), '\s+', ' ', 'g')), '&amp;?', '&', 'g') END AS line
  FROM pieces WHERE piece = '<hr>' OR trim(regexp_replace(piece, '\s+|</?b>|<br>', ' ', 'g')) <> ''
),
sums AS (
  SELECT *, sum(length(line)) OVER (PARTITION BY page_id, url ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS w FROM plain
),
stretches AS (
  SELECT *, least(12, max(w) OVER (PARTITION BY page_id, url)) AS surge, sum(CASE WHEN w = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY page_id, url ORDER BY i) AS stretch FROM sums
),
starts AS (
  SELECT *, min(CASE WHEN line <> '' AND w >= surge THEN i END) OVER (PARTITION BY page_id, url, stretch) AS first FROM stretches
),
texts AS (
  SELECT page_id, url, coalesce(string_agg(line, chr(10) || chr(10) ORDER BY i) FILTER (WHERE line <> '' AND i >= first), '') AS text FROM starts GROUP BY ALL
)
SELECT page_id, url, coalesce(text, '') AS text, length(coalesce(text, '')) AS n_chars FROM pages LEFT JOIN texts USING (page_id, url)
""",
    # every pair that shares a shingle is counted, and links are followed from every document
    "op6_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
shingles AS (
  SELECT DISTINCT r, sh FROM (
    SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM words)
),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.r <> b.r GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.r = a JOIN sizes y ON y.r = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
reach AS (SELECT r, r AS to_r FROM words UNION SELECT reach.r, links.b FROM reach JOIN links ON links.a = reach.to_r)
SELECT w.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(t.doc_id) AS component_id
FROM words w JOIN reach USING (r) JOIN words t ON t.r = reach.to_r LEFT JOIN sizes ON sizes.r = w.r GROUP BY w.r, w.doc_id
""",
    "op9_rendezvous_sharding": f"""
WITH {_CRC}
docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body, coalesce(doc_id::VARCHAR, '') AS k FROM documents
),
draws AS (
  SELECT r, s, -ln((('0x' || substr(md5(k || ':' || s::VARCHAR), 1, 13))::BIGINT + 0.5) / 4503599627370496.0) AS v
  FROM docs, range(41) AS n(s)
),
placed AS (
  SELECT r, arg_min(s, v) FILTER (WHERE s < 40) AS shard, arg_min(s, v) AS grown_shard FROM draws GROUP BY r
),
sums AS (
  SELECT r, doc_id, k, strlen(body) + 16 AS size,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
      regexp_extract_all(hex(encode(body)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM docs, crc_table
)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY ('0x' || substr(md5(k), 1, 4))::INTEGER % 64, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
  grown_shard::INTEGER AS grown_shard
FROM sums JOIN placed USING (r)
""",
}
