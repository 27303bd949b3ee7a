"""DuckDB SQL for those of the queries that SQL can express; plain definitions, not the operators' methods."""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS x, vec_id AS c FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.x
), c AS (SELECT x, min(c) AS component_id FROM r GROUP BY x)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.x = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.x = e.vec_id
"""

CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), f AS (
  SELECT *, length(regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g'))
    + length(role) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)) AS chars FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""

URLS = r"""
WITH RECURSIVE p AS (
  SELECT page_id, html,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^[^?#]*(\?[^#]*)', 1), '') AS query
  FROM pages
), rules(name, rhost, rpath, verdict) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), m AS (
  SELECT unnest(list_concat(
      list_transform(regexp_extract_all(html, '(?is)(<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>)', 1), lambda x: regexp_extract(x, '(?is)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(regexp_extract_all(html, '(?is)(<meta\b[^>]*http-equiv\s*=\s*["'']?refresh\b[^>]*>)', 1), lambda x: regexp_extract(x, '(?is)\burl\s*=\s*["'']?([^"''\s>;]+)', 1)))) AS target,
    host || path || query AS a FROM p WHERE host <> ''
), e AS (
  SELECT a, translate(regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    || regexp_extract(target, '(?s)^.*?://[^/?#]*([^?#]*)', 1) || regexp_extract(target, '(?s)^[^?#]*(\?[^#]*)', 1) AS b
  FROM m WHERE regexp_extract(target, '(?s)^.*?://([^/?#]*)', 1) <> ''
), l AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (
  SELECT a AS x, a AS y FROM l UNION SELECT r.x, l.b FROM r JOIN l ON l.a = r.y
), n AS (
  SELECT y, host, path FROM (SELECT DISTINCT y, split_part(split_part(y, '?', 1), '/', 1) AS host FROM r) JOIN LATERAL (SELECT substr(split_part(y, '?', 1), length(host) + 1) AS path) ON true
), said AS (
  SELECT y, (SELECT verdict FROM rules WHERE (n.host = rhost OR ends_with(n.host, '.' || rhost)) AND starts_with(n.path, rpath) ORDER BY length(name) DESC, name LIMIT 1) AS v FROM n
), c AS (
  SELECT x FROM r JOIN said USING (y) GROUP BY x HAVING bool_or(coalesce(v, '') = 'block') AND NOT bool_or(coalesce(v, '') = 'allow')
), o AS (
  SELECT page_id, host, path, query, (SELECT {'name': name, 'verdict': verdict} FROM rules WHERE (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath) ORDER BY length(name) DESC, name LIMIT 1) AS w FROM p
)
SELECT page_id, host, path, w.name AS rule, coalesce(w.verdict, CASE WHEN c.x IS NOT NULL THEN 'block' END, 'allow') AS verdict
FROM o LEFT JOIN c ON o.host <> '' AND c.x = o.host || o.path || o.query
"""

MIX = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('9:' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source), w AS (
  SELECT *, [1.0, 2.0, 3.0][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, coalesce(least(cap, (SELECT arg_min(level, cap / w) FROM l WHERE cap >= level * w) * w), cap) AS target FROM l
), r AS (
  SELECT d.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN size > 0 AND start + size / 2.0::DOUBLE <= target - whole * source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

#: A repeat longer than 200 words is a window of 201 words that is there twice; it covers as many words, so few texts are asked.
QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), l AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), w AS (
  SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM d
), g AS (
  SELECT r, i, word, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram FROM w
), t AS (
  SELECT r, i, word, len(gram) = 8 AND count(*) OVER (PARTITION BY r, gram) > 1 AS twice FROM g
), c AS (
  SELECT r, word, bool_or(twice) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered FROM t
), n AS (
  SELECT r, count(*) AS n_words, sum(length(word))::BIGINT AS word_chars, count(*) FILTER (covered) AS n_repeat_words FROM c GROUP BY r
), x AS (
  SELECT r, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 200 FOLLOWING) AS gram
  FROM w WHERE r IN (SELECT r FROM n WHERE n_repeat_words > 200)
), long AS (
  SELECT DISTINCT r FROM (SELECT r FROM x WHERE len(gram) = 201 GROUP BY r, gram HAVING count(*) > 1)
), s AS (
  SELECT d.doc_id, coalesce(n.n_words, 0) AS n_words, coalesce(n.word_chars, 0) AS word_chars,
    length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    (len(l.lines) - len(list_distinct(l.lines)))::BIGINT AS n_dup_lines,
    coalesce(n.n_repeat_words, 0) AS n_repeat_words, long.r IS NOT NULL AS long
  FROM d JOIN l USING (r) LEFT JOIN n USING (r) LEFT JOIN long USING (r)
)
SELECT * EXCLUDE (long), n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT long AS kept
FROM s
"""

ORACLES = {"op2_embedding_dedup": EMBEDDINGS, "op3_chat": CHAT, "op5_quality": QUALITY, "op7_url_filter": URLS, "op9_mix": MIX}
