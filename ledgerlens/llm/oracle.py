"""DuckDB SQL for the queries of this folder that SQL can express."""

from __future__ import annotations

from .licenses import CONTAINMENT, SHINGLE, TEMPLATES

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = """
WITH hashed AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hx FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda j: substr(
    '0000000100100011010001010110011110001001101010111100110111101111',
    4 * (strpos('0123456789abcdef', substr(hx, CAST(j AS INTEGER), 1)) - 1) + 1, 4)), '') AS b
  FROM hashed
), named AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr(
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + 16 * CAST(substr(b, CAST(5 * i + 1 AS INTEGER), 1) AS INTEGER) + 8 * CAST(substr(b, CAST(5 * i + 2 AS INTEGER), 1) AS INTEGER)
    + 4 * CAST(substr(b, CAST(5 * i + 3 AS INTEGER), 1) AS INTEGER) + 2 * CAST(substr(b, CAST(5 * i + 4 AS INTEGER), 1) AS INTEGER)
    + CAST(substr(b, CAST(5 * i + 5 AS INTEGER), 1) AS INTEGER) AS INTEGER), 1)), '') AS payload_digest FROM bits
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM named
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM firsts
"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_NEXT = ", ".join(f"lead(w0, {j}) OVER own AS w{j}" for j in range(1, 10))
_WANTED = ", ".join(f"CASE WHEN n > {j} THEN w{j} END" for j in range(1, 10))
OP2 = f"""
WITH items AS (
  SELECT DISTINCT item_id, {_WORDS} AS words FROM benchmark
), patterns AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS n, array_to_string(list_slice(words, i, i + least(10, len(words)) - 1), ' ') AS gram
  FROM (SELECT item_id, words, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS i FROM items WHERE len(words) > 0) q
), docs AS (
  SELECT doc_id, {_WORDS} AS words FROM documents
), places AS (
  SELECT *, {_NEXT} FROM (SELECT doc_id, len(words) AS n_words, unnest(words) AS w0, generate_subscripts(words, 1) AS i FROM docs) q
  WINDOW own AS (PARTITION BY doc_id ORDER BY i)
), grams AS (
  SELECT doc_id, n, i, concat_ws(' ', w0, {_WANTED}) AS gram FROM places, (SELECT DISTINCT n FROM patterns) s WHERE i + n - 1 <= n_words
), hits AS (
  SELECT doc_id, item_id, i, g.n FROM grams g JOIN patterns p ON g.gram = p.gram AND g.n = p.n
), hit_words AS (
  SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM hits) q GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM hits) q GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hit_words w ON d.doc_id = w.doc_id LEFT JOIN hit_items i ON d.doc_id = i.doc_id
"""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST(concat('0x', substr(md5(concat('mix-1:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13)) AS BIGINT) + 1) / 4503599627370496.0::DOUBLE)
    / (1.0::DOUBLE - 0.5::DOUBLE * length(regexp_replace(coalesce(text, ''), '[^!*#$%&|]', '', 'g')) / greatest(length(coalesce(text, '')), 1)) AS key
  FROM documents
), sources AS (
  SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM sized GROUP BY source) q
), capped AS (
  SELECT *, 3 * source_size / weight AS cap,
    coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY 3 * source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open,
    sum(source_size) OVER () AS total
  FROM sources
), levels AS (
  SELECT arg_min(CAST(total - held AS DOUBLE) / CAST(open AS DOUBLE), row_number) AS level
  FROM (SELECT *, row_number() OVER (ORDER BY cap, rank) AS row_number FROM capped) q
  WHERE cap > CAST(total - held AS DOUBLE) / CAST(open AS DOUBLE)
), targets AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM capped, levels
), wanted AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS want FROM targets
), ordered AS (
  SELECT s.doc_id, s.size, w.source_size, w.target, w.want,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target, CAST(coalesce(want // nullif(source_size, 0), 0) * size
  + greatest(0, least(size, coalesce(want % nullif(source_size, 0), 0) - ahead)) AS BIGINT) AS taken
FROM ordered
"""

_HOST = rf"translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{_UP}', '{_LOW}')"
_PATH = r"coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '')"
_RULED = f"""
  SELECT u.*, r.rule, r.own FROM (SELECT *, {_HOST} AS host, {_PATH} AS path FROM {{table}}) u
  LEFT JOIN LATERAL (
    SELECT concat(rules.host, rules.path) AS rule, rules.own FROM rules
    WHERE (u.host = rules.host OR u.host LIKE concat('%.', rules.host)) AND starts_with(u.path, rules.path)
    ORDER BY length(rules.host) + length(rules.path) DESC LIMIT 1) r ON true
"""

OP7 = rf"""
WITH RECURSIVE rules(host, path, own) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), links AS (
  SELECT DISTINCT regexp_replace(url, '(?s)#.*$', '') AS a, regexp_replace(replace(t, '&amp;', '&'), '(?s)#.*$', '') AS b FROM (SELECT url,
    CASE WHEN starts_with(t, '//') THEN concat(regexp_extract(url, '(?s)^(.*?:)//', 1), t) WHEN starts_with(t, '/') THEN concat(regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1), t) ELSE t END AS t FROM (
    SELECT url, unnest([
      regexp_extract(regexp_extract(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical[^>]*>'), '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1),
      regexp_extract(regexp_extract(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>'), '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1)]) AS t
    FROM pages WHERE url IS NOT NULL AND html IS NOT NULL) p) q WHERE contains(t, '://')
), both_ways AS (
  SELECT a, b FROM links WHERE a <> b UNION SELECT b, a FROM links WHERE a <> b
), reach AS (
  SELECT a AS node, a AS url FROM both_ways UNION SELECT reach.node, both_ways.b FROM reach JOIN both_ways ON reach.url = both_ways.a
), judged AS ({_RULED.format(table="reach")}), spread AS (
  SELECT DISTINCT node FROM judged WHERE own = 'block'
), ruled AS ({_RULED.format(table="(SELECT page_id, url FROM pages) p")})
SELECT page_id, host, path, rule, coalesce(own, CASE WHEN node IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN spread ON regexp_replace(ruled.url, '(?s)#.*$', '') = spread.node
"""

_LEADS = ", ".join(f"lead(word, {j}) OVER own" for j in range(1, SHINGLE))
_SHINGLES = f"""
  SELECT id, i - 1 AS i, concat_ws(' ', word, {_LEADS}) AS gram, greatest(1, n - {SHINGLE - 1}) AS last
  FROM (SELECT id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM (
    SELECT {{id}} AS id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM {{table}}) q) r
  WINDOW own AS (PARTITION BY id ORDER BY i) QUALIFY i <= last
"""

#: Containment in every window, without retrieval by MinHash bands; so a window that no band meets would differ.
OP8 = f"""
WITH notices(id, name, text) AS (
  VALUES {", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))}
), grams AS (
  SELECT DISTINCT id, gram FROM ({_SHINGLES.format(id="id", table="notices")}) t
), templates AS (
  SELECT id, name, m, CAST(2 ** greatest(0, ceil(log2(m))) AS BIGINT) AS step, gram
  FROM grams JOIN (SELECT id, count(*) AS m FROM grams GROUP BY id) c USING (id) JOIN notices USING (id)
), places AS (
  SELECT id AS doc_id, i, gram FROM ({_SHINGLES.format(id="doc_id", table="documents")}) d
), hits AS (
  SELECT DISTINCT doc_id, id, name, m, gram, unnest([i // step, greatest(i // step - 1, 0)]) AS k
  FROM (SELECT p.doc_id, t.id, t.name, t.m, t.gram, p.i, t.step FROM places p JOIN templates t ON p.gram = t.gram) q
), windows AS (
  SELECT doc_id, id, name, k FROM hits GROUP BY doc_id, id, name, k, m HAVING count(*) >= {CONTAINMENT}::DOUBLE * m
), found AS (
  SELECT doc_id, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_windows FROM windows GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(n_windows, 0) AS n_windows
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""

ORACLE_SQL = {"op1_warc": OP1, "op2_decontamination": OP2, "op5_mixing": OP5, "op7_urlfilter": OP7, "op8_licenses": OP8}
