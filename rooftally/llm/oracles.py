"""Plain SQL for DuckDB that gives the rows of the registered queries."""

from __future__ import annotations

from rooftally.llm.license_scan import TEMPLATES

_WORD = r"[^\x20\x09-\x0D]+"

OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{_WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM rep) GROUP BY r),
f AS (SELECT w.r, doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS bad FROM b GROUP BY source),
m AS (SELECT sum(bad) / sum(n) AS m FROM h),
s AS (SELECT any_value(m) AS m, avg((bad / n - m) ** 2) - avg(m * (1 - m) / n) AS between_ FROM h, m),
k AS (SELECT m, CASE WHEN between_ > 1e-12 THEN greatest(1.0, m * (1 - m) / between_ - 1) ELSE 1e9 END AS k FROM s),
v AS (SELECT source, (bad + k * m) / (n + k) > 0.5 AS host_failed FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

_HOST = "lower(regexp_extract(CASE WHEN position('://' IN {0}) > 0 THEN substr({0}, position('://' IN {0}) + 3) END, '^[^/?#]*'))"
_PATH = ("regexp_extract(CASE WHEN position('://' IN {0}) > 0 THEN substr({0}, position('://' IN {0}) + 3) END, "
         "'^[^/?#]*([^?#]*)', 1)")
_QUERY = "regexp_extract({0}, '^[^?#]*([?][^#]*)', 1)"
_ADDRESS = (f"CASE WHEN {_HOST} <> '' THEN {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END || "
            f"coalesce({_QUERY}, '') END")
_ATTR = ("trim(regexp_extract({0}, '(?i)\\b{1}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s>\"'']+))', 1) || "
         "regexp_extract({0}, '(?i)\\b{1}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s>\"'']+))', 2) || "
         "regexp_extract({0}, '(?i)\\b{1}\\s*=\\s*(?:\"([^\"]*)\"|''([^'']*)''|([^\\s>\"'']+))', 3))")

OP6 = f"""
WITH RECURSIVE p AS (SELECT row_number() OVER () AS r, page_id, url, html, coalesce({_HOST.format('url')}, '') AS host,
                            coalesce({_PATH.format('url')}, '') AS path, {_ADDRESS.format('url')} AS node FROM pages),
tags AS (SELECT url, node, host, path, unnest(regexp_extract_all(
           regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>', '', 'g'), '(?is)<(?:link|meta)\\b[^>]*>')) AS tag FROM p),
hrefs AS (SELECT *, replace(CASE
            WHEN regexp_matches(tag, '(?i)^<link\\b') AND regexp_matches({_ATTR.format('tag', 'rel')}, '(?i)(^|\\s)canonical(\\s|$)')
            THEN {_ATTR.format('tag', 'href')}
            WHEN regexp_matches(tag, '(?i)^<meta\\b') AND lower({_ATTR.format('tag', 'http-equiv')}) = 'refresh'
            THEN trim(regexp_extract({_ATTR.format('tag', 'content')}, '(?i)\\burl\\s*=\\s*[''"]?([^''"]*)', 1))
          END, '&amp;', '&') AS href FROM tags),
targets AS (SELECT node AS src, CASE
              WHEN regexp_matches(href, '(?i)^https?://') THEN href
              WHEN starts_with(href, '//') THEN 'http:' || href
              WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(href, '#') OR href = '' THEN NULL
              WHEN starts_with(href, '/') THEN 'http://' || host || href
              WHEN starts_with(href, '?') THEN 'http://' || host || path || href
              ELSE 'http://' || host || coalesce(nullif(regexp_extract(path, '^(.*/)', 1), ''), '/') || href END AS target
            FROM hrefs WHERE href IS NOT NULL),
e AS (SELECT DISTINCT src, {_ADDRESS.format('target')} AS dst FROM targets WHERE src IS NOT NULL AND target IS NOT NULL),
both_ AS (SELECT src, dst FROM e WHERE dst IS NOT NULL UNION SELECT dst, src FROM e WHERE dst IS NOT NULL),
reach AS (SELECT src AS a, src AS b FROM both_ UNION SELECT reach.a, both_.dst FROM reach JOIN both_ ON reach.b = both_.src),
rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                                 ('org', '/fr/', 'allow')),
places AS (SELECT host, path FROM p UNION SELECT {_HOST.format("('http://' || a)")}, {_PATH.format("('http://' || a)")} FROM reach),
best AS (SELECT host, path, first(rh || rp ORDER BY length(rh || rp) DESC, rh || rp, action) AS rule,
                first(action ORDER BY length(rh || rp) DESC, rh || rp, action) AS action
         FROM places JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY host, path),
bad AS (SELECT DISTINCT a FROM reach JOIN best ON best.host = {_HOST.format("('http://' || b)")}
        AND best.path = {_PATH.format("('http://' || b)")} AND action = 'block')
SELECT page_id, p.host, p.path, rule, coalesce(action, CASE WHEN bad.a IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN best ON p.host = best.host AND p.path = best.path LEFT JOIN bad ON bad.a = p.node
"""


def mixing_ctes(docs: str, most_repeats: float = 2.0, block_rows: int = 1000) -> str:
    """CTEs that end in ``placed`` (source, doc_id, key, n_tokens, copies, pass, start) for the relation ``docs``."""
    return f"""
units AS (SELECT source, doc_id, key, n_tokens, count(*) AS copies FROM (
            SELECT source, doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS BIGINT) AS n_tokens,
                   md5(coalesce('=' || doc_id, '-') || '|' || coalesce('=' || source, '-') || '|' || coalesce('=' || text, '-')) AS key
            FROM {docs}) GROUP BY ALL),
totals AS (SELECT source, sum(n_tokens * copies)::BIGINT AS tokens, count(*) AS n_units FROM units GROUP BY source),
ratio AS (SELECT coalesce(max(tokens) FILTER (tokens > 0) / min(tokens) FILTER (tokens > 0), 1.0) AS q FROM totals),
halving(k, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL SELECT k + 1, CASE WHEN q ** (1 - (lo + hi) / 2) > {most_repeats} THEN (lo + hi) / 2 ELSE lo END,
                   CASE WHEN q ** (1 - (lo + hi) / 2) > {most_repeats} THEN hi ELSE (lo + hi) / 2 END
  FROM halving, ratio WHERE k < 40),
tau AS (SELECT CASE WHEN q <= {most_repeats} THEN 0.0 ELSE hi END AS x FROM halving, ratio WHERE k = 40),
relative AS (SELECT *, CASE WHEN tokens > 0 THEN tokens::DOUBLE ** (x - 1.0) END AS rel FROM totals, tau),
plan AS (SELECT source, tokens, greatest(1, ceil(n_units / {block_rows}))::BIGINT AS blocks,
                floor(round(tokens * round(coalesce(rel / (SELECT min(rel) FROM relative), 0.0), 6), 3))::BIGINT AS quota FROM relative),
passes AS (SELECT u.*, tokens, quota, blocks, ('0x' || key[1:12])::BIGINT % blocks AS block,
                  unnest(range(0, CASE WHEN tokens > 0 THEN (quota // tokens) + 1 ELSE 1 END))::INTEGER AS pass
           FROM units u JOIN plan ON u.source IS NOT DISTINCT FROM plan.source),
sums AS (SELECT source, pass, block, sum(n_tokens * copies)::BIGINT AS s FROM passes GROUP BY ALL),
starts AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY source, pass ORDER BY md5(pass || '|' || coalesce(source, '') || '|' || block), block
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0 FROM sums),
inside AS (SELECT *, coalesce(sum(n_tokens * copies) OVER (PARTITION BY source, pass, block ORDER BY md5(pass || '|' || key), key
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0 FROM passes),
placed AS (SELECT i.source, doc_id, key, n_tokens, copies, i.pass, (i.pass * tokens + s0 + b0)::BIGINT AS start
           FROM inside i JOIN starts t ON i.source IS NOT DISTINCT FROM t.source AND i.pass = t.pass AND i.block = t.block
           WHERE i.pass * tokens + s0 + b0 + n_tokens * copies <= quota)"""


OP10 = f"""
WITH RECURSIVE {mixing_ctes('documents')}
SELECT source, doc_id, n_tokens, pass, start + k * n_tokens AS start
FROM (SELECT *, unnest(range(0, copies)) AS k FROM placed)
"""


OP2 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source FROM documents),
texts AS (SELECT DISTINCT text FROM d WHERE text IS NOT NULL),
bare AS (SELECT DISTINCT text, site, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line
         FROM (SELECT text, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line FROM d WHERE text IS NOT NULL)),
common AS (SELECT line FROM bare WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= 10 AND count(DISTINCT text) > 1),
each AS (SELECT text, i, lines[i] AS line FROM (SELECT text, lines, unnest(range(1, len(lines) + 1)) AS i
         FROM (SELECT text, string_split(text, chr(10)) AS lines FROM texts))),
kept AS (SELECT text, count(*) AS n, count(c.line) AS gone, coalesce(string_agg(e.line, chr(10) ORDER BY i) FILTER (c.line IS NULL), '') AS left_
         FROM each e LEFT JOIN common c ON trim(e.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = c.line GROUP BY text)
SELECT doc_id, coalesce(n, 0) AS n_lines, coalesce(gone, 0) AS n_removed, md5(left_) AS text_md5
FROM d LEFT JOIN kept ON d.text = kept.text
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_GRAMS = "list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4 = f"""
WITH templates(license, template, words) AS (
  SELECT license, template, regexp_extract_all({_LOWER.format('body')}, '[a-z0-9]+') FROM (VALUES
  {", ".join(f"({_quoted(name)}, {k}, {_quoted(v)})" for name, versions in TEMPLATES.items() for k, v in enumerate(versions))}) AS v(license, template, body)),
theirs AS (SELECT license, template, size, g, count(*) AS n FROM (
             SELECT license, template, len(words) - 1 AS size, unnest({_GRAMS.format('words')}) AS g FROM templates) GROUP BY ALL),
d AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text <> ''),
line AS (SELECT r, doc_id, len(lines) AS n_lines, k - 1 AS k, lines[k] AS line,
                trim(lines[k], chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) = '' AS blank
         FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM d)),
block AS (SELECT *, count(*) FILTER (blank) OVER (PARTITION BY r ORDER BY k) AS b FROM line),
extents AS (
  SELECT r, doc_id, 'text' AS segment, 0 AS a, n_lines - 1 AS z, 0 AS rank_ FROM line WHERE k = 0
  UNION ALL SELECT r, doc_id, 'paragraph', min(k), max(k), 1 FROM block WHERE NOT blank GROUP BY r, doc_id, b
  UNION ALL SELECT r, doc_id, 'line', k, k, 2 FROM line WHERE NOT blank),
largest AS (SELECT * FROM extents QUALIFY row_number() OVER (PARTITION BY r, a, z ORDER BY rank_) = 1),
words AS (SELECT l.r, l.doc_id, segment, a, z, regexp_extract_all({_LOWER.format("string_agg(line, chr(10) ORDER BY k)")}, '[a-z0-9]+') AS ws
          FROM largest l JOIN line ON line.r = l.r AND k BETWEEN a AND z GROUP BY l.r, l.doc_id, segment, a, z),
mine AS (SELECT r, doc_id, segment, a, z, size, g, count(*) AS n FROM (
           SELECT r, doc_id, segment, a, z, len(ws) - 1 AS size, unnest({_GRAMS.format('ws')}) AS g FROM words
           WHERE len(ws) BETWEEN 2 AND 1000) GROUP BY ALL)
SELECT doc_id, license, template::INTEGER AS template, segment, a::BIGINT AS first_line, z::BIGINT AS last_line,
       round(2 * sum(least(mine.n, theirs.n)) / (any_value(mine.size) + any_value(theirs.size)), 6)::DOUBLE AS dice
FROM mine JOIN theirs USING (g) GROUP BY r, doc_id, license, template, segment, a, z
HAVING 2 * sum(least(mine.n, theirs.n)) / (any_value(mine.size) + any_value(theirs.size)) >= 0.8
"""

OP8 = """
WITH d AS (SELECT DISTINCT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
windows AS (SELECT doc_id, i, md5(substr(hx, 2 * i + 1, 200)) AS g FROM (SELECT *, unnest(range(0, length(hx) // 2 - 99)) AS i FROM d)),
again AS (SELECT doc_id, i FROM windows QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
steps AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS opens FROM again),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS b
         FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM steps) GROUP BY doc_id, k),
before AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM runs),
kept AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last,
                string_agg(substr(hx, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS head
         FROM before JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

def _field(v: str) -> str:
    return f"coalesce(octet_length(encode(({v})::VARCHAR))::VARCHAR || ':' || ({v})::VARCHAR, '-')"


OP13 = f"""
WITH RECURSIVE leaf AS (
  SELECT doc_id, coalesce('=' || lang, '-') AS tree,
         sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars')} || {_field('text')}) AS leaf,
         sha256({_field('doc_id')} || {_field('source')} || {_field('lang')} || {_field('n_chars + 1')} || {_field('text')}) AS forged,
         -- CRC-32 a bit at a time: each byte is folded in ahead of eight steps
         xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0])),
                         lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS crc
  FROM documents),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
node AS (
  SELECT tree, 0 AS level, i, leaf AS h, n FROM placed
  UNION ALL
  SELECT tree, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM node WHERE n > 1
  GROUP BY tree, level, i // 2),
subroot AS (SELECT tree, h, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM node WHERE n = 1),
high AS (
  SELECT 0 AS level, i, h, n FROM subroot
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, i // 2),
low_fold AS (
  SELECT doc_id, tree, i AS leaf_no, i, 0 AS level, n, CASE WHEN crc % 7 = 0 THEN forged ELSE leaf END AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.doc_id, f.tree, f.leaf_no, f.i // 2, f.level + 1, (f.n + 1) // 2,
         sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM low_fold f LEFT JOIN node s ON s.tree = f.tree AND s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1),
high_fold AS (
  SELECT f.doc_id, f.tree, f.leaf_no, r.i, 0 AS level, r.n, f.h, f.proof FROM low_fold f JOIN subroot r ON r.tree = f.tree WHERE f.n = 1
  UNION ALL
  SELECT f.doc_id, f.tree, f.leaf_no, f.i // 2, f.level + 1, (f.n + 1) // 2,
         sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
  FROM high_fold f LEFT JOIN high s ON s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1)
SELECT p.doc_id, p.leaf, r.h AS subroot, t.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN high_fold f ON f.tree = p.tree AND f.leaf_no = p.i AND f.n = 1 JOIN subroot r ON r.tree = p.tree
JOIN high t ON t.n = 1
"""

ORACLES = {"op2_line_dedup": OP2, "op3_quality_rules": OP3, "op4_license_scan": OP4, "op6_url_filter": OP6, "op8_suffix_dedup": OP8,
           "op10_mixing": OP10, "op13_merkle": OP13}
