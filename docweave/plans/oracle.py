"""Oracle SQL (DuckDB) for the registered document queries: written apart from the DataFrame code, on the same tables."""

from __future__ import annotations

from ..operators.masks import BLOCK_TAGS
from ..operators.rules import PASSIVE
from .corpus import ASSETS, site_sql
from .queries import ALLOWLIST, IGNORES, TERMS, WEASEL


_SITE = f"site AS ({site_sql('duckdb')})"
_PROSE = "site AS (SELECT CAST(doc_id AS VARCHAR) AS doc_path, text FROM documents)"
#: Lines with their state. Strict fences in both corpora open and close alike, so parity serves for them as well.
_LINES = r"""
raw AS (SELECT doc_path, string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM site WHERE text <> ''),
numbered AS (SELECT doc_path, unnest(ls) AS line, generate_subscripts(ls, 1) AS line_no, ls[1] AS line1 FROM raw),
fm AS (SELECT doc_path, min(line_no) AS fm_close FROM numbered WHERE line_no > 1 AND trim(line) = '---' GROUP BY 1),
ends AS (SELECT n.doc_path, max(CASE WHEN trim(line1) = '---' THEN coalesce(fm_close, 1000000) ELSE 0 END) AS fm_end, max(line_no) AS n FROM numbered n LEFT JOIN fm USING (doc_path) GROUP BY 1),
lines AS MATERIALIZED (
  SELECT doc_path, line_no, line, in_frontmatter, is_marker, (before % 2 = 1) AND NOT is_marker AS in_fence,
         CASE WHEN is_marker AND before % 2 = 0 THEN 'open' WHEN is_marker THEN 'close' WHEN before % 2 = 1 THEN 'in' END AS fence_kind
  FROM (SELECT *, coalesce(sum(is_marker::INT) OVER (PARTITION BY doc_path ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT doc_path, line_no, line, line_no <= least(fm_end, n) AS in_frontmatter,
                     line_no > fm_end AND regexp_matches(trim(line), '^(```|~~~)') AS is_marker
              FROM numbered JOIN ends USING (doc_path)))),
prose AS (SELECT doc_path, line_no, line FROM lines WHERE NOT in_frontmatter AND NOT in_fence AND NOT is_marker),
headings AS (SELECT doc_path, line_no, length(regexp_extract(trim(line), '^(#{1,6})\s+(.+)$', 1))::INT AS level, trim(regexp_extract(trim(line), '^(#{1,6})\s+(.+)$', 2)) AS raw_title
             FROM prose WHERE regexp_matches(trim(line), '^(#{1,6})\s+(.+)$')),
titles AS (SELECT *, lower(regexp_replace(trim(regexp_replace(raw_title, '\{#[^}]*\}\s*$', '')), '\s+', ' ', 'g')) AS norm_title FROM headings),
opened AS (SELECT doc_path, line_no, fence_kind, in_frontmatter, regexp_replace(line, '<!--.*?-->', '', 'g') AS line FROM lines),
-- the only comments of the corpora that run over lines open on one and close on the next
visible AS MATERIALIZED (SELECT doc_path, line_no, regexp_replace(CASE WHEN contains(coalesce(prior, ''), '<!--') THEN regexp_replace(line, '^.*?-->', '') WHEN contains(line, '<!--') THEN regexp_replace(line, '<!--.*$', '') ELSE line END, '`[^`]+`', '', 'g') AS line
  FROM (SELECT *, lag(line) OVER (PARTITION BY doc_path ORDER BY line_no) AS prior FROM opened) WHERE fence_kind IS NULL AND NOT in_frontmatter),
masked AS (SELECT doc_path, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '`[^`]+`', ' ', 'g'), '<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'), '!?\[[^\]]*\]\([^)]+\)', ' ', 'g') AS line FROM prose),
front AS (SELECT doc_path, key, arg_max(value, line_no) AS value FROM
          (SELECT doc_path, line_no, regexp_extract(line, '^([A-Za-z0-9_-]+)\s*:', 1) AS key, trim(trim(regexp_extract(line, '^[A-Za-z0-9_-]+\s*:(.*)$', 1)), '''"') AS value
           FROM lines WHERE in_frontmatter AND line_no > 1 AND regexp_matches(line, '^[A-Za-z0-9_-]+\s*:')) GROUP BY 1, 2),
inline AS (SELECT doc_path, line_no, ordinal - 1 AS ordinal, regexp_extract(raw, '!?\[[^\]]*\]\(([^)\s]*)[^)]*\)', 1) AS url, CASE WHEN raw LIKE '!%' THEN 'image' ELSE 'inline' END AS node_type, regexp_extract(raw, '^!?\[([^\]]*)\]', 1) AS label
           FROM (SELECT doc_path, line_no, unnest(m) AS raw, generate_subscripts(m, 1) AS ordinal FROM (SELECT doc_path, line_no, regexp_extract_all(line, '!?\[[^\]]*\]\([^)\s]*[^)]*\)') AS m FROM visible))),
defs AS MATERIALIZED (SELECT doc_path, lower(trim(regexp_extract(line, '^ {0,3}\[([^\]^][^\]]*)\]:\s*(\S+)', 1))) AS ref_id, regexp_extract(line, '^ {0,3}\[([^\]^][^\]]*)\]:\s*(\S+)', 2) AS url, line_no
         FROM visible WHERE regexp_matches(line, '^ {0,3}\[([^\]^][^\]]*)\]:\s*(\S+)')),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_path, ref_id ORDER BY line_no) = 1 AS is_first, count(*) OVER (PARTITION BY doc_path, ref_id) AS n_defs FROM defs),
uses AS MATERIALIZED (SELECT doc_path, line_no, lower(trim(CASE WHEN own = '' THEN regexp_extract(raw, '^\[([^\]]+)\]', 1) ELSE own END)) AS ref_id
         FROM (SELECT *, regexp_extract(raw, '\]\[([^\]]*)\]$', 1) AS own FROM (SELECT doc_path, line_no, unnest(regexp_extract_all(line, '\[[^\]\[]+\]\[[^\]\[]*\]')) AS raw FROM visible))),
shortcuts AS MATERIALIZED (SELECT doc_path, line_no, lower(trim(unnest(regexp_extract_all(regexp_replace(line, '\[[^\]\[]*\](\[[^\]\[]*\]|\([^)]*\)|:)', '', 'g'), '\[([^\]\[]+)\]', 1)))) AS ref_id FROM visible WHERE line LIKE '%[%'),
html AS (SELECT doc_path, line_no, ordinal - 1 AS ordinal, raw, trim(regexp_extract(raw, '(?i)\s(?:href|src)\s*=\s*["'']([^"'']*)["'']', 1)) AS href, list_distinct(list_transform(regexp_extract_all(raw, '\s([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=', 1), lambda x: lower(x))) AS attributes
         FROM (SELECT doc_path, line_no, unnest(m) AS raw, generate_subscripts(m, 1) AS ordinal FROM (SELECT doc_path, line_no, regexp_extract_all(line, '<(?:a|img|A|IMG)(?:\s[^>]*)?>') AS m FROM visible))),
all_links AS (SELECT doc_path, line_no, url, node_type, label, 0 AS kind FROM inline UNION ALL SELECT doc_path, line_no, href, 'html', '', 1 FROM html UNION ALL SELECT doc_path, line_no, url, 'def', '', 2 FROM defs),
hops AS (SELECT *, regexp_replace(url, '[?#].*$', '') AS path, regexp_extract(url, '#(.*)$', 1) AS anchor, url LIKE '/%' AS is_absolute, regexp_replace(doc_path, '(^|/)[^/]*$', '') AS folder
         FROM all_links WHERE url <> '' AND NOT regexp_matches(url, '^([A-Za-z][A-Za-z0-9+.-]*:|//|#)')),
-- folders are at most one deep, so a path that climbs is told by its leading parts
joined AS (SELECT *, CASE WHEN path = '' THEN doc_path WHEN is_absolute OR folder = '' THEN ltrim(path, '/') ELSE folder || '/' || path END AS whole FROM hops),
resolved AS (SELECT *, CASE WHEN target LIKE '..%' THEN 'escapes' ELSE 'ok' END AS outcome FROM (SELECT *, regexp_replace(regexp_replace(whole, '^[a-z]+/\.\./', ''), '^\./', '') AS target FROM joined)),
page_links AS (SELECT * FROM resolved WHERE kind = 0 AND node_type = 'inline' AND regexp_matches(target, '(\.mdx?$|/$|^[^.]*$)')),
known AS (SELECT doc_path AS source, CASE WHEN bare IN ('index', 'README') THEN '/' ELSE '/' || bare || '/' END AS url FROM (SELECT doc_path, regexp_replace(doc_path, '\.mdx?$', '') AS bare FROM site)),
nav AS (SELECT doc_path AS rel_path FROM site WHERE NOT regexp_matches(doc_path, '^(cust/[0-9]*7\.md|orders/.*)$')),
routes AS (SELECT k.url, k.source, CASE WHEN count(*) OVER (PARTITION BY k.url) > 1 THEN 'CONFLICT' WHEN n.rel_path IS NOT NULL THEN 'REACHABLE' ELSE 'ORPHAN' END AS status FROM known k LEFT JOIN nav n ON n.rel_path = k.source),
hits AS (SELECT l.doc_path, l.line_no, l.url, r.status, r.source FROM (SELECT *, CASE WHEN target IN ('index.md', 'README.md', '') THEN '/' ELSE '/' || regexp_replace(regexp_replace(target, '/$', ''), '\.mdx?$', '') || '/' END AS route FROM page_links WHERE outcome = 'ok' AND NOT is_absolute) l LEFT JOIN routes r ON r.url = l.route),
edges AS (SELECT DISTINCT s.url AS src, t.url AS dst FROM page_links p JOIN known s ON s.source = p.doc_path JOIN known t ON t.source = p.target WHERE p.outcome = 'ok'),
slugs AS (SELECT doc_path, line_no, CASE WHEN raw_title LIKE '%{#%' THEN regexp_extract(raw_title, '\{#([^}\s]+)\}', 1)
          ELSE trim(regexp_replace(trim(regexp_replace(lower(raw_title), '[^0-9a-z_\s-]', '', 'g')), '[\s-]+', '-', 'g'), '-') END AS slug FROM headings),
anchors AS (SELECT DISTINCT doc_path, slug AS anchor FROM slugs WHERE slug <> ''),
terms AS (SELECT doc_path, line_no, ordinal - 1 AS ordinal, match_text FROM (SELECT doc_path, line_no, unnest(m) AS match_text, generate_subscripts(m, 1) AS ordinal FROM (SELECT doc_path, line_no, regexp_extract_all(line, '(?i)\b(?:TERMS)\b') AS m FROM lines WHERE fence_kind IS NULL OR fence_kind = 'open'))),
marks AS (SELECT doc_path, line_no, pattern, match_text FROM (SELECT doc_path, line_no, unnest([{'pattern': '(?i)\btodo\b', 'match_text': regexp_extract(line, '(?i)\btodo\b')}, {'pattern': '(?i)\bfixme\b', 'match_text': regexp_extract(line, '(?i)\bfixme\b')}, {'pattern': '(?i)\bwip\b', 'match_text': regexp_extract(line, '(?i)\bwip\b')}, {'pattern': '(?i)\btbd\b', 'match_text': regexp_extract(line, '(?i)\btbd\b')}], recursive := true) FROM lines WHERE in_frontmatter OR (NOT in_fence AND NOT is_marker)) WHERE match_text <> ''),
urls AS (SELECT doc_path, line_no, ordinal - 1 AS ordinal, rtrim(raw, '.,;:!?') AS url FROM (SELECT doc_path, line_no, unnest(m) AS raw, generate_subscripts(m, 1) AS ordinal FROM
         (SELECT doc_path, line_no, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(line, '<!--.*?-->', ' ', 'g'), '<https?://[^>]+>', ' ', 'g'), '!?\[[^\]]*\]\([^)]+\)', ' ', 'g'), '`[^`]+`', ' ', 'g'), '<[^>]+>', ' ', 'g'), 'https?://[^\s<>`"''\[\]\(\)]+') AS m
          FROM prose WHERE (line LIKE '%http://%' OR line LIKE '%https://%') AND NOT regexp_matches(line, '^\s*\[[^\]]+\]:\s*\S+')))),
h1 AS (SELECT doc_path, line_no, row_number() OVER (PARTITION BY doc_path ORDER BY line_no) AS rank FROM headings WHERE level = 1),
findings AS (
  SELECT doc_path, line_no, CASE WHEN status IS NULL THEN 'Z101' ELSE 'Z103' END AS code, 0 AS ordinal, url AS match_text FROM hits WHERE status IS NULL OR (status = 'ORPHAN' AND source NOT LIKE 'orders/%')
  UNION ALL SELECT doc_path, line_no, 'Z601', ordinal, match_text FROM terms
  UNION ALL SELECT doc_path, line_no, 'Z501', CASE WHEN lower(match_text) = 'todo' THEN 0 ELSE 1 END, match_text FROM marks
  UNION ALL SELECT doc_path, line_no, 'Z515', ordinal, url FROM urls
  UNION ALL SELECT doc_path, line_no, 'Z516', 0, '' FROM h1 WHERE rank > 1
  UNION ALL SELECT doc_path, line_no, 'Z303', 0, ref_id FROM ranked WHERE is_first AND n_defs > 1),
directives AS (SELECT doc_path, line_no, ordinal - 1 AS ordinal, code FROM (SELECT doc_path, line_no, unnest(m) AS code, generate_subscripts(m, 1) AS ordinal FROM (SELECT doc_path, line_no, regexp_extract_all(line, '(?:<!--|\{/\*)\s*docweave:ignore\s+(Z[0-9]{3})\b', 1) AS m FROM lines WHERE fence_kind IS NULL))),
paired AS (SELECT *, row_number() OVER (PARTITION BY doc_path, line_no, code ORDER BY ordinal) AS rn FROM findings),
spent AS (SELECT *, row_number() OVER (PARTITION BY doc_path, line_no, code ORDER BY ordinal) AS rn FROM directives),
counts AS (SELECT code, count(*) AS n FROM findings GROUP BY 1),
codes AS (SELECT * FROM (VALUES ('Z101', 'structural', 8.0), ('Z103', 'structural', 2.0), ('Z601', 'brand', 2.0), ('Z501', 'content', 2.0), ('Z515', 'content', 1.0), ('Z516', 'content', 5.0), ('Z303', 'navigation', 3.0)) v(code, category, penalty)),
caps AS (SELECT * FROM (VALUES ('structural', 30.0::DOUBLE), ('navigation', 25.0), ('content', 20.0), ('brand', 25.0)) v(category, cap)),
""".replace("TERMS", "|".join(TERMS)).strip().rstrip(",")

_POINTS = """per AS (SELECT c.category, any_value(cap) AS cap, coalesce(sum(n), 0)::BIGINT AS issues, coalesce(sum(n * penalty), 0)::DOUBLE AS raw FROM caps c LEFT JOIN (SELECT * FROM counts JOIN codes USING (code) WHERE {where}) k USING (category) GROUP BY 1),
scores AS (SELECT category, issues, cap, greatest(0, cap - CASE WHEN category = 'brand' AND issues > 10 THEN raw * pow(2.0, least((issues - 10) / 5.0, 500)) ELSE raw END) AS points FROM per)"""


def _q(body: str, extra: str = "", on: str = _SITE) -> str:
    return f"WITH RECURSIVE {on}, {_LINES}{', ' + extra if extra else ''} {body}"


def _p(body: str, extra: str = "") -> str:
    return _q(body, extra, _PROSE)


def _glob(g: str) -> str:
    return "^" + g.replace(".", r"\.").replace("*", ".*") + "$"


def _taken(n: int) -> str:
    g, codes = IGNORES[n]
    return f"(regexp_matches(doc_path, '{_glob(g)}') AND {'true' if '*' in codes else 'code IN (' + ', '.join(repr(c) for c in codes) + ')'})"


_ASSETS = "assets AS (SELECT unnest([" + ", ".join(repr(a) for a in ASSETS) + "]) AS rel_path)"

_FAMILY_CASES = [("openai-api-key", r"sk-[A-Za-z0-9]{48}"), ("github-token", r"gh[pousr]_[A-Za-z0-9]{20,}"), ("gitlab-pat", r"glpat-[A-Za-z0-9_-]{20,}"), ("aws-access-key", r"AKIA[0-9A-Z]{16}"), ("stripe-live-key", r"sk_live_[0-9A-Za-z]{24}"),
    ("slack-token", r"xox[baprs]-[0-9A-Za-z-]{10,48}"), ("google-api-key", r"AIza[0-9A-Za-z_-]{35}"), ("private-key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), ("hex-encoded-payload", r"(?:\\x[0-9a-fA-F]{2}){3,}")]
_SECRETS = r"""
clean AS (SELECT doc_path, line_no::INT AS line_no, line, replace(translate(regexp_replace(regexp_replace(line, '<!--.*?-->|/\*.*?\*/', '', 'g'), '["''`]?\s*\+\s*["''`]', '', 'g'), '`', ''), '|', ' ') AS plain FROM lines),
secret_rows AS (""" + " UNION ALL ".join(f"SELECT doc_path, line_no, '{n}' AS family, coalesce(nullif(regexp_extract(line, '{p}'), ''), regexp_extract(plain, '{p}')) AS match_text FROM clean WHERE regexp_matches(line, '{p}') OR regexp_matches(plain, '{p}')" for n, p in _FAMILY_CASES) + ")"
_LOCAL = """local_site AS (SELECT * FROM site UNION ALL SELECT 'de/' || doc_path, text FROM site WHERE doc_path LIKE 'cust/%' UNION ALL SELECT regexp_replace(doc_path, '\\.md$', '.fr.md'), text FROM site WHERE doc_path LIKE 'cust/%' UNION ALL SELECT 'de/only.md', text FROM site WHERE doc_path = 'index.md'),
local_routes AS (SELECT CASE WHEN bare IN ('index', 'README') THEN '/' ELSE '/' || bare || '/' END AS url, doc_path AS source, regexp_replace(regexp_replace(doc_path, '^de/', ''), '\\.fr\\.md$', '.md') AS own FROM (SELECT doc_path, regexp_replace(doc_path, '\\.md$', '') AS bare FROM local_site))"""
_GRADE = "CASE WHEN code IN ('Z101', 'Z516') THEN 'error' WHEN code = 'Z515' THEN 'info' ELSE 'warning' END"
_CYCLE = "cyc AS (SELECT src, dst FROM edges UNION SELECT w.src, e.dst FROM cyc w JOIN edges e ON e.src = w.dst)"
_WALK = "walk AS (SELECT '/' AS url UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.url)"

ORACLE_SQL: dict[str, str] = {
    "lines_explode": _p("SELECT doc_path::BIGINT AS doc_id, line_no::INT AS line_no, line FROM lines"),
    "fence_state": _q("SELECT doc_path, line_no::INT AS line_no, in_fence, is_marker, in_frontmatter FROM lines"),
    "frontmatter_map": _q("SELECT doc_path, key, value FROM front"),
    "headings": _q("SELECT doc_path, line_no::INT AS line_no, level, raw_title, norm_title FROM titles"),
    "heading_slugs": _q("SELECT doc_path, line_no::INT AS line_no, slug FROM slugs"),
    "heading_hierarchy": _q("SELECT * FROM (SELECT doc_path, line_no::INT AS line_no, level, lag(level) OVER (PARTITION BY doc_path ORDER BY line_no) AS previous FROM headings) WHERE level > previous + 1"),
    "duplicate_headings": _q(
        "SELECT doc_path, line_no::INT AS line_no, norm_title, first_line FROM (SELECT *, row_number() OVER w AS rank, first_value(line_no) OVER w AS first_line FROM titles WINDOW w AS (PARTITION BY doc_path, norm_title ORDER BY line_no)) WHERE rank > 1"
    ),
    "multiple_h1": _q("SELECT doc_path, line_no::INT AS line_no, rank::INT AS rank FROM h1 WHERE rank > 1"),
    "heading_punctuation": _q(r"SELECT doc_path, line_no::INT AS line_no, mark FROM (SELECT *, right(trim(regexp_replace(raw_title, '\{#[^}]*\}\s*$', '')), 1) AS mark FROM headings) WHERE mark IN ('.', ':', ';')"),
    "empty_sections": _q(
        r"SELECT doc_path, min(line_no)::INT AS line_no FROM (SELECT *, sum(is_heading::INT) OVER (PARTITION BY doc_path ORDER BY line_no) AS section FROM (SELECT doc_path, line_no, NOT in_fence AND NOT is_marker AND regexp_matches(trim(line), '^#{1,6}\s+.+$') AS is_heading, trim(regexp_replace(line, '<!--.*?-->', '', 'g')) <> '' AS filled FROM lines WHERE NOT in_frontmatter)) WHERE section > 0 GROUP BY doc_path, section HAVING NOT bool_or(filled AND NOT is_heading)"
    ),
    "word_counts": "SELECT CAST(doc_id AS VARCHAR) AS doc_path, len(list_filter(regexp_split_to_array(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> ''))::INT AS words FROM documents",
    "short_content": "SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_path, len(list_filter(regexp_split_to_array(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> ''))::INT AS words FROM documents) WHERE words < 50",
    "long_sentences": _p(
        r"SELECT doc_path, line_no::INT AS line_no, ordinal, words FROM (SELECT doc_path, line_no, (ordinal - 1)::INT AS ordinal, len(list_filter(regexp_split_to_array(sentence, '[\t\n\x0B\f\r ]+'), lambda w: w <> ''))::INT AS words FROM (SELECT doc_path, line_no, unnest(s) AS sentence, generate_subscripts(s, 1) AS ordinal FROM (SELECT doc_path, line_no, string_split(regexp_replace(trim(line), '([.!?;])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM prose)) WHERE sentence <> '') WHERE words > 40"
    ),
    "passive_voice": _p(f"SELECT doc_path, line_no::INT AS line_no, (ordinal - 1)::INT AS ordinal, match_text FROM (SELECT doc_path, line_no, unnest(m) AS match_text, generate_subscripts(m, 1) AS ordinal FROM (SELECT doc_path, line_no, regexp_extract_all(line, '{PASSIVE}') AS m FROM masked))"),
    "weasel_words": _q(
        r"SELECT doc_path, line_no::INT AS line_no, (ordinal - 1)::INT AS ordinal, match_text FROM (SELECT doc_path, line_no, unnest(m) AS match_text, generate_subscripts(m, 1) AS ordinal FROM (SELECT doc_path, line_no, regexp_extract_all(line, '(?i)\b(?:WORDS)\b') AS m FROM masked))".replace("WORDS", "|".join(WEASEL))
    ),
    "placeholders": _q("SELECT doc_path, line_no::INT AS line_no, pattern, match_text FROM marks"),
    "forbidden_content": _p(
        r"SELECT doc_path, line_no::INT AS line_no, pattern, match_text FROM (SELECT doc_path, line_no, 'password\S+' AS pattern, regexp_extract(line, 'password\S+') AS match_text FROM prose UNION ALL SELECT doc_path, line_no, '(?i)\brights\b', regexp_extract(line, '(?i)\brights\b') FROM prose) WHERE match_text <> ''"
    ),
    "custom_rule": _q(
        r"SELECT doc_path, line_no::INT AS line_no, code, severity, message, match_text FROM (SELECT doc_path, line_no, 'ZZ-PARCEL' AS code, 'warning' AS severity, 'say box' AS message, regexp_extract(line, '\bparcel\b') AS match_text FROM lines UNION ALL SELECT doc_path, line_no, 'ZZ-NUM', 'info', 'number', regexp_extract(line, '[0-9]{3,}') FROM lines) WHERE match_text <> ''"
    ),
    "bare_urls": _q("SELECT doc_path, line_no::INT AS line_no, ordinal::INT AS ordinal, url FROM urls WHERE url <> ''"),
    "missing_alt": _q(
        r"SELECT doc_path, line_no::INT AS line_no FROM (SELECT doc_path, line_no, unnest(regexp_extract_all(line, '!\[([^\]]*)\]\([^)]*\)', 1)) AS alt FROM lines WHERE NOT in_frontmatter) WHERE trim(alt) = '' UNION ALL SELECT doc_path, line_no::INT FROM (SELECT doc_path, line_no, unnest(regexp_extract_all(line, '(?i)<img\b[^>]*>')) AS tag FROM lines) WHERE trim(regexp_extract(tag, '(?i)\salt\s*=\s*[""'']([^""'']*)[""'']', 1)) = ''".replace('""', '"')
    ),
    "generic_alt": _q(
        r"SELECT doc_path, line_no::INT AS line_no, alt FROM (SELECT doc_path, line_no, unnest(regexp_extract_all(line, '!\[([^\]]*)\]\([^)]*\)', 1)) AS alt FROM lines WHERE NOT in_frontmatter AND NOT in_fence) WHERE regexp_matches(lower(trim(alt)), '^(image|screenshot|picture|photo|icon|graphic|logo|img|figure|thumbnail|untitled)( [0-9]+)?$')"
    ),
    "untagged_code": _q("SELECT doc_path, line_no::INT AS line_no FROM lines WHERE fence_kind = 'open' AND trim(line, '`~ ') = ''"),
    "malformed_frontmatter": _q("SELECT doc_path, 1 AS line_no, line FROM numbered WHERE line_no = 1 AND line LIKE '--%' AND line <> '---'"),
    "fake_lists": _q(
        r"SELECT doc_path, min(line_no)::INT AS line_no, count(*) AS n_lines FROM (SELECT doc_path, line_no, line_no - row_number() OVER (PARTITION BY doc_path ORDER BY line_no) AS island FROM prose WHERE regexp_matches(trim(line), '[;,]$') AND NOT regexp_matches(trim(line), '^(?:[#|]|[-*+]\s|[0-9]+[.)]\s)')) GROUP BY doc_path, island HAVING count(*) >= 3"
    ),
    "document_complexity": _q(
        r"SELECT doc_path, words::BIGINT AS words, n_headings, max_depth, n_links::BIGINT AS n_links, (words // 50 + 2 * n_headings + 3 * max_depth + 2 * n_links)::BIGINT AS complexity FROM (SELECT doc_path, sum(CASE WHEN trim(line) LIKE '#%' THEN 0 ELSE len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) END) AS words, count(nullif(length(regexp_extract(trim(line), '^(#{1,6})\s', 1)), 0)) AS n_headings, greatest(max(length(regexp_extract(trim(line), '^(#{1,6})\s', 1))), 1)::INT AS max_depth, sum(len(regexp_extract_all(line, '\[[^\]]*\]\([^)]+\)'))) AS n_links FROM prose GROUP BY doc_path)"
    ),
    "secret_scan": _q("SELECT doc_path, line_no, family, match_text FROM secret_rows", _SECRETS),
    "obsolete_terms": _q("SELECT doc_path, line_no::INT AS line_no, ordinal::INT AS ordinal, match_text FROM terms"),
    "html_links": """SELECT page_id, (ordinal - 1)::INT AS ordinal, href FROM (SELECT page_id, unnest(m) AS href, generate_subscripts(m, 1) AS ordinal FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS m FROM pages))""",
    "html_hygiene": _q(
        r"""SELECT doc_path, line_no::INT AS line_no, ordinal::INT AS ordinal, unnest(list_filter([
             CASE WHEN regexp_matches(plain, '^(javascript|data):') THEN 'Z205' END, CASE WHEN len(list_filter(attributes, lambda a: a LIKE 'on%' OR a IN ('data-url', 'data-path', 'data-target', 'data-route'))) > 0 THEN 'Z124' END, CASE WHEN href = '' THEN 'Z121' END, CASE WHEN href = '#' THEN 'Z122' END,
             CASE WHEN regexp_matches(plain, '^(mailto|tel|ftp):') THEN 'Z123' END, CASE WHEN len(list_filter(attributes, lambda a: a NOT IN ('href', 'src', 'id', 'class', 'title', 'rel', 'target', 'lang', 'download', 'alt', 'width', 'height', 'loading', 'decoding', 'data-docweave-ignore', 'data-url', 'data-path', 'data-target', 'data-route') AND a NOT LIKE 'on%' AND a NOT LIKE 'aria-%')) > 0 THEN 'Z120' END], lambda x: x IS NOT NULL)) AS code FROM (SELECT *, lower(replace(href, '&#x73;', 's')) AS plain FROM html)"""
    ),
    "inline_links": _q("SELECT doc_path, line_no::INT AS line_no, ordinal::INT AS ordinal, url, node_type, label FROM inline"),
    "empty_labels": _q("SELECT doc_path, line_no::INT AS line_no, url FROM inline WHERE node_type = 'inline' AND label = ''"),
    "circular_anchors": _q("SELECT doc_path, line_no::INT AS line_no, url FROM inline WHERE node_type = 'inline' AND url LIKE '#%' AND replace(trim(lower(label)), ' ', '-') = lower(url[2:])"),
    "ref_definitions": _q("SELECT doc_path, ref_id, url, line_no::INT AS line_no, is_first, n_defs FROM ranked"),
    "ref_dangling": _q("SELECT u.doc_path, u.line_no::INT AS line_no, u.ref_id FROM uses u ANTI JOIN known_refs d ON d.doc_path = u.doc_path AND d.ref_id = u.ref_id", "known_refs AS MATERIALIZED (SELECT DISTINCT doc_path, ref_id FROM defs)"),
    "ref_dead": _q("SELECT doc_path, line_no::INT AS line_no, ref_id FROM ranked d WHERE is_first AND NOT EXISTS (SELECT 1 FROM (SELECT doc_path, ref_id FROM uses UNION SELECT doc_path, ref_id FROM shortcuts) u WHERE d.doc_path = u.doc_path AND d.ref_id = u.ref_id)"),
    "ref_duplicate": _q("SELECT doc_path, line_no::INT AS line_no, ref_id, n_defs FROM ranked WHERE is_first AND n_defs > 1"),
    "ref_integrity": _q(
        "SELECT s.doc_path, coalesce(n_defs, 0) AS n_defs, coalesce(n_used, 0) AS n_used, coalesce(n_used * 100.0 / n_defs, 100.0)::DOUBLE AS integrity FROM site s LEFT JOIN (SELECT d.doc_path, count(*) AS n_defs, count(u.ref_id) AS n_used FROM ranked d LEFT JOIN (SELECT doc_path, ref_id FROM uses UNION SELECT doc_path, ref_id FROM shortcuts) u ON u.doc_path = d.doc_path AND u.ref_id = d.ref_id WHERE is_first GROUP BY 1) k USING (doc_path)"
    ),
    "anchors": _q("SELECT doc_path, anchor FROM anchors"),
    "routes": _q("SELECT url, source, status FROM routes"),
    "route_collisions": "SELECT '/' AS url, unnest(['index.md', 'README.md']) AS source, 'CONFLICT' AS status",
    "route_digest": _q("SELECT url, sha256(url || ':' || string_agg(source, ',' ORDER BY source)) AS digest FROM known GROUP BY url"),
    "broken_links": _q("SELECT doc_path, line_no::INT AS line_no, url, 'Z101' AS code FROM hits WHERE source IS NULL"),
    "orphan_links": _q("SELECT doc_path, line_no::INT AS line_no, url, 'Z103' AS code FROM hits WHERE status = 'ORPHAN'"),
    "missing_anchors": _q("SELECT doc_path, line_no::INT AS line_no, url FROM page_links p WHERE outcome = 'ok' AND anchor <> '' AND target IN (SELECT doc_path FROM site) AND NOT EXISTS (SELECT 1 FROM anchors a WHERE a.doc_path = p.target AND a.anchor = p.anchor)"),
    "missing_files": _q("SELECT doc_path, line_no::INT AS line_no, url, target FROM resolved WHERE kind = 0 AND node_type = 'image' AND outcome = 'ok' AND target NOT IN (SELECT rel_path FROM assets)", _ASSETS),
    "path_findings": _q(
        "SELECT * FROM (SELECT doc_path, line_no::INT AS line_no, url, CASE WHEN (outcome = 'escapes' OR is_absolute) AND regexp_matches(url, '(^|/)(etc|root|var|proc|sys|usr)(/|$)') THEN 'Z203' WHEN outcome = 'escapes' THEN 'Z202' WHEN is_absolute THEN 'Z105' END AS code FROM resolved WHERE kind = 0) WHERE code IS NOT NULL"
    ),
    "unused_assets": _q("SELECT rel_path FROM assets EXCEPT SELECT target FROM resolved WHERE outcome = 'ok'", _ASSETS),
    "orphan_pages": _q("SELECT doc_path AS rel_path FROM site EXCEPT SELECT rel_path FROM nav"),
    "missing_indexes": _q("SELECT split_part(doc_path, '/', 1) AS folder, count(*) AS n_docs FROM site WHERE doc_path LIKE '%/%' GROUP BY 1"),
    "edges": _q("SELECT src, dst FROM edges"),
    "reachability": _q("SELECT url, min(depth)::INT AS depth FROM walk GROUP BY url", "walk AS (SELECT '/' AS url, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.url WHERE w.depth < 25)"),
    "unreachable": _q("SELECT url FROM known EXCEPT SELECT url FROM walk", "walk AS (SELECT '/' AS url UNION SELECT e.dst FROM walk w JOIN edges e ON e.src = w.url)"),
    "dead_ends": _q("SELECT url FROM known EXCEPT SELECT src FROM edges"),
    "suppressions": _q("SELECT doc_path, line_no::INT AS line_no, code, ordinal::INT AS ordinal FROM directives"),
    "suppressions_applied": _q("SELECT doc_path, line_no::INT AS line_no, code, ordinal::INT AS ordinal, match_text FROM paired f WHERE NOT EXISTS (SELECT 1 FROM spent s WHERE s.doc_path = f.doc_path AND s.line_no = f.line_no AND s.code = f.code AND s.rn = f.rn)"),
    "dead_suppressions": _q("SELECT doc_path, line_no::INT AS line_no, code, ordinal::INT AS ordinal FROM spent s WHERE NOT EXISTS (SELECT 1 FROM paired f WHERE s.doc_path = f.doc_path AND s.line_no = f.line_no AND s.code = f.code AND s.rn = f.rn)"),
    "per_file_ignores": _q(f"SELECT doc_path, line_no::INT AS line_no, code, ordinal::INT AS ordinal, match_text FROM findings WHERE NOT ({' OR '.join(_taken(n) for n in range(len(IGNORES)))})"),
    "directory_policies": _q(f"SELECT doc_path, line_no::INT AS line_no, code, ordinal::INT AS ordinal, match_text, CASE {' '.join(f'WHEN {_taken(n)} THEN {n}' for n in range(len(IGNORES)))} END AS policy FROM findings"),
    "stale_policies": _q(" UNION ALL ".join(f"SELECT {n} AS policy, '{g}' AS glob WHERE NOT EXISTS (SELECT 1 FROM findings WHERE {_taken(n)})" for n, (g, _) in enumerate(IGNORES))),
    "required_keys": _q("SELECT doc_path, key FROM site, (SELECT unnest(['status', 'title']) AS key) EXCEPT SELECT doc_path, key FROM front"),
    "forbidden_keys": _q("SELECT doc_path, key FROM front WHERE key = 'internal'"),
    "key_schema": _q("SELECT doc_path, key, value FROM front WHERE key = 'status' AND NOT regexp_matches(value, '^(open|done)$')"),
    "domain_policy": _q("SELECT doc_path, line_no::INT AS line_no, url, host, 'Z611' AS code FROM (SELECT *, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM defs) WHERE host = 'other.example.org'"),
    "domain_allowlist": _q("SELECT doc_path, line_no::INT AS line_no, url, host, 'Z614' AS code FROM (SELECT *, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM defs) WHERE host <> '' AND host NOT LIKE '%.example.com' AND host <> 'example.com'"),
    "scheme_policy": _q("SELECT doc_path, line_no::INT AS line_no, href AS url, 'mailto' AS scheme FROM html WHERE href LIKE 'mailto:%'"),
    "namespace_policy": _q(
        "SELECT * FROM (SELECT doc_path, line_no::INT AS line_no, url, CASE WHEN doc_path LIKE 'orders/1%' THEN CASE WHEN target LIKE 'cust/1%' THEN 'cust/1' WHEN target LIKE 'cust/2%' THEN 'cust/2' END WHEN doc_path LIKE 'orders/%' AND target LIKE 'cust/3%' THEN 'cust/3' END AS namespace FROM resolved WHERE kind = 0 AND outcome = 'ok') WHERE namespace IS NOT NULL"
    ),
    "required_headings": _q(
        r"SELECT doc_path, '(?i)^notes' AS pattern FROM site WHERE doc_path NOT IN (SELECT doc_path FROM headings WHERE regexp_matches(raw_title, '(?i)^notes')) UNION ALL SELECT doc_path, '^Second' FROM site WHERE doc_path NOT IN (SELECT doc_path FROM headings WHERE regexp_matches(raw_title, '^Second'))"
    ),
    "unused_allowlist": _q("SELECT prefix FROM (SELECT unnest([" + ", ".join(repr(p) for p in ALLOWLIST) + "]) AS prefix) a WHERE NOT EXISTS (SELECT 1 FROM inline WHERE url LIKE a.prefix || '%')"),
    "findings_by_code": _q("SELECT code, n FROM counts"),
    "category_scores": _q("SELECT category, issues, points::DOUBLE AS points, round(points / cap, 4)::DOUBLE AS category_score, round(points / 100, 4)::DOUBLE AS contribution FROM scores", _POINTS.format(where="true")),
    "total_score": _q("SELECT round_even(greatest(0, CASE WHEN (SELECT points FROM scores WHERE category = 'brand') = 0 THEN least(sum(points), 70) ELSE sum(points) END - 3), 0)::INT AS score, 3 AS suppressions FROM scores", _POINTS.format(where="true")),
    "suppression_hotspots": _q("SELECT doc_path, count(*) AS n FROM directives GROUP BY 1 ORDER BY n DESC, doc_path LIMIT 5"),
    "baseline_signatures": _q("SELECT doc_path, line_no::INT AS line_no, ordinal::INT AS ordinal, code, substr(sha256(code || ':' || doc_path || ':' || match_text), 1, 16) AS signature FROM findings"),
    "cycle_members": _q("SELECT src AS url FROM walk WHERE src = dst", "walk AS (SELECT src, dst FROM edges UNION SELECT w.src, e.dst FROM walk w JOIN edges e ON e.src = w.dst)"),
    "cycle_links": _q("SELECT p.doc_path, p.line_no::INT AS line_no, p.url FROM page_links p JOIN known t ON t.source = p.target WHERE p.outcome = 'ok' AND t.url IN (SELECT src FROM walk WHERE src = dst)", "walk AS (SELECT src, dst FROM edges UNION SELECT w.src, e.dst FROM walk w JOIN edges e ON e.src = w.dst)"),
    "baseline_diff": _q(
        "SELECT count(*) FILTER (known) AS baselined, count(*) FILTER (NOT known) AS new, (SELECT count(*) FROM base) - count(DISTINCT signature) FILTER (known) AS fixed FROM (SELECT signature, signature IN (SELECT signature FROM base) AS known FROM signed)",
        "signed AS (SELECT doc_path, substr(sha256(code || ':' || doc_path || ':' || match_text), 1, 16) AS signature FROM findings), base AS (SELECT DISTINCT signature FROM signed WHERE doc_path LIKE '%1.md' OR doc_path LIKE '%2.md')",
    ),
}

_FOUND = "SELECT doc_path, line_no::INT AS line_no, code, ordinal::INT AS ordinal, match_text FROM findings"
ORACLE_SQL |= {
    "split_secrets": _q("SELECT doc_path, line_no::INT AS line_no, 'aws-access-key' AS family, regexp_extract(rtrim(prior) || ltrim(line), 'AKIA[0-9A-Z]{16}') AS match_text FROM (SELECT *, lag(line) OVER (PARTITION BY doc_path ORDER BY line_no) AS prior FROM lines) WHERE prior LIKE 'over AKIA%'"),
    "forbidden_terms": _q("SELECT doc_path, line_no::INT AS line_no, regexp_extract(line, '(?i)(?:c\\+\\+|key AKIA|packed BY hand)') AS match_text FROM lines WHERE regexp_matches(line, '(?i)(?:c\\+\\+|key AKIA|packed BY hand)') AND NOT regexp_matches(line, 'AKIA[0-9A-Z]{16}')"),
    "html_depth": _q(
        r"""SELECT doc_path, line_no::INT AS line_no, coalesce(lag(total - least(0, low)) OVER (PARTITION BY doc_path ORDER BY line_no), 0)::INT AS depth FROM (SELECT *, min(total) OVER (PARTITION BY doc_path ORDER BY line_no) AS low FROM (SELECT doc_path, line_no, sum(step) OVER (PARTITION BY doc_path ORDER BY line_no) AS total FROM (SELECT doc_path, line_no, len(regexp_extract_all(line, '(?i)<(?:TAGS)(?:\s[^>]*)?>')) - len(regexp_extract_all(line, '(?i)</(?:TAGS)\s*>')) AS step FROM prose)))""".replace("TAGS", "|".join(BLOCK_TAGS)),
        "",
        "site AS (SELECT CAST(doc_id AS VARCHAR) AS doc_path, replace(text, ' the ', chr(10) || '<div>x' || chr(10) || '</p><section>y</div></div>' || chr(10)) AS text FROM documents)",
    ),
    "first_content_line": _q(r"SELECT s.doc_path, coalesce(line_no, 1)::INT AS line_no FROM site s LEFT JOIN (SELECT doc_path, min(line_no) AS line_no FROM lines WHERE NOT in_frontmatter AND trim(regexp_replace(line, '<!--.*?-->', '', 'g')) <> '' AND NOT regexp_matches(trim(line), '^#{1,6}\s') GROUP BY 1) USING (doc_path)"),
    "utf16_columns": _p(
        r"SELECT doc_path, line_no::INT AS line_no, (instr(line, word) - 1 + CASE WHEN line_no = 1 AND instr(line, word) > 1 THEN 1 ELSE 0 END)::INT AS col_utf16 FROM (SELECT doc_path, line_no, line, regexp_extract(line, '[a-z]+$') AS word FROM lines) WHERE word <> ''"
    ).replace("CAST(doc_id AS VARCHAR) AS doc_path, text FROM", "CAST(doc_id AS VARCHAR) AS doc_path, '\U0001F600x ' || text AS text FROM"),
    "flat_routes": _q("SELECT CASE WHEN doc_path = 'README.md' THEN '/index.html' ELSE '/' || regexp_replace(doc_path, '\\.md$', '.html') END AS url, doc_path AS source, CASE WHEN rel_path IS NULL THEN 'ORPHAN' ELSE 'REACHABLE' END AS status FROM site LEFT JOIN nav ON rel_path = doc_path"),
    "locale_routes": _q("SELECT url, source, CASE WHEN count(*) OVER (PARTITION BY url) > 1 THEN 'CONFLICT' WHEN own IN (SELECT rel_path FROM nav) THEN 'REACHABLE' ELSE 'ORPHAN' END AS status FROM local_routes", _LOCAL),
    "entry_points": _q("SELECT DISTINCT url FROM routes WHERE status = 'REACHABLE' OR url = '/'"),
    "links_of_all_forms": _q("SELECT doc_path, line_no::INT AS line_no, 'inline' AS form, url FROM inline UNION ALL SELECT doc_path, line_no, 'html', href FROM html WHERE href <> '' UNION ALL SELECT r.doc_path, line_no, 'reference', url FROM ranked r JOIN (SELECT doc_path, ref_id FROM uses UNION SELECT doc_path, ref_id FROM shortcuts) u ON u.doc_path = r.doc_path AND u.ref_id = r.ref_id WHERE is_first"),
    "missing_alternates": "SELECT '/de/' AS link",
    "missing_declared": "SELECT 'img/favicon.ico' AS rel_path",
    "virtual_routes": "SELECT '/_virtual/note.md' AS url, 'tmp/note.md' AS source",
    "topology_delta": _q("SELECT DISTINCT src AS url, 'new' AS change FROM edges WHERE src LIKE '/cust/4%'"),
    "only_codes": _q(f"{_FOUND} WHERE code IN ('Z516', 'Z303')"),
    "shown_findings": _q(f"SELECT severity, count(*) AS count FROM (SELECT {_GRADE} AS severity FROM findings) WHERE severity <> 'info' GROUP BY 1"),
    "quiet_counts": _q(f"SELECT count(DISTINCT doc_path) AS files, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (code IN ('Z201', 'Z203', 'Z204')) AS breaches FROM (SELECT *, {_GRADE} AS severity FROM findings)"),
    "file_reports": _q(f"SELECT s.doc_path, coalesce(n, 0) AS n_findings, coalesce(e, false) AS has_errors FROM site s LEFT JOIN (SELECT doc_path, count(*) AS n, bool_or({_GRADE} = 'error') AS e FROM findings GROUP BY 1) USING (doc_path)"),
    "finding_context": _q("SELECT f.doc_path, f.line_no::INT AS line_no, string_agg(CASE WHEN l.line_no = f.line_no THEN '> ' ELSE '  ' END || l.line_no || ' | ' || l.line, chr(10) ORDER BY l.line_no) AS context FROM (SELECT DISTINCT doc_path, line_no FROM findings WHERE code = 'Z516') f JOIN lines l ON l.doc_path = f.doc_path AND abs(l.line_no - f.line_no) <= 2 GROUP BY 1, 2"),
    "section_counts": _q("SELECT section, count(f.code) AS n FROM (VALUES ('links', 'Z101'), ('links', 'Z103'), ('orphans', 'Z402'), ('snippets', 'Z503'), ('unused_assets', 'Z405'), ('nav_contract', 'Z406'), ('references', 'Z303')) v(section, code) LEFT JOIN findings f USING (code) GROUP BY 1"),
    "section_lines": _q("SELECT section, count(*) AS n, min('{\"file\":\"' || doc_path || '\",\"line\":' || line_no || ',\"code\":\"' || code || '\",\"match_text\":\"' || match_text || '\"}') AS first FROM findings JOIN (VALUES ('links', 'Z101'), ('links', 'Z103'), ('references', 'Z303')) v(section, code) USING (code) WHERE doc_path LIKE '%2.md' GROUP BY 1"),
    "first_of_each": _q("SELECT doc_path, code, min(line_no)::INT AS line_no FROM findings GROUP BY 1, 2"),
    "url_occurrences": _q("SELECT url, count(*) AS n, count(DISTINCT doc_path) AS n_docs, min(doc_path) AS first_path FROM defs WHERE url LIKE 'http%' AND url NOT LIKE 'https://other.%' GROUP BY 1"),
    "outside_security": _q("SELECT doc_path, line_no::INT AS line_no, url FROM defs WHERE doc_path NOT IN (SELECT doc_path FROM secret_rows)", _SECRETS),
    "probe_fan_out": _q("SELECT doc_path, line_no::INT AS line_no, url, 404 AS status FROM defs WHERE url = 'https://other.example.org/b'"),
    "url_cache_reusable": "SELECT CAST(o_orderkey AS VARCHAR) AS url, 200 AS status, o_orderkey % 1000 * 100 AS ts FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 1000 * 100 > 50000",
    "cache_hit_rate": _q("SELECT count(*) AS docs, count(*) FILTER (text IN (SELECT text FROM site WHERE doc_path LIKE '%2.md')) AS hits, round(count(*) FILTER (text IN (SELECT text FROM site WHERE doc_path LIKE '%2.md')) / count(*), 4) AS rate FROM site"),
    "stale_cache_paths": _q("SELECT 'gone.md' AS doc_path UNION ALL SELECT doc_path FROM site WHERE doc_path LIKE 'cust/1%'"),
    "site_counts": _q(f"SELECT count(*) AS docs, {len(ASSETS)}::BIGINT AS assets, sum(strlen(text))::BIGINT AS bytes FROM site"),
    "score_badge": _q("SELECT 'docs score' AS label, score || '/100' AS message, CASE WHEN score >= 90 THEN 'brightgreen' WHEN score >= 70 THEN 'yellow' WHEN score >= 50 THEN 'orange' ELSE 'red' END AS color FROM (SELECT round_even(greatest(0, CASE WHEN (SELECT points FROM scores WHERE category = 'brand') = 0 THEN least(sum(points), 70) ELSE sum(points) END - 3), 0)::INT AS score FROM scores)", _POINTS.format(where="true")),
    "audit_report": _q(
        f"SELECT inline, 3::BIGINT AS per_file, inline + 3 AS debt, CASE WHEN inline + 3 > 30 THEN 'CRITICAL' ELSE 'MANAGED' END AS status, findings, errors, 0::BIGINT AS breaches, inline + 3 <= 30 AS passes FROM (SELECT count(*) AS inline FROM directives), (SELECT count(*) AS findings, count(*) FILTER ({_GRADE} = 'error') AS errors FROM findings)"
    ),
    "cap_exceeded": _q("""SELECT '{"error":"suppression-cap-exceeded","n":' || count(*) || ',"cap":1}' AS json FROM directives HAVING count(*) > 1"""),
    "graph_rule": _q("SELECT doc_path, line_no::INT AS line_no, 'house:HOME' AS code, url AS match_text FROM page_links WHERE outcome = 'ok' AND target = 'index.md'"),
    "policy_findings": _q(
        r"""SELECT doc_path, 0 AS line_no, 'Z610' AS code, 'status' AS match_text FROM site WHERE doc_path NOT IN (SELECT doc_path FROM front WHERE key = 'status')
UNION ALL SELECT doc_path, 0, 'Z612', key FROM front WHERE key = 'internal'
UNION ALL SELECT doc_path, 0, 'Z613', key FROM front WHERE key = 'status' AND NOT regexp_matches(value, '^(open|done)$')
UNION ALL SELECT doc_path, line_no, 'Z616', url FROM resolved WHERE kind = 0 AND outcome = 'ok' AND ((doc_path LIKE 'orders/1%' AND (target LIKE 'cust/1%' OR target LIKE 'cust/2%')) OR (doc_path LIKE 'orders/%' AND doc_path NOT LIKE 'orders/1%' AND target LIKE 'cust/3%'))
UNION ALL SELECT doc_path, 0, 'Z618', '^Second' FROM site WHERE doc_path NOT IN (SELECT doc_path FROM headings WHERE raw_title LIKE 'Second%')
UNION ALL SELECT doc_path, 0, 'Z619', (words // 50 + 2 * n_headings + 3 * max_depth + 2 * n_links)::BIGINT::VARCHAR FROM (SELECT doc_path, sum(CASE WHEN trim(line) LIKE '#%' THEN 0 ELSE len(list_filter(regexp_split_to_array(line, '\s+'), lambda w: w <> '')) END) AS words, count(nullif(length(regexp_extract(trim(line), '^(#{1,6})\s', 1)), 0)) AS n_headings, greatest(max(length(regexp_extract(trim(line), '^(#{1,6})\s', 1))), 1) AS max_depth, sum(len(regexp_extract_all(line, '\[[^\]]*\]\([^)]+\)'))) AS n_links FROM prose GROUP BY doc_path) WHERE words // 50 + 2 * n_headings + 3 * max_depth + 2 * n_links > 26
UNION ALL SELECT doc_path, line_no, 'Z519', unnest(regexp_extract_all(line, '(?i)\bvery\b')) FROM masked"""
    ),
}


def _body(name: str) -> str:
    """The SELECT of an oracle that needs no tables beyond those of all."""
    return ORACLE_SQL[name].removeprefix(f"WITH RECURSIVE {_SITE}, {_LINES} ")


def _part(name: str, code: str, match: str = "''", line: str = "line_no", path: str = "doc_path", body: str | None = None) -> str:
    return f"SELECT {path} AS doc_path, {line} AS line_no, {code} AS code, {match} AS match_text FROM ({body or _body(name)})"


_SHORT = "SELECT * FROM (SELECT doc_path, len(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'), '(?s)\\A---\\n.*?\\n---(\\n|\\z)', ''), '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '')) AS words FROM site) WHERE words < 50"
_ALL = " UNION ALL ".join([
    _part("", "CASE WHEN status IS NULL THEN 'Z101' ELSE 'Z103' END", "url", body="SELECT * FROM hits WHERE status IS NULL OR status = 'ORPHAN'"), _part("missing_anchors", "'Z102'", "url"), _part("path_findings", "code", "url"), _part("circular_anchors", "'Z107'", "url"),
    _part("empty_labels", "'Z108'", "url"), _part("html_hygiene", "code"), _part("", "'Z104'", "url", body="SELECT * FROM resolved WHERE kind = 0 AND node_type = 'image' AND outcome = 'ok' AND target NOT IN (SELECT rel_path FROM assets) AND target NOT IN (SELECT doc_path FROM site)"),
    _part("", "'Z301'", "ref_id", body="SELECT u.* FROM uses u ANTI JOIN known_refs d ON d.doc_path = u.doc_path AND d.ref_id = u.ref_id"), _part("ref_dead", "'Z302'", "ref_id"), _part("ref_duplicate", "'Z303'", "ref_id"),
    _part("placeholders", "'Z501'", "match_text"), _part("", "'Z502'", line="1", body=_SHORT), _part("untagged_code", "'Z505'"), _part("malformed_frontmatter", "'Z506'"), _part("heading_hierarchy", "'Z510'"),
    _part("", "'Z511'", body=ORACLE_SQL["long_sentences"].removeprefix(f"WITH RECURSIVE {_PROSE}, {_LINES} ")), _part("empty_sections", "'Z512'"), _part("duplicate_headings", "'Z513'", "norm_title"), _part("generic_alt", "'Z514'", "alt"),
    _part("bare_urls", "'Z515'", "url"), _part("multiple_h1", "'Z516'"), _part("heading_punctuation", "'Z517'"), _part("fake_lists", "'Z520'"), _part("missing_alt", "'Z403'"), _part("", "'Z201'", "family", body="SELECT * FROM secret_rows"),
    # of the site's blocks that are checked, those of JSON, one line says whether they parse
    _part("", "'Z503'", body="SELECT doc_path, line_no - 1 AS line_no FROM lines WHERE fence_kind = 'in' AND line = '{\"a\": }' AND doc_path IN (SELECT doc_path FROM lines WHERE line = '```json')"),
    _part("missing_indexes", "'Z401'", line="0", path="folder"), _part("", "'Z410'", line="0", path="source", body="SELECT source FROM known WHERE url NOT IN (SELECT url FROM walk)"), _part("", "'Z411'", line="0", path="source", body="SELECT source FROM known WHERE url NOT IN (SELECT src FROM edges)"),
    _part("", "'Z106'", "url", body="SELECT p.* FROM page_links p JOIN known t ON t.source = p.target WHERE p.outcome = 'ok' AND t.url IN (SELECT src FROM cyc WHERE src = dst)"), _part("orphan_pages", "'Z402'", line="0", path="rel_path"), _part("", "'Z405'", line="0", path="rel_path", body="SELECT rel_path FROM assets EXCEPT SELECT target FROM resolved WHERE outcome = 'ok'"),
])
_CHECK = f"""{_ASSETS}, {_SECRETS}, known_refs AS MATERIALIZED (SELECT DISTINCT doc_path, ref_id FROM defs), {_WALK}, {_CYCLE},
every AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_path, line_no, code ORDER BY match_text) AS rn FROM ({_ALL})),
unspent AS (SELECT s.* FROM spent s ANTI JOIN every f ON s.doc_path = f.doc_path AND s.line_no = f.line_no AND s.code = f.code AND s.rn = f.rn),
left_over AS (SELECT f.doc_path, f.line_no, f.code, (f.rn - 1)::INT AS ordinal, f.match_text FROM every f ANTI JOIN spent s ON s.doc_path = f.doc_path AND s.line_no = f.line_no AND s.code = f.code AND s.rn = f.rn AND s.code NOT IN ('Z110', 'Z111', 'Z201', 'Z202', 'Z203', 'Z204', 'Z205')
  UNION ALL SELECT DISTINCT doc_path, line_no, 'Z603', 0, '' FROM unspent)"""
_ERRORS = "'Z101', 'Z102', 'Z104', 'Z105', 'Z107', 'Z108', 'Z121', 'Z124', 'Z201', 'Z202', 'Z203', 'Z204', 'Z205', 'Z301', 'Z503', 'Z506', 'Z516', 'Z613', 'Z614', 'Z616'"
ORACLE_SQL["check_all"] = _q(
    f"SELECT doc_path, line_no::INT AS line_no, code, ordinal, match_text, CASE WHEN code IN ({_ERRORS}) THEN 'error' WHEN code IN ('Z106', 'Z123', 'Z401') THEN 'info' ELSE 'warning' END AS severity FROM left_over WHERE code IN ('Z110', 'Z111', 'Z201', 'Z202', 'Z203', 'Z204', 'Z205') OR NOT ({' OR '.join(_taken(n) for n in range(len(IGNORES)))})",
    _CHECK,
)
# credentials and paths that escape are among the site's findings, and any one of them makes the score nothing
ORACLE_SQL["site_score"] = _q("SELECT CASE WHEN bool_or(code IN ('Z201', 'Z202', 'Z203', 'Z205')) THEN 0 END::INT AS score, (SELECT count(*) FROM directives)::INT AS suppressions FROM left_over", _CHECK)
