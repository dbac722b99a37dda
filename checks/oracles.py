"""SQL that gives the results of the queries from the same tables.

Word lists and regular expressions are the fixed values of the package; how
they are put to use is written independently, in the dialect of the checker.
"""

from __future__ import annotations

import re

from checks.queries import NOTES, SCRIPTED, SKIPPED, SLOT_PERIOD, SNIPPETS
from pressmill.functions import quality as q
from pressmill.functions.markdown import BYLINES, SOCIAL_HOSTS, SOCIAL_NETWORKS, SOCIAL_VERBS
from pressmill.functions.text import SPACE, SPACE_CHARS
from pressmill.functions.urls import REGISTERED_DOMAIN, SCRIPTED_DOMAINS, SKIPPED_DOMAINS
from pressmill.operators.retrieval import (
    PROMPT_CLOSING,
    PROMPT_CONTEXT,
    PROMPT_QUESTION,
    SYSTEM_PROMPT,
)


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


NL = "chr(10)"
WHITE = lit(SPACE_CHARS)


def has_any(col: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, {lit(p)})" for p in phrases) + ")"


def like_any(col: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches({col}, {lit(p)})" for p in patterns) + ")"


def among(col: str, values: list) -> str:
    return f"{col} IN (" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + ")"


def replaced(col: str, pattern: str, new: str = "") -> str:
    return f"regexp_replace({col}, {lit(pattern)}, {lit(new)}, 'g')"


BODIES = f"""bodies AS (
  SELECT 'page' AS kind, page_id AS id, url, html FROM pages
  UNION ALL
  SELECT 'document', doc_id, 'https://' || source || '.example.com/d/' || doc_id,
         text || [{', '.join(lit(s) for s in SNIPPETS)}][doc_id % {len(SNIPPETS)} + 1]
  FROM documents)"""

DOMAIN = f"coalesce(nullif(regexp_extract(url, {lit(REGISTERED_DOMAIN)}, 1), ''), 'unknown')"

JS_PATTERNS = [
    (".+" if gap else ".*").join(map(re.escape, words)) for gap, words in q.SCRIPT_WORD_RUNS
] + q.SCRIPT_PATTERNS

NEEDS_SCRIPT = (
    f"({like_any('low', JS_PATTERNS)} OR {has_any('low', q.SCRIPT_PHRASES)} OR "
    f"(length(low) < 1000 AND NOT {has_any('low', q.SHORT_PAGE_MARKERS)}))"
)
MEANINGFUL = f"""(length(low) >= 200 AND {has_any('low', q.SHELL_MARKERS)} AND (
  {has_any('low', q.LAYOUT_MARKERS)}
  OR length(trim(array_to_string(regexp_extract_all(low, '<p[^>]*>([^<]+)</p>', 1), ' '), {WHITE})) > 100
  OR len(regexp_extract_all(low, '<p[^>]*>([^<]+)</p>', 1)) >= 2))"""


def routed(source: str, skipped: list[str], scripted: list[str]) -> str:
    """Columns domain, route and content for rows with url, html, low."""
    return f"""
  SELECT *, CASE WHEN route = 'complete' AND NOT {among('domain', skipped)} THEN html ELSE '' END AS content
  FROM (SELECT *, CASE
      WHEN {among('domain', skipped)} THEN 'complete'
      WHEN coalesce({among('status', q.PROTECTED_STATUSES)}, false) OR protecting
        OR {has_any('low', q.PROTECTION_PHRASES)} THEN 'needs_javascript'
      WHEN {NEEDS_SCRIPT} OR NOT {MEANINGFUL} THEN 'needs_javascript'
      WHEN {has_any('domain', scripted)} THEN 'needs_javascript'
      ELSE 'complete' END AS route
    FROM (SELECT *, {DOMAIN} AS domain FROM {source}))"""


RESPONSES = f"""{BODIES},
responses AS (
  SELECT *, lower(html) AS low, (id % 13) IN (4, 5) AS protecting,
    CASE id % 11 WHEN 3 THEN 403 WHEN 5 THEN 503 WHEN 7 THEN 429 WHEN 0 THEN NULL ELSE 200 END AS status
  FROM bodies),
routed AS ({routed('responses', SKIPPED, SCRIPTED)})"""

PLAIN_PAGES = f"""landed AS (
  SELECT *, lower(html) AS low, false AS protecting, NULL::INTEGER AS status FROM pages),
routed AS ({routed('landed', SKIPPED_DOMAINS, SCRIPTED_DOMAINS)})"""

NOISE = [
    rf"(?i)^[{SPACE}]*(?:{SOCIAL_VERBS})",
    rf"^[{SPACE}]*\[(?:{SOCIAL_NETWORKS})[^\]]*\]\(http[^\)]+\)",
    rf"^http[s]?://.*?(?:{SOCIAL_HOSTS})\.com",
    rf"^[{SPACE}]*\[.*\]\(/.*\)",
    rf"(?i)^[{SPACE}]*(?:{BYLINES})",
    rf"(?i)^[{SPACE}]*(?:\d+[{SPACE}]*min(?:ute)?s?[{SPACE}]*read)",
    rf"^[{SPACE}]*-[{SPACE}]*\[.*\]\(.*\)",
    rf"^[{SPACE}]*[-—_]{{3,}}[{SPACE}]*$",
]
NAVIGATION = [
    r"^menu\b", r"^navigation\b", r"^skip to\b", r"^go to\b", r"^search\b",
    r"^home$", r"^about$", r"^contact\b", r"^main menu\b",
]


def cleaned(source: str, made: str) -> str:
    """CTEs that clean column ``txt`` of ``source`` into relation ``made``."""
    text = "array_to_string(shown, chr(10))"
    text = replaced(text, rf"\[([^\]]*)\]\([{SPACE}]*\)", r"\1")
    text = replaced(text, rf"!\[([^\]]*)\]\([{SPACE}]*\)")
    text = replaced(text, rf"(?m)^#+[{SPACE}]*$")
    # a heading line gets a blank line after it; the next rule evens out
    text = replaced(text, r"(?m)^(#.*)\n", "\\1\n\n")
    text = replaced(text, r"\n\n\n+", "\n\n")
    text = replaced(text, r"(?m)[ \t]+$")
    return f"""
{made}_kept AS (
  SELECT * EXCLUDE (txt), list_filter(string_split(txt, chr(10)), lambda l: NOT {like_any('l', NOISE)}) AS kept
  FROM {source}),
{made}_shown AS (
  SELECT * EXCLUDE (kept), list_transform(
    list_filter(kept, lambda l, i: trim(l, {WHITE}) <> '' OR (i > 1 AND trim(kept[i - 1], {WHITE}) <> '')),
    lambda l: CASE WHEN trim(l, {WHITE}) = '' THEN '' ELSE l END) AS shown
  FROM {made}_kept),
{made} AS (SELECT * EXCLUDE (shown), trim({text}, {WHITE}) AS txt FROM {made}_shown)"""


def page_markdown_ctes(source: str, keep: str) -> str:
    """Markdown of the given pages: only what occurs on them is converted.

    Bold text is never closed on these pages, so it ends with its article.
    """
    unseen = replaced("html", r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>")
    dropped = unseen
    for tag in ("head", "nav", "footer"):
        dropped = replaced(dropped, rf"(?is)<{tag}(?:\s[^>]*)?>.*?(?:</{tag}>|\z)")
    units = "regexp_extract_all(body, '</?[a-zA-Z][^>]*>|<![^>]*>|[^<]+|<')"
    run = replaced(replaced(replaced("u", r"[ \t\r\n]*[\r\n][ \t\r\n]*", "\n"), "[ \\t]+", " "), r"([*_])", r"\\\1")
    text = f"array_to_string(list_transform({units}, lambda u: CASE WHEN regexp_matches(u, '^<[a-zA-Z/!]') THEN u ELSE {run} END), '')"
    text = replaced(text, r"[ \t\r\n]*(</?(?:h1|p|div|article|ul|li)(?:\s[^>]*)?>)[ \t\r\n]*", r"\1")
    text = replaced(text, r"(?s)<h1>(.*?)</h1>", "\n\n# \\1\n\n")
    text = replaced(text, r"</?p>", "\n\n")
    text = replaced(text, r"</?(?:br|div|html|body|!DOCTYPE)(?:\s[^>]*)?>|<!DOCTYPE html>|<article>")
    scope = f"""CASE WHEN contains(x, '<b>') THEN
      trim(replace(regexp_replace(x, '<b>[ \\t\\r\\n]*', '<b>', 'g'), '<b>', '**'), {lit(chr(32) + chr(9) + chr(10) + chr(13))})
      || repeat('**', len(string_split(x, '<b>')) - 1) || chr(10) || chr(10) ELSE x END"""
    text = f"array_to_string(list_transform(string_split({text}, '</article>'), lambda x: {scope}), '')"
    for name, char in [("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")]:
        text = f"replace({text}, '{name}', {lit(char)})"
    return f"""
bodies_only AS (SELECT {keep}, {dropped} AS body FROM {source}),
converted AS (SELECT {keep}, {text} AS txt FROM bodies_only),
{cleaned('converted', 'once')},
{cleaned('once', 'twice')}"""


NOTED = "text"
for _old, _new in NOTES:
    NOTED = f"replace({NOTED}, {lit(_old)}, {lit(_new)})"

CHUNKS = f"""
runs AS (
  SELECT doc_id, 0 AS i, text AS rest, '' AS run FROM documents WHERE length(text) > 2000
  UNION ALL
  SELECT doc_id, i + 1, substr(rest, length(cut) + 1), cut
  FROM (
    SELECT *, CASE WHEN length(rest) <= 1950 THEN rest ELSE coalesce(
        nullif(regexp_extract(substr(rest, 1, 1950), '(?s)^(.*\\n\\n)', 1), ''),
        nullif(regexp_extract(substr(rest, 1, 1950), '(?s)^(.*\\n)', 1), ''),
        nullif(regexp_extract(substr(rest, 1, 1950), '(?s)^(.* )', 1), ''),
        substr(rest, 1, 1950)) END AS cut
    FROM runs WHERE rest <> '')),
tailed AS (
  SELECT doc_id, i, run, lag(run) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM runs WHERE i > 0),
joined AS (
  SELECT doc_id, i, trim(coalesce(CASE WHEN length(before) <= 50 THEN before
      ELSE regexp_extract(right(before, 51), '(?s)[ \\n](.*)$', 1) END, '') || run, {WHITE}) AS text FROM tailed
  UNION ALL
  SELECT doc_id, 0, trim(text, {WHITE}) FROM documents WHERE length(text) <= 2000),
chunks AS (
  SELECT printf('d%08d', doc_id) AS path,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, text
  FROM joined WHERE text <> '')"""


def embedded(source: str, key: str, text: str, made: str) -> str:
    """CTEs with the dense vector of each text of ``source``."""
    return f"""
{made}_words AS (
  SELECT {key} AS k, unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{Nd}}]+')) AS w FROM {source}),
{made}_counts AS (
  SELECT k, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INTEGER) AS b, count(*) AS c
  FROM {made}_words GROUP BY 1, 2),
{made}_weights AS (
  SELECT k, b, CAST(c / sqrt(sum(c * c) OVER (PARTITION BY k)) AS FLOAT) AS w FROM {made}_counts),
{made} AS (
  SELECT s.{key} AS k, list(CAST(coalesce(w, 0) AS DOUBLE) ORDER BY r.b) AS v
  FROM {source} s CROSS JOIN (SELECT CAST(range AS INTEGER) AS b FROM range(64)) r
  LEFT JOIN {made}_weights t ON t.k = s.{key} AND t.b = r.b GROUP BY 1)"""


PROMPTS = f"""WITH RECURSIVE {CHUNKS},
keyed AS (SELECT path || '#' || printf('%08d', chunk_no) AS vec_id, text FROM chunks),
{embedded('keyed', 'vec_id', 'text', 'stored')},
{embedded('benchmark', 'item_id', 'text', 'asked')},
gaps AS (SELECT a.k AS query_id, s.k AS vec_id, list_distance(a.v, s.v) AS d FROM asked a CROSS JOIN stored s),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, vec_id) AS rank FROM gaps) WHERE rank <= 4),
contexts AS (
  SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
  FROM hits JOIN keyed USING (vec_id) GROUP BY 1)
SELECT item_id AS query_id, md5(coalesce(context, '')) AS context_md5,
  md5({lit(PROMPT_CONTEXT)} || coalesce(context, '') || {lit(PROMPT_QUESTION)} || text || {lit(PROMPT_CLOSING)}) AS prompt_md5,
  CAST(length({lit(SYSTEM_PROMPT)}) AS INTEGER) AS system_length
FROM benchmark LEFT JOIN contexts ON query_id = item_id"""

NEIGHBOURS = """
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY a.vec_id
      ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a CROSS JOIN embeddings b) WHERE rank <= 4"""

# The 32 vectors with the least digest of their id are pivots, in the order of their
# elements; a query looks into the cells of its eight nearest.
APPROXIMATE = """
WITH points AS (
  SELECT row_number() OVER (ORDER BY v) AS cell, v FROM (
    SELECT DISTINCT embedding::DOUBLE[] AS v FROM (SELECT embedding FROM embeddings ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 32))),
away AS (
  SELECT vec_id, cell, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], v), cell) AS place
  FROM embeddings CROSS JOIN points)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(d, 6) AS distance FROM (
  SELECT a.vec_id AS query_id, b.vec_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d,
    row_number() OVER (PARTITION BY a.vec_id
      ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a JOIN away p ON p.vec_id = a.vec_id AND p.place <= 8
    JOIN away c ON c.cell = p.cell AND c.place = 1 JOIN embeddings b ON b.vec_id = c.vec_id) WHERE rank <= 4"""

DIRTY_NEIGHBOURS = f"""
WITH embeddings AS (SELECT * FROM main.embeddings WHERE vec_id % 10 NOT IN (3, 5, 7, 9)) {NEIGHBOURS}"""

DIRTY_PAGES = """
SELECT doc_id, md5('Zq ' || trim(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')) || chr(10) || chr(10)
  || 'see [link ' || doc_id || '](http://h.net/' || doc_id || ') and ![pic](' || doc_id || '.png)' || chr(10) || chr(10)
  || '- one ' || doc_id || chr(10) || '- two' || chr(10) || chr(10)
  || '| A | B |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || doc_id || ' | x + [ |' || chr(10) || chr(10)
  || '1. one ' || doc_id || chr(10) || '  4. four' || chr(10) || '  5. five ' || doc_id || chr(10) || '2. two' || chr(10) || chr(10)
  || '> out ' || doc_id || chr(10) || '>' || chr(10) || '> > in' || chr(10) || '>' || chr(10) || '> out again' || chr(10) || chr(10)
  || '**x' || doc_id || 'z** a' || chr(57344) || 'b' || chr(57354) || 'c' || chr(10) || chr(10)
  || '| T |' || chr(10) || '| --- |' || chr(10) || '| ' || doc_id || ' deep |') AS markdown_md5
FROM documents"""

ARTICLE_FILES = """
SELECT 'issue-' || doc_id // 16 || '/article-' || doc_id || '.md' AS path,
  md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS text_md5
FROM documents"""

ISSUES = """
SELECT o_orderkey // 50 AS page_no, CAST(o_orderkey AS INTEGER) AS num,
  CASE WHEN o_orderkey % 3 = 2 THEN 'http://other.example.org/i/' ELSE 'https://news.example.com/issues/' END || o_orderkey AS url,
  CAST(o_orderdate AS DATE) AS date,
  CAST(row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) - 1 AS INTEGER) AS current,
  CAST(count(*) OVER (PARTITION BY o_orderkey // 50) AS INTEGER) AS total
FROM orders"""

ARTICLES = f"""
SELECT CAST(doc_id // 16 AS INTEGER) AS issue_num, 'Document & ' || doc_id AS title,
  'https://' || source || '.example.com/d/' || doc_id || '?a=1&b=2' AS url,
  CAST(n_chars // 1000 AS INTEGER) AS reading_time,
  md5(CASE WHEN n_chars // 1000 > 0 THEN trim(text, {WHITE}) ELSE '' END) AS summary_md5,
  CAST(row_number() OVER (PARTITION BY doc_id // 16 ORDER BY lang, doc_id) - 1 AS INTEGER) AS current,
  total, CAST(doc_id // 16 AS INTEGER) AS issue_current
FROM (SELECT *, CAST(count(*) OVER (PARTITION BY doc_id // 16) AS INTEGER) AS total FROM documents)
WHERE source <> 'src4'"""

HEADERS = f"""
SELECT 'issue-' || (doc_id // 25) || '/article-' || (doc_id % 25) || '.md' AS path,
  trim(row[1], '# ' || chr(9) || chr(13) || chr(10)) AS title,
  CASE WHEN doc_id % 5 = 0 THEN 'q' ELSE url END AS source_url,
  (n_chars // 1000) || ' minutes' AS reading_time,
  trim(coalesce(row[2], ''), {WHITE}) AS summary,
  md5('# ' || row[1] || chr(10) || chr(10) || 'Source: [' || url || '](' || url || ')' || chr(10)
    || 'Reading time: ' || (n_chars // 1000) || ' minutes' || chr(10) || chr(10) || coalesce(row[2], '')
    || chr(10) || chr(10) || '---' || chr(10) || chr(10) || text) AS text_md5
FROM (SELECT *, string_split(text, chr(10)) AS row,
  'http://a.example.com/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '_(q)' ELSE '' END AS url FROM documents)"""

ANSWERS = """
SELECT conv_id, turn AS question_turn, text AS question,
  CASE WHEN r = 'assistant' THEN t END AS answer_turn, CASE WHEN r = 'assistant' THEN x END AS answer
FROM (SELECT *, lead(role) OVER w AS r, lead(turn) OVER w AS t, lead(text) OVER w AS x
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'"""

SLOTS = f"""
SELECT event_type AS domain, at_micros, event_id AS request_id,
  max(at_micros - n * {SLOT_PERIOD}) OVER (PARTITION BY event_type ORDER BY n) + n * {SLOT_PERIOD} AS slot
FROM (SELECT *, epoch_us(ts) AS at_micros,
  row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS n FROM events)"""

LANDED_MARKDOWN = f"""
WITH {PLAIN_PAGES},
made AS (SELECT page_id, route, content AS html FROM routed),
{page_markdown_ctes('made', 'page_id, route')}
SELECT page_id, route, md5(txt) AS markdown_md5 FROM twice"""

CORPUS = f"""
WITH listed AS ({ARTICLES}),
texts AS (
  SELECT lang, {replaced('text', r'[&<>*_#\[\]\\]', ' ')} AS safe,
    'https://' || source || '.example.com/d/' || doc_id || '?a=1&b=2' AS url FROM documents),
shells AS (
  SELECT *, lower('<html><body><article><h2>Document</h2><p>' || replace(safe, chr(10), '</p><p>') || '</p></article></body></html>') AS low
  FROM texts),
decided AS (
  SELECT *, CASE WHEN lang <> 'en' OR {has_any('low', q.PROTECTION_PHRASES)} OR {NEEDS_SCRIPT} OR NOT {MEANINGFUL}
    THEN 'needs_javascript' ELSE 'complete' END AS route FROM shells),
converted AS (
  SELECT url, route, CASE WHEN lang <> 'en' OR route = 'complete' THEN
    '## Document' || chr(10) || chr(10) || array_to_string(list_filter(list_transform(
      string_split(safe, chr(10)), lambda l: trim({replaced(replaced('l', '[ \\t]*[\\r][ \\t\\r]*', ' '), '[ \\t]+', ' ')}, ' ')), lambda l: l <> ''), chr(10) || chr(10))
    ELSE '' END AS txt FROM decided),
{cleaned('converted', 'once')},
{cleaned('once', 'twice')}
SELECT issue_num, url, route, current, md5(txt) AS markdown_md5 FROM listed JOIN twice USING (url)"""


def all_oracles() -> dict[str, str]:
    chunk_select = f"WITH RECURSIVE {CHUNKS} SELECT path, chunk_no, text FROM chunks"
    windows = """
SELECT printf('d%08d', doc_id) AS path, CAST(i AS INTEGER) AS chunk_no, substr(text, CAST(1 + i * 1950 AS INTEGER), 2000) AS text
FROM (SELECT *, unnest(range(greatest(CAST(ceil((length(text) - 50) / 1950.0) AS BIGINT), 1))) AS i FROM documents)"""
    return {
        "url_domains": f"""
SELECT page_id, domain, {among('domain', SKIPPED)} AS is_skipped, {has_any('domain', SCRIPTED)} AS is_scripted
FROM (SELECT page_id, {DOMAIN} AS domain FROM pages)""",
        "page_quality": f"""
WITH {BODIES},
marked AS (
  SELECT kind, id, CAST(strlen(html) AS INTEGER) AS content_length, CAST(length(low) AS INTEGER) AS text_length,
    {has_any('low', q.STRUCTURE_MARKERS)} AS has_html_structure,
    {has_any('low', q.ARTICLE_MARKERS)} AS has_article_content,
    {has_any('low', q.BLOCKED_PHRASES)} AS is_blocked, {NEEDS_SCRIPT} AS needs_javascript
  FROM (SELECT *, lower(html) AS low FROM bodies))
SELECT *, least(CASE WHEN content_length > 1000 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN has_html_structure THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN has_article_content THEN 0.3::DOUBLE ELSE 0 END
  + CASE WHEN is_blocked THEN 0 ELSE 0.2::DOUBLE END
  + CASE WHEN needs_javascript THEN 0 ELSE 0.1::DOUBLE END, 1.0::DOUBLE) AS quality_score
FROM marked""",
        "page_checks": f"""
WITH {BODIES}
SELECT kind, id, {MEANINGFUL} AS is_meaningful, {has_any('low', q.PROTECTION_PHRASES)} AS is_protected,
  (contains(low, '<article>') OR contains(low, 'class="story-content"')
    OR len(regexp_extract_all(low, '<p[ >]')) > 3 OR regexp_matches(low, '<h[123][ >]')) AS is_loaded
FROM (SELECT *, lower(html) AS low FROM bodies)""",
        "page_routes": f"WITH {RESPONSES} SELECT kind, id, domain, route, CAST(length(content) AS INTEGER) AS content_length FROM routed",
        "route_counts": f"WITH {RESPONSES} SELECT domain, route, count(*) AS n FROM routed GROUP BY ALL",
        "merged_pages": f"""
WITH {RESPONSES},
second AS (SELECT DISTINCT url FROM bodies WHERE kind = 'document')
SELECT kind, id, route, md5(CASE WHEN route = 'complete' THEN content
  WHEN s.url IS NOT NULL THEN '<html>rendered ' || s.url ELSE '' END) AS content_md5
FROM routed r LEFT JOIN second s ON s.url = r.url""",
        "response_bodies": f"""
SELECT page_id,
  ['utf-8', NULL, 'windows-1252', 'utf-16be', 'latin1', 'iso-8859-1'][page_id % 6 + 1] AS charset,
  CASE WHEN page_id % 6 = 5 THEN 'gzip' END AS compression,
  CASE page_id % 6 WHEN 3 THEN 'application/xhtml+xml' WHEN 4 THEN 'text/plain' ELSE 'text/html' END AS content_type,
  md5(CASE page_id % 6 WHEN 1 THEN html || chr(65533) WHEN 2 THEN plain || '€' WHEN 4 THEN plain || 'é'
    WHEN 5 THEN chr(31) || chr(65533) || html ELSE html END) AS text_md5
FROM (SELECT *, {replaced('html', '[^\\x00-\\x7f]', '?')} AS plain FROM pages)""",
        "page_markdown": f"WITH {page_markdown_ctes('pages', 'page_id')} SELECT page_id, txt AS markdown FROM twice",
        "clean_documents": f"""
WITH noted AS (SELECT doc_id, {NOTED} AS txt FROM documents), {cleaned('noted', 'made')}
SELECT doc_id, txt AS markdown FROM made""",
        "document_lines": f"""
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, md5(l) AS line_md5,
  {like_any('l', NOISE)} AS is_noise, {like_any('lower(l)', NAVIGATION)} AS is_navigation
FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i
  FROM (SELECT doc_id, string_split({NOTED}, chr(10)) AS ls FROM documents))""",
        "page_paragraphs": """
SELECT page_id, CAST(i - 1 AS INTEGER) AS paragraph_no, p AS paragraph
FROM (SELECT page_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
  FROM (SELECT page_id, regexp_extract_all(lower(html), '<p[^>]*>([^<]+)</p>', 1) AS ps FROM pages))""",
        "issue_index": ISSUES,
        "issue_index_first": f"SELECT * FROM ({ISSUES}) WHERE current < 20",
        "issue_articles": ARTICLES,
        "article_headers": HEADERS,
        "stored_articles": HEADERS,
        "chunk_windows": windows,
        "chunk_sections": chunk_select,
        "new_issues": "SELECT doc_id AS num, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "forced_issues": "SELECT doc_id AS num, source FROM documents",
        "new_chunks": f"""
SELECT path, chunk_no FROM ({windows})
WHERE chunk_no > 0 OR path NOT IN (SELECT printf('d%08d', doc_id) FROM labels)""",
        "document_vectors": f"""
WITH named AS (SELECT printf('d%08d', doc_id) AS path, text FROM documents),
{embedded('named', 'path', 'text', 'made')}
SELECT k AS path, b AS bucket, round(CAST(w AS DOUBLE), 6) AS weight FROM made_weights""",
        "nearest_vectors": NEIGHBOURS,
        "nearest_by_cells": NEIGHBOURS,
        "nearest_approximate": APPROXIMATE,
        "nearest_dirty": DIRTY_NEIGHBOURS,
        "dirty_page_markdown": DIRTY_PAGES,
        "article_files": ARTICLE_FILES,
        "question_prompts": PROMPTS,
        "run_counts": f"""
SELECT 'chunks' AS stage, path AS item, count(*) AS n FROM ({chunk_select}) GROUP BY ALL
UNION ALL SELECT 'hits', CAST(query_id AS VARCHAR), count(*) FROM ({NEIGHBOURS}) GROUP BY ALL
UNION ALL SELECT 'articles', CAST(issue_num AS VARCHAR), count(*) FROM ({ARTICLES}) GROUP BY ALL""",
        "chat_answers": ANSWERS,
        "chat_answers_small_blocks": ANSWERS,
        "chat_until_exit": """
SELECT conv_id, turn, role FROM conversations c WHERE NOT EXISTS (
  SELECT 1 FROM conversations e WHERE e.conv_id = c.conv_id AND e.turn <= c.turn
    AND e.role = 'user' AND (e.conv_id * 7 + e.turn) % 5 = 2)""",
        "polite_schedule": SLOTS,
        "corpus_articles": CORPUS,
        "corpus_repeated": CORPUS,
        "batch_markdown": LANDED_MARKDOWN,
        "stream_markdown": LANDED_MARKDOWN,
        "stream_index": chunk_select,
        "stream_answers": PROMPTS,
        "stream_issues": f"SELECT issue_num, 'issue-' || issue_num || '/article-' || current || '.md' AS path, title, url FROM ({ARTICLES})",
        "stream_corpus": f"SELECT issue_num, 'issue-' || issue_num || '/article-' || current || '.md' AS path, url, markdown_md5 FROM ({CORPUS})",
        "stream_schedule": SLOTS,
    }
