"""Registered chunks of Markdown beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracles import WHITE, lit
from checks.queries import named_documents
from pressmill.operators.markdown_chunks import split_markdown

#: What documents get of Markdown: headings, code with things that look like some, tables and rules.
MADE = [
    (". The ", ".\n\n## The part\n\nThe "),
    (". A ", ".\n```py\n# A is no heading\n\nx = 1 | 2\n```\nA "),
    (". En ", ".\n\n| En | b |\n| --- | --- |\n| c | d |\n\n"),
    (". In ", ".\n\n---\nIn "),
    (". Der ", ".\n# Der\n~~~~\n~~~\n# still code\n~~~~\n"),
    (". Le ", ".\n````\nnever closed in its paragraph\n```\n"),
    (". La ", ".\n````\n### La\n"),
]


def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for old, new in MADE:
        text = F.replace(text, F.lit(old), F.lit(new))
    return split_markdown(named_documents(spark, sf_dir).withColumn("text", text))


TEXT = "text"
for _old, _new in MADE:
    TEXT = f"replace({TEXT}, {lit(_old)}, {lit(_new)})"

_TICKS = "|".join(rf" {{0,3}}{c}{{{n}{',' if n == 5 else ''}}}[^{c}\n]*(?s:.*?)\n {{0,3}}{c}{{{n},}}[ \t]*(?:\n|\z)" for c in "`~" for n in (5, 4, 3))
_OPENED = " {0,3}(?:`{3,}[^`\\n]*|~{3,}[^~\\n]*)"
_UNITS = lit(_TICKS + "|" + _OPENED + r"(?:\n(?s:.*))?\z|[^\n]*\n|[^\n]+\z")


def _cut(kind: str) -> str:
    return f"nullif(regexp_extract(substr(rest, 1, 1950), {lit('(?s)^(.*' + kind + ')')}, 1), '')"


_BEST = ", ".join(_cut(kind) for kind in ("\ufdd1", "\ufdd2", "\\n\\n", "\\n", "\ufdd0", " ", "\ufdd3"))
_PLAIN = "translate({}, '\ufdd0\ufdd1\ufdd2\ufdd3', repeat(chr(10), 4))"

CHUNKS = f"""
WITH RECURSIVE made AS (SELECT doc_id, {TEXT} AS text FROM documents),
units AS (
  SELECT doc_id, unnest(us) AS u, generate_subscripts(us, 1) AS n
  FROM (SELECT doc_id, regexp_extract_all(text, {_UNITS}) AS us FROM made WHERE length(text) > 2000)),
named AS (
  SELECT *, CASE WHEN regexp_matches(u, {lit('^' + _OPENED + r'(?:\n|$)')}) THEN 'f'
    WHEN regexp_matches(u, {lit('^#{1,6}(?:[ \\t\\n]|$)')}) THEN 'h'
    WHEN regexp_matches(u, {lit('^ {0,3}(?:[*]{3,}|-{3,}|_{3,})[ \\t]*\\n?$')}) THEN 'r'
    WHEN regexp_matches(u, '^ {{0,3}}[|]') THEN 't' WHEN u = chr(10) THEN 'b' ELSE 'l' END AS kind
  FROM units),
placed AS (
  SELECT *, lag(kind) OVER w AS before, lead(kind) OVER w AS after FROM named WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
marked AS (
  SELECT doc_id, string_agg(CASE WHEN NOT ends_with(u, chr(10)) THEN body ELSE body ||
      CASE WHEN after = 'h' THEN '\ufdd1' WHEN kind IN ('f', 'r') OR after IN ('f', 'r') THEN '\ufdd2'
        WHEN kind = 't' AND after = 't' THEN '\ufdd0' WHEN kind = 'h' OR (kind = 'b' AND before = 'h') THEN '\ufdd3' ELSE chr(10) END END,
      '' ORDER BY n) AS text
  FROM (SELECT *, CASE WHEN kind = 'f' THEN replace(line, chr(10), '\ufdd0') ELSE line END AS body
    FROM (SELECT *, CASE WHEN ends_with(u, chr(10)) THEN left(u, length(u) - 1) ELSE u END AS line FROM placed)) GROUP BY 1),
runs AS (
  SELECT doc_id, 0 AS i, text AS rest, '' AS run FROM marked
  UNION ALL
  SELECT doc_id, i + 1, substr(rest, length(cut) + 1), cut FROM (
    SELECT *, CASE WHEN length(rest) <= 1950 THEN rest ELSE coalesce({_BEST}, substr(rest, 1, 1950)) END AS cut
    FROM runs WHERE rest <> '')),
tailed AS (
  SELECT doc_id, i, run, lag(run) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM runs WHERE i > 0),
joined AS (
  SELECT doc_id, i, trim({_PLAIN.format("coalesce(regexp_extract(CASE WHEN length(before) <= 50 THEN before ELSE regexp_extract(right(before, 51), '(?s)[ \\n](.*)$', 1) END, '([^\ufdd0\ufdd1\ufdd2\ufdd3]*)$', 1), '') || run")}, {WHITE}) AS text
  FROM tailed
  UNION ALL
  SELECT doc_id, 0, trim(text, {WHITE}) FROM made WHERE length(text) <= 2000)
SELECT printf('d%08d', doc_id) AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_no, text
FROM joined WHERE text <> ''"""

QUERIES = [chunk_markdown]
ORACLES = {"chunk_markdown": CHUNKS}
