"""SQL for the operators' queries, where SQL can express them."""

from __future__ import annotations

from pressmill.llm.queries import URL_RULES
from pressmill.llm.url_filter import BLOCKED_DOMAINS


def bloom_cascade() -> str:
    """Membership as a plain look at the list, rules as a table of which the longest fit counts."""
    listed = ", ".join(f"('{name}')" for name in BLOCKED_DOMAINS)
    rules = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)
    return f"""
WITH listed(name) AS (VALUES {listed}),
rules(verdict, host, path) AS (VALUES {rules}),
parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (
  SELECT *,
    (SELECT max_by(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) FROM rules r
     WHERE (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path)) AS fit,
    EXISTS (SELECT 1 FROM listed l WHERE p.host = l.name OR suffix(p.host, '.' || l.name)) AS bad
  FROM parsed p)
SELECT page_id, host, path, fit.rule AS rule,
  coalesce(fit.verdict, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict
FROM judged
"""


def all_oracles() -> dict[str, str]:
    return {"op7_bloom_cascade": bloom_cascade()}
