"""What a landed response looks like: blocked, scripted, meaningful, scored.

Every test works on text that the caller has already lower-cased, so that the
lower-casing is done once per row however many tests are asked for.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.text import any_of, contains_any, find_all, let, matches_any, strip

# Indicator phrases.
BLOCKED_PHRASES = [
    "access denied",
    "403 forbidden",
    "404 not found",
    "page not found",
    "blocked",
    "restricted",
    "paywall",
    "subscription required",
    "login required",
    "sign in to continue",
    "premium content",
]
PROTECTED_STATUSES = [403, 503, 429]
PROTECTION_HEADERS = [
    "cf-ray",
    "cf-cache-status",
    "cf-request-id",
    "server",
    "cf-bgj",
    "cf-polished",
]
PROTECTION_PHRASES = [
    "cloudflare",
    "checking your browser",
    "ddos protection",
    "enable javascript",
    "browser check",
    "security check",
    "cf-browser-verification",
    "challenge-platform",
]
STRUCTURE_MARKERS = ["<!doctype html", "<html", "<head", "<body"]
ARTICLE_MARKERS = [
    "<article",
    "<main",
    "article-content",
    "story-content",
    "post-content",
    "entry-content",
]
SHORT_PAGE_MARKERS = ["<article", "<main", "<section", "<p>"]
LAYOUT_MARKERS = ARTICLE_MARKERS + ["<section", "<div"]
SHELL_MARKERS = ["<html", "<body", "<head"]
PLAIN_PARAGRAPH = r"<p[^>]*>([^<]+)</p>"

# Words that must follow one another on one line, with the least
# number of characters between them, and two attribute patterns.
SCRIPT_WORD_RUNS = [
    (1, ["enable", "javascript"]),
    (1, ["javascript", "required"]),
    (1, ["javascript", "disabled"]),
    (1, ["please", "enable", "javascript"]),
    (1, ["turn", "on", "javascript"]),
    (1, ["javascript", "must", "be", "enabled"]),
    (1, ["requires", "javascript"]),
    (0, ["loading", "app"]),
    (0, ["react", "app"]),
    (0, ["vue", "app"]),
    (0, ["angular", "app"]),
    (0, ["bundle", ".js"]),
    (0, ["window.__", "__"]),
]
SCRIPT_PATTERNS = [r"id=[\"']root[\"']", r"id=[\"']app[\"']"]
SCRIPT_PHRASES = ["<noscript"]


def _word_run(lower: Column, gap: int, words: list[str]) -> Column:
    """Whether ``words`` follow one another on one line, linear in its length.

    Plain searches for the words come first and mostly decide. In the pattern
    the first place of each word is enough, so each step is atomic and a line
    is walked once even when the last word never comes.
    """
    first, *rest = [re.escape(w) for w in words]
    between = r"[^\n]{%d,}?" % gap
    pattern = r"(?dm)^(?>[^\n]*?%s)" % first + "".join(f"(?>{between}{w})" for w in rest)
    present = [lower.contains(w) for w in reversed(dict.fromkeys(words))]
    return reduce(and_, [*present, lower.rlike(pattern)])


def is_blocked(lower: Column) -> Column:
    return contains_any(lower, BLOCKED_PHRASES)


def is_protected(lower: Column, status: Column, headers: Column) -> Column:
    named = F.exists(F.map_keys(headers), lambda k: F.lower(k).isin(*PROTECTION_HEADERS))
    return (
        F.coalesce(status.isin(*PROTECTED_STATUSES), F.lit(False))
        | F.coalesce(named, F.lit(False))
        | contains_any(lower, PROTECTION_PHRASES)
    )


def has_html_structure(lower: Column) -> Column:
    return contains_any(lower, STRUCTURE_MARKERS)


def has_article_content(lower: Column) -> Column:
    return contains_any(lower, ARTICLE_MARKERS)


def needs_script(lower: Column) -> Column:
    runs = [_word_run(lower, gap, words) for gap, words in SCRIPT_WORD_RUNS]
    mounted = lower.contains("id=") & matches_any(lower, SCRIPT_PATTERNS)
    too_plain = (F.length(lower) < 1000) & ~contains_any(lower, SHORT_PAGE_MARKERS)
    return contains_any(lower, SCRIPT_PHRASES) | mounted | any_of(runs) | too_plain


def plain_paragraphs(lower: Column) -> Column:
    """Texts of the paragraphs that hold no inner tag."""
    return find_all(lower, PLAIN_PARAGRAPH, 1)


def has_meaningful_content(lower: Column) -> Column:
    def enough(paragraphs: Column) -> Column:
        return (F.size(paragraphs) >= 2) | (
            F.length(strip(F.array_join(paragraphs, " "))) > 100
        )

    return (
        (F.length(lower) >= 200)
        & contains_any(lower, SHELL_MARKERS)
        & (contains_any(lower, LAYOUT_MARKERS) | let(plain_paragraphs(lower), enough))
    )


def has_loaded_content(html: Column) -> Column:
    """Elements that tell that a rendered page holds its article."""
    class_token = r"(?is)<[a-z][^>]*\sclass\s*=\s*[\"'](?:[^\"']*\s)?(?:story-content|article-content)[\s\"']"
    return any_of(
        [
            html.rlike(r"(?i)<article[\s>]"),
            html.rlike(r"(?is)<[a-z][^>]*\sdata-testid\s*=\s*[\"']?storyContent[\s\"'>]"),
            html.rlike(class_token),
            F.regexp_count(html, F.lit(r"(?i)<p[\s>]")) > 3,
            html.rlike(r"(?i)<h[1-3][\s>]"),
        ]
    )


def quality_score(
    content_length: Column, structure: Column, article: Column, blocked: Column, scripted: Column
) -> Column:
    """Sum of the five weights; all doubles, added in this order."""

    def part(test: Column, weight: float) -> Column:
        return F.when(test, F.lit(weight)).otherwise(F.lit(0.0))

    total = (
        part(content_length > 1000, 0.2)
        + part(structure, 0.2)
        + part(article, 0.3)
        + part(~blocked, 0.2)
        + part(~scripted, 0.1)
    )
    return F.least(total, F.lit(1.0))
