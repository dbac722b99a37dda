"""Markdown of an article: cleaning, the stored file's header, line tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.text import (
    SPACE,
    SPACE_CHARS,
    find_all,
    is_blank,
    let,
    lines,
    matches_any,
    strip,
    sub,
    sub_where,
)

# Openings of lines that are not part of an article.
SOCIAL_VERBS = "Follow|Share|Like|Tweet|Subscribe|Sign up|Sign in|Log in|Register"
SOCIAL_NETWORKS = "Facebook|Twitter|LinkedIn|Instagram|YouTube|GitHub|Pinterest"
SOCIAL_HOSTS = "facebook|twitter|x|linkedin|instagram|youtube|github|pinterest|medium|substack"
BYLINES = "By|Published on|Written by|Author"
NOISE_LINES = [
    rf"(?iu)\A[{SPACE}]*(?:{SOCIAL_VERBS})",
    rf"\A[{SPACE}]*\[(?:{SOCIAL_NETWORKS})[^\]]*\]\(http[^\)]+\)",
    rf"\Ahttps?://[^\n]*?(?:{SOCIAL_HOSTS})\.com",
    rf"\A[{SPACE}]*\[[^\n]*\]\(/[^\n]*\)",
    rf"(?iu)\A[{SPACE}]*(?:{BYLINES})",
    rf"(?iu)\A[{SPACE}]*\p{{Nd}}+[{SPACE}]*min(?:ute)?s?[{SPACE}]*read",
    rf"\A[{SPACE}]*-[{SPACE}]*\[[^\n]*\]\([^\n]*\)",
    rf"\A[{SPACE}]*[-—_]{{3,}}[{SPACE}]*\z",
]

# All of them in one, and what such a line begins with after its white space.
NOISE_LINE = r"\A(?:" + "|".join(f"(?:{line.replace(chr(92) + 'A', '', 1)})" for line in NOISE_LINES) + ")"
NOISE_OPENING = rf"(?iu)\A(?:{SOCIAL_VERBS}|{BYLINES}|\p{{Nd}}|\[|http|[-—_])"
OPENING_LENGTH = 16

# Clean-ups of the joined text, in order. A blank line is put
# after every heading and the next rule takes back what was there already.
CLEAN_UPS = [
    (rf"\[([^\]]*)\]\([{SPACE}]*\)", "$1"),
    (rf"!\[([^\]]*)\]\([{SPACE}]*\)", ""),
    (rf"(?dm)^#+[{SPACE}]*$", ""),
    (r"(?dm)(^#+.*)\n", "$1\n\n"),
    (r"\n{3,}", "\n\n"),
    (r"(?dm)[ \t]+$", ""),
]
# What a text must hold for the clean-up of the same place to matter, as signs and a pattern that opens with
# a plain one. A heading with a blank line after it needs no other; white space at the end is cut after them.
CLEAN_UP_SIGNS = [
    (["]("], None),
    (["]("], None),
    (["#"], rf"(?dm)#(?<=^#)#*[{SPACE}]*$"),
    (["#"], r"(?dm)#(?<=^#).*\n[^\n]"),
    (["\n\n\n"], None),
    ([" \n", "\t\n"], None),
]

# Openings that mark a text as navigation.
NAVIGATION_OPENINGS = [
    r"\Amenu\b",
    r"\Anavigation\b",
    r"\Askip to\b",
    r"\Ago to\b",
    r"\Asearch\b",
    r"\Ahome\n?\z",
    r"\Aabout\n?\z",
    r"\Acontact\b",
    r"\Amain menu\b",
]


def is_noise_line(line: Column) -> Column:
    """Social, byline, reading-time, link-only and rule lines."""
    opening = F.substring(F.ltrim(line, F.lit(SPACE_CHARS)), 1, OPENING_LENGTH)
    return opening.rlike(NOISE_OPENING) & line.rlike(NOISE_LINE)


def is_navigation(text: Column) -> Column:
    return matches_any(F.lower(text), NAVIGATION_OPENINGS)


def _kept_lines(text: Column) -> Column:
    """Text without noise lines and repeated blank lines."""
    kept = F.filter(lines(text), lambda line: ~is_noise_line(line))

    def collapse_blanks(rows: Column) -> Column:
        def keep(line: Column, i: Column) -> Column:
            after_text = (i > 0) & ~is_blank(F.try_element_at(rows, i))
            return ~is_blank(line) | F.coalesce(after_text, F.lit(False))

        shown = F.filter(rows, keep)
        blank_out = F.transform(shown, lambda l: F.when(is_blank(l), F.lit("")).otherwise(l))
        return F.array_join(blank_out, "\n")

    return let(kept, collapse_blanks)


def _tidied(out: Column) -> Column:
    for (pattern, replacement), (signs, test) in zip(CLEAN_UPS, CLEAN_UP_SIGNS, strict=True):
        out = sub_where(out, signs, pattern, replacement, test)
    return strip(out)


def clean_markdown(text: Column) -> Column:
    """Drop noise lines and repeated blank lines, then tidy what is left."""
    return _tidied(_kept_lines(text))


def clean_twice(text: Column) -> Column:
    """``clean_markdown`` of itself.

    Where tidying the kept lines took nothing but white space off their end, they
    are again what a second pass would keep, so it isn't made.
    """

    def passes(joined: Column, once: Column) -> Column:
        rest = F.substring(joined, F.length(once) + 1, F.length(joined))
        return F.when(joined.startswith(once) & is_blank(rest), once).otherwise(clean_markdown(once))

    return let(_kept_lines(text), lambda joined: let(_tidied(joined), lambda once: passes(joined, once)))


def article_path(issue_num: Column, current: Column) -> Column:
    return F.format_string("issue-%d/article-%d.md", issue_num, current)


def render_article(
    title: Column, url: Column, reading_time: Column, summary: Column, markdown: Column
) -> Column:
    """The stored text of an article: header, rule, Markdown."""
    return F.concat(
        F.lit("# "),
        title,
        F.lit("\n\nSource: ["),
        url,
        F.lit("]("),
        url,
        F.lit(")\nReading time: "),
        F.coalesce(reading_time, F.lit(0)).cast("string"),
        F.lit(" minutes\n\n"),
        F.coalesce(summary, F.lit("")),
        F.lit("\n\n---\n\n"),
        F.coalesce(markdown, F.lit("")),
    )


def parse_header(text: Column) -> Column:
    """Title, source, reading time and summary out of a stored article.

    Where a label occurs twice the last line counts; a source link is cut at
    its last opening bracket.
    """
    source, minutes = "Source:", "Reading time:"

    def last(rows: Column, label: str) -> Column:
        return F.coalesce(
            F.try_element_at(F.filter(rows, lambda l: l.startswith(label)), F.lit(-1)), F.lit("")
        )

    def build(rows: Column) -> Column:
        body = F.slice(rows, F.lit(2), F.size(rows))
        other = F.filter(body, lambda l: ~l.startswith(source) & ~l.startswith(minutes))
        return F.struct(
            F.btrim(F.element_at(rows, 1), F.lit("# \t\r\n")).alias("title"),
            F.btrim(F.substring_index(last(body, source), "(", -1), F.lit(")")).alias("source_url"),
            strip(F.substring_index(last(body, minutes), ":", -1)).alias("reading_time"),
            strip(F.array_join(other, "\n")).alias("summary"),
        )

    return let(lines(F.substring_index(text, "\n---\n", 1)), build)


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return find_all(F.lower(text), r"[\p{L}\p{Nd}]+")
