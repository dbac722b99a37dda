"""Markdown columns and the rows inside a text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions import markdown as md
from pressmill.functions.html import html_to_markdown
from pressmill.functions.quality import plain_paragraphs
from pressmill.functions.text import explode_positions, lines


def with_markdown(pages: DataFrame, html: str = "content", out: str = "markdown") -> DataFrame:
    """Add the Markdown of each page; a page without HTML keeps what it has."""
    before = F.col(out) if out in pages.columns else F.lit("")
    made = F.when(F.length(html) > 0, html_to_markdown(F.col(html))).otherwise(before)
    return pages.withColumn(out, made)


def with_clean_markdown(df: DataFrame, text: str, out: str = "markdown") -> DataFrame:
    return df.withColumn(out, md.clean_markdown(F.col(text)))


def explode_lines(df: DataFrame, text: str, number: str = "line_no", out: str = "line") -> DataFrame:
    keep = [c for c in df.columns if c != text]
    return explode_positions(df, keep, lines(F.col(text)), number, out)


def explode_paragraphs(
    df: DataFrame, html: str, number: str = "paragraph_no", out: str = "paragraph"
) -> DataFrame:
    keep = [c for c in df.columns if c != html]
    return explode_positions(df, keep, plain_paragraphs(F.lower(html)), number, out)


def with_article_text(articles: DataFrame) -> DataFrame:
    """Add ``path`` and ``text`` of the stored file of each article."""
    return articles.withColumns(
        {
            "path": md.article_path(F.col("issue_num"), F.col("item_of.current")),
            "text": md.render_article(
                F.col("title"), F.col("url"), F.col("reading_time"), F.col("summary"),
                F.col("markdown"),
            ),
        }
    )


def with_header(files: DataFrame, text: str = "text") -> DataFrame:
    """Add the four header fields of a stored article."""
    names = ["title", "source_url", "reading_time", "summary"]
    return (
        files.withColumn("_header", md.parse_header(F.col(text)))
        .select("*", *[F.col(f"_header.{n}").alias(n) for n in names])
        .drop("_header")
    )
