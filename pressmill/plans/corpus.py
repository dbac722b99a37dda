"""From landed pages to the article table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.operators.extraction import extract_articles, list_issues
from pressmill.operators.incremental import first_by_key, skip_existing_issues
from pressmill.operators.markdown import with_markdown
from pressmill.operators.routing import complete_pages, unfetched_route
from pressmill.session import frozen

ISSUE_LIMIT = 0  # all issues of an index page


def new_issues(
    index_pages: DataFrame,
    stored: DataFrame | None = None,
    limit: int = ISSUE_LIMIT,
    force_all: bool = False,
) -> DataFrame:
    """Issues named by the index pages that are to be worked on."""
    issues = list_issues(index_pages, limit=limit)
    if stored is None:
        return issues
    return skip_existing_issues(issues, stored, force_all=force_all)


def issue_articles(issues: DataFrame, landed: DataFrame) -> DataFrame:
    """Articles of the issues whose page has landed.

    An issue that several index pages list is taken from one of them, a page that
    landed several times from one copy, each by the least hash.
    """
    issues = first_by_key(issues.filter("num is not null"), ["num"])
    pages = landed.select("url", "html").join(issues.select("url").distinct(), "url", "left_semi")
    pages = first_by_key(pages, ["url"])
    return extract_articles(issues.select("num", "url", "item_of").join(pages, "url").drop("url"))


def article_markdown(articles: DataFrame, landed: DataFrame, rendered: DataFrame) -> DataFrame:
    """Articles with the Markdown of their landed page or its rendered second copy.

    Of a url that landed several times one page is taken. Pages are routed and converted by url, only
    those an article asks for, and the Markdown, not the page, is joined to the
    articles: one that many articles link to is converted once, and the articles
    are the side of the last join that adaptive execution may split.
    """
    asked = articles.select("url").distinct()
    wanted = first_by_key(landed.select("url", "html").join(asked, "url", "left_semi"), ["url"])
    again = rendered.select("url", "html").join(asked, "url", "left_semi")
    pages = with_markdown(complete_pages(wanted, again)).select("url", "route", "markdown")
    return articles.join(pages, "url", "left").withColumns(
        {
            "route": F.coalesce("route", unfetched_route(F.col("url"))),
            "markdown": F.coalesce("markdown", F.lit("")),
        }
    )


def build_corpus(
    index_pages: DataFrame,
    landed: DataFrame,
    rendered: DataFrame,
    stored: DataFrame | None = None,
    limit: int = ISSUE_LIMIT,
    force_all: bool = False,
) -> DataFrame:
    """All articles of the new issues, ready for ``save_articles``.

    The list of articles, small against their pages, is written once: the choice
    of pages and the last join read it instead of parsing the issues again.
    """
    issues = new_issues(index_pages, stored, limit, force_all)
    return article_markdown(frozen(issue_articles(issues, landed)), landed, rendered)
