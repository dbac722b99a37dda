"""Quality columns, routing of landed pages and the merge with a second fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions import bodies, quality
from pressmill.functions.urls import (
    SCRIPTED_DOMAINS,
    SKIPPED_DOMAINS,
    is_scripted_domain,
    is_skipped_domain,
    registered_domain,
)

COMPLETE = "complete"
NEEDS_SCRIPT = "needs_javascript"


def _is_binary(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.BinaryType)


def with_quality(pages: DataFrame, body: str = "html") -> DataFrame:
    """Add the quality record of a body, text or bytes, as seven columns."""
    text = bodies.lenient_utf8(F.col(body)) if _is_binary(pages, body) else F.col(body)
    lower = F.col("_lower")
    flags = {
        "has_html_structure": quality.has_html_structure(lower),
        "has_article_content": quality.has_article_content(lower),
        "is_blocked": quality.is_blocked(lower),
        "needs_javascript": quality.needs_script(lower),
    }
    return (
        pages.withColumn("_lower", F.lower(text))
        .withColumns(
            {
                "content_length": F.octet_length(body),
                "text_length": F.length(lower),
                **flags,
            }
        )
        .drop("_lower")
        .withColumn(
            "quality_score",
            quality.quality_score(F.col("content_length"), *[F.col(name) for name in flags]),
        )
    )


def route(
    pages: DataFrame,
    url: str = "url",
    body: str = "html",
    status: str | None = None,
    headers: str | None = None,
    skipped: list[str] = SKIPPED_DOMAINS,
    scripted: list[str] = SCRIPTED_DOMAINS,
) -> DataFrame:
    """Send each page to one of two routes and decode the complete ones.

    Adds ``domain``, ``route`` and ``content``: the decoded text of a page that
    is complete, '' for one that was skipped or must be fetched again.
    """
    status_col = F.col(status) if status else F.lit(None).cast("int")
    header_col = F.col(headers) if headers else F.lit(None).cast("map<string,string>")
    binary = _is_binary(pages, body)
    decoded = (
        bodies.decode_body(F.col(body), bodies.declared_charset(header_col))
        if binary
        else F.col(body)
    )
    staged = pages.withColumns(
        {"domain": registered_domain(F.col(url)), "_decoded": decoded}
    ).withColumn("_lower", F.lower("_decoded"))
    lower = raw = F.col("_lower")
    if binary:
        staged = staged.withColumn("_raw", F.lower(bodies.lenient_utf8(F.col(body))))
        raw = F.col("_raw")
    domain = F.col("domain")
    fetched = (
        F.when(F.col(body).isNull(), NEEDS_SCRIPT)
        .when(quality.is_protected(lower, status_col, header_col), NEEDS_SCRIPT)
        .when(quality.needs_script(raw) | ~quality.has_meaningful_content(raw), NEEDS_SCRIPT)
    )
    if binary:
        fetched = fetched.when(~quality.has_meaningful_content(lower), NEEDS_SCRIPT)
    fetched = fetched.when(is_scripted_domain(domain, scripted), NEEDS_SCRIPT).otherwise(COMPLETE)
    skip = is_skipped_domain(domain, skipped)
    return (
        staged.withColumn("route", F.when(skip, COMPLETE).otherwise(fetched))
        .withColumn(
            "content",
            F.when((F.col("route") == COMPLETE) & ~skip, F.col("_decoded")).otherwise(""),
        )
        .drop("_decoded", "_lower", "_raw")
    )


def split_routes(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Complete pages and pages to be fetched again: disjoint, together all."""
    return (
        routed.filter(F.col("route") == COMPLETE),
        routed.filter(F.col("route") == NEEDS_SCRIPT),
    )


def _per_url(rendered: DataFrame, url: str, html: str) -> DataFrame:
    """One row per url, so that a url many pages share cannot multiply them."""
    return rendered.groupBy(F.col(url)).agg(F.max(html).alias("_rendered"))


def with_second_fetch(
    waiting: DataFrame, rendered: DataFrame, url: str = "url", html: str = "html"
) -> DataFrame:
    """Fill ``content`` from a second table of rendered pages, '' where it has none.

    The many pages stay on the side that adaptive execution may split.
    """
    return (
        waiting.join(_per_url(rendered, url, html), url, "left")
        .withColumn("content", F.coalesce("_rendered", F.lit("")))
        .drop("_rendered")
    )


def complete_pages(
    landed: DataFrame, rendered: DataFrame, url: str = "url", html: str = "html", **how
) -> DataFrame:
    """Route, content and domain of every url, from either table, in one pass.

    ``landed`` holds one row per url, so neither side of the join has a hot key,
    and a page is looked at once however many articles link to it. A url that
    only ``rendered`` knows counts as fetched in vain the first time.
    """
    both = landed.join(_per_url(rendered, url, html), url, "full")
    waits = F.col("route") == NEEDS_SCRIPT
    return (
        route(both, url, html, **how)
        .withColumn(
            "content",
            F.when(waits, F.coalesce("_rendered", F.lit(""))).otherwise(F.col("content")),
        )
        .drop("_rendered")
    )


def unfetched_route(url: Column, skipped: list[str] = SKIPPED_DOMAINS) -> Column:
    """Route of a url that no table has a page for."""
    skip = is_skipped_domain(registered_domain(url), skipped)
    return F.when(skip, COMPLETE).otherwise(NEEDS_SCRIPT)


def merge_routes(
    routed: DataFrame, rendered: DataFrame, url: str = "url", html: str = "html"
) -> DataFrame:
    """Complete pages together with those completed by the second fetch, in one pass.

    A page that waits looks for its url, any other for a key no url can be, all
    different, so that they don't meet in one task.
    """
    waits = F.col("route") == NEEDS_SCRIPT
    sought = F.when(waits, F.col(url)).otherwise(F.concat(F.lit("\n"), F.col(url)))
    second = _per_url(rendered.filter(~F.col(url).startswith("\n")), url, html).withColumnRenamed(url, "_sought")
    merged = routed.filter("route is not null").withColumn("_sought", sought).join(second, "_sought", "left")
    content = F.when(waits, F.coalesce("_rendered", F.lit(""))).otherwise(F.col("content"))
    return merged.withColumn("content", content).drop("_sought", "_rendered")
