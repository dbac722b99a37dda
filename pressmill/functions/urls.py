"""URL classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressmill.functions.text import contains_any

# What counts as the registered part of a host, and the hosts
# that are never fetched or that render their text in the browser.
REGISTERED_DOMAIN = r"https?://(?:[^./]+\.)*([^./]+\.[a-zA-Z][^./:]+)(?:/|$|:)"
SKIPPED_DOMAINS = ["x.com", "youtube.com"]
SCRIPTED_DOMAINS = [
    "medium.com",
    "substack.com",
    "ghost.io",
    "notion.site",
    "vercel.app",
    "netlify.app",
    "firebase.app",
    "web.app",
]


def registered_domain(url: Column) -> Column:
    """Last two labels of the host, or ``unknown``."""
    found = F.regexp_extract(url, REGISTERED_DOMAIN, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def is_skipped_domain(domain: Column, skipped: list[str] = SKIPPED_DOMAINS) -> Column:
    return domain.isin(*skipped)


def is_scripted_domain(domain: Column, names: list[str] = SCRIPTED_DOMAINS) -> Column:
    """Substring test, so a longer host that ends in a listed one counts too."""
    return contains_any(domain, names)


def absolute_url(link: Column, page_url: Column) -> Column:
    base = F.substring_index(page_url, "/", 3)
    rooted = F.when(link.startswith("/"), link).otherwise(F.concat(F.lit("/"), link))
    return F.when(link.startswith("http"), link).otherwise(F.concat(base, rooted))


def trailing_number(link: Column) -> Column:
    return F.substring_index(link, "/", -1).try_cast("int")
