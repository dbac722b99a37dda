"""Issues out of index pages and articles out of issue pages.

A page is one row, so its blocks are found, counted and numbered inside an
array of that row and exploded last: positions and totals need no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.functions.html import attribute, decode_entities, visible_text, without_unseen
from pressmill.functions.text import (
    contains_any,
    explode_positions,
    find_all,
    let,
    strip,
    sub,
)
from pressmill.functions.urls import absolute_url, trailing_number
from pressmill.schemas import POSITION

# Fixed value: words of the links that follow a summary.
SHARING_WORDS = ["read", "share", "pocket", "instapaper", "twitter", "email"]
READING_TIME = "minutes read"


def _with_class(tag: str, name: str) -> str:
    """Opening tag that carries a class, among others or alone."""
    quoted = "|".join(rf"{q}(?:[^{q}]*\s)?{name}(?:\s[^{q}]*)?{q}" for q in "\"'")
    return rf"<{tag}\s(?:[^>]*\s)?class\s*=\s*(?:{quoted}|{name}(?=[\s>]))[^>]*>"


def _after_each(html: Column, opener: str) -> Column:
    """Text following each opener, up to the next one."""
    parts = F.split(html, rf"(?is){opener}")
    return F.slice(parts, F.lit(2), F.size(parts))


def _inner(html: Column, tag: str, name: str) -> Column:
    return F.regexp_extract(html, rf"(?is){_with_class(tag, name)}(.*?)</{tag}\s*>", 1)


def issue_date(text: Column) -> Column:
    """Date out of ``15th December 2023``; NULL when it is none."""
    return F.try_to_date(sub(text, r"(\d+)(?:st|nd|rd|th)", "$1"), "d MMMM yyyy")


def list_issues(
    pages: DataFrame, url: str = "url", html: str = "html", limit: int = 0
) -> DataFrame:
    """One row per issue block of an index page, in page order.

    ``limit`` keeps the first issues of each page; the total still counts all.
    """
    blocks = _after_each(without_unseen(F.col(html)), _with_class("div", "table-issue"))

    def issue(block: Column) -> Column:
        heading = _inner(block, "p", "title-table-issue")
        anchor = F.regexp_extract(heading, r"(?is)<a\s[^>]*>", 0)
        return F.struct(
            F.nullif(decode_entities(attribute(anchor, "href")), F.lit("")).alias("link"),
            visible_text(_inner(block, "p", "text-table-issue")).alias("date"),
        )

    keep = [c for c in pages.columns if c not in (url, html)]
    listed = pages.select(*keep, F.col(url).alias("_page_url"), blocks.alias("_blocks")).select(
        *keep, "_page_url", "_blocks", F.size("_blocks").alias("_total")
    )
    if limit > 0:
        listed = listed.withColumn("_blocks", F.slice("_blocks", 1, limit))
    return (
        explode_positions(
            listed, [*keep, "_page_url", "_total"], F.col("_blocks"), "_pos", "_block"
        )
        .select(*keep, "_page_url", "_total", "_pos", issue(F.col("_block")).alias("_issue"))
        .select(
            *keep,
            trailing_number(F.col("_issue.link")).alias("num"),
            absolute_url(F.col("_issue.link"), F.col("_page_url")).alias("url"),
            issue_date(F.col("_issue.date")).alias("date"),
            F.struct(F.col("_pos").alias("current"), F.col("_total").alias("total"))
            .cast(POSITION)
            .alias("item_of"),
        )
    )


def _sibling_divs(section: Column) -> Column:
    """Divs that follow a section heading at its own level.

    Walks the pieces between opening tags with the depth as state; the walk is
    over once a closing tag leaves the heading's own container.
    """
    state = T.StructType(
        [
            T.StructField("depth", T.IntegerType()),
            T.StructField("over", T.BooleanType()),
            T.StructField("open", T.StringType()),
            T.StructField("done", T.ArrayType(T.StringType())),
        ]
    )
    closer = "</div>"
    other = section.rlike(r"(?i)</div\s*>(?<!(?-i:</div>))")
    pieces = F.split(F.when(other, sub(section, r"(?i)</div\s*>", closer)).otherwise(section), r"(?i)<div(?=[\s>])")

    def start(over: Column) -> Column:
        return F.struct(
            F.lit(0).alias("depth"),
            over.alias("over"),
            F.lit("").alias("open"),
            F.array().cast("array<string>").alias("done"),
        ).cast(state)

    def step(acc: Column, piece: Column) -> Column:
        depth = acc["depth"] + 1 - F.regexp_count(piece, F.lit(closer))
        return F.when(acc["over"], acc).otherwise(let(depth, lambda d: moved_on(acc, piece, d)))

    def moved_on(acc: Column, piece: Column, depth: Column) -> Column:
        # text of the div up to the closing tag that ends it
        ends = depth <= 0
        upto = F.call_function("substring_index", piece, F.lit(closer), acc["depth"] + 1)
        taken = F.concat(acc["open"], F.lit("<div"), F.when(ends, upto).otherwise(piece))
        return F.struct(
            F.greatest(depth, F.lit(0)).alias("depth"),
            (depth < 0).alias("over"),
            F.when(ends, F.lit("")).otherwise(taken).alias("open"),
            F.when(ends, F.concat(acc["done"], F.array(taken))).otherwise(acc["done"]).alias("done"),
        ).cast(state)

    def finish(acc: Column) -> Column:
        unclosed = (acc["open"] != "") & ~acc["over"]
        return F.when(unclosed, F.concat(acc["done"], F.array(acc["open"]))).otherwise(acc["done"])

    def walk(cut: Column) -> Column:
        lead, divs = F.element_at(cut, 1), F.slice(cut, F.lit(2), F.size(cut))
        return F.aggregate(divs, start(lead.contains(closer)), step, finish)

    return let(pieces, walk)


def reading_time(div: Column) -> Column:
    """Minutes named in the first text run that speaks of a reading time, or 0."""
    run = F.regexp_extract(div, rf"(?s)(?:\A|>)([^<>]*{READING_TIME}[^<]*)", 1)
    first = F.regexp_extract(run, r"\A\s*(\S+)", 1).try_cast("int")
    before = F.regexp_extract(run, rf"(\d+)\s+{READING_TIME}", 1).try_cast("int")
    return F.coalesce(first, before, F.lit(0))


def summary(div: Column) -> Column:
    """Text after the reading time, up to the third line break that follows it."""
    tail = F.regexp_extract(div, rf"(?s){READING_TIME}[^<]*(?:</[a-zA-Z][^>]*>)*(.*)\z", 1)
    breaks = F.slice(F.split(tail, r"(?i)<br(?:[\s/][^>]*)?>"), 1, 3)

    def piece(text: Column) -> Column:
        units = find_all(
            text, r"(?is)<([a-z][a-z0-9]*)(?:\s[^>]*)?>.*?</\1\s*>|</?[a-z][^>]*>|[^<]+|<"
        )

        def shown(unit: Column) -> Column:
            element = unit.startswith("<")

            def told(inner: Column) -> Column:
                sharing = element & contains_any(F.lower(inner), SHARING_WORDS)
                return F.when(sharing | inner.contains(READING_TIME), "").otherwise(inner)

            return let(visible_text(unit), told)

        return F.array_join(F.filter(F.transform(units, shown), lambda t: t != ""), " ")

    return F.array_join(F.filter(F.transform(breaks, piece), lambda t: t != ""), " ")


def extract_articles(
    issues: DataFrame, html: str = "html", issue_num: str = "num", item_of: str = "item_of"
) -> DataFrame:
    """One row per titled article of an issue page, in page order.

    The total counts every div under a topic heading; the position counts only
    the divs that name an article.
    """
    title_tag = _with_class("a", "post-title")
    sections = _after_each(without_unseen(F.col(html)), _with_class("h3", "topic-title"))
    divs = F.flatten(F.transform(sections, _sibling_divs))

    def article(div: Column) -> Column:
        opening = F.regexp_extract(div, rf"(?is){title_tag}", 0)
        return F.struct(
            decode_entities(attribute(opening, "href")).alias("url"),
            visible_text(F.regexp_extract(div, rf"(?is){title_tag}(.*?)</a\s*>", 1)).alias("title"),
            reading_time(div).alias("reading_time"),
            summary(div).alias("summary"),
        )

    keep = [c for c in issues.columns if c not in (html, issue_num, item_of)]
    carried = [
        *keep,
        F.col(issue_num).cast("int").alias("issue_num"),
        F.col(item_of).alias("parent_item_of"),
    ]
    names = [*keep, "issue_num", "parent_item_of"]
    found = issues.select(*carried, divs.alias("_divs"))
    titled = F.filter("_divs", lambda d: d.contains("post-title") & d.rlike(rf"(?is){title_tag}"))
    return (
        explode_positions(
            found.select(*names, F.size("_divs").alias("_total"), titled.alias("_titled")),
            [*names, "_total"],
            F.col("_titled"),
            "_pos",
            "_div",
        )
        .select(*names, "_total", "_pos", article(F.col("_div")).alias("_article"))
        .select(
            *keep,
            F.col("_article.title").alias("title"),
            F.col("_article.url").alias("url"),
            "issue_num",
            F.col("_article.reading_time").alias("reading_time"),
            F.col("_article.summary").alias("summary"),
            F.struct(F.col("_pos").alias("current"), F.col("_total").alias("total"))
            .cast(POSITION)
            .alias("item_of"),
            "parent_item_of",
        )
    )
