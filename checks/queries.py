"""Queries over the given tables, one per operator or group of operators.

Where the tables lack what an operator works on (issue pages, response bytes,
exit commands), the input is derived from them by Spark, over all their rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions import bodies as body_functions
from pressmill.functions import quality, urls
from pressmill.functions.html import html_to_markdown
from pressmill.functions.markdown import is_navigation, is_noise_line
from pressmill.functions.text import explode_positions
from pressmill.operators import (
    chunking,
    extraction,
    incremental,
    markdown,
    nearest,
    politeness,
    reports,
    retrieval,
    routing,
    transcripts,
    vectors,
)
from pressmill.plans import ask, corpus, index
from pressmill.schemas import PAGE
from pressmill.session import shared_dir
from pressmill.sources import files, tables, writers
from pressmill.streaming import jobs

SKIPPED = ["example.net"]
SCRIPTED = ["example.org"]
LONG_TEXTS = ["pages", "documents"]
SLOT_PERIOD = 1_200_000_000

# What some documents get appended, so that every indicator occurs.
SNIPPETS = [
    " Please enable\tyour JavaScript now",
    " Access denied",
    " <article>",
    " <div id=\"root\">",
    " Loading the app",
    "<html><body><p>One plain paragraph</p><p>and two</p>",
    " Checking your browser",
    " window.__STATE__ = 1",
    " <main><h2>Head</h2></main>",
    "\n\nenable\njavascript",
    "<html><body><section>",
    " Paywall <p class=\"story-content\">",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return tables.read_pages(spark, path) if name in LONG_TEXTS else spark.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one."""
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def files_each(spark: SparkSession, sf_dir: str, parts: int) -> int:
    """Into how many files each of the ``parts`` of the documents should go, for no task to write more than a scan's split or two."""
    return -(-spark.read.parquet(f"{sf_dir}/documents.parquet").rdd.getNumPartitions() // parts)


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents as one table of bodies with urls."""
    pages = table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), "url", F.col("html")
    )
    snippet = F.element_at(
        F.array(*[F.lit(s) for s in SNIPPETS]), (F.col("doc_id") % len(SNIPPETS) + 1).cast("int")
    )
    documents = table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"),
        F.col("doc_id").alias("id"),
        F.concat(F.lit("https://"), "source", F.lit(".example.com/d/"), F.col("doc_id").cast("string")).alias("url"),
        F.concat("text", snippet).alias("html"),
    )
    return pages.unionByName(documents)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies with a status and headers that follow from their id."""
    status = (
        F.when(F.col("id") % 11 == 3, 403)
        .when(F.col("id") % 11 == 5, 503)
        .when(F.col("id") % 11 == 7, 429)
        .when(F.col("id") % 11 != 0, 200)
    )
    headers = (
        F.when(F.col("id") % 13 == 4, F.create_map(F.lit("Server"), F.lit("nginx")))
        .when(F.col("id") % 13 == 5, F.create_map(F.lit("CF-Ray"), F.lit("7")))
        .when(F.col("id") % 13 != 6, F.create_map(F.lit("content-type"), F.lit("text/html")))
    )
    return bodies(spark, sf_dir).withColumns({"status": status, "headers": headers})


def url_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", urls.registered_domain(F.col("url")).alias("domain"))
        .withColumns(
            {
                "is_skipped": urls.is_skipped_domain(F.col("domain"), SKIPPED),
                "is_scripted": urls.is_scripted_domain(F.col("domain"), SCRIPTED),
            }
        )
    )


def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.with_quality(bodies(spark, sf_dir)).drop("url", "html")


def page_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.col("lower")
    none = F.lit(None)
    return (
        bodies(spark, sf_dir)
        .withColumn("lower", F.lower("html"))
        .select(
            "kind",
            "id",
            quality.has_meaningful_content(lower).alias("is_meaningful"),
            quality.is_protected(lower, none.cast("int"), none.cast("map<string,string>")).alias(
                "is_protected"
            ),
            quality.has_loaded_content(F.col("html")).alias("is_loaded"),
        )
    )


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.route(
        responses(spark, sf_dir), status="status", headers="headers", skipped=SKIPPED,
        scripted=SCRIPTED,
    )


def page_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).select(
        "kind", "id", "domain", "route", F.length("content").alias("content_length")
    )


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    complete, waiting = routing.split_routes(routed(spark, sf_dir))
    return (
        complete.unionByName(waiting)
        .groupBy("domain", "route")
        .agg(F.count("*").alias("n"))
    )


def merged_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second fetch knows the documents."""
    known = bodies(spark, sf_dir).filter(F.col("kind") == "document")
    rendered = known.select("url", F.concat(F.lit("<html>rendered "), F.col("url")).alias("html"))
    return routing.merge_routes(routed(spark, sf_dir), rendered).select(
        "kind", "id", "route", F.md5("content").alias("content_md5")
    )


def response_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as bytes under six charsets and states, then read back."""
    case = F.col("page_id") % 6
    plain = F.regexp_replace("html", r"[^\x00-\x7f]", "?")
    utf8 = F.col("html").cast("binary")

    def joined(*parts: Column) -> Column:
        return F.concat(*[p.cast("binary") for p in parts])

    body = (
        F.when(case == 0, utf8)
        .when(case == 1, joined(utf8, F.lit(b"\xff")))
        .when(case == 2, joined(plain, F.lit(b"\x80")))
        .when(case == 3, F.encode("html", "UTF-16BE"))
        .when(case == 4, joined(plain, F.lit(b"\xe9")))
        .otherwise(joined(F.lit(b"\x1f\x8b"), utf8))
    )
    declared = F.element_at(
        F.array(
            *[
                F.lit(v)
                for v in (
                    "text/html; charset=utf-8",
                    None,
                    "Text/HTML;charset=\"Windows-1252\"",
                    "application/xhtml+xml ; charset=UTF-16BE",
                    "text/plain; charset=latin1",
                    "text/html; charset=ISO-8859-1",
                )
            ]
        ),
        (case + 1).cast("int"),
    )
    headers = F.when(declared.isNotNull(), F.create_map(F.lit("Content-Type"), declared))
    landed = table(spark, sf_dir, "pages").select(
        "page_id", body.alias("body"), headers.alias("headers")
    )
    charset = body_functions.declared_charset(F.col("headers"))
    return landed.select(
        "page_id",
        charset.alias("charset"),
        body_functions.compression(F.col("body")).alias("compression"),
        body_functions.content_type(F.col("headers"), F.col("body")).alias("content_type"),
        F.md5(body_functions.decode_body(F.col("body"), charset)).alias("text_md5"),
    )


def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.with_markdown(table(spark, sf_dir, "pages"), "html").select(
        "page_id", "markdown"
    )


def noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with headings, links, bylines and blank lines put in."""
    text = F.col("text")
    for old, new in NOTES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("noted"))


NOTES = [
    (". The ", ".\n# The "),
    (". En ", ".\n\n\n- [En](/x)\n"),
    (". A ", ".\nBy A "),
    (", la ", ",\n[la]( )\n"),
    (". Is ", ".\n5 min read Is\n   \n"),
    (", und ", ", und \t\n#\n---\n"),
    (". Of ", ".\nMenu Of\n"),
    (". La ", ".\nShare La\n\n"),
    (". In ", ".\nhttps://www.netflix.com/in\n"),
    (". Die ", ".\nsearch die\n"),
]


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.with_clean_markdown(noted(spark, sf_dir), "noted").select("doc_id", "markdown")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    exploded = markdown.explode_lines(noted(spark, sf_dir), "noted")
    return exploded.select(
        "doc_id",
        "line_no",
        F.md5("line").alias("line_md5"),
        is_noise_line(F.col("line")).alias("is_noise"),
        is_navigation(F.col("line")).alias("is_navigation"),
    )


def page_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return markdown.explode_paragraphs(pages, "html")


def index_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index pages of fifty orders each: an order is an issue."""
    day = F.dayofmonth("o_orderdate")
    suffix = (
        F.when(day.isin(1, 21, 31), "st").when(day.isin(2, 22), "nd").when(day.isin(3, 23), "rd")
        .otherwise("th")
    )
    date = F.concat(day.cast("string"), suffix, F.date_format("o_orderdate", " MMMM yyyy"))
    key = F.col("o_orderkey")
    block = F.concat(
        F.lit('\n<div data-v="1" class="row table-issue"><p class="title-table-issue"><a class="t" href="'),
        F.when(key % 3 == 0, "/issues/").when(key % 3 == 1, "issues/").otherwise("http://other.example.org/i/"),
        key.cast("string"),
        F.lit('">Issue</a></p>\n<p class="text-table-issue"> '),
        date,
        F.lit(" </p></div>"),
    )
    return (
        table(spark, sf_dir, "orders")
        .select(F.floor(key / 50).alias("page_no"), F.struct(key.alias("k"), block.alias("b")).alias("b"))
        .groupBy("page_no")
        .agg(F.array_sort(F.collect_list("b")).alias("b"))
        .select(
            "page_no",
            F.lit("https://news.example.com/issues/").alias("url"),
            F.concat(F.lit("<html><body>"), F.array_join(F.transform("b", lambda x: x["b"]), ""), F.lit("</body>")).alias("html"),
        )
    )


def _flat_issues(issues: DataFrame) -> DataFrame:
    return issues.select(
        "page_no", "num", "url", "date", F.col("item_of.current").alias("current"),
        F.col("item_of.total").alias("total"),
    )


def issue_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_issues(extraction.list_issues(index_pages(spark, sf_dir)))


def issue_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat_issues(corpus.new_issues(index_pages(spark, sf_dir), limit=20))


def issue_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue pages of sixteen documents each, a topic per language."""
    minutes = F.floor(F.col("n_chars") / 1000)
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    key = F.col("doc_id").cast("string")
    title = F.when(
        F.col("source") != "src4",
        F.concat(
            F.lit('<a title="t" href="https://'), "source", F.lit(".example.com/d/"), key,
            F.lit('?a=1&amp;b=2" class="post-title" data-v> Document &amp; '), key, F.lit(" </a>"),
        ),
    ).otherwise("<i>no link</i>")
    told = F.when(
        minutes > 0,
        F.concat(
            F.lit(" <br>"), minutes.cast("string"), F.lit(" minutes read.<br><br>\n  "), escaped,
            F.lit('\n <br><br><b>Read</b> it later via <a href="p">Pocket</a>.<br><b> Share</b>'),
        ),
    ).otherwise("")
    div = F.concat(F.lit("<div data-v><span></span>"), title, told, F.lit("<div>inner</div></div>\n"))
    entry = F.struct(F.col("lang"), F.col("doc_id"), div.alias("div"))
    pages = (
        table(spark, sf_dir, "documents")
        .select(F.floor(F.col("doc_id") / 16).alias("issue"), entry.alias("e"))
        .groupBy("issue")
        .agg(F.array_sort(F.collect_list("e")).alias("e"))
    )
    heading = F.transform(
        "e",
        lambda x, i: F.concat(
            F.when(
                (i == 0) | (x["lang"] != F.coalesce(F.try_element_at("e", i)["lang"], F.lit(""))),
                F.concat(
                    F.when(i == 0, "").otherwise("</div></div>"),
                    F.lit('<div class="row"><div><h3 data-v class="topic-title">'), x["lang"],
                    F.lit("</h3> <hr> "),
                ),
            ).otherwise(""),
            x["div"],
        ),
    )
    return pages.select(
        F.col("issue").cast("int").alias("num"),
        F.struct(F.col("issue").cast("int").alias("current"), F.lit(9).alias("total")).alias("item_of"),
        F.concat(F.lit("<html><body><div>top</div>"), F.array_join(heading, ""), F.lit("</div></div></body></html>")).alias("html"),
    )


def issue_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract_articles(issue_pages(spark, sf_dir)).select(
        "issue_num", "title", "url", "reading_time", F.md5("summary").alias("summary_md5"),
        F.col("item_of.current").alias("current"), F.col("item_of.total").alias("total"),
        F.col("parent_item_of.current").alias("issue_current"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles out of documents: first line as title, the next as summary."""
    row = F.split("text", "\n")
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.element_at(row, 1).alias("title"),
        F.concat(F.lit("http://a.example.com/"), key, F.when(F.col("doc_id") % 5 == 0, "_(q)").otherwise("")).alias("url"),
        F.floor(F.col("doc_id") / 25).cast("int").alias("issue_num"),
        F.floor(F.col("n_chars") / 1000).cast("int").alias("reading_time"),
        F.coalesce(F.try_element_at(row, F.lit(2)), F.lit("")).alias("summary"),
        F.col("text").alias("markdown"),
        F.struct((F.col("doc_id") % 25).cast("int").alias("current"), F.lit(25).alias("total")).alias("item_of"),
    )


def _parsed(files: DataFrame) -> DataFrame:
    return tables.load_documents(files).select(
        "path", "title", "source_url", "reading_time", "summary", F.md5("text").alias("text_md5")
    )


def article_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(markdown.with_article_text(articles(spark, sf_dir)).select("path", "text"))


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "articles")
    made = articles(spark, sf_dir).drop("doc_id")
    writers.save_articles(made, out)
    writers.save_articles(made, out)
    return _parsed(tables.read_article_table(spark, out))


def named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.format_string("d%08d", "doc_id").alias("path"), "text"
    )


def chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_documents(named_documents(spark, sf_dir), fixed=True)


def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_documents(named_documents(spark, sf_dir))


def _documents_as_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("num"), "source")


def _labels_as_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("issue_num"))


def new_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.skip_existing_issues(
        _documents_as_issues(spark, sf_dir), _labels_as_stored(spark, sf_dir)
    )


def forced_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.skip_existing_issues(
        _documents_as_issues(spark, sf_dir), _labels_as_stored(spark, sf_dir), force_all=True
    )


def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks twice in the batch, against the first chunks of labelled documents."""
    chunks = chunk_windows(spark, sf_dir).select("path", "chunk_no")
    stored = table(spark, sf_dir, "labels").select(
        F.format_string("d%08d", "doc_id").alias("path"), F.lit(0).alias("chunk_no")
    )
    return incremental.skip_stored_chunks(chunks.unionByName(chunks), stored)


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = vectors.embed(named_documents(spark, sf_dir))
    return (
        explode_positions(made, ["path"], F.col("embedding"), "bucket", "w")
        .filter(F.col("w") != 0)
        .select("path", "bucket", F.round(F.col("w").cast("double"), 6).alias("weight"))
    )


def _neighbours(spark: SparkSession, sf_dir: str, search: Callable[..., DataFrame], **how) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = stored.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return search(asked, stored, **how).select(
        "query_id", "rank", "vec_id", F.round("distance", 6).alias("distance")
    )


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, nearest.nearest)


def nearest_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, nearest.nearest_by_cells, pivots=32)


def nearest_approximate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _neighbours(spark, sf_dir, nearest.nearest_by_cells, pivots=32, probes=8)


def nearest_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides hold vectors with NaN, with NULL and cut short, which have and are no neighbours."""
    embedding = F.col("embedding")
    bad = (
        F.when(F.col("vec_id") % 10 == 3, F.transform(embedding, lambda x, n: F.when(n == 5, float("nan")).otherwise(x)))
        .when(F.col("vec_id") % 10 == 5, F.transform(embedding, lambda x, n: F.when(n != 0, x)))
        .when(F.col("vec_id") % 10 == 7, F.slice(embedding, 1, 40))
        .when(F.col("vec_id") % 10 != 9, embedding)
    )
    stored = table(spark, sf_dir, "embeddings").select("vec_id", bad.cast("array<float>").alias("embedding"))
    asked = stored.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return nearest.nearest(asked, stored).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def dirty_page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages around the words of every document, with nested, open and self-closed elements to drop."""
    words = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    number = F.col("doc_id").cast("string")
    html = F.concat(
        F.lit("<div class=sidebar><div>in</div><p>leak</p></div><p>Zq "), words,
        F.lit("</p><iframe src='x'/><nav>a<nav>b</nav>c</nav><p>see <a href='http://h.net/"), number,
        F.lit("'>link "), number, F.lit("</a> and <img alt='pic' src='"), number,
        F.lit(".png'></p><ul><li>one "), number, F.lit("</li><li class=\"x nav\">gone<li>two</ul><table><tr><th>A</th><th>B</th></tr><tr><td>"), number,
        F.lit("</td><td>x &#0000043; &lsqb;</td></tr></table><ol><li>one "), number, F.lit("<ol start=4><li>four<li>five "), number,
        F.lit("</ol></li><li>two</li></ol><blockquote>out "), number, F.lit("<blockquote>in</blockquote>out again</blockquote><p><b>x<b>"), number,
        F.lit("</b>z</b> a\ue000b\ue00ac</p><table><tr><th>T</th></tr><tr><td>"), number,
        F.lit("<table><tr><td>deep</td></tr></table></td></tr></table><h2 class='ads'>Ad</h2><footer>open "), words,
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(html_to_markdown(html)).alias("markdown_md5"))


def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as files of issue folders, then listed and read."""
    issue = (F.col("doc_id") / 16).cast("int")
    paths = F.concat(F.lit("issue-"), issue.cast("string"), F.lit("/article-"), F.col("doc_id").cast("string"), F.lit(".md"))
    folder = scratch(spark, "article-files")
    files.write_article_files(table(spark, sf_dir, "documents").select(paths.alias("path"), "text"), folder)
    return tables.load_documents(tables.list_article_files(spark, folder)).select("path", F.md5("text").alias("text_md5"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def _prompts(asked: DataFrame) -> DataFrame:
    return asked.select(
        "query_id", F.md5("context").alias("context_md5"), F.md5("user_prompt").alias("prompt_md5"),
        F.length("system_prompt").alias("system_length"),
    )


def question_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = index.index_documents(named_documents(spark, sf_dir))
    return _prompts(ask.ask(questions(spark, sf_dir), made))


def run_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        reports.count_by(chunk_sections(spark, sf_dir), "chunks", "path")
        .unionByName(reports.count_by(nearest_vectors(spark, sf_dir), "hits", "query_id"))
        .unionByName(reports.count_by(issue_articles(spark, sf_dir), "articles", "issue_num"))
    )


def chat_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.question_answers(table(spark, sf_dir, "conversations"))


def chat_answers_small_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with blocks of two turns, so that answers cross them."""
    return transcripts.question_answers(table(spark, sf_dir, "conversations"), block_size=2)


def chat_until_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = ((F.col("conv_id") * 7 + F.col("turn")) % 5 == 2) & (F.col("role") == "user")
    talks = table(spark, sf_dir, "conversations").withColumn(
        "text", F.when(leaves, "  /BYE\n").otherwise(F.col("text"))
    )
    return transcripts.until_exit(talks).select("conv_id", "turn", "role")


def wall_micros(time: Column) -> Column:
    """Microseconds of a time without zone, whatever zone the session has."""
    return F.unix_micros(F.from_utc_timestamp(time.cast("timestamp"), F.current_timezone()))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("domain"),
        wall_micros(F.col("ts")).alias("at_micros"),
        F.col("event_id").alias("request_id"),
    )


def polite_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return politeness.schedule(requests(spark, sf_dir), period=SLOT_PERIOD)


def stream_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "stream-markdown")
    pages = jobs.read_table_stream(spark, f"{sf_dir}/pages.parquet", PAGE)
    jobs.stream_markdown(pages, f"{out}/rows", f"{out}/log").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select(
        "page_id", "route", F.md5("markdown").alias("markdown_md5")
    )


def batch_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing and Markdown of landed pages in one go."""
    made = markdown.with_markdown(routing.route(table(spark, sf_dir, "pages")))
    return made.select("page_id", "route", F.md5("markdown").alias("markdown_md5"))


def _streamed_index(spark: SparkSession, sf_dir: str, out: str) -> str:
    schema = table(spark, sf_dir, "documents").schema
    for log in ("log", "again"):
        # a second run from the start must add nothing
        documents = jobs.read_table_stream(spark, f"{sf_dir}/documents.parquet", schema).select(
            F.format_string("d%08d", "doc_id").alias("path"), "text"
        )
        jobs.stream_index(documents, f"{out}/table", f"{out}/{log}").awaitTermination()
    return f"{out}/table"


def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = _streamed_index(spark, sf_dir, scratch(spark, "stream-index"))
    return spark.read.parquet(made).select("path", "chunk_no", "text")


def stream_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "stream-answers")
    made = f"{out}/table"
    writers.append_vectors(index.index_documents(named_documents(spark, sf_dir)), made)
    schema = table(spark, sf_dir, "benchmark").schema
    asked = jobs.read_table_stream(spark, f"{sf_dir}/benchmark.parquet", schema).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )
    for log in ("log", "again"):
        jobs.stream_answers(asked, made, f"{out}/answers", f"{out}/{log}").awaitTermination()
    # a second checkpoint answers all questions again, beside the first answers
    told = F.struct("context", "user_prompt", "system_prompt")
    answers = spark.read.parquet(f"{out}/answers").groupBy("query_id").agg(
        F.countDistinct("run").alias("runs"), F.min_by(told, "run").alias("told")
    )
    return _prompts(answers.filter("runs = 2").select("query_id", "told.*"))


def stream_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "stream-issues")
    issue_pages(spark, sf_dir).write.parquet(f"{out}/landed")
    schema = spark.read.parquet(f"{out}/landed").schema
    for log in ("log", "again"):
        landed = jobs.read_stream(spark, f"{out}/landed", schema)
        jobs.stream_issues(landed, f"{out}/table", f"{out}/{log}").awaitTermination()
    return tables.read_folders(spark, f"{out}/table").select("issue_num", "path", "title", "url")


def stream_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "stream-schedule")
    events = jobs.read_table_stream(spark, f"{sf_dir}/events.parquet", table(spark, sf_dir, "events").schema)
    asked = events.select(
        F.col("event_type").alias("domain"),
        wall_micros(F.col("ts")).alias("at_micros"),
        F.col("event_id").alias("request_id"),
    )
    jobs.stream_schedule(
        asked, f"{out}/slots", f"{out}/state", f"{out}/log", SLOT_PERIOD
    ).awaitTermination()
    return spark.read.parquet(f"{out}/slots").select("domain", "at_micros", "request_id", "slot")


def corpus_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir)


def corpus_repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every index page, and every page, has landed twice."""
    return _corpus(spark, sf_dir, times=2)


def _corpus(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    tables = _corpus_tables(spark, sf_dir)
    built = corpus.build_corpus(*[reduce(DataFrame.unionByName, [df] * times) for df in tables])
    return built.select(
        "issue_num", "url", "route", F.col("item_of.current").alias("current"),
        F.md5("markdown").alias("markdown_md5"),
    )


def stream_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same articles from a stream of issue pages, as they are stored, by two checkpoints."""
    out = scratch(spark, "stream-corpus")
    for name, df in zip(("landed", "rendered"), _corpus_tables(spark, sf_dir)[1:], strict=True):
        df.write.option("compression", "zstd").parquet(f"{out}/{name}")
    issue_pages(spark, sf_dir).write.option("compression", "zstd").parquet(f"{out}/issues")
    schema = spark.read.parquet(f"{out}/issues").schema
    for log in ("log", "again"):
        issues = jobs.read_stream(spark, f"{out}/issues", schema)
        at = [f"{out}/{name}" for name in ("landed", "rendered", "table", "state", log)]
        jobs.stream_corpus(issues, *at).awaitTermination()
    return tables.read_folders(spark, f"{out}/table").select(
        "issue_num", "path", "url", F.md5(F.expr("substring(text, locate('\n\n---\n\n', text) + 7)")).alias("markdown_md5")
    )


def _corpus_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Index pages to article Markdown: issues of documents, articles of pages.

    The landed table holds the issue pages and, for every document that is
    linked to, a page around its text; all but the English ones ask for a
    second fetch.
    """
    issues = issue_pages(spark, sf_dir)
    listed = issues.select(
        F.floor(F.col("num") / 50).alias("page_no"),
        F.struct(
            F.col("num").alias("k"),
            F.concat(
                F.lit('<div class="table-issue"><p class="title-table-issue"><a href="/issues/'),
                F.col("num").cast("string"),
                F.lit('">x</a></p><p class="text-table-issue">1st May 2024</p></div>'),
            ).alias("b"),
        ).alias("b"),
    ).groupBy("page_no").agg(F.array_sort(F.collect_list("b")).alias("b")).select(
        F.lit("https://news.example.com/issues/").alias("url"),
        F.array_join(F.transform("b", lambda x: x["b"]), "").alias("html"),
    )
    article_url = F.concat(
        F.lit("https://"), "source", F.lit(".example.com/d/"), F.col("doc_id").cast("string"), F.lit("?a=1&b=2")
    )
    # each line a paragraph, with what Markdown and HTML reserve taken out
    safe = F.regexp_replace("text", r"[&<>*_#\[\]\\]", " ")
    shell = F.concat(
        F.lit("<html><body><article><h2>Document</h2><p>"),
        F.regexp_replace(safe, r"\n", "</p><p>"),
        F.lit("</p></article></body></html>"),
    )
    documents = table(spark, sf_dir, "documents").select("lang", article_url.alias("url"), shell.alias("html"))
    landed_articles = documents.select(
        "url", F.when(F.col("lang") == "en", F.col("html")).otherwise("<noscript>").alias("html")
    )
    landed_issues = issues.select(
        F.concat(F.lit("https://news.example.com/issues/"), F.col("num").cast("string")).alias("url"), "html"
    )
    rendered = documents.filter(F.col("lang") != "en").select("url", "html")
    landed = landed_articles.unionByName(landed_issues)
    return listed, landed, rendered


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        url_domains,
        page_quality,
        page_checks,
        page_routes,
        route_counts,
        merged_pages,
        response_bodies,
        page_markdown,
        clean_documents,
        document_lines,
        page_paragraphs,
        issue_index,
        issue_index_first,
        issue_articles,
        article_headers,
        stored_articles,
        chunk_windows,
        chunk_sections,
        new_issues,
        forced_issues,
        new_chunks,
        document_vectors,
        nearest_vectors,
        nearest_by_cells,
        nearest_approximate,
        nearest_dirty,
        dirty_page_markdown,
        article_files,
        question_prompts,
        run_counts,
        chat_answers,
        chat_answers_small_blocks,
        chat_until_exit,
        polite_schedule,
        corpus_articles,
        corpus_repeated,
        batch_markdown,
        stream_markdown,
        stream_index,
        stream_answers,
        stream_issues,
        stream_corpus,
        stream_schedule,
    ]
    return {q.__name__: q for q in named}
