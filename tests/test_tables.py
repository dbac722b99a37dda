"""Files, tables, whole plans and streams."""

import datetime

from pyspark.sql import functions as F

from pressmill.operators.chunking import split_documents
from pressmill.operators.nearest import nearest
from pressmill.operators.routing import route, with_quality
from pressmill.plans import ask, corpus, index
from pressmill.schemas import PAGE
from pressmill.sources import tables, writers
from pressmill.streaming import jobs

ARTICLE = "title string, url string, issue_num int, reading_time int, summary string, markdown string, item_of struct<current:int,total:int>"


def test_list_article_files(spark, tmp_path):
    for folder in ("issue-1", "issue-2", "other"):
        (tmp_path / folder).mkdir()
        for name in ("article-0.md", "article-1.md", "notes.txt"):
            (tmp_path / folder / name).write_text(
                f"# {folder}\r\n\nSource: [u](u)\nReading time: 3 minutes\n\nShort\n\n---\n\nBody\nmore"
            )
    rows = tables.load_documents(tables.list_article_files(spark, str(tmp_path))).collect()
    assert sorted(r.path for r in rows) == [
        f"issue-{i}/article-{k}.md" for i in (1, 2) for k in (0, 1)
    ]
    assert {(r.source_url, r.reading_time, r.summary) for r in rows} == {("u", "3 minutes", "Short")}
    assert all(r.title in ("issue-1", "issue-2") and r.text.endswith("Body\nmore") for r in rows)


def test_save_articles_replaces_touched_issues(spark, tmp_path):
    out = str(tmp_path / "articles")

    def save(*rows):
        writers.save_articles(spark.createDataFrame(list(rows), ARTICLE), out)

    save(("A", "u", 1, 3, "s", "old", (6, 8)), ("B", "u", 2, 0, None, None, (0, 1)))
    save(("A", "u", 1, 3, "s", "new", (6, 8)))
    rows = {r.path: r.text for r in tables.read_article_table(spark, out).collect()}
    assert sorted(rows) == ["issue-1/article-6.md", "issue-2/article-0.md"]
    assert rows["issue-1/article-6.md"] == (
        "# A\n\nSource: [u](u)\nReading time: 3 minutes\n\ns\n\n---\n\nnew"
    )
    assert rows["issue-2/article-0.md"].endswith("minutes\n\n\n\n---\n\n")


def documents(spark, *texts):
    return spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, text string")


def test_append_is_idempotent(spark, tmp_path):
    table = str(tmp_path / "vectors")
    assert tables.read_table(spark, table) is None
    made = index.index_documents(documents(spark, "one two", "three " * 900))
    writers.append_vectors(made, table)
    n = spark.read.parquet(table).count()
    writers.append_vectors(made, table)
    index.append_documents(documents(spark, "one two", "three " * 900, "four"), table)
    assert spark.read.parquet(table).count() == n + 1


def test_ask(spark):
    made = index.index_documents(documents(spark, "red apples grow", "blue boats sail", "dogs bark"))
    asked = spark.createDataFrame([(1, "apples red")], "query_id int, query string")
    row = ask.ask(asked, made, k=1).first()
    assert row.context == "red apples grow" and "Question: apples red" in row.user_prompt


def test_build_corpus(spark):
    listing = spark.createDataFrame(
        [("https://n.org/issues/", "".join(
            f'<div class="table-issue"><p class="title-table-issue"><a href="/issues/{i}">x</a></p>'
            f'<p class="text-table-issue">{i}th May 2024</p></div>' for i in (4, 5, 6)
        ))], "url string, html string",
    )
    def issue(i):
        return f'<h3 class="topic-title">T</h3><div><a class="post-title" href="http://a.org/{i}">A{i}</a></div>'

    body = "<html><body><article>" + "<p>Some words to read.</p>" * 12 + "</article></body></html>"
    landed = spark.createDataFrame(
        [(f"https://n.org/issues/{i}", issue(i)) for i in (4, 5, 6)]
        + [("http://a.org/4", body), ("http://a.org/5", "<noscript>")],
        "url string, html string",
    )
    rendered = spark.createDataFrame([("http://a.org/5", "<p>Second look</p>")], "url string, html string")
    stored = spark.createDataFrame([(6,)], "issue_num int")
    rows = {r.issue_num: r for r in corpus.build_corpus(listing, landed, rendered, stored).collect()}
    assert sorted(rows) == [4, 5]
    assert rows[4].markdown.startswith("Some words to read.\n\nSome") and rows[4].route == "complete"
    assert rows[5].markdown == "Second look" and rows[5].route == "needs_javascript"
    forced = corpus.build_corpus(listing, landed, rendered, stored, force_all=True)
    assert {r.issue_num: r.markdown for r in forced.collect()}[6] == ""
    assert corpus.new_issues(listing, limit=1).first().date == datetime.date(2024, 5, 4)


def test_stream_markdown_equals_batch(spark, tmp_path):
    pages = spark.createDataFrame(
        [(i, f"http://p.org/{i}", f"<html><body><div>{'<p>w x y z</p>' * 20}<h1>{i}</h1></div>") for i in range(6)],
        PAGE,
    )
    pages.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), PAGE)
    jobs.stream_markdown(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    from pressmill.operators.markdown import with_markdown

    want = with_markdown(route(pages)).select("page_id", "route", "markdown")
    got = spark.read.parquet(str(tmp_path / "out")).select("page_id", "route", "markdown")
    assert sorted(got.collect()) == sorted(want.collect())


def test_stream_index_adds_each_document_once(spark, tmp_path):
    source, table, log = (str(tmp_path / n) for n in ("in", "table", "log"))

    def run(checkpoint=log):
        stream = jobs.read_stream(spark, source, documents(spark, "x").schema)
        jobs.stream_index(stream, table, checkpoint).awaitTermination()
        return spark.read.parquet(table).count()

    documents(spark, "one", "two").write.parquet(source)
    assert run() == 2 and run() == 2
    documents(spark, "one", "two", "three").write.mode("append").parquet(source)
    assert run() == 3
    # a lost checkpoint reads everything again and still adds nothing
    assert run(str(tmp_path / "log2")) == 3


def test_stream_answers(spark, tmp_path):
    table, out = str(tmp_path / "table"), str(tmp_path / "out")
    index.append_documents(documents(spark, "red apples", "blue boats"), table)
    asked = spark.createDataFrame([(1, "apples"), (2, "boats")], "query_id int, query string")
    asked.write.parquet(str(tmp_path / "in"))
    stream = jobs.read_stream(spark, str(tmp_path / "in"), asked.schema)
    jobs.stream_answers(stream, table, out, str(tmp_path / "log"), k=1).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.query_id, r.context) for r in rows) == [(1, "red apples"), (2, "blue boats")]


def test_stream_issues_skips_what_is_stored(spark, tmp_path):
    schema = "num int, item_of struct<current:int,total:int>, html string"
    page = '<h3 class="topic-title">T</h3><div><a class="post-title" href="u">{}</a></div>'

    def land(num, title):
        rows = [(num, (0, 1), page.format(title))]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        landed = spark.read.parquet(str(tmp_path / "in")).schema
        stream = jobs.read_stream(spark, str(tmp_path / "in"), landed)
        jobs.stream_issues(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
        stored = spark.read.parquet(str(tmp_path / "out"))
        return sorted((r.issue_num, r.title) for r in stored.collect())

    assert land(1, "first") == [(1, "first")]
    assert land(1, "again") == [(1, "first")]
    assert land(2, "other") == [(1, "first"), (2, "other")]


def test_stream_corpus_stores_texts_and_waits_for_pages(spark, tmp_path):
    schema = "num int, item_of struct<current:int,total:int>, html string"
    page = '<h3 class="topic-title">T</h3><div><a class="post-title" href="https://a.example.com/{}">t</a></div>'
    body = "<html><body><article><h2>Head</h2><p>" + "Some words of the text. " * 30 + "</p></article></body></html>"
    paths = {name: str(tmp_path / name) for name in ("in", "landed", "rendered", "out", "state", "log")}

    def put(name, rows, kind="url string, html string"):
        spark.createDataFrame(rows, kind).write.mode("append").parquet(paths[name])

    def texts():
        stream = jobs.read_stream(spark, paths["in"], spark.createDataFrame([], schema).schema)
        jobs.stream_corpus(stream, *[paths[n] for n in ("landed", "rendered", "out", "state", "log")]).awaitTermination()
        stored = spark.read.parquet(paths["out"]).collect()
        return {r.issue_num: "Some words of the text." in r.text for r in stored}

    put("in", [(n, (0, 1), page.format(n)) for n in (1, 2, 3)], schema)
    put("landed", [("https://a.example.com/1", body), ("https://a.example.com/3", "<noscript>")])
    assert texts() == {1: True, 2: False, 3: False}
    put("landed", [("https://a.example.com/2", body)])
    assert texts() == {1: True, 2: True, 3: False}
    put("rendered", [("https://a.example.com/3", body)])
    assert texts() == {1: True, 2: True, 3: True}
    done = spark.read.parquet(paths["state"] + "/done")
    assert sorted(r.num for r in done.collect()) == [1, 2, 3]


def test_stream_schedule_keeps_the_last_slot(spark, tmp_path):
    schema = "domain string, at_micros long, request_id long"

    def land(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        jobs.stream_schedule(
            stream, *[str(tmp_path / n) for n in ("out", "state", "log")], 10
        ).awaitTermination()
        return {r.request_id: r.slot for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    assert land(("a", 0, 1), ("a", 1, 2), ("b", 5, 3)) == {1: 0, 2: 10, 3: 5}
    assert land(("c", 1, 6)) == {1: 0, 2: 10, 3: 5, 6: 1}
    assert land(("a", 2, 4), ("b", 50, 5)) == {1: 0, 2: 10, 3: 5, 6: 1, 4: 20, 5: 50}


def test_streams_go_on_under_a_new_checkpoint(spark, tmp_path):
    """Neither slots nor answers of an earlier checkpoint are lost, and empty files stop nothing."""
    schema = "domain string, at_micros long, request_id long"

    def land(log, *rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        jobs.stream_schedule(stream, *[str(tmp_path / n) for n in ("out", "state", log)], 10).awaitTermination()

    def slots():
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        return sorted((r.request_id, r.slot) for r in rows)

    land("one")  # a landed file without rows
    land("one", ("a", 0, 1), ("a", 0, 2))
    land("one")
    land("one", ("a", 0, 3))
    assert slots() == [(1, 0), (2, 10), (3, 20)]
    land("two", ("b", 7, 4))
    # the new checkpoint reads all files again and gives out further slots
    assert slots() == [(1, 0), (1, 30), (2, 10), (2, 40), (3, 20), (3, 50), (4, 7)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_rows_stay_in_the_jvm_without_shuffle(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], PAGE)
    from pressmill.operators.markdown import with_markdown

    for made in (with_quality(pages), with_markdown(route(pages)), split_documents(documents(spark, "x"))):
        text = plan(made)
        assert "Exchange" not in text
    for made in (with_quality(pages), route(pages), split_documents(documents(spark, "x"))):
        assert "Python" not in plan(made).replace("PythonRDD", "")


def test_ranking_trims_before_the_shuffle(spark):
    q = spark.createDataFrame([(1, [0.0])], "query_id long, query_vec array<double>")
    s = spark.createDataFrame([(1, [0.0])], "vec_id long, embedding array<double>")
    text = plan(nearest(q, s))
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_scan_reads_only_what_is_asked(spark, tmp_path):
    spark.range(5).select(
        "id", F.lit("u").alias("url"), F.lit("h").alias("html"), F.lit("x").alias("other")
    ).write.parquet(str(tmp_path / "p"))
    made = with_quality(tables.read_pages(spark, str(tmp_path / "p"))).select("id", "quality_score")
    assert "ReadSchema: struct<id:bigint,html:string>" in plan(made)
