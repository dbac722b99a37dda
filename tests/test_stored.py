"""Loads into stored tables, streams of files, counters of streams."""

import pytest
from pyspark.sql import functions as F

from pressmill.sources import bucketed, files, tables, writers
from pressmill.streaming import jobs
from pressmill.streaming.counters import StreamCounts, counted

ARTICLE = "title string, url string, issue_num int, reading_time int, summary string, markdown string, item_of struct<current:int,total:int>"


def test_merge_replaces_one_article_of_an_issue(spark, tmp_path):
    out = str(tmp_path / "articles")

    def rows(*given):
        return spark.createDataFrame(list(given), ARTICLE)

    def held():
        return sorted((r.path, r.text.rsplit("\n", 1)[-1]) for r in spark.read.parquet(out).collect())

    writers.merge_articles(rows(("A", "u", 1, 3, "s", "a", (0, 3)), ("B", "u", 1, 3, "s", "b", (1, 3)), ("C", "u", 2, 3, "s", "c", (0, 1))), out)
    before = held()
    for _ in range(2):
        writers.merge_articles(rows(("B", "v", 1, 3, "s", "new", (1, 3)), ("D", "u", 1, 3, "s", "d", (2, 3)), ("E", "u", 30, 3, "s", "e", (0, 1))), out)
        assert held() == [
            ("issue-1/article-0.md", "a"), ("issue-1/article-1.md", "new"), ("issue-1/article-2.md", "d"),
            ("issue-2/article-0.md", "c"), ("issue-30/article-0.md", "e"),
        ]
    assert len(before) == 3
    writers.merge_articles(rows(), out)
    assert len(held()) == 5


def test_merge_leaves_other_issues_alone(spark, tmp_path):
    out = tmp_path / "articles"
    rows = spark.createDataFrame([(f"t{n}", "u", n % 3, 1, "s", "x", (n, 9)) for n in range(9)], ARTICLE)
    writers.save_articles(rows, str(out))
    kept = {p: p.stat().st_mtime_ns for p in out.glob("issue_num=[12]/*.parquet")}
    writers.merge_articles(rows.filter("title = 't3'").withColumn("markdown", F.lit("y")), str(out))
    assert {p: p.stat().st_mtime_ns for p in out.glob("issue_num=[12]/*.parquet")} == kept and kept
    assert spark.read.parquet(str(out)).filter("text like '%y'").count() == 1


def test_articles_without_an_issue_stay_one_each(spark, tmp_path):
    out = str(tmp_path / "articles")
    rows = spark.createDataFrame([("N", "u", None, 1, "s", "n", (0, 1)), ("A", "u", 1, 1, "s", "a", (0, 1))], ARTICLE)
    for _ in range(3):
        writers.merge_articles(rows, out)
    assert spark.read.parquet(out).count() == 2


def test_merge_deals_rows_once(spark, tmp_path, monkeypatch):
    """Given and stored rows meet in one exchange, whatever repeats; rows of another writer's table stay as they are."""
    row = "path string, text string, title string, url string, issue_num int, _held boolean"
    rows = spark.createDataFrame(
        [("p", "old", "t", "u", 1, True), ("p", "new", "t", "u", 1, False), ("p", "new", "t", "u", 1, False)]
        + [("q", "held", "t", "u", 1, True)] * 2 + [("q", None, "t", "u", 1, True)]
        + [(None, "x", None, "u", None, True)] * 2 + [(None, "y", None, "u", None, True)],
        row,
    )
    made = writers._merged(rows)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 1
    assert sorted(map(str, made.select("path", "text").toLocalIterator())) == sorted(
        str(r) for r in spark.createDataFrame([("p", "new"), ("q", "held"), ("q", None), (None, "x"), (None, "y")], "path string, text string").collect()
    )
    crowd = spark.createDataFrame([(f"t{n % 3}", "u", 1, 1, "s", f"m{n % 3}", (n % 3, 3)) for n in range(30)], ARTICLE)
    monkeypatch.setattr(writers, "CROWD", 5)
    for _ in range(2):
        writers.merge_articles(crowd, str(tmp_path / "out"))
    assert sorted(r.title for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["t0", "t1", "t2"]


def documents(spark, first, last, words=700):
    text = F.concat(F.lit("start "), F.repeat(F.concat(F.col("id").cast("string"), F.lit(" word ")), words))
    return spark.range(first, last).select(F.format_string("p%05d", "id").alias("path"), text.alias("text"))


def test_bucketed_load_shuffles_no_stored_key(spark, tmp_path):
    folder, name = str(tmp_path / "vectors"), "bucketed_plan"
    bucketed.append_bucketed(documents(spark, 0, 40), name, folder, 8, dim=16)
    bucketed.append_bucketed(documents(spark, 20, 60), name, folder, 8, dim=16)
    bucketed.append_bucketed(documents(spark, 20, 60), name, folder, 8, dim=16)
    stored = bucketed.bucketed_table(spark, name, folder, 8)
    keys = stored.select("path", "chunk_no")
    assert keys.count() == keys.distinct().count() > 60 and keys.select("path").distinct().count() == 60
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for a table that has grown
    try:
        fresh = bucketed.new_document_chunks(documents(spark, 50, 2000), stored, 8)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan and "SortMergeJoin" in plan
    assert fresh.select("path").distinct().count() == 1940


def test_bucketed_load_reads_the_buckets_of_few_paths(spark, tmp_path):
    folder, name = str(tmp_path / "vectors"), "bucketed_few"
    bucketed.append_bucketed(documents(spark, 0, 60), name, folder, 8, dim=16)
    stored = bucketed.bucketed_table(spark, name, folder, 8)
    plan = bucketed.new_document_chunks(documents(spark, 7, 8), stored, 8)._jdf.queryExecution().executedPlan().toString()
    assert "SelectedBucketsCount: 1 out of 8" in plan
    both = [bucketed.stored_numbers(stored, documents(spark, 0, 9), named).count() for named in (9, 8)]
    assert both == [9, 60]


def test_bucketed_table_is_found_again_by_its_folder(spark, tmp_path):
    folder = str(tmp_path / "vectors")
    assert bucketed.bucketed_table(spark, "bucketed_none", folder, 4) is None
    given = documents(spark, 0, 12).unionByName(documents(spark, 0, 12)).unionByName(spark.createDataFrame([(None, "x"), ("null", None), ("empty", "")], "path string, text string"))
    bucketed.append_bucketed(given, "bucketed_first", folder, 4, dim=16)
    count = spark.table("bucketed_first").count()
    bucketed.append_bucketed(given, "bucketed_second", folder, 4, dim=16)
    assert bucketed.bucketed_table(spark, "bucketed_second", folder, 4).count() == count
    bucketed.append_bucketed(documents(spark, 0, 0), "bucketed_second", folder, 4, dim=16)
    assert spark.table("bucketed_second").count() == count
    with pytest.raises(ValueError, match="buckets by path"):
        bucketed.append_bucketed(documents(spark, 20, 22), "bucketed_second", folder, 6, dim=16)


def test_stream_of_article_files_takes_new_files_only(spark, tmp_path):
    landed, out = str(tmp_path / "landed"), str(tmp_path / "table")

    def land(issue):
        rows = [(f"issue-{issue}/article-{n}.md", f"# T{issue}\r\n\nSource: [u](u)\nReading time: 1 minutes\n\nS\n\n---\n\nbody {n}") for n in range(3)]
        files.write_article_files(spark.createDataFrame(rows, "path string, text string"), landed)

    for issue in (4, 5):
        land(issue)
        made = tables.load_documents(tables.stream_article_files(spark, landed, 2))
        jobs.stream_index(made, out, str(tmp_path / "log")).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted(r.path for r in rows) == [f"issue-{i}/article-{n}.md" for i in (4, 5) for n in range(3)]
    assert {r.title for r in rows} == {"T4", "T5"} and all("\r" not in r.text for r in rows)


def test_counts_add_up_over_batches_and_restarts(spark, tmp_path):
    landed, counts = str(tmp_path / "landed"), StreamCounts()
    spark.streams.addListener(counts)
    try:
        for first in (0, 30):
            spark.range(first, first + 30, numPartitions=3).write.mode("append").parquet(landed)
            stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(landed)
            even = counted(counted(stream, "read", ids=F.col("id")).filter("id % 2 = 0"), "even")
            writer = even.writeStream.format("parquet").option("path", str(tmp_path / "out"))
            query = writer.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
            query.awaitTermination()
            counts.settle([query])
            if not first:
                counts.forget(str(query.id))
    finally:
        spark.streams.removeListener(counts)
    assert counts.totals() == {("read", "rows"): 60, ("read", "ids"): 1770, ("even", "rows"): 30}
    assert counts.report(spark).count() == 3
