"""Many issues: their folders are written and listed by a few tasks, without a process for each."""

import pathlib
import uuid

from pyspark.sql import functions as F

from pressmill.sources import tables, writers

ARTICLE = "title string, url string, issue_num int, reading_time int, summary string, markdown string, item_of struct<current:int,total:int>"


def articles(spark, issues, text, each=3):
    rows = [(f"t{n}", "u", n, 1, "s", text, (k, each)) for n in issues for k in range(each)]
    return spark.createDataFrame(rows, ARTICLE)


def tasks_of(spark, work):
    group, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(group, "counted")
    try:
        work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return max(info.numTasks for info in map(tracker.getStageInfo, stages) if info)


def test_issue_folders_hold_their_files_alone(spark, tmp_path):
    out = tmp_path / "articles"
    writers.save_articles(articles(spark, [*range(40), None], "old"), str(out))
    kept = {p: p.stat().st_mtime_ns for n in range(5, 40) for p in out.glob(f"issue_num={n}/*")}
    for _ in range(2):
        writers.save_articles(articles(spark, [*range(5), None, 50], "new", each=2), str(out))
    assert {p: p.stat().st_mtime_ns for p in kept} == kept and len(kept) == 35
    # neither what was replaced nor what the tasks wrote beside the table is left
    assert [p.name for p in out.iterdir() if p.name.startswith(".")] == []
    assert all(len(list(folder.iterdir())) == 1 for folder in out.iterdir() if folder.is_dir())
    found = spark.read.parquet(str(out))
    assert found.schema["issue_num"].dataType.simpleString() == "int"
    ends = found.groupBy("issue_num").agg(F.count("*"), F.max(F.right("text", F.lit(3)))).collect()
    old, new = {n: (3, "old") for n in range(5, 40)}, {n: (2, "new") for n in [*range(5), 50]}
    assert {r[0]: tuple(r)[1:] for r in ends} == {**old, **new, None: (2, "new")}


def test_folders_are_listed_by_few_tasks(spark, tmp_path):
    out = str(tmp_path / "articles")
    writers.save_articles(articles(spark, range(60), "x"), out)
    assert tasks_of(spark, lambda: tables.read_table(spark, out)) <= 8
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    assert tables.read_article_table(spark, out).count() == 180


def test_files_of_lost_attempts_are_not_moved(spark, tmp_path):
    """A table that fails half-way stays as it was, and nothing lies beside it."""
    out = tmp_path / "articles"
    writers.save_articles(articles(spark, range(3), "old"), str(out))
    before = sorted(p.name for p in out.glob("*/*"))
    bad = articles(spark, range(6), "new").withColumn("markdown", F.when(F.col("issue_num") == 5, F.raise_error(F.lit("bad"))).otherwise(F.col("markdown")))
    try:
        writers.save_articles(bad, str(out))
        raise AssertionError("went through")
    except Exception as error:
        assert "bad" in str(error)
    assert sorted(p.name for p in out.glob("*/*")) == before
    assert [p.name for p in out.iterdir() if p.name.startswith(".")] == []


def test_a_batch_of_many_files_is_listed_by_few_tasks_and_read_once(spark, tmp_path):
    from pressmill.sources import tables
    from pressmill.streaming import jobs

    for n in range(40):
        (tmp_path / f"landed/issue-{n}").mkdir(parents=True)
        (tmp_path / f"landed/issue-{n}/article-0.md").write_text(f"text {n}")
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(shared.glob("frozen-*"))
    for log in ("log", "again"):
        stream = tables.stream_article_files(spark, str(tmp_path / "landed"))
        query = jobs.stream_index(stream, str(tmp_path / "table"), str(tmp_path / log), size=1 << 28, fixed=True, read_once=True)
        query.awaitTermination()
        tracker = spark.sparkContext.statusTracker()
        stages = [stage for job in tracker.getJobIdsForGroup(query.runId) for stage in tracker.getJobInfo(job).stageIds]
        tasks = [info.numTasks for info in map(tracker.getStageInfo, stages) if info]
        assert tasks and max(tasks) <= 8  # one for each file before
    got = sorted((r.path, r.text) for r in spark.read.parquet(str(tmp_path / "table")).collect())
    assert got == sorted((f"issue-{n}/article-0.md", f"text {n}") for n in range(40))
    assert set(shared.glob("frozen-*")) == before
