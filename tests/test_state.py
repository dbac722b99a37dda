"""What streams remember: no more than they must, over many batches and restarts."""

import datetime

from pressmill.sources import writers
from pressmill.streaming import jobs, stateful

REQUEST = "domain string, at_micros long, request_id long"


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def stream(spark, path, schema, files=1):
    kind = spark.createDataFrame([], schema).schema
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files).parquet(str(path))


def sequential(rows, period):
    last, out = {}, {}
    for domain, at, request in rows:
        slot = max(at, last.get(domain, at - period) + period)
        last[domain] = out[request] = slot
    return out


def run_slots(spark, tmp_path, **how):
    made = stateful.stream_slots(stream(spark, tmp_path / "in", REQUEST), str(tmp_path / "out"), str(tmp_path / "log"), 10, **how)
    made.awaitTermination()
    return {r.request_id: r.slot for r in spark.read.parquet(str(tmp_path / "out")).collect()}


def test_slots_follow_the_domains_over_batches_and_restarts(spark, tmp_path):
    rows = [(f"d{n % 3}", n * 2, n) for n in range(60)]
    for start in range(0, 40, 10):
        land(spark, tmp_path / "in", rows[start : start + 10], REQUEST)
    run_slots(spark, tmp_path)
    land(spark, tmp_path / "in", rows[40:] + [(None, 1, 900), ("d0", None, 901)], REQUEST)
    assert run_slots(spark, tmp_path) == sequential(rows, 10)
    state = spark.read.format("statestore").load(str(tmp_path / "log"))
    assert state.count() == 3


def test_domains_are_forgotten_behind_the_watermark(spark, tmp_path):
    second = 1_000_000
    first = [(f"d{n}", n + 1000, n) for n in range(20)]
    for rows in (first, [("late", 500 * second, 100)], [("late", 501 * second, 101)], [("late", 502 * second, 102)]):
        land(spark, tmp_path / "in", rows, REQUEST)
    got = run_slots(spark, tmp_path, lateness="10 seconds")
    assert got == sequential(first + [("late", (500 + n) * second, 100 + n) for n in range(3)], 10)
    assert spark.read.format("statestore").load(str(tmp_path / "log")).count() == 1


def test_unique_issues_over_files_and_a_restart(spark, tmp_path):
    schema = "num int, html string"

    def run():
        made = stateful.unique_issues(stream(spark, tmp_path / "in", schema))
        writer = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
        writer.trigger(availableNow=True).start().awaitTermination()
        return sorted(r.num for r in spark.read.parquet(str(tmp_path / "out")).collect())

    land(spark, tmp_path / "in", [(1, "a"), (1, "b"), (2, "c"), (None, "x")], schema)
    land(spark, tmp_path / "in", [(2, "d"), (3, "e")], schema)
    assert run() == [1, 2, 3]
    land(spark, tmp_path / "in", [(3, "f"), (4, "g"), (1, "h")], schema)
    assert run() == [1, 2, 3, 4]


def test_unique_issues_within_a_time_forget(spark, tmp_path):
    schema = "num int, at timestamp"
    day = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=n)
    for n in range(4):
        land(spark, tmp_path / "in", [(n, day(10 * n)), (n, day(10 * n))], schema)
    made = stateful.unique_issues(stream(spark, tmp_path / "in", schema), "at", "1 day")
    writer = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "log"))
    writer.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.num for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2, 3]
    assert spark.read.format("statestore").load(str(tmp_path / "log")).count() <= 2


def test_kept_states_do_not_grow_with_the_batches(spark, tmp_path):
    state = str(tmp_path / "state")
    rows, n = [], 0
    for n in range(12):
        rows.append(("a" if n % 2 else f"d{n}", n, n))
        land(spark, tmp_path / "in", rows[-1:], REQUEST)
    jobs.stream_schedule(stream(spark, tmp_path / "in", REQUEST), str(tmp_path / "out"), state, str(tmp_path / "log"), 10).awaitTermination()
    got = {r.request_id: r.slot for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == sequential(rows, 10)
    held = writers.batch_folders(spark, state)
    assert [number for _, number in held] == [10, 11]
    assert spark.read.parquet(f"{state}/run={held[-1][0]}/batch_id=11").count() == 7


def test_waiting_issues_do_not_grow_with_the_batches(spark, tmp_path):
    schema = "num int, item_of struct<current:int,total:int>, html string"
    page = '<h3 class="topic-title">T</h3><div><a class="post-title" href="https://a.example.com/{}">t</a></div>'
    for n in range(5):
        land(spark, tmp_path / "in", [(n, (0, 1), page.format(n))], schema)
    land(spark, tmp_path / "landed", [("https://a.example.com/3", "<html><body><article><p>" + "words " * 60 + "</p></article></body></html>")], "url string, html string")
    paths = [str(tmp_path / name) for name in ("landed", "rendered", "out", "state", "log")]
    jobs.stream_corpus(stream(spark, tmp_path / "in", schema), *paths).awaitTermination()
    held = writers.batch_folders(spark, f"{paths[3]}/waiting")
    assert len(held) == 2
    last = spark.read.parquet(f"{paths[3]}/waiting/run={held[-1][0]}/batch_id={held[-1][1]}")
    assert sorted(r.num for r in last.collect()) == [0, 1, 2, 4]
    assert sorted(r.num for r in spark.read.parquet(f"{paths[3]}/done").collect()) == [3]
    land(spark, tmp_path / "landed", [(f"https://a.example.com/{n}", "<html><body><article><p>" + "words " * 60 + "</p></article></body></html>") for n in (0, 1)], "url string, html string")
    jobs.stream_corpus(stream(spark, tmp_path / "in", schema), *paths).awaitTermination()
    assert sorted(r.num for r in spark.read.parquet(f"{paths[3]}/done").distinct().collect()) == [0, 1, 3]
    assert len(writers.batch_folders(spark, f"{paths[3]}/waiting")) <= 4


def test_stream_corpus_leaves_no_table_of_its_own_behind(spark, tmp_path):
    import pathlib

    issue = '<div class="section"><p><a class="title" href="https://a.example.com/1">One</a></p></div>'
    spark.createDataFrame([(n, (1, 1), issue) for n in range(3)], "num int, item_of struct<current:int,total:int>, html string").write.parquet(str(tmp_path / "issues"))
    spark.createDataFrame([("https://a.example.com/1", "<p>text</p>")], "url string, html string").write.parquet(str(tmp_path / "landed"))
    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir"))
    before, names = set(shared.glob("frozen-*")), ["spark.sql.parquet.compression.codec", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"]
    held = [spark.conf.get(name, None) for name in names]
    for log in ("log", "again"):
        issues = jobs.read_stream(spark, str(tmp_path / "issues"), spark.read.parquet(str(tmp_path / "issues")).schema)
        at = [str(tmp_path / name) for name in ("landed", "rendered", "table", "state", log)]
        jobs.stream_corpus(issues, *at).awaitTermination()
    assert (tmp_path / "state").exists()
    assert set(shared.glob("frozen-*")) == before
    assert [spark.conf.get(name, None) for name in names] == held
