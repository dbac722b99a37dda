"""Streams, searches and loads on tables as large inputs have them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks import queries
from pressmill.operators import hashed, nearest, weighted_vectors
from pressmill.sources import tables
from pressmill.streaming import jobs


@pytest.mark.parametrize("files", [1, 3])
def test_streams_of_tables_that_are_folders(spark, tmp_path, files):
    rows = spark.range(40).selectExpr("id AS doc_id", "concat('words of ', id) AS text")
    rows.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    spark.range(3).write.parquet(str(tmp_path / "pages.parquet"))
    place = str(tmp_path / "documents.parquet")
    if files == 1:  # the table is its only file
        place = str(next((tmp_path / "documents.parquet").glob("*.parquet")))
    stream = jobs.read_table_stream(spark, place, rows.schema)
    made = stream.selectExpr("concat('d', doc_id) AS path", "text")
    jobs.stream_index(made, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_stream_queries_read_tables_that_are_folders(spark, tmp_path):
    spark.createDataFrame([(1, "http://a.org/1", "<p>one</p>"), (2, "http://a.org/2", None)], "page_id long, url string, html string").repartition(2).write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(n, f"text {n}") for n in range(9)], "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.stream_markdown(spark, str(tmp_path)).count() == 2
    assert queries.stream_index(spark, str(tmp_path)).count() == 9


def vectors(spark, count, dim=6, seed=5):
    rows = np.random.default_rng(seed).standard_normal((count, dim)).tolist()
    return spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>")


def asking(stored):
    return stored.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def test_hashed_search_sends_a_query_once_per_block(spark):
    stored = vectors(spark, 300)
    asked = asking(stored)
    hashing = spark.sparkContext.broadcast(hashed.Hashing(3, 4, [0] * 6))
    rows = hashed._probing(asked, "query_vec", hashing, 5).collect()
    assert len(rows) == 300
    for row in rows[:20]:
        want = hashing.value.probed(np.array([row.query_vec]), 5)[0]
        assert np.frombuffer(row.probed, "<u4").reshape(3, 5).tolist() == want.tolist()


def test_hashed_search_is_the_same_in_any_blocks(spark):
    stored = vectors(spark, 300)
    found = [
        sorted(map(tuple, hashed.nearest_hashed(asking(stored), stored, 3, tables=3, bits=4, probes=5, rows_per_slice=size).collect()))
        for size in (70, 1000)
    ]
    assert found[0] == found[1] and len(found[0]) >= 800


def test_search_by_cells_hands_over_few_rows_at_a_time(spark, monkeypatch):
    stored = vectors(spark, 120)
    want = sorted(map(tuple, nearest.nearest(asking(stored), stored, 3).collect()))
    monkeypatch.setattr(nearest, "ROWS_TOGETHER", 7)
    monkeypatch.setattr(nearest, "BLOCK_VALUES", 50)
    got = nearest.nearest_by_cells(asking(stored), stored, 3, pivots=5)
    assert sorted(map(tuple, got.select("query_id", "vec_id", "distance", "rank").collect())) == want


def test_article_files_are_listed_by_tasks(spark, tmp_path):
    for folder in ("issue-1", "issue-22", "issues", "issue-1/deeper"):
        (tmp_path / folder).mkdir()
        for name, text in (("a.md", b"x\r\ny\rz"), ("b c.md", b"b"), ("e.md", b""), ("d.md", b"\xff \xc3\xa9"), ("n.txt", b"n"), (".h.md", b"h"), ("_u.md", b"u")):
            (tmp_path / folder / name).write_bytes(text)
    own, sparks = tables.list_article_files(spark, str(tmp_path)), tables._listed_by_spark(spark, str(tmp_path))
    rows = [sorted(map(tuple, df.select("path", F.hex(F.col("text").cast("binary"))).collect())) for df in (own, sparks)]
    assert rows[0] == rows[1] and len(rows[0]) == 6
    assert tables.list_article_files(spark, str(tmp_path / "none")).count() == 0


def test_streamed_article_files_are_read_by_few_tasks(spark, tmp_path):
    for n in range(60):
        (tmp_path / f"issue-{n}").mkdir()
        (tmp_path / f"issue-{n}" / "a.md").write_text(f"text {n}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a split
    try:
        parts = []
        query = tables.stream_article_files(spark, str(tmp_path)).writeStream.foreachBatch(lambda rows, _: parts.append((rows.rdd.getNumPartitions(), rows.count())))
        query.option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert parts == [(2 * spark.sparkContext.defaultParallelism, 60)]


def test_words_are_not_shuffled(spark):
    docs = spark.createDataFrame([("a", "x y x"), ("b", "y")], "path string, text string")
    plan = weighted_vectors.term_counts(docs, "path")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    counts = spark.createDataFrame([(weighted_vectors.ALL, 9)], "place int, documents long")
    made = weighted_vectors.embed_weighted(docs, counts, "path").collect()
    assert sorted((r.path, [round(w, 3) for w in sorted(r.weights)]) for r in made) == [("a", [0.447, 0.894]), ("b", [1.0])]


def test_landed_files_follow_the_size_of_the_input(spark, tmp_path):
    from checks import stateful, stored

    spark.createDataFrame([(n, f"text {n}", "en", "src1", 9) for n in range(64)], "doc_id long, text string, lang string, source string, n_chars long").repartition(12).write.parquet(str(tmp_path / "documents.parquet"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # a file a split
    try:
        assert queries.files_each(spark, str(tmp_path), 4) == 3
        assert {(r.stage, r.counter): r.n for r in stored.stream_counts(spark, str(tmp_path)).collect()}["documents", "rows"] == 64
        assert sorted(r.num for r in stateful.stream_unique_issues(spark, str(tmp_path)).collect()) == [0, 1, 2, 3]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
