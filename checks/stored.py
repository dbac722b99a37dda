"""Registered loads into stored tables, and streams that count, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracles import ARTICLE_FILES, CHUNKS, HEADERS
from checks.queries import _parsed, articles, files_each, named_documents, scratch, table
from pressmill.operators.chunking import split_documents
from pressmill.sources import bucketed, files, tables, writers
from pressmill.streaming import jobs
from pressmill.streaming.counters import StreamCounts, counted

CHUNK_ROWS = f"WITH RECURSIVE {CHUNKS} SELECT path, chunk_no, text FROM chunks"
BUCKETS = 16
BATCHES = 4


def merged_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored with other texts or not at all, every article is saved again by itself in two rounds."""
    out = scratch(spark, "merged")
    made = articles(spark, sf_dir)
    kind = F.col("doc_id") % 4
    writers.save_articles(made.filter(kind != 3).withColumn("markdown", F.when(kind != 0, "old").otherwise(F.col("markdown"))).drop("doc_id"), out)
    writers.merge_articles(made.filter(kind == 1).drop("doc_id"), out)
    for _ in range(2):
        writers.merge_articles(made.filter(kind >= 2).drop("doc_id"), out)
    return _parsed(tables.read_article_table(spark, out))


def bucketed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two loads that share a third of them, the second run twice."""
    folder = scratch(spark, "bucketed")
    name = folder.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    documents = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 3).alias("third"), F.format_string("d%08d", "doc_id").alias("path"), "text"
    )
    for part in (F.col("third") < 2, F.col("third") > 0, F.col("third") > 0):
        bucketed.append_bucketed(documents.filter(part).drop("third"), name, folder, BUCKETS)
    return bucketed.bucketed_table(spark, name, folder, BUCKETS).select("path", "chunk_no", "text")


def _landed_files(spark: SparkSession, sf_dir: str, folder: str) -> None:
    issue = (F.col("doc_id") / 16).cast("int").cast("string")
    paths = F.concat(F.lit("issue-"), issue, F.lit("/article-"), F.col("doc_id").cast("string"), F.lit(".md"))
    files.write_article_files(table(spark, sf_dir, "documents").select(paths.alias("path"), "text"), folder)


def stream_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown files of issue folders as a stream into the vector table, again from a new checkpoint."""
    out = scratch(spark, "stream-files")
    _landed_files(spark, sf_dir, f"{out}/landed")
    for log in ("log", "again"):
        stream = tables.stream_article_files(spark, f"{out}/landed")
        jobs.stream_index(stream, f"{out}/table", f"{out}/{log}", size=1 << 28, fixed=True, read_once=True).awaitTermination()
    return spark.read.parquet(f"{out}/table").select("path", F.md5("text").alias("text_md5"))


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents landed in several files and cut to chunks: what the listener adds up over the batches."""
    out = scratch(spark, "stream-counts")
    documents = named_documents(spark, sf_dir)
    each = files_each(spark, sf_dir, BATCHES)
    documents.repartition(BATCHES * each).write.parquet(f"{out}/landed")
    counts = StreamCounts()
    spark.streams.addListener(counts)
    try:
        stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", each).parquet(f"{out}/landed")
        read = counted(stream, "documents", characters=F.length("text"))
        chunks = counted(split_documents(read), "chunks", characters=F.length("text"), firsts=F.col("chunk_no") == 0)
        query = chunks.writeStream.format("parquet").option("path", f"{out}/chunks").option("checkpointLocation", f"{out}/log")
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        counts.settle([query])
    finally:
        spark.streams.removeListener(counts)
    return counts.report(spark)


QUERIES = [merged_articles, bucketed_chunks, stream_files, stream_counts]
ORACLES = {
    "merged_articles": HEADERS,
    "bucketed_chunks": CHUNK_ROWS,
    "stream_files": ARTICLE_FILES,
    "stream_counts": f"""
SELECT stage, counter, n FROM (
  SELECT 'documents' AS stage, unnest(['rows', 'characters']) AS counter,
    unnest([count(*), CAST(sum(length(text)) AS BIGINT)]) AS n FROM documents
  UNION ALL SELECT 'chunks', unnest(['rows', 'characters', 'firsts']),
    unnest([count(*), CAST(sum(length(text)) AS BIGINT), count(*) FILTER (chunk_no = 0)]) FROM ({CHUNK_ROWS}))""",
}
