"""Reading landed pages, stored articles and vector tables."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.text import sub
from pressmill.operators.markdown import with_header


#: Article files that a task holds at once.
FILES_TOGETHER = 256


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out over the cores where a scan would leave half of them idle.

    Work on the text of pages and documents is long against reading them, so a
    few large row groups would hold everything up. A scan with splits enough for
    the cluster stays as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages or responses."""
    return spread(spark.read.parquet(path))


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A table of vectors or articles, or None where none has been written."""
    try:
        return read_folders(spark, path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def list_by_few_tasks(spark: SparkSession) -> str:
    """As many tasks as a shuffle has list folders and files, where Spark would start one for nearly each of them.

    Returns what the session had before.
    """
    before = spark.conf.get(LISTING)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    spark.conf.set(LISTING, str(min(int(before), tasks)))
    return before


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """A table of many folders, listed by few tasks."""
    before = list_by_few_tasks(spark)
    try:
        return spark.read.parquet(path)
    finally:
        spark.conf.set(LISTING, before)


def within_range(stored: DataFrame | None, rows: DataFrame, key: str = "path") -> DataFrame | None:
    """The stored rows between the least and greatest key of a batch.

    A filter on a plain range lets the scan pass over the files of earlier
    loads; it holds every key of the batch, so what is found stays the same.
    """
    if stored is None:
        return None
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high")).first()
    if ends["low"] is None:
        return stored.limit(0)
    return stored.filter(F.col(key).between(ends["low"], ends["high"]))


def list_article_files(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of the Markdown files in the ``issue-*`` folders; no rows where there are none.

    Tasks list the folders and read their files, so that no list of files reaches
    the driver. Stores that pyarrow doesn't know are listed by Spark.
    """
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _listed_by_spark(spark, path)

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            system, top = fs.FileSystem.from_uri(path)
            found = system.get_file_info(fs.FileSelector(top, allow_not_found=True))
            names = [one.base_name for one in found if one.type == fs.FileType.Directory and one.base_name.startswith("issue-")]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], names=["folder"])

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(path)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{top}/{folder}"))
                sound = [one for one in found if one.is_file and one.size and one.base_name[0] not in "._"]  # empty files give no rows, as in Spark
                names = [one.base_name for one in sound if one.base_name.endswith(".md")]
                for start in range(0, len(names), FILES_TOGETHER):
                    part, texts = names[start : start + FILES_TOGETHER], []
                    for name in part:
                        with system.open_input_stream(f"{top}/{folder}/{name}") as file:
                            texts.append(file.read())
                    paths = pa.array([quote(f"{folder}/{name}") for name in part], pa.string())
                    yield pa.RecordBatch.from_arrays([paths, pa.array(texts, pa.binary())], names=["path", "text"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    listed = spark.range(1, numPartitions=1).mapInArrow(folders, "folder string").repartition(tasks)
    read = listed.mapInArrow(files, "path string, text binary")
    return read.select("path", sub(F.col("text").cast("string"), r"\r\n?", "\n").alias("text"))


def _listed_by_spark(spark: SparkSession, path: str) -> DataFrame:
    try:
        files = spark.read.text(f"{path}/issue-*", wholetext=True, pathGlobFilter="*.md")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, text string")
    return _path_and_text(files)


def stream_article_files(spark: SparkSession, path: str, files_per_batch: int = 10_000) -> DataFrame:
    """The same of Markdown files as they land, each file once.

    The folder needs an ``issue-*`` folder when the stream starts; folders that
    come later are seen too. A task reads many of the files of a batch, where Spark
    would give it a few for their cost of opening. A file is read when it is first listed, so it must be
    moved into place whole, as ``write_article_files`` does. Spark lists the folders, and the
    files of every batch once more by themselves, under the setting of the session at that
    time, so the session keeps to few tasks for it from here on.
    """
    list_by_few_tasks(spark)
    files = (
        spark.readStream.option("maxFilesPerTrigger", files_per_batch)
        .text(f"{path}/issue-*", wholetext=True, pathGlobFilter="*.md")
    )
    return _path_and_text(files).coalesce(2 * spark.sparkContext.defaultParallelism)


def _path_and_text(files: DataFrame) -> DataFrame:
    return files.select(
        F.regexp_extract("_metadata.file_path", r"issue-[^/]*/[^/]*\z", 0).alias("path"),
        sub(F.col("value"), r"\r\n?", "\n").alias("text"),
    )


def read_article_table(spark: SparkSession, path: str) -> DataFrame:
    """``path`` and ``text`` of the articles written by ``save_articles``."""
    return read_folders(spark, path).select("path", "text")


def load_documents(files: DataFrame) -> DataFrame:
    """Documents with the fields of their header."""
    return with_header(files).select(
        "path", "title", "source_url", "reading_time", "summary", "text"
    )
