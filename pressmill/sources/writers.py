"""Writing articles, vectors and answers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pressmill.operators.incremental import first_by_key, skip_stored_chunks
from pressmill.operators.markdown import with_article_text
from pressmill.session import frozen, released
from pressmill.sources.tables import read_table, within_range


#: Copies of a path beyond which given articles are brought to one per path before they are dealt.
CROWD = 10_000


def save_articles(articles: DataFrame, path: str) -> None:
    """Write each article's file text, one folder per issue.

    The folders of the issues that are written are replaced, all others stay,
    so the input must hold every article of an issue it touches; ``merge_articles``
    replaces single ones. The rebalance hint sizes the files and splits an issue
    that is large by itself. Of articles with one path one is written.
    """
    _write_issues(_stored_rows(articles), path)


def merge_articles(articles: DataFrame, path: str) -> None:
    """Write articles one by one: a stored one of the same path is replaced, the others of its issue stay.

    Only the folders of the issues that are touched are read and written again. Given
    and stored rows are dealt once, together, by ranges of issue and path, and meet
    there; Spark writes beside the table and moves the folders when all are whole.
    Articles without an issue share a folder of their own; a stored row with a NULL
    path is replaced by nothing but a row that is the same in all columns.
    """
    stored = read_table(articles.sparkSession, path)
    if stored is None:
        return save_articles(articles, path)
    given = frozen(_all_stored_rows(articles))
    if not given.groupBy("path").count().filter(F.col("count") > CROWD).isEmpty():
        given = frozen(first_by_key(given, ["path"]))  # else a task would get all copies
    kind = given.schema["issue_num"].dataType
    stored = stored.select(*[name for name in given.columns if name != "issue_num"], F.col("issue_num").cast(kind))
    # a table of known size, so that the stored rows aren't shuffled only to be told apart by it
    touched = frozen(given.select("issue_num").distinct())
    held = stored.filter("issue_num is not null").join(touched, "issue_num", "left_semi")
    if not touched.filter("issue_num is null").isEmpty():
        held = held.unionByName(stored.filter("issue_num is null"))
    both = given.withColumn("_held", F.lit(False)).unionByName(held.withColumn("_held", F.lit(True)))
    _write_sorted(_merged(both), path)
    released(given, touched)


def _all_stored_rows(articles: DataFrame) -> DataFrame:
    return with_article_text(articles).select("path", "text", "title", "url", "issue_num")


def _stored_rows(articles: DataFrame) -> DataFrame:
    return first_by_key(_all_stored_rows(articles), ["path"])


def _merged(rows: DataFrame) -> DataFrame:
    """Of each path the given row by the least hash, or else what is held, each row once; sorted by issue.

    The ranges split an issue that is large by itself; rows of one path lie in one range.
    """
    spark = rows.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    values = ["text", "title", "url", "issue_num"]
    digest = F.xxhash64(*values, *[F.col(name).isNull() for name in values])
    whole = F.struct(*values)
    apart = F.when(F.col("path").isNull(), whole)
    near = Window.partitionBy("issue_num", "path", apart).orderBy("_held", digest, *[F.col(name).isNull() for name in values])
    again = F.lag(whole).over(near).eqNullSafe(whole)
    return (
        rows.repartitionByRange(tasks, "issue_num", "path")
        .withColumns({"_place": F.row_number().over(near), "_first": F.first("_held").over(near), "_again": again})
        .filter((F.col("_place") == 1) | (F.col("_first") & ~F.col("_again")))
        .drop("_held", "_place", "_first", "_again")
    )


def _write_issues(rows: DataFrame, path: str) -> None:
    _write_sorted(rows.hint("rebalance", "issue_num"), path)


def _write_sorted(rows: DataFrame, path: str) -> None:
    """Rows of an issue should lie in few tasks, each of which writes a file of its own. Texts are a third smaller under zstd.

    Tasks write through pyarrow, as Hadoop's local file system starts three processes
    for a folder with one file. Spark writes to stores that pyarrow doesn't know, and issues
    that have other keys than whole numbers.
    """
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    try:
        fs.FileSystem.from_uri(path)
        known = isinstance(rows.schema["issue_num"].dataType, whole)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        known = False
    if known:
        return _write_by_tasks(rows, path)
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy("issue_num")
        .parquet(path)
    )


def _write_by_tasks(rows: DataFrame, path: str) -> None:
    """Replaces the folders of the issues among the rows, once all their files lie in a hidden folder beside them.

    Only files of attempts that Spark counts are moved. A move or a removal that is run
    again finds what is left to do.
    """
    spark, staging = rows.sparkSession, f".staging-{uuid.uuid4().hex}"
    names = [name for name in rows.columns if name != "issue_num"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(path)
        own, folders, held, out, writer = uuid.uuid4().hex, [], None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if not folders:
                system.create_dir(f"{top}/{staging}/{own}")
            issues, plain = batch.column("issue_num").to_pylist(), batch.select(names)
            starts = [n for n in range(len(issues)) if not n or issues[n] != issues[n - 1]]
            for start, end in zip(starts, [*starts[1:], len(issues)], strict=True):
                folder = f"issue_num={'__HIVE_DEFAULT_PARTITION__' if issues[start] is None else issues[start]}"
                if folder != held:
                    if writer:
                        writer.close()
                        out.close()
                    out = system.open_output_stream(f"{top}/{staging}/{own}/part-{own}-{len(folders)}.parquet")
                    writer = pq.ParquetWriter(out, plain.schema, compression="zstd")
                    folders.append(folder)
                    held = folder
                writer.write_batch(plain.slice(start, end - start))
        if writer:
            writer.close()
            out.close()
        files = [f"part-{own}-{n}.parquet" for n in range(len(folders))]
        yield pa.RecordBatch.from_pydict({"folder": folders, "own": [own] * len(files), "file": files}, pa.schema([(n, pa.string()) for n in ("folder", "own", "file")]))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = fs.FileSystem.from_uri(path)
        for batch in batches:
            for folder, files in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                system.create_dir(f"{top}/{folder}")
                before = {one.base_name: one for one in system.get_file_info(fs.FileSelector(f"{top}/{folder}"))}
                for own, file in ((one["own"], one["file"]) for one in files):
                    if file not in before:
                        system.move(f"{top}/{staging}/{own}/{file}", f"{top}/{folder}/{file}")
                    before.pop(file, None)
                for one in before.values():
                    system.delete_file(one.path)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["moved"])

    at = spark._jvm.org.apache.hadoop.fs.Path(path, staging)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(at)
    try:
        written = frozen(rows.sortWithinPartitions("issue_num").mapInArrow(write, "folder string, own string, file string"))
        # by number, as Spark would take the short list for the work of one task
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        folders = written.repartition(tasks, "folder").groupBy("folder").agg(F.collect_list(F.struct("own", "file")).alias("files"))
        folders.mapInArrow(move, "moved long").agg(F.sum("moved")).first()
        released(written)
    finally:
        system.delete(at, True)


def append_vectors(vectors: DataFrame, path: str) -> None:
    """Append the chunks that the table does not hold yet; a rerun adds nothing."""
    stored = within_range(read_table(vectors.sparkSession, path), vectors)
    skip_stored_chunks(vectors, stored).write.mode("append").parquet(path)


def save_batch(df: DataFrame, path: str, batch_id: int, run: str) -> None:
    """Write a batch under its run and number; a batch that is run again replaces itself alone."""
    (
        df.withColumns({"run": F.lit(run), "batch_id": F.lit(batch_id)})
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("run", "batch_id")
        .parquet(path)
    )


def save_whole_batch(df: DataFrame, path: str, batch_id: int, run: str) -> None:
    """Like ``save_batch``, but a batch without rows leaves a folder too."""
    df.write.mode("overwrite").parquet(f"{path}/run={run}/batch_id={batch_id}")


def batch_folders(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Run and number of the batches that ``save_batch`` wrote to a table."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = top.getFileSystem(spark._jsc.hadoopConfiguration())
    found = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(top, "run=*/batch_id=*")) or []
    parts = [str(one.getPath().toString()).split("/")[-2:] for one in found]
    return sorted((run.removeprefix("run="), int(batch.removeprefix("batch_id="))) for run, batch in parts)


def drop_batches(spark: SparkSession, path: str, batches: list[tuple[str, int]]) -> None:
    """Removes batches that no later one will look at."""
    for run, number in batches:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run={run}/batch_id={number}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def state_before(spark: SparkSession, path: str, run: str, batch_id: int) -> tuple[DataFrame | None, list[tuple[str, int]]]:
    """The state that a batch goes on from, and the batches it lies in.

    That is what the last earlier batch of the run left; a run that has none yet
    goes on from what all others left. Every batch that leaves a state leaves all
    of it, so those before it may go.
    """
    held = [one for one in batch_folders(spark, path) if one[0] != run or one[1] < batch_id]
    own = [one for one in held if one[0] == run]
    chosen = own[-1:] or held
    if not chosen:
        return None, []
    folders = [f"{path}/run={name}/batch_id={number}" for name, number in chosen]
    return spark.read.option("basePath", path).parquet(*folders), chosen


def forget_before(spark: SparkSession, path: str, run: str, batch_id: int, used: list[tuple[str, int]]) -> None:
    """Removes the states but that of a batch and those it went on from, which it needs if it is run again."""
    kept = {(run, batch_id), *used}
    drop_batches(spark, path, [one for one in batch_folders(spark, path) if one not in kept])
