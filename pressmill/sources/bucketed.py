"""A vector table whose stored keys stay where they are.

The table is bucketed by ``path``, so all chunks of a document lie in the files of
one bucket. A load deals its documents into the same buckets once; what is stored
is grouped, joined and appended to bucket by bucket, and never shuffled however
large it has grown. The folder is the table: another application registers it
again under the name it likes.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressmill.functions.vectors import DIMENSIONS
from pressmill.operators.chunking import split_documents
from pressmill.operators.incremental import first_by_key
from pressmill.operators.markdown_chunks import split_markdown
from pressmill.operators.vectors import embed
from pressmill.plans.index import with_chunk_id
from pressmill.sources.tables import read_table

#: At least as many as the tasks a load of the grown table is to have.
BUCKETS = 512
#: Paths of a load that are named to the scan, which then reads their buckets alone.
NAMED_PATHS = 200


def bucketed_table(spark: SparkSession, name: str, folder: str, buckets: int = BUCKETS) -> DataFrame | None:
    """The table in ``folder``, registered as ``name`` where it isn't yet; None before the first load.

    The number of buckets is the one the folder was written with.
    """
    if not spark.catalog.tableExists(name):
        held = read_table(spark, folder)
        if held is None:
            return None
        columns = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in held.schema)
        place = folder.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (path) SORTED BY (path, chunk_no) "
            f"INTO {int(buckets)} BUCKETS LOCATION '{place}'"
        )
    spark.catalog.refreshTable(name)
    return spark.table(name)


def stored_numbers(stored: DataFrame, paths: DataFrame | None = None, named: int = NAMED_PATHS) -> DataFrame:
    """``path`` and the chunk numbers stored of it, grouped within the buckets.

    Where ``paths`` holds at most ``named`` different ones they are named to the scan.
    That changes only what is read: keys beyond those of the load join nothing.
    """
    if paths is not None:
        asked = [row.path for row in paths.select("path").distinct().limit(named + 1).collect()]
        if len(asked) <= named:
            stored = stored.filter(F.col("path").isin(asked))
    return stored.groupBy("path").agg(F.collect_set("chunk_no").alias("_stored"))


def new_document_chunks(
    documents: DataFrame, stored: DataFrame | None, buckets: int = BUCKETS, markdown: bool = False, **cut
) -> DataFrame:
    """Chunks of ``documents`` that ``stored``, a bucketed table, doesn't hold.

    Documents are dealt into the buckets by one exchange, which their choice by
    path and the join with what is stored share. Rows with a NULL path are left
    out, of rows with one path one is cut.
    """
    dealt = documents.filter("path is not null").repartition(buckets, "path")
    rows = first_by_key(dealt, ["path"])
    if stored is not None:
        rows = rows.join(stored_numbers(stored, documents.filter("path is not null")), "path", "left")
    chunks = (split_markdown if markdown else split_documents)(rows, "text", **cut)
    if stored is None:
        return chunks
    seen = F.coalesce(F.array_contains("_stored", F.col("chunk_no")), F.lit(False))
    return chunks.filter(~seen).drop("_stored")


def append_bucketed(
    documents: DataFrame, name: str, folder: str, buckets: int = BUCKETS, dim: int = DIMENSIONS, markdown: bool = False, **cut
) -> None:
    """Add the chunks of documents to a bucketed vector table, each once; a rerun adds nothing.

    Each task holds one bucket, so a load adds at most one file to each.
    """
    spark = documents.sparkSession
    stored = bucketed_table(spark, name, folder, buckets)
    fresh = embed(with_chunk_id(new_document_chunks(documents, stored, buckets, markdown, **cut)), dim=dim)
    writer = fresh.write.format("parquet").mode("append").bucketBy(buckets, "path").sortBy("path", "chunk_no")
    if stored is None:
        writer = writer.option("path", folder)
    try:
        writer.saveAsTable(name)
    except AnalysisException as error:
        raise ValueError(f"{folder} isn't a table of {buckets} buckets by path") from error
