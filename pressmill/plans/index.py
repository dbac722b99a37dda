"""From documents to the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.functions.vectors import DIMENSIONS
from pressmill.operators.chunking import CHUNK_SIZE, OVERLAP, split_documents
from pressmill.operators.incremental import first_by_key, skip_stored_chunks
from pressmill.operators.markdown_chunks import split_markdown
from pressmill.operators.vectors import embed
from pressmill.sources.tables import read_table, within_range


def with_chunk_id(chunks: DataFrame, out: str = "vec_id") -> DataFrame:
    """Add one sortable key out of path and chunk number."""
    return chunks.withColumn(out, F.format_string("%s#%08d", "path", "chunk_no"))


def index_documents(
    documents: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    dim: int = DIMENSIONS,
    fixed: bool = False,
    markdown: bool = False,
) -> DataFrame:
    """Chunks with key and vector, ready for ``append_vectors``; ``markdown`` cuts by headings, fences and tables."""
    if markdown:
        return embed(with_chunk_id(split_markdown(documents, "text", size, overlap)), dim=dim)
    return embed(with_chunk_id(split_documents(documents, "text", size, overlap, fixed)), dim=dim)


def append_documents(documents: DataFrame, path: str, markdown: bool = False, **cut) -> None:
    """Add the chunks of documents to a vector table, each once.

    Of documents with one path one is cut, so that no chunks of two texts mix;
    what is stored is left out by key before any vector is made.
    """
    documents = first_by_key(documents.filter("path is not null"), ["path"])
    stored = within_range(read_table(documents.sparkSession, path), documents)
    chunks = (split_markdown if markdown else split_documents)(documents, "text", **cut)
    fresh = with_chunk_id(skip_stored_chunks(chunks, stored))
    embed(fresh).write.mode("append").parquet(path)
