"""Documents and token counts of flat token files, found by their separators.

A flat file is ids one after the other with an end id behind each document, and no
index. Files are cut into blocks of equal size whatever lies across the cuts. Each
block is searched for end ids as a whole array and tells how many documents end in
it, and how many ids lie before its first and behind its last end. A running sum
over the blocks of a file then gives every block the number of documents before it
and the ids of the document it begins in, so that documents over any number of
blocks come out whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressmill.llm import encoding, store
from pressmill.llm.common import frozen, record_batch

BLOCK_IDS = 1 << 20
ENDS_SCHEMA = "file string, block long, nth long, gap long"


def write_flat(docs: DataFrame, tokenizer: str, end: int, folder: str, threads: int = 1) -> DataFrame:
    """Writes the ids of every text of ``docs`` to a flat file per partition; ``file``, ``place`` and ``doc_id`` of each.

    A NULL text counts as empty; every document gets the id ``end`` behind its own.
    """
    schema = pa.schema([("file", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = f"{TaskContext.get().partitionId():06d}.ids"
        encoder = encoding.byte_level_encoder(tokenizer, threads)
        held = 0
        with store.written(folder, name) as out:
            for batch in batches:
                for part in encoding.slices(batch.column(1)):
                    out.write(encoder.ids(part, end)[0].tobytes())
                places = np.arange(held, held + batch.num_rows)
                held += batch.num_rows
                yield record_batch(schema, [[name] * batch.num_rows, places, batch.column(0)])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "file string, place long, doc_id long")


def blocks_of(spark: SparkSession, folder: str, width: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``file``, ``block``, and ``ids`` (those from its start to the file's end) of all blocks in a folder.

    The driver lists files only; the blocks are made by the tasks.
    """
    files = [(name, size // width) for name, size in store.names(folder, ".ids") if size >= width]
    listed = spark.createDataFrame(files, "file string, ids long")
    last = F.floor((F.col("ids") - 1) / block_ids)
    cut = listed.select("file", "ids", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return cut.repartition(parts, "file", "block")


def _scan(blocks: DataFrame, folder: str, id_type: str, end: int, block_ids: int) -> DataFrame:
    """Per block the number of its document ends and its ids before the first and after the last, and the gaps between.

    ``gaps`` holds the ids of each document that begins behind an end of the block
    and ends in it, the end id included.
    """
    kind = np.dtype(id_type)
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("ends", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("gaps", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, ids in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                count = min(block_ids, ids - block * block_ids)
                with store.opened(folder, file) as found:
                    data = np.frombuffer(found.read_at(count * kind.itemsize, block * block_ids * kind.itemsize), kind)
                places = np.flatnonzero(data == end)
                if len(places):
                    row = (file, block, len(places), int(places[0]) + 1, count - 1 - int(places[-1]), np.diff(places))
                else:
                    row = (file, block, 0, 0, count, [])
                yield record_batch(schema, [[value] for value in row])

    return blocks.mapInArrow(run, "file string, block long, ends long, head long, tail long, gaps array<long>")


def count_tokens(spark: SparkSession, folder: str, id_type: str, end: int, block_ids: int = BLOCK_IDS) -> DataFrame:
    """``file``, ``place`` (from 0) and ``n_tokens`` (end id included) of every document in the flat files of a folder.

    Ids behind the last end of a file are a document without one and counted as
    they are. Files without ids and empty folders give no rows. What a document
    has in earlier blocks is a running sum over the blocks of its file: ids
    since the last block with an end.
    """
    width = np.dtype(id_type).itemsize
    scanned = frozen(_scan(blocks_of(spark, folder, width, block_ids), folder, id_type, end, block_ids))
    line = Window.partitionBy("file").orderBy("block")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    full = F.sum("tail").over(before)  # ids behind the last end of every earlier block
    last = F.max(F.when(F.col("ends") > 0, F.struct("block", F.col("upto").alias("upto")))).over(before)
    summed = scanned.drop("gaps").withColumn("upto", F.coalesce(full, F.lit(0).cast("long")))
    placed = summed.select(
        "file",
        "block",
        "ends",
        "head",
        "tail",
        F.coalesce(F.sum("ends").over(before), F.lit(0).cast("long")).alias("place"),
        (F.col("upto") - F.coalesce(last["upto"], F.lit(0).cast("long"))).alias("carried"),
        (F.lead("block").over(line).isNull()).alias("is_last"),
    )
    stitched = scanned.select("file", "block", "gaps").join(placed, ["file", "block"])
    whole = F.when(F.col("ends") > 0, F.concat(F.array(F.col("carried") + F.col("head")), "gaps")).otherwise(F.array().cast("array<long>"))
    left = F.col("tail") + F.when(F.col("ends") > 0, 0).otherwise(F.col("carried"))
    rest = F.when(F.col("is_last") & (left > 0), F.array(left)).otherwise(F.array().cast("array<long>"))
    counts = stitched.select("file", "place", F.posexplode(F.concat(whole, rest)).alias("nth", "n_tokens"))
    return counts.select("file", (F.col("place") + F.col("nth")).alias("place"), "n_tokens")


def counted_documents(docs: DataFrame, tokenizer: str, end: int, block_ids: int = BLOCK_IDS, threads: int = 1) -> DataFrame:
    """Writes ``docs`` as flat files and counts their tokens: ``doc_id``, ``file``, ``place`` and ``n_tokens``.

    One row per row of ``docs``, which needs ``doc_id`` and ``text``; other columns
    are ignored. The ids of the documents are told by the writer, the counts come
    from the files alone. The end id must be none that a text can have.
    """
    spark = docs.sparkSession
    folder = store.new_folder(spark, "flat")
    written = frozen(write_flat(docs, tokenizer, end, folder, threads))
    counts = count_tokens(spark, folder, encoding.byte_level_encoder(tokenizer).id_type.str, end, block_ids)
    return written.join(counts, ["file", "place"]).select("doc_id", "file", "place", "n_tokens")
