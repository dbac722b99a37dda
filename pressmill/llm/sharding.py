"""Weighted rendezvous sharding of records by stable keys, in built-in expressions.

Every shard bids for a key with -ln(u) / weight, u being a hash of key and shard
name in (0, 1); the least bid wins. A new shard only takes the keys it wins, and a
shard that goes only gives its own away. Text is read once and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressmill.llm.common import frozen

ROWS_PER_BLOCK = 65536


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Number of the shard that wins a key; NULL keys count as the empty text.

    ``weights`` are those of shards 0, 1, ...; a weight of 0 never wins unless all are 0.
    """
    key = F.coalesce(key.cast("string"), F.lit(""))
    bids = []
    for shard, weight in enumerate(weights):
        bits = F.xxhash64(key, F.lit(f"shard {shard}")).bitwiseAND((1 << 53) - 1)
        bid = -F.log((bits + 0.5) / float(1 << 53)) / float(weight) if weight > 0 else F.lit(float("inf"))
        bids.append(F.struct(bid.alias("bid"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*bids))["shard"]


def numbered(rows: DataFrame, group: str, number: str) -> DataFrame:
    """Gapless numbers from 0 within each value of ``group``, in the order of a hash of the row.

    Groups are cut into blocks by the leading bits of the hash and the blocks
    counted, so the rows of one group are numbered by many tasks; where the cuts
    lie doesn't change the numbers. Repeated rows are counted before they are
    shuffled and dealt out after.
    """
    spark = rows.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = (max(least, rows.count() // ROWS_PER_BLOCK) - 1).bit_length()
    counted = rows.groupBy(*[F.col(f"`{name}`") for name in rows.columns]).agg(F.count(F.lit(1)).alias("copies"))
    mixed = counted.withColumn("mixed", F.xxhash64(*[F.col(f"`{name}`") for name in rows.columns]))
    block = F.shiftright("mixed", 64 - bits) if bits else F.lit(0)
    placed = frozen(mixed.withColumn("block", block.cast("int")))
    within = Window.partitionBy(group, "block").orderBy("mixed", *[f"`{name}`" for name in rows.columns])
    upto = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = placed.groupBy(group, "block").agg(F.sum("copies").alias("held"))
    before = Window.partitionBy(group).orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = blocks.select(group, "block", (F.sum("held").over(before) - F.col("held")).alias("start"))
    first = F.sum("copies").over(upto) - F.col("copies")
    lined = placed.withColumn("first", first).join(starts, [group, "block"])
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    dealt = lined.select(*[f"`{name}`" for name in rows.columns], (F.col("first") + F.col("start")).alias("from"), copy.alias("copy"))
    return dealt.select(*[f"`{name}`" for name in rows.columns], (F.col("from") + F.col("copy")).alias(number))


def shard_documents(docs: DataFrame, weights: list[float], grown: list[float] | None = None) -> DataFrame:
    """Shard and slot of every row of ``docs``, by ``doc_id``.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. A NULL id
    goes where the empty key goes, a NULL text has size 1 and the checksum of the
    empty text. Repeated rows share a shard and have slots of their own. With
    ``grown``, the weights after a change, ``grown_shard`` tells where the row
    would be then. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    moved = rendezvous(F.col("doc_id"), grown) if grown else F.lit(None).cast("int")
    rows = frozen(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            rendezvous(F.col("doc_id"), weights).alias("shard"),
            moved.alias("grown_shard"),
        )
    )
    return numbered(rows, "shard", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
