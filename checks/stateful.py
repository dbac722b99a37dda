"""Registered streams that keep state, beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.oracles import SLOTS
from checks.queries import SLOT_PERIOD, files_each, issue_pages, requests, scratch
from pressmill.streaming import stateful

FILES = 4


def stream_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests landed in files one after the other in time, a batch each, the last after a restart."""
    out = scratch(spark, "stream-slots")
    asked = requests(spark, sf_dir)
    ends = asked.agg(F.min("at_micros").alias("low"), F.max("at_micros").alias("high")).first()
    width = (ends["high"] - ends["low"]) // FILES + 1 if ends["low"] is not None else 1
    for file in range(FILES):
        low = (ends["low"] or 0) + file * width
        part = asked.filter((F.col("at_micros") >= low) & (F.col("at_micros") < low + width))
        part.coalesce(1).write.mode("append").parquet(f"{out}/landed")
        if file >= FILES - 2:
            stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/landed")
            stateful.stream_slots(stream, f"{out}/slots", f"{out}/log", SLOT_PERIOD).awaitTermination()
    return spark.read.parquet(f"{out}/slots").select("domain", "at_micros", "request_id", "slot")


def stream_unique_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issue pages that land twice over, in several files and again after a restart."""
    out = scratch(spark, "stream-unique")
    pages = issue_pages(spark, sf_dir).select("num", "html")
    for again in range(2):
        each = files_each(spark, sf_dir, 3 + again)
        pages.repartition((3 + again) * each).write.mode("append").parquet(f"{out}/landed")
        stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 2 * each).parquet(f"{out}/landed")
        made = stateful.unique_issues(stream)
        writer = made.writeStream.format("parquet").option("path", f"{out}/issues").option("checkpointLocation", f"{out}/log")
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/issues").select("num")


QUERIES = [stream_slots, stream_unique_issues]
ORACLES = {
    "stream_slots": SLOTS,
    "stream_unique_issues": "SELECT DISTINCT CAST(doc_id // 16 AS INTEGER) AS num FROM documents",
}
