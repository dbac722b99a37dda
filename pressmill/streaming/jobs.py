"""The same stages on streams.

Row-wise stages run on the stream itself. Stages that look at what is stored
run per batch against the stored table, so what earlier runs did is known from
the output alone and a batch that is run again changes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from pressmill.operators.extraction import extract_articles
from pressmill.operators.incremental import first_by_key, skip_existing_issues
from pressmill.operators.markdown import with_markdown
from pressmill.operators.nearest import K
from pressmill.operators.politeness import PERIOD_MICROS, schedule
from pressmill.operators.routing import NEEDS_SCRIPT, route
from pressmill.plans.ask import ask
from pressmill.plans.corpus import article_markdown
from pressmill.plans.index import append_documents
from pressmill.session import frozen, released, sparing_disk
from pressmill.sources.tables import read_table
from pressmill.sources.writers import forget_before, save_articles, save_batch, save_whole_batch, state_before


def read_stream(
    spark: SparkSession, path: str, schema: StructType, glob: str = "*.parquet"
) -> DataFrame:
    """New parquet files of a landing folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(path)


def read_table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The parquet files of a table, be it one file or a folder of them, and those that come to it later."""
    # as a pattern: Spark takes a plain path of a stream for a folder
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def _run(rows: DataFrame) -> str:
    """The id of the running query, which its checkpoint keeps over restarts."""
    return rows.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


def _start(writer, checkpoint: str) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_markdown(pages: DataFrame, out: str, checkpoint: str, **routing) -> StreamingQuery:
    """Landed pages to routed pages with Markdown, row by row."""
    made = with_markdown(route(pages, **routing))
    return _start(made.writeStream.format("parquet").option("path", out), checkpoint)


def stream_index(documents: DataFrame, table: str, checkpoint: str, read_once: bool = False, **cut) -> StreamingQuery:
    """New documents into the vector table, each chunk once.

    With ``read_once`` a batch is written as a table before it is worked on, as small files
    are dear to read twice.
    """

    def batch(rows: DataFrame, _: int) -> None:
        if not read_once:
            return append_documents(rows, table, **cut)
        rows = frozen(rows)
        append_documents(rows, table, **cut)
        released(rows)

    return _start(documents.writeStream.foreachBatch(batch), checkpoint)


def stream_answers(
    queries: DataFrame, table: str, out: str, checkpoint: str, k: int = K
) -> StreamingQuery:
    """Prompts for questions as they come, against the table as it stands.

    Batches lie under the run of their checkpoint, so a new one adds to what
    earlier ones left.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        index = read_table(rows.sparkSession, table)
        if index is None:
            raise ValueError(f"no vector table at {table}")
        save_batch(ask(rows, index, k), out, batch_id, _run(rows))

    return _start(queries.writeStream.foreachBatch(batch), checkpoint)


def stream_issues(
    issues: DataFrame, table: str, checkpoint: str, force_all: bool = False
) -> StreamingQuery:
    """Articles of issue pages as they land, leaving out issues already stored."""

    def batch(rows: DataFrame, _: int) -> None:
        stored = read_table(rows.sparkSession, table)
        if stored is not None:
            rows = skip_existing_issues(rows, stored, force_all=force_all)
        # a batch may hold the page of an issue twice
        articles = extract_articles(first_by_key(rows, ["num"])).withColumn("markdown", F.lit(""))
        save_articles(articles, table)

    return _start(issues.writeStream.foreachBatch(batch), checkpoint)


def stream_corpus(
    issues: DataFrame, landed: str, rendered: str, table: str, state: str, checkpoint: str, force_all: bool = False
) -> StreamingQuery:
    """Articles of issue pages as they land, with the text of the pages landed by then.

    ``landed`` and ``rendered`` are tables of ``url`` and ``html`` that each batch
    reads as they stand. An issue counts as done, and is left out from then on,
    only when every article has its page, or its second copy where it needs one.
    Others are stored with what there is and kept in ``state``; each batch, and
    each call before its first batch, works on them again. What a batch writes and
    shuffles on the way goes as soon as it has been used.
    """
    spark, names = issues.sparkSession, ["num", "item_of", "html"]

    def work(rows: DataFrame, batch_id: int, run: str) -> None:
        seen, used = state_before(spark, f"{state}/waiting", run, batch_id)
        done = read_table(spark, f"{state}/done")
        rows = rows.select(*names)
        if done is not None and not force_all:
            rows = rows.join(done.select("num").distinct(), "num", "left_anti")
        if seen is not None:
            seen = seen.select(*names)
            if done is not None:
                seen = seen.join(done.select("num").distinct(), "num", "left_anti")
            rows = rows.unionByName(seen)
        rows = frozen(first_by_key(rows.filter("num is not null"), ["num"]))
        if rows.isEmpty():
            released(rows)
            return  # what an earlier batch left to wait has been done since, and is filtered again
        page = spark.createDataFrame([], "url string, html string")
        first, second = [read_table(spark, path) for path in (landed, rendered)]
        first = page if first is None else first.select("url", "html")
        second = page if second is None else second.select("url", "html")
        extracted = frozen(extract_articles(rows))
        articles = frozen(article_markdown(extracted, first, second))
        released(extracted)
        again = second.filter("html is not null").select("url").distinct()
        missing = articles.filter((F.col("route") == NEEDS_SCRIPT) & F.col("url").isNotNull())
        missing = frozen(missing.join(again, "url", "left_anti").select(F.col("issue_num").alias("num")).distinct())
        save_articles(articles, table)
        released(articles)
        # new rows only: a batch that is run again finds what it left and adds the same
        save_batch(rows.join(missing, "num", "left_anti").select("num"), f"{state}/done", batch_id, run)
        save_whole_batch(rows.join(missing, "num", "left_semi"), f"{state}/waiting", batch_id, run)
        released(rows, missing)
        forget_before(spark, f"{state}/waiting", run, batch_id, used)

    if (kept := read_table(spark, f"{state}/waiting")) is not None:
        with sparing_disk(spark):
            work(kept.select(*names).limit(0), 0, f"retry-{uuid.uuid4().hex}")

    def batch(rows: DataFrame, batch_id: int) -> None:
        with sparing_disk(rows.sparkSession):
            work(rows, batch_id, _run(rows))

    return _start(issues.writeStream.foreachBatch(batch), checkpoint)


def stream_schedule(
    requests: DataFrame, out: str, state: str, checkpoint: str, period: int = PERIOD_MICROS
) -> StreamingQuery:
    """Slots for requests as they come; the last slot of each domain is kept.

    The state is written whole under each batch's run and number, from the state
    the last batch before left; a new checkpoint goes on from what earlier ones
    left. States that no batch can need any more are removed. ``slots`` of
    ``stateful`` keeps the same in the state of the stream itself.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark, run = rows.sparkSession, _run(rows)
        here = f"run={run}/batch_id={batch_id}"
        if rows.isEmpty():
            return
        last, used = state_before(spark, state, run, batch_id)
        last = last.groupBy("domain").agg(F.max("slot").alias("slot")) if last is not None else None
        slots = schedule(rows, period=period, last_slots=last)
        save_batch(slots, out, batch_id, run)
        given = spark.read.schema(slots.schema).parquet(f"{out}/{here}").select("domain", "slot")
        known = given if last is None else given.unionByName(last)
        save_whole_batch(known.groupBy("domain").agg(F.max("slot").alias("slot")), state, batch_id, run)
        forget_before(spark, state, run, batch_id, used)

    return _start(requests.writeStream.foreachBatch(batch), checkpoint)
