"""Stages that keep what they must remember in Spark's own stream state.

The state lies in the checkpoint of its query: a restart goes on with it, and a
batch that runs again finds it as it was before that batch.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pressmill.operators.politeness import PERIOD_MICROS

SLOT_STATE = "slot long"


def unique_issues(issues: DataFrame, arrived: str | None = None, within: str | None = None) -> DataFrame:
    """Each issue number of a stream once, over all its files and restarts.

    The state holds a number per issue. With ``arrived`` (a timestamp column) and
    ``within`` (a length of time) numbers are forgotten that long after they came,
    so that the state is bounded where repeats come soon. Rows without a number go.
    """
    known = issues.filter(F.col("num").isNotNull())
    if arrived is None or within is None:
        return known.dropDuplicates(["num"])
    return known.withWatermark(arrived, within).dropDuplicatesWithinWatermark(["num"])


def slots(requests: DataFrame, period: int = PERIOD_MICROS, lateness: str | None = None) -> DataFrame:
    """Requests of a stream with the ``slot`` of each, at most one per domain and period.

    ``requests`` has ``domain``, ``at_micros`` and ``request_id``. What a batch
    brings of a domain is put in order of time and id behind the slots given out
    before. A task holds the times and ids of a domain's requests in one batch,
    which the size of batches bounds (``maxFilesPerTrigger``). The state is the
    last slot of each domain. With ``lateness`` a domain is forgotten when the
    watermark, so far behind the latest request, has passed its last slot and
    period; requests behind the watermark are dropped then. NULL domains and times
    have no slot and go.
    """
    fields = [requests.schema[name] for name in ("domain", "at_micros", "request_id")]
    schema = T.StructType([*fields, T.StructField("slot", T.LongType())])
    known = requests.filter(F.col("domain").isNotNull() & F.col("at_micros").isNotNull()).select(*[f.name for f in fields])
    timers = GroupStateTimeout.NoTimeout
    if lateness is not None:
        known = known.withColumn("at", F.timestamp_micros("at_micros")).withWatermark("at", lateness)
        timers = GroupStateTimeout.EventTimeTimeout

    def give(key: tuple, parts: Iterator, state: GroupState) -> Iterator:
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat([part[["domain", "at_micros", "request_id"]] for part in parts], ignore_index=True)
        rows = rows.sort_values(["at_micros", "request_id"], kind="stable", ignore_index=True)
        steps = np.arange(len(rows), dtype="int64") * period
        lead = rows["at_micros"].to_numpy("int64") - steps
        if state.exists:
            lead[0] = max(lead[0], state.get[0] + period)
        given = np.maximum.accumulate(lead) + steps
        state.update((int(given[-1]),))
        if lateness is not None:
            state.setTimeoutTimestamp(max((int(given[-1]) + period) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield rows.assign(slot=given)

    return known.groupBy("domain").applyInPandasWithState(give, schema, SLOT_STATE, "append", timers)


def stream_slots(
    requests: DataFrame, out: str, checkpoint: str, period: int = PERIOD_MICROS, lateness: str | None = None
) -> StreamingQuery:
    """The rows of ``slots`` as a table."""
    made = slots(requests, period, lateness)
    writer = made.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
