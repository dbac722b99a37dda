"""Counters of streams: rows and bytes of text per stage, told by Spark while they pass.

A stage is marked by ``counted``; no job, shuffle or second read is added. The
numbers of each batch come with its progress to a listener, which keeps a batch
that is told of twice, or run again after a restart, once.
"""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "stage string, counter string, n long"


def counted(rows: DataFrame, stage: str, **counters: Column) -> DataFrame:
    """The same rows; ``rows``, and each named sum of a column, is observed as they pass."""
    sums = [F.coalesce(F.sum(what.cast("long")), F.lit(0).cast("long")).alias(name) for name, what in counters.items()]
    return rows.observe(stage, F.count(F.lit(1)).alias("rows"), *sums)


class StreamCounts(StreamingQueryListener):
    """Sums of what the stages of all queries of a session observed, by query and batch.

    Add it with ``spark.streams.addListener`` before the queries start. What is
    kept in the driver is one number per query, batch and counter; ``forget``
    folds the batches of a query that has ended into its sums.
    """

    def __init__(self) -> None:
        self._found: dict[tuple[str, int, str, str], int] = {}
        self._folded: dict[tuple[str, str, str], int] = {}
        self._ended: set[str] = set()
        self._told = threading.Condition()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        with self._told:
            for stage, row in progress.observedMetrics.items():
                for counter, n in row.asDict().items():
                    self._found[str(progress.id), progress.batchId, stage, counter] = int(n or 0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._told:
            self._ended.add(str(event.runId))
            self._told.notify_all()

    def settle(self, queries: Iterable[StreamingQuery], seconds: float = 60.0) -> None:
        """Wait until all has arrived that ended queries had to tell; events come some time after."""
        asked = {str(query.runId) for query in queries}
        with self._told:
            if not self._told.wait_for(lambda: asked <= self._ended, seconds):
                raise TimeoutError(f"no end of {sorted(asked - self._ended)} within {seconds} s")

    def forget(self, query_id: str) -> None:
        """Keep the sums of a query but not its batches, which then can't be told twice any more."""
        with self._told:
            for key in [key for key in self._found if key[0] == query_id]:
                place = (key[0], key[2], key[3])
                self._folded[place] = self._folded.get(place, 0) + self._found.pop(key)

    def totals(self) -> dict[tuple[str, str], int]:
        """Sums over all queries and batches by stage and counter."""
        out: dict[tuple[str, str], int] = {}
        with self._told:
            for (_, _, stage, counter), n in self._found.items():
                out[stage, counter] = out.get((stage, counter), 0) + n
            for (_, stage, counter), n in self._folded.items():
                out[stage, counter] = out.get((stage, counter), 0) + n
        return out

    def report(self, spark: SparkSession) -> DataFrame:
        """``stage``, ``counter`` and ``n``, a row a counter."""
        rows = [(stage, counter, n) for (stage, counter), n in sorted(self.totals().items())]
        return spark.createDataFrame(rows, SCHEMA)
