"""When each request may go out, at most one per domain and period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pressmill.session import frozen

PERIOD_MICROS = 1_000_000
ROWS_PER_RANGE = 500_000


def schedule(
    requests: DataFrame,
    domain: str = "domain",
    at: str = "at_micros",
    request_id: str = "request_id",
    period: int = PERIOD_MICROS,
    last_slots: DataFrame | None = None,
    slices: int | None = None,
) -> DataFrame:
    """Add ``slot``: the later of the request's time and the domain's last slot
    plus the period, in microseconds.

    The n-th slot of a domain is the running maximum of ``time - n * period``
    plus ``n * period``. It is taken in two steps: the requests are cut into
    ranges of (domain, time, id) of like size whatever the domains hold, each
    range has its own running maximum, and the ranges of a domain, as many as
    there are partitions at most, pass on count and maximum. The cut is frozen
    so that both steps see the same ranges. ``last_slots(domain, slot)`` names
    the slots given out by earlier runs.
    """
    if last_slots is not None:
        earliest = last_slots.groupBy(domain).agg((F.max("slot") + F.lit(period).cast("long")).alias("_from"))
        requests = (
            requests.join(earliest, domain, "left")
            .withColumn("_ready", F.greatest(F.col(at), F.coalesce("_from", F.col(at))))
            .drop("_from")
        )
    else:
        requests = requests.withColumn("_ready", F.col(at))
    step = F.lit(period).cast("long")
    least = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    count = slices or max(least, requests.count() // ROWS_PER_RANGE)
    cut = frozen(
        requests.repartitionByRange(count, domain, at, request_id).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    order = Window.partitionBy(domain, "_slice").orderBy(at, request_id)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = cut.withColumn("_n", F.row_number().over(order) - 1).withColumn(
        "_lead", F.max(F.col("_ready") - F.col("_n") * step).over(so_far)
    )
    before = Window.partitionBy(domain).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        numbered.groupBy(domain, "_slice")
        .agg(F.count("*").alias("_rows"), F.max("_lead").alias("_peak"))
        .withColumn("_offset", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
        .withColumn("_peak", F.col("_peak") - F.col("_offset") * step)
        .withColumn("_carry", F.max("_peak").over(before))
        .select(domain, "_slice", "_offset", "_carry")
    )
    shift = F.col("_offset") * step
    return (
        numbered.join(ranges, [domain, "_slice"])
        .withColumn(
            "slot",
            F.greatest(F.col("_lead") - shift, F.coalesce("_carry", F.col("_lead") - shift))
            + (F.col("_offset") + F.col("_n")) * step,
        )
        .drop("_ready", "_slice", "_n", "_lead", "_offset", "_carry")
    )
