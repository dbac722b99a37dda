"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import frozen, released


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least node of its star."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    return (
        both.filter("b > a")
        .join(least, "a")
        .select(F.col("b").alias("a"), F.least("a", "least").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below are tied to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    tied = edges.join(least, "a").filter("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return tied.unionByName(least.select("a", F.col("least").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node with an edge.

    ``edges`` has two columns of one orderable type; NULL ends and loops are left
    out, edges may repeat and go either way. No edges: no rows. A node's
    neighbours are only ever aggregated and joined, never gathered in one row.
    Each round is written to the shared folder, so a lost executor costs one
    round; their number is logarithmic in the size of the components.
    """
    left, right = (F.col(f"`{name}`") for name in edges.columns[:2])
    edges = edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"), left.isNull().alias("l"), right.isNull().alias("r"))
    edges = frozen(edges.filter("not l and not r and a <> b").select("a", "b").distinct())
    digest = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = None
    while True:
        last, edges = edges, frozen(_small_star(_large_star(edges)))
        released(last)
        now = edges.agg(digest.alias("d")).first()["d"]
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    found._frozen_at = edges._frozen_at  # so that ``released`` removes what it reads
    return found
