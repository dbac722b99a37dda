"""Sparse vectors of hashed words, weighted by how rare the words are in a corpus.

A word's place is a hash into ``buckets`` places. Its weight in a document is its
count times ln((documents + 1) / (documents with the place + 1)), and the vector is
scaled to length one. What the weights need of the corpus, documents by place, is a
table that every load adds its own counts to; it has at most ``buckets`` rows a
load, so that it can be sent to the tasks that make vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pressmill.functions.markdown import words
from pressmill.functions.vectors import bucket
from pressmill.sources.tables import read_table

BUCKETS = 1 << 18
#: The place under which a load counts its documents.
ALL = -1


def term_counts(documents: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """``key``, ``place`` and ``count`` of the words of every document.

    Rows with the same key are one document. NULL keys, NULL texts and texts
    without words give no rows.
    """
    # the texts are dealt by key, so that their words, far more and larger, need not be
    dealt = documents.filter(F.col(key).isNotNull()).select(key, text).repartition(key)
    found = dealt.select(F.col(key), F.explode(words(F.col(text))).alias("word"))
    # words first: a place is computed once per document and word
    counted = found.groupBy(key, "word").agg(F.count(F.lit(1)).alias("count"))
    return counted.groupBy(key, bucket(F.col("word"), buckets).cast("int").alias("place")).agg(F.sum("count").alias("count"))


def document_counts(documents: DataFrame, terms: DataFrame, key: str) -> DataFrame:
    """``place`` and ``documents`` that have a word there; under ``ALL`` how many there are, those without words too."""
    found = terms.groupBy("place").agg(F.count(F.lit(1)).alias("documents"))
    total = documents.filter(F.col(key).isNotNull()).agg(F.count_distinct(key).alias("documents"))
    return found.unionByName(total.select(F.lit(ALL).alias("place"), "documents"))


def save_counts(counts: DataFrame, path: str, load: str) -> None:
    """Adds the counts of a load to a table; a load that is run again replaces what it added."""
    (
        counts.withColumn("load", F.lit(load))
        .coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("load")
        .parquet(path)
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts of all loads together; none where there is no table. Loads must not share documents."""
    found = read_table(spark, path)
    if found is None:
        return spark.createDataFrame([], "place int, documents long")
    return found.groupBy("place").agg(F.sum("documents").alias("documents"))


def rarity(counts: DataFrame) -> DataFrame:
    """``place`` and its ``weight``; places that the counts don't have are missing."""
    total = counts.filter(F.col("place") == ALL).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("total"))
    weight = F.log((F.col("total") + 1) / (F.col("documents") + 1))
    return counts.filter(F.col("place") != ALL).join(F.broadcast(total)).select("place", weight.alias("weight"), "total")


def weighted_terms(terms: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """``key``, ``place`` and ``weight`` of every term whose weight isn't zero, vectors scaled to length one.

    A place that the counts don't have weighs as if no document had it. Vectors of
    words that every document has are empty.
    """
    total = counts.filter(F.col("place") == ALL).agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("total"))
    known = rarity(counts).select("place", F.col("weight").alias("rare"))
    # at most ``buckets`` rows, and one row
    joined = terms.join(F.broadcast(known), "place", "left").join(F.broadcast(total))
    weight: Column = F.col("count") * F.coalesce("rare", F.log(F.col("total") + 1))
    made = joined.select(key, "place", weight.alias("weight")).filter("weight <> 0")
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(key)))
    return made.select(key, "place", (F.col("weight") / length).alias("weight"))


def sparse_vectors(weighted: DataFrame, key: str) -> DataFrame:
    """``key``, ``places`` (ascending) and ``weights`` of each document; a row holds one document's words."""
    pairs = F.sort_array(F.collect_list(F.struct("place", "weight")))
    found = weighted.groupBy(key).agg(pairs.alias("pairs"))
    return found.select(key, F.col("pairs.place").alias("places"), F.col("pairs.weight").alias("weights"))


def embed_weighted(documents: DataFrame, counts: DataFrame, key: str, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """Sparse vectors of documents by the counts of a corpus."""
    return sparse_vectors(weighted_terms(term_counts(documents, key, text, buckets), counts, key), key)
