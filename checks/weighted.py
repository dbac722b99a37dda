"""Registered weighted vectors beside their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.queries import named_documents, scratch
from pressmill.operators import weighted_vectors as w
from pressmill.operators.vectors import embed_with

BUCKETS = 1 << 16


def document_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights by the counts of two loads, of which the second ran twice."""
    documents = named_documents(spark, sf_dir)
    first = F.substring("path", -1, 1).isin(*"01234")
    folder = scratch(spark, "counts")
    for load, part in [("a", first), ("b", ~first), ("b", ~first)]:
        rows = documents.filter(part)
        w.save_counts(w.document_counts(rows, w.term_counts(rows, "path", buckets=BUCKETS), "path"), folder, load)
    made = w.embed_weighted(documents, w.read_counts(spark, folder), "path", buckets=BUCKETS)
    pairs = made.select("path", F.explode(F.arrays_zip("places", "weights")).alias("one"))
    return pairs.select("path", F.col("one.places").alias("place"), F.round("one.weights", 6).alias("weight"))


def letter_shares():
    """A stand-in for a model: shares of five letters in each text."""
    return lambda texts: [[(text or "").count(letter) / max(1, len(text or "")) for letter in "aeiou"] for text in texts]


def model_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a model of the caller's for every document."""
    made = embed_with(named_documents(spark, sf_dir), letter_shares)
    return made.select("path", F.posexplode("embedding").alias("at", "share")).select(
        "path", "at", F.round(F.col("share").cast("double"), 6).alias("share")
    )


QUERIES = [document_weights, model_vectors]
ORACLES = {
    "document_weights": f"""
WITH found AS (
  SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{Nd}}]+')) AS word FROM documents),
terms AS (
  SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 8))::BIGINT % {BUCKETS} AS INTEGER) AS place, count(*) AS n FROM found GROUP BY 1, 2),
rare AS (
  SELECT place, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) AS r FROM terms GROUP BY 1),
made AS (SELECT doc_id, place, n * r AS v FROM terms JOIN rare USING (place) WHERE r <> 0)
SELECT printf('d%08d', doc_id) AS path, place, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS weight FROM made""",
    "model_vectors": """
SELECT printf('d%08d', doc_id) AS path, CAST(i AS INTEGER) AS at,
  round(CAST((length(text) - length(replace(text, substr('aeiou', CAST(i + 1 AS INTEGER), 1), ''))) / greatest(1, length(text)) AS FLOAT)::DOUBLE, 6) AS share
FROM documents, range(5) r(i)""",
}
