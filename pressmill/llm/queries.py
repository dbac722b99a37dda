"""The operators applied to the given tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pressmill.llm import decontamination, hmm, merkle, packing, pieces, quality, sharding, simhash, token_counts, token_store, url_filter, weighted_sampling, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_sampling.fingerprint_pairs(table(spark, sf_dir, "documents"))


def op5_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), [1.0] * 8, [1.0] * 9)


END_OF_TEXT = 50256  # no text has it, as special strings are ordinary text to the encoder


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted_documents(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), END_OF_TEXT)


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op7_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(name,) for name in url_filter.BLOCKED_DOMAINS], "key string")
    return url_filter.judge_pages(table(spark, sf_dir, "pages"), listed, URL_RULES)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


BYTE_BPE = "byte_bpe_50k.json"
END = 2


def tokenizer_file(name: str) -> str:
    """Where this machine has a public vocabulary file; on a cluster all have it at one place."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.stored_documents(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE), END)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored_documents(table(spark, sf_dir, "documents"))


PIECE_BPE = "piece_bpe_32k.model"


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_documents(table(spark, sf_dir, "documents"), tokenizer_file(PIECE_BPE))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), tokenizer_file(BYTE_BPE))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_documents(table(spark, sf_dir, "documents"))


QUERIES = [
    op1_simhash,
    op2_weighted_sampling,
    op3_quality,
    op4_token_store,
    op5_rendezvous,
    op6_separator_scan,
    op7_bloom_cascade,
    op8_hidden_markov,
    op9_sentencepiece,
    op10_decontamination,
    op11_packing,
    op12_whitening,
    op13_merkle_manifest,
]


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: query for query in QUERIES}
