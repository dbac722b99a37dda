"""Supervised subword embeddings that tell good documents from bad ones.

A document's features are its words, their character 3- and 4-grams within word
ends, and a mark for a word that repeats the one before; each is hashed to one of
``BUCKETS`` learned vectors. Their average goes through a softmax layer of two
classes. All is trained by stochastic gradient descent in numpy on a bounded
sample of labelled documents; what the softmax sees of a feature is one number,
so the scoring tasks get one number a bucket.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pressmill.llm.common import crc_remainder, frozen, record_batch

BUCKETS = 1 << 18
DIMENSION = 16
EPOCHS = 10
RATE = 2.0
SAMPLE = 3000
FOLDS, HELD_OUT = 3, 1
#: Words a scoring worker remembers, and characters of the longest of them.
REMEMBERED, LONGEST = 400_000, 64
ALWAYS, REPEAT = 0, 1


def word_features(word: str) -> Iterator[int]:
    """Buckets of a word: itself and its character n-grams, ends marked; one after the other, as words may be megabytes."""
    marked = f"<{word}>"
    for size in (len(marked), 3, 4):
        for at in range(len(marked) - size + 1):
            yield zlib.crc32(marked[at : at + size].encode("utf-8", "surrogatepass")) % (BUCKETS - 2) + 2


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text in ascending order, and how often it has each; every text has ``ALWAYS``."""
    words = text.split()
    counts: Counter = Counter({ALWAYS: 1})
    repeats = sum(map(eq, words, words[1:]))
    if repeats:
        counts[REPEAT] = 8 * repeats
    for word, times in Counter(words).items():
        for bucket in word_features(word):
            counts[bucket] += times
    buckets = np.array(sorted(counts), dtype=np.uint32)
    return buckets, np.array([counts[b] for b in buckets.tolist()], dtype=np.float32)


def train(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 11) -> np.ndarray:
    """The log odds of class 1 that each bucket adds; all zero where there is nothing to learn from.

    Plain stochastic gradient descent, one document a step, with a rate that
    falls to zero; the order is drawn from a fixed seed.
    """
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.5 / DIMENSION, 0.5 / DIMENSION, (BUCKETS, DIMENSION)).astype(np.float32)
    output = rng.normal(0, 0.1, (2, DIMENSION)).astype(np.float32)
    bound = len(examples) * epochs
    for step in range(bound):
        if step % len(examples) == 0:
            order = rng.permutation(len(examples))
        buckets, counts, label = examples[order[step % len(examples)]]
        share = counts / counts.sum()
        own = vectors[buckets]
        mean = share @ own
        odds = np.exp(output @ mean - (output @ mean).max())
        error = odds / odds.sum()
        error[label] -= 1
        now = rate * (1 - step / bound)
        back = error @ output
        output -= 0.05 * now * np.outer(error, mean)
        # the average over n features shrinks their steps by n; the square root of n is given back
        vectors[buckets] = own - now * np.float32(len(share) ** 0.5) * share[:, None] * back
    return (vectors @ (output[1] - output[0])).astype(np.float32) if examples else np.zeros(BUCKETS, dtype=np.float32)


class Scorer:
    """Probability of class 1 for texts; words are hashed once while remembered."""

    def __init__(self, odds: np.ndarray, remembered: int = REMEMBERED):
        self.odds, self.remembered = odds.astype(np.float64), remembered
        self.words: dict[str, complex] = {}

    def __call__(self, texts: list[str]) -> list[float]:
        return [self.score(text) for text in texts]

    def score(self, text: str) -> float:
        words = text.split()
        known, odds = self.words, self.odds
        missing = set(words).difference(known)
        if len(known) + len(missing) > self.remembered:
            known.clear()
            missing = set(words)
        for word in missing:
            buckets = np.fromiter(word_features(word), np.uint32)
            known[word] = complex(float(odds[buckets].sum()), len(buckets))
        total = sum(map(known.__getitem__, words), complex(float(odds[ALWAYS]), 1))
        repeats = 8 * sum(map(eq, words, words[1:]))
        total += complex(float(odds[REPEAT]) * repeats, repeats)
        for word in missing:
            if len(word) > LONGEST:
                del known[word]
        return float(1 / (1 + np.exp(-np.clip(total.real / total.imag, -700, 700))))


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """The model learned from labelled rows outside the held-out fold.

    ``docs`` needs ``doc_id`` and ``text``, ``labels`` needs ``doc_id`` and
    ``quality``; rows with a NULL there teach nothing. At most ``sample``
    documents are used, those with the least hash of their id and text; they are
    turned to features in the tasks. Of several labels of one id the least counts;
    repeated rows teach once, and the driver gets one row of each.
    """
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marked = marked.filter(crc_remainder(F.col("doc_id"), FOLDS) != HELD_OUT)
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("string"), text).alias("order"))
    chosen = texts.filter("text is not null").join(marked, "doc_id").select("doc_id", "order", "quality").distinct()
    # a share of the hashes first, so that tasks send few rows; then no more than asked for
    share = min(1.0, 1.5 * sample / max(1, marked.count()))
    least = min((1 << 63) - 1, -(1 << 63) + int(share * (1 << 64)))
    chosen = frozen(chosen.filter(F.col("order") <= least).orderBy("order", "doc_id").limit(sample))
    own = texts.join(chosen.select("doc_id", "order", "quality"), ["doc_id", "order"])
    own = own.select(F.col("doc_id").cast("long").alias("doc_id"), "order", "quality", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("order", pa.int64()), ("quality", pa.int32()), ("buckets", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # no more than ``sample``
        for batch in batches:
            keys = list(zip(batch.column("doc_id").to_pylist(), batch.column("order").to_pylist(), strict=True))
            first = [at for at, key in enumerate(keys) if key not in seen and not seen.add(key)]
            batch = batch.take(pa.array(first, pa.int64()))
            found = [document_features(value) for value in batch.column("text").to_pylist()]
            columns = [[b.astype("<u4").tobytes() for b, _ in found], [c.astype("<f4").tobytes() for _, c in found]]
            yield record_batch(schema, [batch.column("doc_id"), batch.column("order"), batch.column("quality"), *columns])

    made = own.mapInArrow(run, "doc_id long, order long, quality int, buckets binary, counts binary")
    rows = made.dropDuplicates(["doc_id", "order"]).toArrow().sort_by([("order", "ascending"), ("doc_id", "ascending")])
    examples = [
        (np.frombuffer(buckets, "<u4"), np.frombuffer(counts, "<f4"), quality)
        for buckets, counts, quality in zip(rows.column("buckets").to_pylist(), rows.column("counts").to_pylist(), rows.column("quality").to_pylist(), strict=True)
    ]
    return train(examples)


def quality_score(text: Column, odds: np.ndarray) -> Column:
    """Probability that a text is good; NULL counts as empty. The model has one number a bucket."""
    data, held = odds.astype("<f4").tobytes(), []

    @F.arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        if not held:
            held.append(Scorer(np.frombuffer(data, "<f4")))
        return pa.array(held[0]([value or "" for value in column.to_pylist()]), pa.float64())

    return scored(text.cast("string"))


def scored_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row of ``docs``.

    Scores come from the text alone. Empty and NULL texts get the score of a text
    without words. Repeated rows come out as often as they went in; other columns
    are ignored. Without labels every score is 0.5.
    """
    odds = fitted(docs, labels, sample)
    held_out = crc_remainder(F.col("doc_id"), FOLDS) == HELD_OUT
    rows = docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), quality_score(F.col("text"), odds).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that score 0.5 or more."""
    return docs.filter(quality_score(F.col("text"), fitted(docs, labels, sample)) >= 0.5)
