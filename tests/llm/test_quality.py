import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from pressmill.llm import quality

DATA = "/root/testdata/sf0.01"


def test_scorer_equals_plain_sums():
    rng = np.random.default_rng(0)
    odds = rng.normal(0, 3, quality.BUCKETS).astype(np.float32)
    texts = ["", " ", "one", "one one one", "Ünder the\nÜnder the", "x" * 50000, " ".join(random.Random(1).choices("abcdefg", k=3000))]
    for remembered in (10**6, 3):
        got = quality.Scorer(odds, remembered)(texts)
        for text, score in zip(texts, got, strict=True):
            buckets, counts = quality.document_features(text)
            odd = float((odds[buckets].astype(float) * counts).sum() / counts.sum())
            assert abs(score - 1 / (1 + np.exp(-odd))) < 1e-6


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{name}.parquet") for name in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.scored_documents(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for d, r in rows.items())
    held = [(rows[r.doc_id].predicted, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    # labels of the held-out fold teach nothing
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.scored_documents(docs, turned).collect()}
    assert again == {d: r.score for d, r in rows.items()}


def test_odd_rows(spark):
    good = [(n, "plain words make a fine text", n) for n in range(40)]
    bad = [(100 + n, "### $$$ spam spam spam", n) for n in range(40)]
    odd = [(500, None, 1), (501, "", 1), (None, "plain words", 1), (502, "word " * 60000, 1), good[0], good[0]]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i < 100), "x") for i, _, _ in good + bad] + [(500, 1, "x"), (None, 0, "x"), (501, None, "x"), (3, 1, "x")], "doc_id long, quality int, text string")
    got = quality.scored_documents(docs, labels).collect()
    assert len(got) == 86
    assert all(r.predicted == int(r.doc_id < 100) for r in got if r.doc_id is not None and r.doc_id < 500)
    assert {r.doc_id: r.score for r in got}[500] == {r.doc_id: r.score for r in got}[501]
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and all(r.doc_id is None or r.doc_id < 100 or r.doc_id >= 500 for r in kept.collect())
    assert quality.scored_documents(docs.limit(0), labels).collect() == []
    assert {r.score for r in quality.scored_documents(docs, labels.limit(0)).collect()} == {0.5}


def test_repeated_rows_teach_once(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "same words")] * 2000 + [(0, "other words"), (1, "more words")], "doc_id long, text string").repartition(7)
    labels = spark.createDataFrame([(0, 0), (1, 1), (1, 1)], "doc_id long, quality int")
    taught = []
    monkeypatch.setattr(quality, "train", taught.extend)
    quality.fitted(docs, labels)
    assert all(zlib.crc32(n) % quality.FOLDS != quality.HELD_OUT for n in (b"0", b"1"))
    assert len(taught) == 3


def test_long_words_are_not_remembered():
    scorer = quality.Scorer(np.ones(quality.BUCKETS, dtype=np.float32))
    scorer(["short " + "y" * 3_000_000 + " short", "y" * (quality.LONGEST + 1)])
    assert set(scorer.words) == {"short"}
