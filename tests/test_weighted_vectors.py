"""Weighted sparse vectors against plain counting, and loads against a refit."""

import math
from collections import Counter

from pyspark.sql import functions as F

from pressmill.functions.vectors import bucket
from pressmill.operators import weighted_vectors as w

DOCS = [("a", "red red fish"), ("b", "blue fish"), ("c", "one Fish two fish"), ("d", ""), ("e", None), (None, "fish alone"), ("f", "red"), ("f", "blue red")]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(k, t, 1) for k, t in rows], "name string, text string, place int")


def places(spark, words, buckets):
    rows = spark.createDataFrame([(word,) for word in words], "word string")
    return {r.word: r.at for r in rows.select("word", bucket(F.col("word"), buckets).alias("at")).collect()}


def expected(rows, at, total):
    counts = {}
    for key, text in rows:
        if key is not None:
            counts.setdefault(key, Counter()).update(at[word] for word in (text or "").lower().split())
    held = Counter(place for one in counts.values() for place in one)
    out = {}
    for key, one in counts.items():
        vector = {place: n * math.log((total + 1) / (held[place] + 1)) for place, n in one.items() if total != held[place]}
        length = math.sqrt(sum(v * v for v in vector.values()))
        if length:
            out[key] = {place: round(v / length, 9) for place, v in vector.items()}
    return out


def shown(vectors, key="name"):
    return {r[key]: {p: round(v, 9) for p, v in zip(r.places, r.weights, strict=True)} for r in vectors.collect()}


def test_weights(spark):
    for buckets in (1 << 18, 3):
        docs = frame(spark)
        counts = w.document_counts(docs, w.term_counts(docs, "name", buckets=buckets), "name")
        at = places(spark, ["red", "fish", "blue", "one", "two", "alone"], buckets)
        made = w.embed_weighted(docs, counts, "name", buckets=buckets)
        assert shown(made) == expected(DOCS, at, 6)
        assert all(r.places == sorted(r.places) for r in made.collect())


def test_a_second_load_equals_a_refit(spark, tmp_path):
    docs, path = frame(spark), str(tmp_path / "counts")
    early = F.col("name").isin("a", "b")
    for load, part in (("1", early), ("2", ~early), ("2", ~early)):
        rows = docs.filter(part)
        w.save_counts(w.document_counts(rows, w.term_counts(rows, "name"), "name"), path, load)
    refit = w.document_counts(docs, w.term_counts(docs, "name"), "name")
    assert Counter(map(tuple, w.read_counts(spark, path).collect())) == Counter(map(tuple, refit.collect()))
    assert shown(w.embed_weighted(docs, w.read_counts(spark, path), "name")) == shown(w.embed_weighted(docs, refit, "name"))


def test_new_words_weigh_most_and_no_counts_none(spark, tmp_path):
    docs = frame(spark)
    counts = w.document_counts(docs, w.term_counts(docs, "name"), "name")
    fresh = frame(spark, [("z", "fish unheard")])
    at = places(spark, ["fish", "unheard"], w.BUCKETS)
    got = shown(w.embed_weighted(fresh, counts, "name"))["z"]
    fish, new = math.log(7 / 4), math.log(7)
    length = math.hypot(fish, new)
    assert got == {at["fish"]: round(fish / length, 9), at["unheard"]: round(new / length, 9)}
    assert w.embed_weighted(docs, w.read_counts(spark, str(tmp_path / "none")), "name").collect() == []
    assert w.embed_weighted(docs.limit(0), counts, "name").collect() == []
