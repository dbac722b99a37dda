import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from pressmill.llm import weighted_sampling as ws


def similarity(left, right):
    """Generalised Jaccard similarity of word counts."""
    a, b = (Counter(t.lower().split() or [""]) for t in (left, right))
    return sum((a & b).values()) / sum((a | b).values())


def rows():
    rng = random.Random(2)
    words = [f"w{int(2000 * rng.random() ** 3)}" for _ in range(4000)]
    made = [(n, " ".join(rng.choices(words, k=rng.randint(1, 300)))) for n in range(80)]
    made += [(100, ""), (101, None), (102, "é" * 7), (103, "Ärger über Œuvre und mehr 🙂 davon"), (104, "many " * 20000), (105, "  \t\n")]
    return made + [made[3], made[3], (3, "another text of the same id"), (None, "no id at all"), (None, None)]


def test_pairs(spark):
    given = rows()
    docs = spark.createDataFrame(given, "doc_id long, text string").withColumn("part", F.lit(1)).withColumn("digest", F.lit(2))
    got = ws.fingerprint_pairs(docs).collect()
    assert len(got) == len(given)
    distinct = {(d, t or "") for d, t in given}
    digests = dict(spark.createDataFrame([(t,) for _, t in distinct], "t string").select("t", F.xxhash64("t")).collect())
    order = sorted(distinct, key=lambda r: (r[0] is None, -(r[0] or 0), digests[r[1]]))
    expected = {}
    for n, (doc_id, text) in enumerate(order):
        following = order[(n + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        expected[doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()] = (text, edited, following)
    gaps, by_text = [], {}
    for row in got:
        text, edited, following = expected[row.doc_id, row.n_chars, row.edited_sha256]
        assert len(row.fingerprint) == len(row.edited_fingerprint) == ws.SAMPLES * ws.HEX_DIGITS
        gaps += [row.near_edited - similarity(text, edited), row.near_next - similarity(text, following)]
        for one, mark in ((text, row.fingerprint), (edited, row.edited_fingerprint)):
            by_text.setdefault(" ".join(one.lower().split()), set()).add(mark)
    assert all(len(marks) == 1 for marks in by_text.values())
    assert abs(sum(gaps) / len(gaps)) < 0.03  # the texts share their few words, and so their draws
    assert (sum(g * g for g in gaps) / len(gaps)) ** 0.5 < 0.07


def test_collision_rate_is_the_similarity(spark):
    """With many samples the share of equal positions settles at the generalised Jaccard similarity."""
    texts = ["a a a a b b c d e", "a b b b c c f g", "a a a a b b c d x"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    marks = dict(ws.signatures(df, ["n"], samples=4096).collect())
    for i in range(3):
        for j in range(i):
            equal = sum(marks[i][2 * k : 2 * k + 2] == marks[j][2 * k : 2 * k + 2] for k in range(4096)) / 4096
            assert abs(equal - similarity(texts[i], texts[j])) < 0.03


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "only one text")], "doc_id long, text string")
    one = ws.fingerprint_pairs(docs).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)]
    assert ws.fingerprint_pairs(docs.limit(0)).collect() == []


def test_copies_stay_one_row_until_the_end(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 1000 + [(2, "b c d")] * 700 + [(3, None)] * 2, "doc_id long, text string")
    pairs, near = ws.edited_pairs(docs)
    assert (pairs.count(), near.count()) == (3, 3)
    got = ws.fingerprint_pairs(docs).groupBy("doc_id", "edited_sha256").count().collect()
    assert sorted((r.doc_id, r["count"]) for r in got) == [(1, 1000), (2, 700), (3, 2)]
    edits = {1: "a b", 2: "b ca ", 3: ""}
    assert {r.doc_id: r.edited_sha256 for r in got} == {n: hashlib.sha256(text.encode()).hexdigest() for n, text in edits.items()}


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    plan = ws.signatures(docs, ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
