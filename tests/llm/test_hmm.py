import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np

from pressmill.llm import hmm


def tiny(states=3, classes=4, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda a, axis: a / a.sum(axis=axis, keepdims=True)
    return hmm.Hmm(norm(rng.random(states), 0), norm(rng.random(states), 0), norm(rng.random((states, states)), 1), norm(rng.random((classes, states)), 0))


def paths(model, run, start):
    """Probability of every path of states along with a run."""
    for path in product(range(len(start)), repeat=len(run)):
        p = start[path[0]] * model.emits[run[0], path[0]]
        for a, b, symbol in zip(path, path[1:], run[1:], strict=False):
            p *= model.moves[a, b] * model.emits[symbol, b]
        yield path, p


def test_forward_and_counts_equal_all_paths():
    model, rng = tiny(), random.Random(1)
    runs = [np.array([rng.randrange(4) for _ in range(n)]) for n in (1, 4, 2, 5, 4)]
    got = hmm.log_likelihoods(model, runs)
    for run, value in zip(runs, got, strict=True):
        assert abs(value - math.log(sum(p for _, p in paths(model, run, model.start)))) < 1e-9
    first = np.array([True, False, True, True, False])
    want = np.zeros((1 + 3 + 4, 3))
    for run, opens in zip(runs, first, strict=True):
        found = list(paths(model, run, model.start if opens else model.later))
        total = sum(p for _, p in found)
        for path, p in found:
            want[0, path[0]] += p / total * opens
            for a, b in zip(path, path[1:], strict=False):
                want[1 + a, b] += p / total
            for state, symbol in zip(path, run, strict=True):
                want[4 + symbol, state] += p / total
    assert np.allclose(hmm.expected_counts(model, runs, first), want)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(3)
    runs = [rng.choice(4, 60, p=[0.7, 0.2, 0.1, 0] if n % 2 else [0, 0.1, 0.3, 0.6]) for n in range(30)]
    model, shares, seen = tiny(2), np.full(4, 1e-9), []
    for _ in range(12):
        seen.append(hmm.log_likelihoods(model, runs).sum())
        model = hmm.Hmm.from_counts(hmm.summed_counts(model, runs), shares)
    assert all(b > a - 0.5 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0] + 100


def rows():
    rng = random.Random(4)
    tongues = [[f"{end}{n}{end}" for n in range(150)] for end in ("tion", "heit")]
    made = [(n, " ".join(rng.choices(tongues[n % 2], k=rng.randint(1, 200)))) for n in range(160)]
    return made + [(500, None), (501, ""), (502, "NEVER seen Words"), (503, "tion1tion " * 20000), (None, "no id"), made[4], made[4], (504, "Ä ä É")]


def test_documents(spark):
    given = rows()
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in given], "doc_id long, text string, score double, word string")
    got = hmm.scored_documents(docs).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tokens = lambda t: [*(t or "").encode().lower().split(), None]
    counts = Counter(token for i, t in given if not held(i) for token in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (repr(i), held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 4))
        for i, t in given
    )
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    ordinary = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 500]
    assert sum(r.score for r in ordinary) > sum(r.base_score for r in ordinary) and len(ordinary) > 5
    same = {r.score for r in got if r.doc_id == 4}
    assert max(same) - min(same) < 1e-9
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert hmm.scored_documents(docs.limit(0)).collect() == []


def test_words_of_a_class_sum_to_one():
    counts = {b"xtion": 5, b"ytion": 2}
    tokens, words = np.zeros(hmm.CLASSES, dtype=np.int64), np.zeros(hmm.CLASSES, dtype=np.int64)
    number = hmm.shared_class(b"xtion")
    tokens[number], words[number] = 7, 2
    logs = hmm.Vocabulary(1, 8, 3, {}, tokens, words).class_logs()
    known = sum(10 ** (math.log10(c + 1) - logs[number]) for c in counts.values())
    assert abs(known + 10 ** (0 - logs[number]) - 1) < 1e-12


def test_frequent_words_are_bounded_and_whole_steps(spark):
    rng = random.Random(8)
    rows = [(f"w{n}".encode(), int(rng.paretovariate(0.6))) for n in range(3000)]
    counts = spark.createDataFrame(rows, "word binary, count long")
    for most in (0, 1, 50, 700, 10**6):
        got = [r["count"] for r in hmm.frequent_words(counts, most).collect()]
        rest = sorted(c for _, c in rows)[: len(rows) - len(got)]
        assert len(got) <= most and (not rest or not got or max(rest) < min(got))
    assert hmm.frequent_words(counts.limit(0)).collect() == []


def test_many_words_of_one_count_give_the_first_of_them(spark):
    counts = spark.createDataFrame([(f"w{n:04d}".encode(), 7) for n in range(500)], "word binary, count long")
    assert sorted(bytes(r["word"]) for r in hmm.frequent_words(counts, 30).collect()) == [f"w{n:04d}".encode() for n in range(30)]


def test_states_start_from_classes_of_the_same_documents(spark):
    rng = np.random.default_rng(2)
    runs = [rng.integers(n % 4 * 50, n % 4 * 50 + 50, rng.integers(1, 300)).astype("<u2") for n in range(200)]
    shares = (np.bincount(np.concatenate(runs), minlength=hmm.CLASSES) + 1) / (sum(map(len, runs)) + hmm.CLASSES)
    coded = spark.createDataFrame([(one.tobytes(),) for one in runs], "classes binary").repartition(5)
    model = hmm.started(coded, shares)
    favoured = np.argmax(model.emits[:200] / hmm.Hmm.fresh(shares).emits[:200], axis=1).reshape(4, 50)
    kinds = [set(row) for row in favoured.tolist()]
    # more states than kinds of documents: a kind may have several states, but no state has two kinds
    assert len(set().union(*kinds)) == sum(map(len, kinds)) <= hmm.STATES
    assert np.allclose(model.emits.sum(axis=0), 1)


def test_profiles_equal_sums_by_hand():
    rng = np.random.default_rng(4)
    signs = rng.choice([-1.0, 1.0], (6, 3))
    runs = [rng.integers(0, 6, n) for n in (1, 5, 9)]
    want = np.zeros((6, 3))
    for run in runs:
        for one in run:
            want[one] += signs[run].mean(axis=0)
    assert np.allclose(hmm.profile_sums(runs, signs), want)
