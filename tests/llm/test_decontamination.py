import random
import re
from collections import Counter

import numpy as np

from pressmill.llm import decontamination as dc


def words_of(text):
    return [w.encode() for w in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").casefold())]


def by_hand(docs, items):
    """Best similarity of every document and item over all windows of the item's size."""
    found = {}
    for d, (doc_id, text) in enumerate(docs):
        words = words_of(text)
        for item_id, item in items:
            own = words_of(item)
            size = min(5, len(own))
            if not own:
                continue
            target = Counter(tuple(own[i : i + size]) for i in range(len(own) - size + 1))
            for start in range(max(0, len(words) - len(own)) + 1):
                window = words[start : start + len(own)]
                bag = Counter(tuple(window[i : i + size]) for i in range(len(window) - size + 1))
                shared = sum((bag & target).values())
                score = shared / (sum(bag.values()) + sum(target.values()) - shared)
                if score >= 0.8:
                    found[d, item_id] = max(score, found.get((d, item_id), 0))
    return Counter((docs[d][0], item, round(s, 9)) for (d, item), s in found.items())


def sample():
    rng = random.Random(6)
    word = lambda: rng.choice(["the", "of", "en", "straße", "été"]) if rng.random() < 0.3 else f"w{rng.randrange(500)}"
    items = [(n, " ".join(word() for _ in range(rng.randint(10, 45)))) for n in range(25)]
    items += [(90, "three little words"), (91, ""), (92, None), (93, "the the the the the the the the"), items[0]]
    docs = []
    for n in range(120):
        words = [word() for _ in range(rng.randint(0, 150))]
        for _ in range(n % 3):
            passage = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, 3)):
                place = rng.randrange(len(passage))
                passage[place : place + 1] = rng.choice([[word()], [], [passage[place], word()]])
            at = rng.randint(0, len(words))
            words[at:at] = passage
        text = rng.choice([" ", "\n", "!! "]).join(words)
        docs.append((n, text.upper() if n % 5 == 0 else text))
    for n, (_, item) in enumerate(items[:25]):
        # an item and nothing else, with its end or start cut off
        words, cut = item.split(), n % 3
        docs.append((300 + n, " ".join(words[cut:] if n % 2 else words[: len(words) - cut])))
    docs += [(500, None), (501, ""), (502, "x the " * 9000 + items[3][1]), (503, "THREE, little: words"), docs[7], docs[7], (None, items[1][1])]
    return docs, items


def test_matches_equal_brute_force(spark):
    docs, items = sample()
    given = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, similarity string")
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = Counter((r.doc_id, r.item_id, round(r.similarity, 9)) for r in dc.contaminated(given, benchmark).collect())
    short = [(i, t) for i, t in docs if i != 502]
    want = by_hand(short, items[:-1])
    assert {k: n for k, n in got.items() if k[0] != 502} == want and sum(want.values()) > 25
    assert (502, 3, 1.0) in got
    dirty = {d for d, _, _ in got}
    kept = dc.drop_contaminated(given, benchmark)
    assert kept.columns == given.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, _ in docs if i not in dirty), key=repr)
    assert dc.contaminated(given.limit(0), benchmark).collect() == []
    assert dc.contaminated(given, benchmark.limit(0)).collect() == []
    assert dc.drop_contaminated(given, benchmark.limit(0)).count() == len(docs)


def test_groups_of_items(spark):
    benchmark = spark.createDataFrame([(n, "x" * 40) for n in range(10)], "item_id long, text string")
    assert [len(g) for g in dc.item_groups(benchmark, 100)] == [2] * 5


def test_blocks_find_all_within_the_radius(monkeypatch):
    rng = np.random.default_rng(0)
    hashes = [rng.integers(0, 1 << 63, 30, dtype=np.int64).view(np.uint64) for _ in range(40)]
    sized = dc.Sized(34, 5, list(range(40)), [[b"w"] * 34] * 40, hashes)
    near = []
    for n in range(2000):
        value = int(sized.prints[n % 40])
        for bit in rng.choice(64, rng.integers(0, 40), replace=False).tolist():
            value ^= 1 << bit
        near.append(value)
    prints = np.array(near, dtype=np.uint64)
    distance = np.bitwise_count(prints[:, None] ^ sized.prints[None, :])
    want = sorted(zip(*[a.tolist() for a in np.nonzero(distance <= dc.RADIUS)], strict=True))
    for together in (1 << 20, 97):
        monkeypatch.setattr(dc, "PAIRS_TOGETHER", together)
        got = []
        for window, item, apart in sized.candidates(prints):
            got += zip(window.tolist(), item.tolist(), strict=True)
            assert (distance[window, item] == apart).all()
        assert sorted(got) == want


def test_a_long_item_without_its_ends_is_found(spark):
    words = [f"w{n}" for n in range(50)]
    cuts = {1: words[:-1], 2: words[1:], 3: words[4:-4], 4: words[6:-6], 5: words[:4], 6: ["other", *words[:-1]]}
    docs = spark.createDataFrame([(n, " ".join(one)) for n, one in cuts.items()], "doc_id long, text string")
    benchmark = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: (round(r.similarity, 6), r.first_word, r.n_words) for r in dc.contaminated(docs, benchmark).collect()}
    assert got == {1: (round(45 / 46, 6), 0, 49), 2: (round(45 / 46, 6), 0, 49), 3: (round(38 / 46, 6), 0, 42), 6: (round(45 / 47, 6), 0, 50)}
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, benchmark).collect()) == [4, 5]


def test_several_groups_give_the_same(spark):
    docs, items = sample()
    given = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, digest string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = [Counter(tuple(r) for r in dc.contaminated(given, benchmark, size).collect()) for size in (1 << 20, 600)]
    assert whole == parts and len(list(dc.item_groups(benchmark, 600))) > 5
    kept, left = [Counter(tuple(r) for r in dc.drop_contaminated(given, benchmark, size).collect()) for size in (1 << 20, 600)]
    assert kept == left and 0 < kept.total() < len(docs)
