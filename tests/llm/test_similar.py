import random
import re

from pressmill.llm import similar, simhash


def bag(text):
    words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").casefold())
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def sample():
    """Bases, copies with some changed words, and texts that share a third with them."""
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for n in range(25):
        base = [word() for _ in range(rng.randint(60, 300))]
        rows.append(base)
        for changes in (1, len(base) // 60, len(base) // 50, len(base) // 12):
            copy = list(base)
            for place in rng.sample(range(len(base)), changes):
                copy[place] = word()
            rows.append(copy)
        rows.append(base[: len(base) // 3] + [word() for _ in range(150)])
    return [(n, " ".join(words)) for n, words in enumerate(rows)] + [(900, ""), (901, None), (902, "two words"), (903, "Two, words!")]


def test_links_are_the_alike_pairs(spark):
    rows = sample()
    texts = spark.createDataFrame(rows, "node long, text string")
    got = {tuple(r) for r in similar.similar_links(texts).collect()}
    bags = {n: bag(t) for n, t in rows}
    want = {
        (a, b)
        for a in bags
        for b in bags
        if a < b and bags[a] and bags[b] and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])
    }
    assert got <= want and (902, 903) in got
    assert len(got) > 0.8 * len(want) > 40


def test_copies_go_and_others_stay(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    bags = {n: bag(t) for n, t in rows}
    like = lambda a, b: bags[a] and bags[b] and len(bags[a] & bags[b]) >= 0.8 * len(bags[a] | bags[b])
    left = [(a, b) for a in kept for b in kept if a < b and like(a, b)]
    assert len(left) <= 1
    assert all(n in kept for n in bags if not any(like(n, other) for other in bags if other != n) and n not in (900, 901))
    assert similar.similar_links(spark.createDataFrame([], "node long, text string")).collect() == []


def changed(rng, words, share):
    """A copy with as many scattered words changed as lower the similarity to about ``share``."""
    gone = round(len(words) * (1 - share) / (1 + share))
    copy = list(words)
    for place in rng.sample(range(0, len(words), 6), max(1, round(gone / 5))):
        copy[place] = f"new{rng.randrange(10**9)}"
    return copy


def pairs_by_hand(rows):
    import numpy as np

    bags = [bag(text) for _, text in rows]
    number = {one: n for n, one in enumerate({one for held in bags for one in held})}
    held = np.zeros((len(bags), len(number)), dtype=np.float32)
    for n, one in enumerate(bags):
        held[n, [number[key] for key in one]] = 1
    shared = (held @ held.T).astype(np.float64)
    sizes = held.sum(axis=1, dtype=np.float64)
    alike = shared >= 0.8 * (sizes[:, None] + sizes[None, :] - shared)
    return {tuple(sorted((rows[a][0], rows[b][0]))) for a, b in np.argwhere(alike).tolist() if a < b}


def components_of(nodes, pairs):
    at = {n: n for n in nodes}

    def top(n):
        while at[n] != n:
            n = at[n]
        return n

    for a, b in pairs:
        low, high = sorted((top(a), top(b)))
        at[high] = low
    return {n: top(n) for n in nodes}


def groups_match(spark, rows):
    got = {tuple(r) for r in similar.similar_links(spark.createDataFrame(rows, "node long, text string")).collect()}
    want = pairs_by_hand(rows)
    assert got <= want
    keys = {n: set(similar.band_keys(next(iter(similar.shingle_sets([text]))))) for n, text in rows}
    want = {(a, b) for a, b in want if keys[a] & keys[b]}
    nodes = [n for n, _ in rows]
    found = components_of(nodes, want)
    assert components_of(nodes, got) == found
    return len(set(found.values()))


def test_a_base_ties_all_its_copies(spark):
    rng = random.Random(4)
    base = [f"w{n}" for n in range(300)]
    texts = [base] + [changed(rng, base, 0.85) for _ in range(1000)]
    nodes = rng.sample(range(10**6), len(texts))
    # one copy shares none of the twelve keys, as one of some thousands does
    assert groups_match(spark, [(n, " ".join(words)) for n, words in zip(nodes, texts, strict=True)]) <= 2


def test_pairs_in_a_crowd_of_unlike_texts(spark):
    rng = random.Random(5)
    base = [f"w{n}" for n in range(300)]
    texts = []
    for _ in range(60):
        own = changed(rng, base, 0.75)
        texts += [own, changed(rng, own, 0.88), changed(rng, own, 0.88)]
    nodes = rng.sample(range(10**6), len(texts))
    assert 30 < groups_match(spark, [(n, " ".join(words)) for n, words in zip(nodes, texts, strict=True)]) < 100
