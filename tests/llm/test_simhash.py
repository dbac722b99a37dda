import random
import re

import xxhash
from pyspark.sql import functions as F

from pressmill.llm import simhash
from pressmill.llm.components import connected_components


def by_hand(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_by_hand(rows, alike=lambda i, j: False):
    """Component id per row, comparing all pairs."""
    prints = [by_hand(text) for _, text in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 2 or alike(i, j):
                parent[root(i)] = root(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [d for j, (d, _) in enumerate(rows) if root(j) == root(i) and d is not None]
        out.append((doc_id, f"{prints[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=repr)


def wider_groups_by_hand(rows):
    """The same with texts joined whose five-word shingles are 0.8 or more alike."""
    bags = []
    for _, text in rows:
        words = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", (text or "").casefold())
        bags.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set()))

    def alike(i, j):
        few, many = sorted((len(bags[i]), len(bags[j])))
        return few >= 0.8 * many > 0 and len(bags[i] & bags[j]) >= 0.8 * len(bags[i] | bags[j])

    return groups_by_hand(rows, alike)


def texts():
    rng = random.Random(3)
    words = [f"w{n}" for n in range(300)]
    rows = []
    for n in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        rows.append((2 * n, " ".join(base)))
        for copy in range(n % 4):
            changed = list(base)
            changed[rng.randrange(len(changed))] = rng.choice(words)
            rows.append((1000 + 10 * n + copy, "\t".join(changed).upper()))
    rows += [(5000, ""), (5001, None), (5002, " \n"), (5003, "One"), (5004, "ONE two"), (5005, "één two drie vier"), (5006, "lone " * 8000)]
    return rows + [rows[0], (None, rows[0][1]), (None, "nobody else has this text here")]


def test_groups_equal_all_pairs(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
    for crowd in (128, 1):
        got = [tuple(r) for r in simhash.near_duplicates(docs, crowd=crowd).select("doc_id", "fingerprint", "component_id").collect()]
        assert sorted(got, key=repr) == groups_by_hand(rows)


def test_dense_crowd(spark):
    """Fingerprints in a chain and a ball: the crowded way gives the same components."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    prints = {base ^ (1 << a) ^ (1 << b) for a in range(20) for b in range(20)} | {rng.getrandbits(64) for _ in range(200)}
    chain = rng.getrandbits(64)
    for bit in range(0, 60, 2):
        chain ^= 3 << bit
        prints.add(chain)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    df = spark.createDataFrame(signed, "fingerprint long")
    parts = []
    for crowd in (2, 10**6):
        parts.append({tuple(r) for r in connected_components(simhash.links(df, crowd)).collect()})
    assert parts[0] == parts[1]
    by = {}
    for node, component in parts[0]:
        by.setdefault(component, set()).add(node)
    assert sorted(map(len, by.values()))[-2:] == [30, 191]


def test_one_of_each_group_stays(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, digest long")
    kept = [tuple(r) for r in simhash.drop_near_duplicates(docs).collect()]
    firsts = {c for _, _, c in wider_groups_by_hand(rows)}
    assert len(kept) == len(set(kept))
    assert {d for d, _, _ in kept} == firsts
    assert simhash.drop_near_duplicates(docs.limit(0)).collect() == []
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 99), (99, 100), (7, 7), (None, 3), (50, 60), (60, 55)]
    got = dict(connected_components(spark.createDataFrame(edges, "x long, y long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 99: 99, 100: 99, 50: 50, 60: 50, 55: 50}
