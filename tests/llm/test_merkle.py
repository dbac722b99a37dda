"""The manifest against one built by plain recursion over sorted rows."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from pressmill.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """Root, and for each node the pairs of siblings before and after it, lowest first."""
    paths = [[] for _ in nodes]
    of = list(range(len(nodes)))
    while len(nodes) > 1:
        for n, at in enumerate(of):
            start = at // 3 * 3
            paths[n].append(("".join(nodes[start:at]), "".join(nodes[at + 1 : start + 3])))
        of = [at // 3 for at in of]
        nodes = [h("".join(nodes[at : at + 3])) for at in range(0, len(nodes), 3)]
    return nodes[0], paths


def expected(rows):
    sources = sorted({row[1] for row in rows}, key=lambda s: (s is not None, (s or "").encode()))
    kept = {s: sorted((row for row in rows if row[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    subs = {s: tree([leaf(row) for row in kept[s]]) for s in sources}
    root, tops = tree([subs[s][0] for s in sources])
    out = []
    for s, top in zip(sources, tops, strict=True):
        for row, path in zip(kept[s], subs[s][1], strict=True):
            path = path + top
            changed = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                changed = (*row[:4], row[4].replace("\n", ""))
            fold = leaf(changed)
            for left, right in path:
                fold = h(left + fold + right)
            out.append((row[0], leaf(row), subs[s][0], root, h("".join(left + right for left, right in path)), fold, fold == root))
    return out


SHAPE = "doc_id long, source string, lang string, n_chars long, text string, at int, src string"


def check(spark, rows, parts=3, levels=merkle.LEVELS):
    docs = spark.createDataFrame([(*row, 1, "x") for row in rows], SHAPE).repartition(parts)
    got = merkle.verified_documents(docs, levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert Counter(map(tuple, got.collect())) == Counter(expected(rows))


def random_rows(count, rng):
    ids = rng.sample(range(-5000, 60000), count)
    source = lambda: rng.choice(["web", "web", "web", "books", "é", "z", None])
    return [(n, source(), rng.choice(["en", None]), rng.choice([1, 22, None]), rng.choice(["a\nb", "é", "", None, f"t{n}\n"])) for n in ids]


def test_many_sources_and_empty_fields(spark):
    check(spark, random_rows(500, random.Random(1)))
    check(spark, [(n, f"s{n}", "en", 1, "x\n") for n in range(40)])


@pytest.mark.parametrize("levels", [1, 3])
def test_several_rounds_of_blocks(spark, levels):
    """Blocks of 3 or 27 slots, so that trees take several rounds up and down."""
    rng = random.Random(levels)
    check(spark, random_rows(100, rng) + [(10**12 + n, f"s{n}", "de", 2, "a\nb") for n in range(15)], levels=levels)


def test_repeated_ids_and_rows(spark):
    rng = random.Random(3)
    rows = random_rows(60, rng)
    rows += [(None, "web", "en", n % 7, f"n{n}") for n in range(30)] + [(None, None, None, None, None)] * 2
    rows += [(77, "web", "en", 1, f"same id {n % 11}\n") for n in range(90)] + [(78, "web", "en", 1, "b")] + [(64, "web", "en", 1, "b")] * 25
    check(spark, rows, 5)


def test_small_tables(spark):
    check(spark, [(5, "a", "en", 1, "only\n")])
    check(spark, [(5, "a", "en", 1, "x"), (5, "a", "en", 1, "x"), (6, "b", "en", 1, "long " * 100000)])
    docs = spark.createDataFrame([], SHAPE)
    assert merkle.verified_documents(docs).collect() == []


def test_running_sums_over_ranges(spark):
    rows = [("hot", n, 1 + n % 3) for n in range(300)] + [(f"g{n}", n, 2) for n in range(20)]
    df = spark.createDataFrame(rows, "g string, n long, v long").repartition(4)
    got = {(r.g, r.n): r.before for r in merkle.running(df, "g", ["n"], df["v"], "before").collect()}
    assert got == {(g, n): sum(v for other, m, v in rows if other == g and m < n) for g, n, _ in rows}
